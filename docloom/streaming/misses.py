"""The log of failed searches: detection, the hourly limit in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.text import normal_query, query_hash

THRESHOLD = 0.025
HOUR = 3600
KEYS = ["query_hash", "error_type", "source_type_filter"]


def detected(outcomes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Misses of search outcomes (query, mode, n_results, top_score, top_chunk_id, source_type_filter, ts).

    A search without results misses; a hybrid one with a low top score does, too.
    """
    kind = F.when(F.col("n_results") == 0, "no_results").when((F.col("mode") == "hybrid") & (F.col("top_score") < threshold), "low_confidence")
    found = outcomes.withColumn("error_type", kind).where("error_type is not null")
    some = lambda c: F.when(F.col("error_type") == "low_confidence", F.col(c)).alias(c)
    return found.select(normal_query("query").alias("query"), query_hash("query").alias("query_hash"), some("top_score"), some("top_chunk_id"), "error_type", "source_type_filter", F.col("ts").alias("detected_at"))


def hourly(events: DataFrame, keys: list[str], at: str = "detected_at") -> DataFrame:
    """The first event of each key in any hour: a kept event silences its key for an hour.

    Which events are kept depends on those kept before, so times are folded in order. An
    event an hour or more after the one before it is always kept, so a key's times are cut
    there and each piece is folded by itself.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    step = HOUR * 1_000_000
    order = Window.partitionBy(*keys).orderBy("us")
    cut = F.coalesce((F.col("us") - F.lag("us").over(order) >= step).cast("int"), F.lit(1))
    pieces = events.select(*keys, seconds.alias("us")).distinct().withColumn("cut", cut).withColumn("piece", F.sum("cut").over(order))
    times = pieces.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list("us")).alias("t"))
    kept = F.aggregate("t", F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) >= step), F.concat(a, F.array(x))).otherwise(a))
    return times.select(*keys, F.explode(kept).alias("us")).select(*keys, F.timestamp_micros("us").alias(at))


def hourly_stream(events: DataFrame, at: str = "detected_at", late: str = "10 minutes") -> DataFrame:
    """The hourly limit as a stream: the state of a key is the time it was last kept, and ends an hour after.

    ``events`` is a stream with query_hash, error_type, source_type_filter (null as empty) and ``at``.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for part in parts for t in part[at].astype("int64").tolist())
        unit, kept = 1_000_000_000, []
        for t in times:
            if last is None or t - last >= HOUR * unit:
                last = t
                kept.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1_000_000 + HOUR * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, pd.Timestamp(t, unit="ns", tz="UTC").tz_localize(None)) for t in kept], columns=[*KEYS, at])

    named = events.withColumn("source_type_filter", F.coalesce("source_type_filter", F.lit(""))).select(*KEYS, F.col(at).cast("timestamp").alias(at))
    out = f"query_hash string, error_type string, source_type_filter string, {at} timestamp"
    return named.withWatermark(at, late).groupBy(*KEYS).applyInPandasWithState(fold, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_hour(events: DataFrame, at: str = "detected_at", late: str = "10 minutes") -> DataFrame:
    """Misses by hour and type, for late data up to ``late``."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), "error_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "error_type", "n")
