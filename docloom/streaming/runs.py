"""Streams run to their end, and windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_dir, table


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A driver table as a stream of its files; ``ts`` becomes a time of the session's zone."""
    raw = spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may be a file
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has given when all there is now has been read.

    State and progress lie in the shared folder, so a lost driver goes on where it was. Each
    batch writes a folder of its own, replacing it if it runs again. In append mode the result
    is all batches' rows, in complete mode those of the last batch, and in update mode the
    latest row of each of ``keys``.
    """
    spark, at = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/rows/n={batch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    schema = stream.withColumn("batch", F.lit(0)).schema
    empty = spark.createDataFrame([], schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(schema).parquet(f"{at}/rows/*") if there else empty
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("last")  # one row
    elif mode == "update":
        others = [c for c in stream.columns if c not in keys]
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x"))
        return latest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in others])
    return rows.drop("batch")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of events in windows of a width; rows later than ``late`` behind the newest are left out."""
    w = F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of each user's sessions: a pause of ``gap`` ends one."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n")
