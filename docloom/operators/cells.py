"""Exact nearest vectors by cells around pivots.

``MetricIndex.of`` takes some vectors as pivots, puts every vector into the cell of its nearest
pivot and keeps its distance from it. A cell is dealt into parts of about ``PART`` rows, each
with the least and greatest distance of its vectors, so copies and dense regions are spread.
Parts are cut by distance from the pivot, which makes rings around it.

A search measures each query against the pivots. By the triangle inequality no vector of a
part is nearer than ``max(0, d - high, low - d)`` with d the query's distance from the pivot.

1. The parts with the smallest bounds that hold k vectors together are visited first; the k-th
   distance found there can only shrink.
2. All other parts whose bound is at most that distance are visited, with it as the limit: a
   vector whose own distance from the pivot rules it out is not measured.

Any number of queries goes through one plan: (query, part) rows meet the vectors of the part,
and what leaves a part is at most k rows for a query. Results, ties and rounding are those of
measuring every vector. The pivots are a sample bounded by ``MOST_PIVOTS``; it steers the work,
never the result.

Cosine distances are measured on unit vectors, whose Euclidean order is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import normalised
from docloom.operators.lexical import top
from docloom.session import written

MOST_PIVOTS, PART = 2048, 2048
#: What rounding may add to a computed distance or take from it.
SLACK = 1e-7
#: Queries that meet a part in one task at once.
QUERIES = 1024


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows by one matrix product; near zero they are rough."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def measured(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of one vector from rows, component by component."""
    return np.sqrt(((v - q) ** 2).sum(1))


@dataclass
class MetricIndex:
    """vectors (part, key, embedding, away), parts (part, pivot, n, low, high) and pivots (pivot, embedding).

    ``away`` is the distance from the cell's pivot, ``low`` and ``high`` are its limits in a part.
    """

    vectors: DataFrame
    parts: DataFrame
    pivots: DataFrame
    key: str
    metric: str = "l2"

    @classmethod
    def of(cls, vectors: DataFrame, key: str, metric: str = "l2", pivots: int | None = None, part: int = PART) -> MetricIndex:
        """An index of (key, embedding), written to the shared folder; null vectors (and zero ones for cosine) are left out."""
        spark, unit = vectors.sparkSession, metric == "cosine"
        shaped = normalised("embedding") if unit else F.transform("embedding", lambda x: x.cast("double"))
        rows = written(vectors.select(key, shaped.alias("embedding")).where("embedding is not null"), "vectors")
        count = rows.count()
        n = min(MOST_PIVOTS, max(1, int(count**0.5))) if pivots is None else pivots
        # the same rows every time: those whose vectors' hashes are smallest, equal vectors once
        chosen = rows.groupBy(F.xxhash64("embedding").alias("h")).agg(F.first("embedding").alias("embedding")).orderBy("h").limit(n)
        points = [r.embedding for r in chosen.collect()] or [[0.0]]  # n vectors
        table = np.array(points, np.float64)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(matrix(batch.column(1)), table)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], [key, "embedding", "pivot", "away"])

        kind = rows.schema[key].dataType.simpleString()
        cells = written(rows.mapInArrow(placed, f"{key} {kind}, embedding array<double>, pivot int, away double"), "cells")
        # a cell is cut into rings at quantiles of the distance, and a ring that stays large by a hash
        sizes = cells.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("away", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
        rings = F.least(F.ceil(F.col("n") / part).cast("int"), F.lit(64))
        step = sizes.select("pivot", F.when(rings > 1, F.filter("cuts", lambda x, i: F.pmod(i + 1, F.greatest(F.lit(1), F.ceil(64 / rings).cast("int"))) == 0)).otherwise(F.array().cast("array<double>")).alias("cuts"))
        ringed = cells.join(F.broadcast(step), "pivot")  # a row for each pivot
        ringed = ringed.withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away"))))
        ring_sizes = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / part).cast("int").alias("deal"))
        dealt = ringed.join(F.broadcast(ring_sizes), ["pivot", "ring"])  # at most 64 rows for each pivot
        name = (F.col("pivot").cast("long") * 64 + F.col("ring")) * (1 << 20) + F.pmod(F.xxhash64(key), F.col("deal"))
        parted = written(dealt.select(name.alias("part"), "pivot", key, "embedding", "away").repartition("part").sortWithinPartitions("part"), "parts")
        parts = written(parted.groupBy("part", "pivot").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")), "bounds")
        return cls(parted.drop("pivot"), parts, spark.createDataFrame(pd.DataFrame({"pivot": range(len(points)), "embedding": points}), "pivot int, embedding array<double>"), key, metric)

    def near_cells(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, part, n, d, bound) of parts for queries (q, qvec, most).

        With a limit these are all parts that may hold a vector within it, without one the
        parts of the nearest cells that hold ``k`` vectors together.
        """
        cells = self.parts.groupBy("pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        known = cells.join(self.pivots, "pivot").collect()  # MOST_PIVOTS rows
        table = np.array([r.embedding for r in known] or [[0.0]], np.float64)[: len(known)]
        names, n, low, high = (np.array([r[c] for r in known]) for c in ("pivot", "n", "low", "high"))

        def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows if known else 0, 256):
                    some = batch.slice(at, 256)
                    d = distances(matrix(some.column(1)), table)
                    bound = np.maximum(np.maximum(d - high, low - d), 0) - SLACK
                    most = some.column(2).to_numpy(zero_copy_only=False)
                    order = np.lexsort((d, bound), axis=1)
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(d.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    i, j = np.nonzero(np.where(np.isnan(most)[:, None], first, bound <= most[:, None] + SLACK))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), pa.array(names[j], pa.int32()), pa.array(d[i, j])], ["q", "pivot", "d"])

        each = queries.select("q", "qvec", F.coalesce("most", F.lit(float("nan"))).alias("most")).mapInArrow(away, "q long, pivot int, d double")
        least = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d")) - SLACK
        return each.join(self.parts, "pivot").select("q", "part", "n", "d", least.alias("bound"))

    def _visited(self, asked: DataFrame, k: int, blocks: int) -> DataFrame:
        """(q, key, distance, read) of the best k of each part for (q, part, qvec, d, most): each part meets its queries, in ``blocks`` of them."""
        key, kind = self.key, self.vectors.schema[self.key].dataType.simpleString()
        blocked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        visits = blocked.select(F.col("part").alias("at"), F.col("block").alias("of")).distinct()
        held = self.vectors.join(visits, F.col("part") == F.col("at")).drop("part")
        met = blocked.groupBy("part", "block").cogroup(held.groupBy("at", "of"))
        return met.applyInArrow(_nearest(key, k), f"q long, {key} {kind}, distance double, read int")

    def nearest(self, queries: DataFrame, k: int, digits: int = 9, counted: bool = False) -> DataFrame:
        """(query_id, key, distance, rank): the exact k nearest vectors for queries (query_id, qvec) of any number.

        ``counted`` returns (query_id, read) instead: how many vectors were measured.
        """
        key = self.key
        shaped = normalised("qvec") if self.metric == "cosine" else F.transform("qvec", lambda x: x.cast("double"))
        rows = queries.select("query_id", shaped.alias("qvec"), F.monotonically_increasing_id().alias("q")).where("qvec is not null")
        rows = written(rows, "queries")
        blocks = max(1, -(-rows.count() // QUERIES))  # a vector is sent once for each
        order = Window.partitionBy("q").orderBy("bound", "part")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nearby = self.near_cells(rows.withColumn("most", F.lit(None).cast("double")), k)
        first = written(nearby.withColumn("before", before).where(F.col("before") < k).select("q", "part", "d"), "first")
        vectors = rows.select("q", "qvec")
        columns = ["q", "part", "qvec", "d", "most"]
        seeds = written(self._visited(first.withColumn("most", F.lit(float("inf"))).join(vectors, "q").select(columns), k, blocks), "seeds")
        ranked = seeds.where(f"{key} is not null").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("distance")))
        limits = ranked.where(F.col("r") == k).select("q", F.col("distance").alias("most"))
        limited = written(rows.join(limits, "q", "left").select("q", "qvec", F.coalesce("most", F.lit(float("inf"))).alias("most")), "limits")
        rest = self.near_cells(limited, k).join(first.select("q", "part"), ["q", "part"], "left_anti").join(limited, "q")
        later = written(self._visited(rest.where(F.col("bound") <= F.col("most") + SLACK).select(columns), k, blocks), "later")
        names = rows.select("q", "query_id")
        every = seeds.unionByName(later)
        if counted:
            return every.where(f"{key} is null").groupBy("q").agg(F.sum("read").alias("read")).join(names, "q").select("query_id", "read")
        found = every.where(f"{key} is not null").join(names, "q")
        if self.metric == "cosine":  # of unit vectors
            found = found.withColumn("distance", F.col("distance") * F.col("distance") / 2)
        return top(found.select("query_id", key, "distance"), key, k, digits, "distance", False)


def _nearest(key: str, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of(asked: pa.Table, held: pa.Table) -> pa.Table:
        kind = held.schema.field(key).type
        schema = pa.schema([("q", pa.int64()), (key, kind), ("distance", pa.float64()), ("read", pa.int32())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        v, away, keys = matrix(held.column("embedding")), held.column("away").to_numpy(), held.column(key).combine_chunks()
        q, vectors, d, most = asked.column("q").to_numpy(), matrix(asked.column("qvec")), asked.column("d").to_numpy(), asked.column("most").to_numpy()
        out = []
        for at in range(0, len(q), QUERIES):
            part = slice(at, at + QUERIES)
            rough = distances(vectors[part], v)
            possible = np.abs(d[part, None] - away[None, :]) <= most[part, None] + SLACK
            rough[~possible] = np.inf
            for i, row in enumerate(rough):
                n = int(possible[i].sum())
                out.append(pa.table([[q[at + i]], pa.nulls(1, kind), [np.nan], [n]], schema=schema))
                if not n:
                    continue
                limit = min(np.partition(row, min(k, n) - 1)[min(k, n) - 1], most[at + i]) + 1e-6 * (1 + np.abs(vectors[at + i]).max(initial=0))
                near = np.flatnonzero(row <= limit)
                exact = measured(vectors[at + i], v[near])
                if len(near) > k:  # all that tie with the k-th after rounding
                    kept = exact <= np.partition(exact, k - 1)[k - 1] + SLACK
                    near, exact = near[kept], exact[kept]
                taken = keys.take(pa.array(near))
                order = np.lexsort((taken.to_numpy(zero_copy_only=False), np.round(exact, 9)))[:k]
                m = len(order)
                out.append(pa.table([np.full(m, q[at + i]), taken.take(pa.array(order)), exact[order], np.zeros(m, np.int32)], schema=schema))
        return pa.concat_tables(out)

    return of


def nearest(queries: DataFrame, vectors: DataFrame, key: str, k: int, metric: str = "l2", digits: int = 9) -> DataFrame:
    """``MetricIndex.nearest`` over an index made for this call."""
    return MetricIndex.of(vectors, key, metric).nearest(queries, k, digits)

