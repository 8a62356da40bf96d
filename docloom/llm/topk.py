"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum over ``SLICES`` slices of the components, and each block of candidates keeps
a list of partial scores for every slice.

1. Gather: from each list of a block the best k entries of every query are taken and summed
   whole; the k-th best sum over all blocks is a score that k candidates reach, so a safe cutoff.
2. Cutoff: it goes back to the blocks with the queries. A candidate whose partial scores are
   all below cutoff / ``SLICES`` stays below the cutoff in sum, so the entries at or above that
   uniform threshold are sufficient.
3. Resolve: the sums of these entries are completed from their other slices, where the
   candidates are; a block hands on its best k that reach the cutoff, and the best k of all
   blocks are the result.

Queries and candidates are dealt into blocks by a hash of the row, so a block holds about as
many rows whatever repeats, and every block of queries meets every block of candidates in a
task of its own. A block's rows follow the data's size and the number of partitions up to
``MOST_BLOCK``. What a block hands on is at most k rows for a query, ties and copies included.

Components are floor(256 * x). Sums are taken in doubles where they are below 2**53 and so
exact, in Python's integers otherwise; a score beyond the range of long ends at its limit.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros; a null id is a candidate like any other (its ties come
last) and never a query; of repeated rows each is a row of its own: a query's own row is left
out, its copies are not; fewer than k candidates give fewer ranks; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import written
from docloom.session import table

TOP, EVERY, SCALE = 5, 50, 256
#: Slices of the components, and most rows of a block of queries or candidates.
SLICES, MOST_BLOCK = 4, 32_768
LEAST_BLOCK = 512
#: Scores that a task holds at once.
TILE = 1 << 21
#: The order of a null id in ties.
LAST = MOST = (1 << 63) - 1
LEAST = -(1 << 63)


def quantised(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, v of longs; rows are numbered as written."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return written(vectors.where(whole).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "vectors")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def magnitude(m: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def partial_scores(queries: np.ndarray, candidates: np.ndarray) -> list[np.ndarray]:
    """Inner products of every query with every candidate, slice by slice, exact."""
    width = queries.shape[1]
    kind = np.float64 if magnitude(queries) * magnitude(candidates) * max(1, width) < 1 << 53 else object
    cuts = np.linspace(0, width, SLICES + 1).astype(int)
    return [queries[:, a:b].astype(kind) @ candidates[:, a:b].astype(kind).T for a, b in zip(cuts, cuts[1:], strict=False)]


def best_entries(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:  # only what reaches the k-th score has to be sorted
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        kept = np.arange(len(score))
    return kept[np.lexsort((ids[kept], -score[kept]))][:k]


def gathered(partial: list[np.ndarray], ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Phase 1 for one query: candidates that are among the k best of some slice's list."""
    places = np.flatnonzero(allowed)
    found = [places[best_entries(p[places], ids[places], k)] for p in partial]
    return np.unique(np.concatenate(found))


def sufficient(partial: list[np.ndarray], allowed: np.ndarray, cutoff: int | None) -> np.ndarray:
    """Phase 2 for one query: candidates with a partial score at or above the uniform threshold."""
    if cutoff is None or cutoff == LEAST:  # fewer than k candidates in all, or a score below every long
        return np.flatnonzero(allowed)
    least = -(-cutoff // SLICES)
    return np.flatnonzero(allowed & np.any([p >= least for p in partial], axis=0))


def tile(k: int, with_cutoff: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Lists of one block of queries (row, v, cutoff) against one block of candidates (row, vec_id, v)."""

    def listed(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        width = max([0, *(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for t in (queries, candidates))])
        q, c = matrix(queries.column("v"), width), matrix(candidates.column("v"), width)
        q_rows, c_rows = queries.column("row").to_numpy(), candidates.column("row").to_numpy()
        ids = candidates.column("vec_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        cutoffs = queries.column("cutoff").to_pylist()
        rows, places, scores = [], [], []
        step = max(1, TILE // max(1, len(c)))
        for at in range(0, len(q), step):
            partial = partial_scores(q[at : at + step], c)
            for i, own in enumerate(q_rows[at : at + step]):
                mine, allowed = [p[i] for p in partial], c_rows != own
                if with_cutoff:
                    cutoff = cutoffs[at + i]
                    found = sufficient(mine, allowed, cutoff)
                else:
                    cutoff, found = None, gathered(mine, ids, allowed, k)
                sums = np.clip(np.sum([p[found] for p in mine], axis=0), LEAST, MOST) if mine[0].dtype == object else np.sum([p[found] for p in mine], axis=0)
                if cutoff is not None:
                    found, sums = found[sums >= cutoff], sums[sums >= cutoff]
                best = best_entries(sums, ids[found], k)
                rows.append(np.full(len(best), own, np.int64))
                places.append(found[best])
                scores.extend(map(int, sums[best]))
        taken = np.concatenate(places) if places else np.zeros(0, np.int64)
        return pa.table(
            {
                "row": pa.array(np.concatenate(rows) if rows else taken, pa.int64()),
                "vec_id": candidates.column("vec_id").combine_chunks().take(pa.array(taken, pa.int64())),
                "score": pa.array(scores, pa.int64()),
            }
        )

    return listed


def blocks(rows: int, partitions: int) -> int:
    """How many blocks a table of so many rows is dealt into."""
    return max(1, -(-rows // min(MOST_BLOCK, max(LEAST_BLOCK, -(-rows // partitions)))))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each query among the candidates.

    Both are rows (row, vec_id, v) of ``quantised``; a query's own row is no candidate of it.
    """
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, c_blocks = blocks(queries.count(), partitions), blocks(candidates.count(), partitions)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = candidates.select("row", "vec_id", "v", dealt(c_blocks).alias("c"), every(q_blocks).alias("q"))

    def lists(left: DataFrame, with_cutoff: bool) -> DataFrame:
        left = left.select("row", "v", "cutoff", dealt(q_blocks).alias("q"), every(c_blocks).alias("c"))
        met = left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))
        return met.applyInArrow(tile(k, with_cutoff), "row long, vec_id long, score long")

    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    cutoffs = ranked(lists(queries.withColumn("cutoff", F.lit(None).cast("long")), False)).where(F.col("rank") == k)
    known = written(queries.join(cutoffs.select("row", F.col("score").alias("cutoff")), "row", "left"), "cutoffs")
    out = ranked(lists(known, True)).join(queries.select("row", F.col("vec_id").alias("query_id")), "row")
    return out.select("query_id", "rank", "vec_id", "score")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for every one whose id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % {EVERY} = 0) q JOIN v c ON c.r <> q.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= {TOP}
"""
