"""Hybrid search: vector legs, rank fusion, folder boost, reranking, hydration."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import keywords, match_query
from docloom.functions.vectors import cosine, l2
from docloom.operators import cells
from docloom.operators.index import Index
from docloom.operators.lexical import QueryError, normal, parse, plain_words, scored_matches, top

# The constant of rank fusion, how many candidates each step takes, and the boost of near folders.
RRF_K = 60
OVERFETCH, OVERFETCH_FILTERED = 3, 15
WINDOW_FACTOR = 2
BOOST, BOOST_FOLDERS, BOOST_WITHIN, BOOST_LEAST = 1.15, 5, 2, 1e-6
RERANK_TOP = 20
MODES = ("hybrid", "fts", "vec")
TYPES = ("pdf", "markdown", "code", "web", "note", "figure")
#: Queries of a batch go to every task up to this many.
QUERY_BLOCK = 1000
#: Vectors that a task compares with all queries at once.
VECTORS_AT_ONCE = 2048


def nearest(queries: DataFrame, vectors: DataFrame, key: str, k: int, metric: str = "l2", digits: int = 9, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, distance, rank): exact k nearest vectors of each query.

    ``queries`` has (query_id, qvec) and any number of rows. Up to ``block`` of them go to every
    task and are compared with all vectors; ranks are limited within partitions before the
    shuffle. More go through ``cells``, where a query reads only the vectors near it. Euclidean
    distances are compared by products of blocks first, and only what can be among the k
    nearest of its task is measured as the metric says.
    """
    queries = queries.select("query_id", "qvec")
    asked = queries.limit(block + 1).collect()  # block + 1 rows
    if len(asked) > block:
        return cells.nearest(queries, vectors, key, k, metric, digits)
    vectors, spark = vectors.select(key, "embedding"), vectors.sparkSession
    points = [r.qvec for r in asked]
    if metric == "l2" and points and _regular(points):
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], T.StructType([T.StructField("i", T.IntegerType()), *queries.schema.fields]))
        schema = T.StructType([T.StructField("i", T.IntegerType()), *vectors.schema.fields])
        pairs = vectors.mapInArrow(_possible(np.array(points, np.float64), k, digits), schema).join(F.broadcast(numbered), "i")
    else:
        pairs = vectors.join(F.broadcast(queries))
    measure = l2("embedding", "qvec") if metric == "l2" else 1 - cosine("embedding", "qvec")
    compared = pairs.select("query_id", key, measure.alias("distance"))
    return top(compared.where("distance is not null"), key, k, digits, "distance", False)


def _regular(points: list[list[float] | None]) -> bool:
    """Whether vectors are of one length and have finite numbers alone."""
    return None not in points and len({len(p) for p in points}) == 1 and len(points[0]) > 0 and all(x is not None and math.isfinite(x) for p in points for x in p)


def _possible(points: np.ndarray, k: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, key, embedding) of (key, embedding): vectors that may be among the k nearest of a task to the i-th point.

    Products are rough, so what they may be off by, and ties after rounding, stay inside. Vectors
    of another length or with nulls have no distance; those that are not finite are not ruled out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.full(len(points), np.inf)
        longest = np.sqrt((points * points).sum(1)).max()
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                some = batch.slice(at, VECTORS_AT_ONCE)
                lists = some.column(1)
                width = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                some = some.filter(pa.array(width == points.shape[1]))
                flat = some.column(1).flatten()
                if flat.null_count:
                    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, points.shape[1]).all(1)
                    some = some.filter(pa.array(whole))
                    flat = some.column(1).flatten()
                if not some.num_rows:
                    continue
                v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, points.shape[1])
                with np.errstate(all="ignore"):
                    size = np.sqrt((v * v).sum(1))
                    odd = ~np.isfinite(size)
                    v[odd], size[odd] = 0, 0
                    rough = cells.distances(points, v)
                    slack = 1e-6 * (1 + max(longest, size.max())) + 2 * 10.0**-digits
                rough[:, odd] = np.inf
                if len(v) - odd.sum() >= k:
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
                i, j = np.nonzero((rough <= limit[:, None]) | odd[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *(c.take(pa.array(j)) for c in some.columns)], ["i", *batch.schema.names])

    return of


def fuse(lexical: DataFrame, vector: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, place): reciprocal rank fusion of two ranked legs.

    Ties keep the lexical leg's order first, then the vector leg's, as ``place`` has it.
    """
    legs = lexical.select("query_id", key, "rank", F.lit(0).alias("leg")).unionByName(vector.select("query_id", key, "rank", F.lit(1).alias("leg")))
    summed = legs.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("first.leg"), F.col("first.rank")))
    return summed.select("query_id", key, "score", place.alias("place"))


def single_leg(ranked: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    return ranked.select("query_id", key, (1.0 / (k + F.col("rank"))).alias("score"), F.col("rank").alias("place"))


def parent_folder(uri: str = "source_uri"):
    """The folder of a path: what stands before the last slash."""
    return F.regexp_replace(uri, r"/[^/]*$", "")


def folder_boost(ranked: DataFrame, uris: DataFrame, folders: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Scores of chunks in a folder near the query, raised.

    Of each query's five nearest folders those within twice the best distance count (within
    1e-6 if the best is 0).
    """
    near = nearest(queries, folders, "folder_path", BOOST_FOLDERS)
    best = F.min("distance").over(Window.partitionBy("query_id"))
    limit = F.when(F.col("best") > 0, F.col("best") * BOOST_WITHIN).otherwise(BOOST_LEAST)
    good = near.withColumn("best", best).where(F.col("distance") <= limit).select("query_id", "folder_path", F.lit(BOOST).alias("boost"))
    placed = ranked.join(uris.select(key, parent_folder().alias("folder_path")), key, "left").join(good, ["query_id", "folder_path"], "left")
    return placed.select("query_id", key, (F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score"), "place")


def validate(mode: str, top_k: int, source_type: str | None = None, chunk_strategy: str | None = None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not 1 <= top_k <= 500:
        raise ValueError("top_k must lie between 1 and 500")
    if source_type is not None and source_type not in TYPES:
        raise ValueError(f"source_type must be one of {TYPES}")
    if chunk_strategy is not None and chunk_strategy not in ("mechanical", "semantic"):
        raise ValueError("chunk_strategy must be mechanical or semantic")


def hybrid(index: Index, vectors: DataFrame, terms: DataFrame, qvecs: DataFrame, k: int = 10, fetch: int = 30, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, place): fused ranks of any number of queries in one pass."""
    fused = fuse(index.best(terms, fetch), nearest(qvecs, vectors, index.key, fetch), index.key, rrf_k)
    return fused.where(F.col("place") <= k)


def lexical_leg(index: Index, query: str, limit: int, among: DataFrame | None = None) -> DataFrame:
    """Ranked matches of a boolean query, of those in ``among``; a query that can't be parsed finds nothing.

    Words joined by OR or AND are a walk over blocks of postings, if the index has them;
    phrases, prefixes and the other operators read the positions.
    """
    key = index.key
    try:
        tree = normal(parse(query), index.stem, index.fold)
        if among is None and index.blocks is not None and (plain := plain_words(tree)):
            wanted = index.postings.sparkSession.createDataFrame([(0, w) for w in plain[0]], "query_id int, term string")
            return index.best_of(wanted, limit, every=plain[1])
        scored = scored_matches(index.asked(tree), index.lengths, key, tree)
    except QueryError:
        scored = index.lengths.select(F.lit(0).alias("query_id"), key, F.lit(0.0).alias("score")).where(F.lit(False))
    if among is not None:
        scored = scored.join(among.select(key), key, "left_semi")
    return top(scored, key, limit)


def intent(query: str, spark: SparkSession) -> str:
    """The intent words of a query, joined by OR; empty without any."""
    found = match_query(keywords(spark.createDataFrame([(0, query)], "query_id int, query string"))).first()
    return found.match if found else ""


def search(
    chunks: DataFrame, query: str, qvec: list[float] | None = None, vectors: DataFrame | None = None, folders: DataFrame | None = None,
    top_k: int = 10, mode: str = "hybrid", source_type: str | None = None, chunk_strategy: str | None = None,
    rerank: Callable[[DataFrame], DataFrame] | None = None, rerank_top: int = RERANK_TOP, prefilter: bool = False,
    index: Index | None = None, keyword_prefilter: bool = False,
) -> DataFrame:
    """The whole search: legs, fusion, boost, rerank, cut, hydration.

    Words are found by stem and without accents, in ``index`` or else in the texts. With
    ``keyword_prefilter`` the lexical leg takes the query's intent words alone. ``source_type``
    filters after the cut, so fewer than ``top_k`` rows may come back, unless ``prefilter``.
    ``match_type`` is hybrid if both legs found something; reranked rows say so. ``rerank``
    takes (chunk_id, content) and returns (chunk_id, rerank_score); if it fails, the fused
    order stays.
    """
    validate(mode, top_k, source_type, chunk_strategy)
    key, spark = "chunk_id", chunks.sparkSession
    if prefilter and source_type:
        chunks = chunks.where(F.col("source_type") == source_type)
    limit = top_k * (OVERFETCH_FILTERED if chunk_strategy else OVERFETCH)
    none = spark.createDataFrame([], f"query_id int, {key} long, rank int")
    index = index or Index.of(chunks, key)
    asked = intent(query, spark) if keyword_prefilter and mode != "vec" else query
    among = chunks.where(F.col("chunk_strategy") == chunk_strategy) if chunk_strategy else chunks if prefilter and source_type else None
    lexical = lexical_leg(index, asked, limit, among) if mode != "vec" and asked.strip() else none
    # a leg has at most 15 * top_k rows
    held = lambda leg: spark.createDataFrame(leg.select(F.col("query_id").cast("int"), F.col(key).cast("long"), F.col("rank").cast("int")).collect(), none.schema)
    lexical, vector, queries = held(lexical), none, None
    if mode != "fts" and qvec is not None and vectors is not None:
        queries = spark.createDataFrame([(0, [float(x) for x in qvec])], "query_id int, qvec array<double>")
        vector = nearest(queries, vectors, key, limit)
        if prefilter and source_type:
            vector = nearest(queries, vectors.join(chunks.select(key), key, "left_semi"), key, limit)
        vector = held(vector)
        if chunk_strategy:
            vector = vector.join(chunks.where(F.col("chunk_strategy") == chunk_strategy), key, "left_semi")
            vector = vector.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    # at most 15 * top_k rows each, from here on
    found_lexical, found_vector = not lexical.isEmpty(), not vector.isEmpty()
    merged = fuse(lexical, vector, key) if found_lexical and found_vector else single_leg(lexical if found_lexical else vector, key)
    kind = "hybrid" if found_lexical and found_vector else "fts" if found_lexical else "vec"
    window = merged.where(F.col("place") <= WINDOW_FACTOR * top_k)
    rows = window.collect()  # 2 * top_k
    window, chunks = spark.createDataFrame(rows, window.schema), chunks.where(F.col(key).isin([r[key] for r in rows]))
    if folders is not None and queries is not None:
        window = folder_boost(window, chunks, folders, queries, key)
    order = [F.desc(F.round("score", 12)), F.col("place")]
    ranked = window.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("match_type", F.lit(kind))
    if rerank is not None:
        pool = ranked.join(chunks.select(key, "content", "source_type", "chunk_strategy"), key)
        if source_type:
            pool = pool.where(F.col("source_type") == source_type)
        if chunk_strategy:
            pool = pool.where(F.col("chunk_strategy") == chunk_strategy)
        pool = pool.orderBy("place").limit(rerank_top).select(key, "content")
        try:
            scored = spark.createDataFrame(rerank(pool).collect(), f"{key} {chunks.schema[key].dataType.simpleString()}, rerank_score double")  # rerank_top rows
        except (PySparkException, ImportError, RuntimeError, ValueError, OSError) as e:
            logging.getLogger(__name__).warning("the reranker failed, the fused order stays: %s", e)
            scored = pool.select(key, F.lit(None).cast("double").alias("rerank_score")).where(F.lit(False))
        ranked = ranked.join(scored, key, "left").select("query_id", key, F.coalesce("rerank_score", "score").alias("score"), "place", F.when(F.col("rerank_score").isNotNull(), "reranked").otherwise(F.col("match_type")).alias("match_type"))
        ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    details = chunks.select(key, "content", "source_type", "source_uri", "chunk_index", "chunk_strategy")
    out = ranked.where(F.col("place") <= top_k).join(details, key)
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    if chunk_strategy:
        out = out.where(F.col("chunk_strategy") == chunk_strategy)
    return out.select(key, "content", "source_type", "source_uri", "chunk_index", F.round("score", 6).alias("score"), "match_type", "place").orderBy("place")
