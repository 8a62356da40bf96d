"""The driver's tables as the engine's: documents as chunks, embeddings as papers, events as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ingest import documents_to_chunks
from docloom.session import table

URI = "concat('/', source, '/', doc_id, '.md')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{URI} AS source_uri", "source", "text", "lang")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(source_uri, chunk_index, content, content_hash)."""
    return documents_to_chunks(documents(spark, sf))


def whole_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one chunk."""
    return documents(spark, sf).selectExpr("doc_id AS chunk_id", "text AS content", "source_uri", "'markdown' AS source_type", "0 AS chunk_index", "if(doc_id % 2 = 0, 'mechanical', 'semantic') AS chunk_strategy")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, embedding, paper_id)."""
    return table(spark, sf, "embeddings").selectExpr("vec_id AS chunk_id", "embedding", "label AS paper_id")


def query_vectors(spark: SparkSession, sf: str, ids: tuple[int, ...] = (0, 7, 42)) -> DataFrame:
    return vectors(spark, sf).where(F.col("chunk_id").isin(list(ids))).select(F.col("chunk_id").cast("int").alias("query_id"), F.col("embedding").alias("qvec"))


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as papers."""
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS paper_id", "s_name AS title", "array(concat(substring('ABCDE', 1 + cast(s_suppkey % 5 AS int), 1), 'author, ', s_name), s_name) AS authors", "cast(1990 + s_nationkey % 3 AS int) AS year", "cast(null AS string) AS doi", "concat('Venue ', s_nationkey) AS venue", "cast(null AS string) AS bibtex")


CHUNKS_SQL = """d AS (SELECT doc_id, source, '/' || source || '/' || doc_id || '.md' AS source_uri, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT source_uri, text, unnest(range(0, CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 800.0)::BIGINT + 1 END)) AS w FROM d),
c AS (SELECT source_uri, w, substr(text, w * 800 + 1, 1000) AS content FROM w),
chunks AS (SELECT source_uri, (row_number() OVER (PARTITION BY source_uri ORDER BY w) - 1)::INT AS chunk_index, content, substr(sha256(content), 1, 16) AS content_hash
  FROM c WHERE regexp_matches(content, '\\S'))"""

WORDS_SQL = """toks AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)"""
