"""Queries of papers and their files: moves, registrations, views, chunks and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import mutate, papers
from docloom.plans import views
from docloom.session import table

_HASH = "sha2(coalesce(text, ''), 256)"


def moved_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is asked to move: some are lost or changed, some share a place or go where another is, some are asked twice."""
    docs = views.documents(spark, sf)
    new = "CASE WHEN doc_id % 11 = 0 THEN concat('/moved/', doc_id div 50) WHEN doc_id % 17 = 0 THEN concat('/', source, '/', doc_id + 1, '.md') ELSE concat('/moved', source_uri) END"
    once = docs.selectExpr("if(doc_id % 13 = 0, concat('/lost', source_uri), source_uri) AS old", f"{new} AS new", f"if(doc_id % 7 = 0, 'x', {_HASH}) AS content_hash")
    again = docs.where("doc_id % 5 = 0").selectExpr("source_uri", "concat('/again', source_uri)", _HASH)
    return papers.moves(once.union(again), docs.selectExpr("doc_id AS paper_id", "source_uri AS path", f"{_HASH} AS content_hash"))


def registered_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is registered: some have a supplier's or another's DOI, copies of a text share a path, some of which papers have."""
    docs = table(spark, sf, "documents").withColumn("path", F.expr(f"concat('/p/', {_HASH})"))
    asked = docs.selectExpr("doc_id AS n", "CASE doc_id % 4 WHEN 0 THEN concat('10.1/s', doc_id) WHEN 1 THEN concat('10.1/d', doc_id % 250) END AS doi", "if(doc_id % 9 = 0, null, path) AS path")
    owned = docs.where("doc_id % 6 = 1").selectExpr("doc_id + 1000000 AS paper_id", "path")
    out = papers.registrations(asked, table(spark, sf, "supplier").selectExpr("concat('10.1/s', s_suppkey) AS doi"), owned)
    return out.select("n", "status", "path_owner", "path_free")


def paper_views(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as papers, their orders as paths, and edges between customers."""
    orders = table(spark, sf, "orders")
    files = orders.selectExpr("o_custkey AS paper_id", "concat('/o/', o_orderkey) AS path", "o_orderkey % 3 = 0 AS is_primary", "o_orderdate AS added_at")
    edges = orders.selectExpr("o_custkey AS source_paper_id", "o_orderkey % 100 + 1 AS target_paper_id", "if(o_orderkey % 2 = 0, 'cites', 'extends') AS relation_type", "0.5D AS confidence").distinct()
    found = mutate.paper_view(table(spark, sf, "customer").selectExpr("c_custkey AS paper_id", "c_name AS title"), files, edges)
    near = "array_join(transform(relationships, r -> concat_ws(' ', r.other_paper_id, r.direction, r.relation_type)), ',')"
    return found.selectExpr("paper_id", "title", "array_join(paths, ',') AS paths", f"{near} AS relationships")


def papers_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of papers with a file, abstracts of the others; each sixth chunk is a figure."""
    docs = views.documents(spark, sf)
    chunks = views.whole_chunks(spark, sf).withColumn("source_type", F.expr("if(chunk_id % 6 = 0, 'figure', source_type)"))
    listed = docs.selectExpr("doc_id AS paper_id", "doc_id + 1 AS abstract_chunk_id")
    found = papers.paper_chunks(listed, docs.where("doc_id % 3 = 0").selectExpr("doc_id AS paper_id", "source_uri AS path"), chunks)
    return found.select("paper_id", "chunk_id", F.length("content").alias("n_chars"))


def conclusion_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Conclusions that name three chunks each, some of which are gone, in the order they name them."""
    docs = table(spark, sf, "documents")
    named = docs.selectExpr("doc_id AS id", "array(doc_id * 7, doc_id, doc_id * 3) AS source_chunk_ids")
    found = mutate.hydrated(named, docs.selectExpr("doc_id AS chunk_id", "coalesce(text, '') AS content").where("chunk_id % 8 <> 5"))
    shown = "array_join(transform(evidence, e -> concat(e.chunk_id, ':', length(e.content))), ',')"
    return found.selectExpr("id", f"coalesce({shown}, '') AS evidence")


QUERIES = {f.__name__: f for f in (moved_papers, registered_papers, paper_views, papers_chunks, conclusion_evidence)}
ORACLES = {
    "moved_papers": """WITH d AS (SELECT doc_id, source, '/' || source || '/' || doc_id || '.md' AS uri, sha256(coalesce(text, '')) AS h FROM documents),
a AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '/lost' || uri ELSE uri END AS old, CASE WHEN doc_id % 11 = 0 THEN '/moved/' || doc_id // 50
    WHEN doc_id % 17 = 0 THEN '/' || source || '/' || (doc_id + 1) || '.md' ELSE '/moved' || uri END AS new, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE h END AS h FROM d
  UNION SELECT uri, '/again' || uri, h FROM d WHERE doc_id % 5 = 0),
s AS (SELECT old, new, CASE WHEN new IS NULL OR NOT EXISTS (SELECT 1 FROM d WHERE uri = old) THEN 'unknown' WHEN NOT EXISTS (SELECT 1 FROM d WHERE uri = old AND d.h = a.h) THEN 'other' END AS st FROM a),
o AS (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY new) AS k, EXISTS (SELECT 1 FROM d WHERE uri = new) AS there FROM (SELECT DISTINCT old, new FROM s WHERE st IS NULL)),
f AS (SELECT old, new, row_number() OVER (PARTITION BY new ORDER BY old) AS k FROM o WHERE k = 1 AND NOT there)
SELECT old, new, st AS status FROM s WHERE st IS NOT NULL UNION SELECT old, new, CASE WHEN k > 1 THEN 'repeated' ELSE 'taken' END FROM o WHERE k > 1 OR there
UNION SELECT old, new, CASE WHEN k = 1 THEN 'moved' ELSE 'taken' END FROM f""",
    "registered_papers": """WITH d AS (SELECT doc_id, '/p/' || sha256(coalesce(text, '')) AS path FROM documents),
a AS (SELECT doc_id AS n, CASE doc_id % 4 WHEN 0 THEN '10.1/s' || doc_id WHEN 1 THEN '10.1/d' || (doc_id % 250) END AS doi, CASE WHEN doc_id % 9 <> 0 THEN path END AS path FROM d),
b AS (SELECT *, CASE WHEN doi IS NOT NULL AND (row_number() OVER (PARTITION BY doi ORDER BY n) > 1 OR doi IN (SELECT '10.1/s' || s_suppkey FROM supplier)) THEN 'doi' ELSE 'added' END AS status FROM a),
c AS (SELECT *, (SELECT min(doc_id) + 1000000 FROM d WHERE d.path = b.path AND doc_id % 6 = 1) AS path_owner FROM b)
SELECT n, status, path_owner, status = 'added' AND path IS NOT NULL AND path_owner IS NULL AND row_number() OVER (PARTITION BY path, status ORDER BY n) = 1 AS path_free FROM c""",
    "paper_views": """WITH p AS (SELECT o_custkey AS c, string_agg('/o/' || o_orderkey, ',' ORDER BY o_orderkey % 3 = 0 DESC, o_orderdate, '/o/' || o_orderkey) AS paths FROM orders GROUP BY 1),
e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 100 + 1 AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'cites' ELSE 'extends' END AS r FROM orders),
n AS (SELECT a AS c, b AS other, 'out' AS dir, r FROM e UNION ALL SELECT b, a, 'in', r FROM e),
m AS (SELECT c, string_agg(other || ' ' || dir || ' ' || r, ',' ORDER BY other, dir, r) AS relationships FROM n GROUP BY 1)
SELECT c_custkey AS paper_id, c_name AS title, paths, relationships FROM customer LEFT JOIN p ON p.c = c_custkey LEFT JOIN m ON m.c = c_custkey""",
    "papers_chunks": """WITH k AS (SELECT doc_id, '/' || source || '/' || doc_id || '.md' AS uri, length(text)::INT AS n_chars FROM documents WHERE doc_id % 6 <> 0),
f AS (SELECT doc_id AS paper_id, doc_id AS chunk_id, n_chars FROM k WHERE doc_id % 3 = 0 AND uri IS NOT NULL)
SELECT * FROM f UNION ALL SELECT k.doc_id - 1, k.doc_id, k.n_chars FROM k JOIN documents p ON p.doc_id = k.doc_id - 1 WHERE k.doc_id - 1 NOT IN (SELECT paper_id FROM f)""",
    "conclusion_evidence": """WITH c AS (SELECT doc_id AS id, unnest([doc_id * 7, doc_id, doc_id * 3]) AS chunk, unnest([1, 2, 3]) AS i FROM documents),
j AS (SELECT id, string_agg(chunk || ':' || length(coalesce(text, '')), ',' ORDER BY i) AS evidence FROM c JOIN documents ON doc_id = chunk WHERE chunk % 8 <> 5 GROUP BY 1)
SELECT doc_id AS id, coalesce(evidence, '') AS evidence FROM documents LEFT JOIN j ON id = doc_id""",
}
