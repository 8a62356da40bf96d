"""Queries of upkeep: what an ingest, a new version of a document, a scan of one paper, or the figures of a file change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import figures, graph, ingest, mutate, web_images
from docloom.plans import views
from docloom.plans.analytics_queries import _GAPS, _PAIRS
from docloom.session import table
from docloom.sources import files


def relinked_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Brands looked up in the chunks of their document, as whole words."""
    part = table(spark, sf, "part")
    named = part.selectExpr("p_partkey AS id", "p_brand AS name", "concat('/d', p_partkey % 20) AS source_uri")
    content = "concat('uses ', p_brand, if(p_partkey % 2 = 0, 'x', ''), ' and ', if(p_partkey % 3 = 0, lower(p_brand), p_brand), if(p_partkey % 5 = 0, '', '_y'), ' of ', p_name)"
    return ingest.relinked(named, part.selectExpr("p_partkey + 100000 AS chunk_id", "p_partkey AS chunk_index", "concat('/d', p_partkey * 7 % 20) AS source_uri", f"{content} AS content"))


def kept_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases in place of the views of a user: the sessions of the views hold for them."""
    events = table(spark, sf, "events")
    rows = lambda kind: events.where(F.col("event_type") == kind).selectExpr("event_id AS chunk_id", "concat('u', user_id) AS source_uri")
    links = events.selectExpr("event_id AS chunk_id", "cast(cast(ts AS date) AS string) AS session_id")
    return ingest.preserved_sessions(rows("view"), rows("purchase"), links)


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: their chunks, the new ones of them, and the first paper of the same text."""
    docs = views.documents(spark, sf)
    chunks = views.chunks(spark, sf)
    hashes = docs.selectExpr("doc_id AS paper_id", "source_uri", "sha2(text, 256) AS content_hash").where("content_hash is not null")
    return ingest.ingest_report(chunks, ingest.deduplicated(chunks), hashes.select("source_uri", "content_hash"), hashes)


def paper_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with one of two papers."""
    of = spark.createDataFrame([(0,), (3,)], "paper_id int")
    vectors = views.vectors(spark, sf)
    found = graph.pair_similarity(vectors, of=of.select(F.col("paper_id").cast(vectors.schema["paper_id"].dataType).alias("paper_id")))
    return found.select("paper_a", "paper_b", F.round("score", 6).alias("score"), "evidence_chunk_id", "n")


def backfilled_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers; every third has a path."""
    docs = views.documents(spark, sf)
    papers = docs.selectExpr("doc_id AS paper_id", "doc_id + 1 AS abstract_chunk_id")
    return mutate.backfilled_paths(papers, docs.selectExpr("doc_id AS chunk_id", "source_uri"), docs.where("doc_id % 3 = 0").selectExpr("doc_id AS paper_id"))


def recovered_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "events").selectExpr("event_id AS id", "element_at(array('pending', 'running', 'completed', 'failed'), cast(event_id % 4 + 1 AS int)) AS status")
    return mutate.jobs_recovered(jobs)


def open_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of users since a day that are not resolved."""
    errors = table(spark, sf, "events").selectExpr("event_id AS id", "concat('u', user_id) AS query", "ts AS detected_at", "if(event_id % 3 = 0, ts, null) AS resolved_at")
    return mutate.open_misses(errors, "2024-01-05").select("id", "query")


def image_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folder names of documents' images, and their paths with forward slashes."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "concat('C:\\\\', source, '\\\\a b(', doc_id, ').v1.pdf') AS path", "substring(sha2(coalesce(text, ''), 256), 1, 16) AS h")
    return docs.select("doc_id", files.unix_paths("path").alias("path"), files.image_dir(files.unix_paths("path"), F.col("h")).alias("folder"))


def figure_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk indexes and metadata of figures, and those on two of the pages."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", "cast(doc_id % 40 AS int) AS page", "cast(doc_id % 7 AS int) AS figure", "if(doc_id % 2 = 0, array(cast(doc_id % 40 AS int)), cast(array() AS array<int>)) AS pages", "if(doc_id % 3 = 0, array(concat(doc_id, '.png')), cast(array() AS array<string>)) AS images")
    placed = docs.select("doc_id", ingest.figure_index("page", "figure").alias("chunk_index"), ingest.chunk_metadata().alias("metadata"))
    return placed.withColumn("chosen", figures.in_pages("chunk_index", [3, 17]))


_BOX = "(cast(embedding[{i}] AS double) + 1) / 2"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Small boxes made of vector components, a page for each label and hundred."""
    x, y = _BOX.format(i=0), _BOX.format(i=1)
    return table(spark, sf, "embeddings").selectExpr("vec_id", "label * 1000 + vec_id div 100 AS page", f"{x} AS x1", f"{y} AS y1", f"{x} + 0.01 AS x2", f"{y} + 0.01 AS y2")


_BOXES = "b AS (SELECT vec_id, label * 1000 + vec_id // 100 AS page, (embedding[1]::DOUBLE + 1) / 2 AS x1, (embedding[2]::DOUBLE + 1) / 2 AS y1, (embedding[1]::DOUBLE + 1) / 2 + 0.01 AS x2, (embedding[2]::DOUBLE + 1) / 2 + 0.01 AS y2 FROM embeddings)"
_ZONES = "(VALUES (0.2, 0.3, 0.5, 0.6), (0.7, 0.1, 0.9, 0.45)) z(zx1, zy1, zx2, zy2)"


def _zones(boxes: DataFrame) -> DataFrame:
    """Two regions on each page."""
    return boxes.select("page").distinct().selectExpr("page", "inline(array(struct(0.2D AS x1, 0.3D AS y1, 0.5D AS x2, 0.6D AS y2), struct(0.7D AS x1, 0.1D AS y1, 0.9D AS x2, 0.45D AS y2)))")


def elements_in_regions(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    return figures.elements_in(boxes, _zones(boxes)).select("vec_id", "page", "rx1")


def elements_outside(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    return figures.outside(boxes, _zones(boxes)).select("vec_id", "page")


def padded_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of pages by the gap of elements, with a margin."""
    found = figures.padded(figures.regions(_boxes(spark, sf).drop("vec_id"), 0.02))
    return found.select("page", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


def vector_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").selectExpr("source AS source_uri", "doc_id AS page", "cast(doc_id % 3 = 0 AS int) AS n_images", "cast(doc_id % 23 AS int) AS n_drawings")
    return figures.vector_pages(pages)


def page_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions for each page of the chunks that have them."""
    content = "concat(coalesce(text, ''), '\\n  Figure ', doc_id % 5, ' shows\\nfig. 7 and table', if(doc_id % 2 = 0, ' 3', ''))"
    chunks = table(spark, sf, "documents").selectExpr("concat('/', source) AS source_uri", f"{content} AS content", "array(cast(doc_id % 4 + 1 AS int), 9) AS pages")
    return figures.page_captions(chunks).withColumn("captions", F.array_join("captions", "|"))


def figure_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as images with a caption, descriptions and recognised texts, of which some lack."""
    s = table(spark, sf, "supplier")
    images = s.selectExpr("concat('i', s_suppkey) AS image", "cast(s_suppkey % 9 AS int) AS page")
    captions = s.where("s_suppkey % 2 = 0").selectExpr("concat('i', s_suppkey) AS image", "concat('Figure ', s_suppkey) AS caption")
    told = s.where("s_suppkey % 3 = 0").selectExpr("concat('i', s_suppkey) AS image", "inline(array(struct(0 AS n, s_name AS description), struct(1 AS n, 'more' AS description)))")
    ocr = s.where("s_suppkey % 5 = 0").selectExpr("concat('i', s_suppkey) AS image", "'axis' AS ocr")
    return figures.figure_texts(images, captions, told, ocr)


def ocr_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as recognised elements of an image."""
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn AS pos", "if(role = 'user', 'text', 'icon') AS type", "text AS content")
    return figures.ocr_text(rows, "conv_id")


_PNG = "unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex({w}), 8, '0'), lpad(hex({h}), 8, '0'), repeat('00', {more})))"


def inline_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a picture of their own and one that all share; some have none, others one that is missing.

    A page that is settled without a figure has a row without an index.
    """
    own = "concat('<img alt=\"Page ', page_id, '\" src=\"https://img.example.org/', page_id, '.png\"><img src=\"https://img.example.org/all.png\">')"
    missing = "concat('<img src=\"https://img.example.org/none/', page_id, '.png\">')"
    pages = table(spark, sf, "pages")
    shown = pages.selectExpr("page_id", "url", f"concat(html, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 7 = 3 THEN {missing} ELSE {own} END) AS html")
    drawn = _PNG.format(w="60 + length(html) % 200", h="80 + page_id % 90", more="cast(page_id % 50 AS int)")
    bytes_ = pages.selectExpr("concat('https://img.example.org/', page_id, '.png') AS url", f"{drawn} AS image")
    shared = spark.range(1).selectExpr("'https://img.example.org/all.png' AS url", f"{_PNG.format(w=300, h=200, more=0)} AS image")
    found, settled = web_images.inline_figures(shown, web_images.ImageTable(bytes_.unionByName(shared)), web_images.SidesDescriber())
    meta = F.from_json("metadata", "image_url string, alt_text string")
    return settled.join(found, "source_uri", "left").select("source_uri", "chunk_index", "content", "content_hash", meta["image_url"].alias("image_url"), meta["alt_text"].alias("alt_text"))


_CUT = "CASE WHEN length({c}) > {n} THEN substr({c}, 1, ({n} - 1)::BIGINT) || '…' ELSE {c} END"
QUERIES = {f.__name__: f for f in (
    relinked_facts, kept_sessions, ingest_report, paper_edges, backfilled_paths, recovered_jobs, open_misses, image_folders, figure_indexes, elements_in_regions,
    elements_outside, padded_regions, vector_pages, page_captions, figure_texts, ocr_texts, inline_figures,
)}
ORACLES = {
    "relinked_facts": """WITH c AS (SELECT p_partkey + 100000 AS chunk_id, p_partkey AS chunk_index, '/d' || p_partkey * 7 % 20 AS uri, 'uses ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END || ' and ' || CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_y' END || ' of ' || p_name AS content FROM part)
SELECT p_partkey AS id, min_by(chunk_id, chunk_index) AS chunk_id FROM part JOIN c ON uri = '/d' || p_partkey % 20 AND regexp_matches(content, '\\b' || p_brand || '\\b') GROUP BY 1""",
    "kept_sessions": "WITH s AS (SELECT DISTINCT user_id, (ts::DATE)::VARCHAR AS session_id FROM events WHERE event_type = 'view') SELECT event_id AS chunk_id, session_id FROM events JOIN s USING (user_id) WHERE event_type = 'purchase'",
    "ingest_report": f"""WITH {views.CHUNKS_SQL}, u AS (SELECT source_uri, row_number() OVER (PARTITION BY content_hash ORDER BY source_uri, chunk_index) = 1 AS fresh FROM chunks), k AS (SELECT source_uri, count(*) FILTER (fresh) AS chunks_added, count(*) FILTER (NOT fresh) AS chunks_skipped FROM u GROUP BY 1),
t AS (SELECT '/' || source || '/' || doc_id || '.md' AS source_uri, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL)
SELECT source_uri, chunks_added, chunks_skipped, CASE WHEN chunks_added = 0 THEN first END AS duplicate_of_paper_id FROM k JOIN t USING (source_uri)""",
    "paper_edges": f"WITH {_PAIRS} SELECT paper_a, paper_b, round(score, 6) AS score, evidence_chunk_id, n FROM pairs WHERE paper_a IN (0, 3) OR paper_b IN (0, 3)",
    "backfilled_paths": "SELECT doc_id - 1 AS paper_id, '/' || source || '/' || doc_id || '.md' AS path FROM documents WHERE (doc_id - 1) % 3 <> 0 AND doc_id - 1 IN (SELECT doc_id FROM documents)",
    "recovered_jobs": "SELECT event_id AS id, CASE event_id % 4 WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'pending' END AS status FROM events",
    "open_misses": "SELECT event_id AS id, 'u' || user_id AS query FROM events WHERE event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-05'",
    "image_folders": "SELECT doc_id, 'C:/' || source || '/a b(' || doc_id || ').v1.pdf' AS path, substr(regexp_replace('a b(' || doc_id || ').v1', '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) || '_' || substr(sha256(coalesce(text, '')), 1, 16) AS folder FROM documents",
    "figure_indexes": """SELECT doc_id, (1000000 + doc_id % 40 * 1000 + doc_id % 7)::INT AS chunk_index, '{' || concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN '"pages":[' || doc_id % 40 || ']' END, CASE WHEN doc_id % 3 = 0 THEN '"images":["' || doc_id || '.png"]' END) || '}' AS metadata, doc_id % 40 IN (3, 17) AS chosen FROM documents""",
    "elements_in_regions": f"WITH {_BOXES} SELECT vec_id, page, zx1::DOUBLE AS rx1 FROM b, {_ZONES} WHERE (x1 + x2) / 2 BETWEEN zx1 AND zx2 AND (y1 + y2) / 2 BETWEEN zy1 AND zy2",
    "elements_outside": f"WITH {_BOXES} SELECT vec_id, page FROM b WHERE NOT EXISTS (SELECT 1 FROM {_ZONES} WHERE x1 < zx2 AND zx1 < x2 AND y1 < zy2 AND zy1 < y2)",
    "padded_regions": f"""WITH {_GAPS}, w AS (SELECT page, CASE WHEN n < 2 THEN 0.0 ELSE x1 END AS a, CASE WHEN n < 2 THEN 0.0 ELSE y1 END AS b, CASE WHEN n < 2 THEN 1.0 ELSE x2 END AS c, CASE WHEN n < 2 THEN 1.0 ELSE y2 END AS d FROM h)
SELECT page, round(greatest(0.0, a - 0.02 * (c - a)), 9) AS x1, round(greatest(0.0, b - 0.02 * (d - b)), 9) AS y1, round(least(1.0, c + 0.02 * (c - a)), 9) AS x2, round(least(1.0, d + 0.02 * (d - b)), 9) AS y2 FROM w""",
    "vector_pages": "SELECT source AS source_uri, doc_id AS page FROM documents WHERE doc_id % 23 > 10 AND doc_id % 3 <> 0",
    "page_captions": """WITH l AS (SELECT '/' || source AS source_uri, doc_id, unnest(string_split(coalesce(text, '') || chr(10) || '  Figure ' || doc_id % 5 || ' shows' || chr(10) || 'fig. 7 and table' || CASE WHEN doc_id % 2 = 0 THEN ' 3' ELSE '' END, chr(10))) AS t FROM documents),
c AS (SELECT DISTINCT source_uri, unnest([(doc_id % 4)::INT, 8]) AS page, trim(t, ' ') AS caption FROM l WHERE regexp_matches(t, '(?i)(?:Figure|Fig\\.|Table)\\s+\\d+')) SELECT source_uri, page, string_agg(caption, '|' ORDER BY caption) AS captions FROM c GROUP BY ALL""",
    "figure_texts": """WITH e AS (SELECT s_suppkey AS k, s_name, unnest(CASE WHEN s_suppkey % 3 = 0 THEN [0, 1] ELSE [NULL] END) AS n FROM supplier),
p AS (SELECT 'i' || k AS image, (k % 9)::INT AS page, n, list_filter([CASE WHEN k % 2 = 0 THEN '[Caption] Figure ' || k END, CASE WHEN n = 0 THEN '[Description] ' || s_name WHEN n = 1 THEN '[Description] more' END, CASE WHEN k % 5 = 0 THEN '[OCR] axis' END], lambda x: x IS NOT NULL) AS parts FROM e)
SELECT image, page, (row_number() OVER (PARTITION BY page ORDER BY image, n) - 1)::INT AS figure, CASE WHEN len(parts) = 1 THEN regexp_replace(parts[1], '^\\[[A-Za-z]+\\] ', '') ELSE array_to_string(parts, chr(10) || chr(10)) END AS text FROM p WHERE len(parts) > 0""",
    "ocr_texts": f"""WITH r AS (SELECT conv_id, turn AS pos, role = 'user' AS is_text, trim(text, ' ') AS c FROM conversations), k AS (SELECT * FROM r WHERE length(c) >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id, lower(c) ORDER BY pos) = 1),
g AS (SELECT conv_id, 'Detected text: ' || string_agg('"' || c || '"', ', ' ORDER BY pos) FILTER (is_text) AS t, 'Detected elements: ' || string_agg('"' || c || '"', ', ' ORDER BY pos) FILTER (NOT is_text) AS i FROM k GROUP BY conv_id),
h AS (SELECT conv_id, i, {_CUT.format(c='t', n='500')} AS a FROM g), j AS (SELECT *, 500 - coalesce(length(a), 0) AS left_ FROM h)
SELECT conv_id, concat_ws(chr(10), a, CASE WHEN left_ > 20 THEN {_CUT.format(c='i', n='left_')} END) AS ocr FROM j""",
    "inline_figures": """WITH p AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS source_uri, length(html) AS n FROM pages
  QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY page_id DESC) = 1),
i AS (
  SELECT page_id, source_uri, 0 AS at_, 'https://img.example.org/' || page_id || '.png' AS image_url, 'Page ' || page_id AS alt_text,
    60 + n % 200 AS w, 80 + page_id % 90 AS h, 24 + page_id % 50 AS size
  FROM p WHERE page_id % 5 <> 0 AND page_id % 7 <> 3
  UNION ALL SELECT page_id, source_uri, 1, 'https://img.example.org/all.png', '', 300, 200, 24 FROM p WHERE page_id % 5 <> 0 AND page_id % 7 <> 3),
f AS (
  SELECT source_uri, (2000000 + row_number() OVER (PARTITION BY source_uri ORDER BY at_) - 1)::INT AS chunk_index,
    'PNG image of ' || w || ' x ' || h || ' pixels, ' || size || ' bytes' AS content, image_url, alt_text
  FROM i WHERE least(w, h) >= 100)
SELECT source_uri, chunk_index, content, substr(sha256(content), 1, 16) AS content_hash, image_url, alt_text FROM f
UNION ALL SELECT source_uri, NULL, NULL, NULL, NULL, NULL FROM p WHERE page_id % 5 = 0""",
}
