"""Queries of analytics: folders, sessions, papers, spaces, facts, changes, figures, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import html as html_functions
from docloom.functions.chunking import chunk_structured, heading_level_of, markdown_chunks, python_chunks, section_chunks, short_image_refs_of
from docloom.functions.text import clean_string
from docloom.operators import facts, figures, graph, ingest, mutate, retrieval, stats
from docloom.plans import views
from docloom.plans.search_queries import _dot
from docloom.plans.views import CHUNKS_SQL
from docloom.session import table
from docloom.sources import bibtex, files
from docloom.streaming import misses

# --- folders and index -------------------------------------------------------------------


def folder_hash(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.folder_hash(views.chunks(spark, sf))


def folder_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.folder_summary(views.chunks(spark, sf))


def stale_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders to refresh after the German documents changed."""
    now = ingest.folder_hash(views.chunks(spark, sf))
    docs = views.documents(spark, sf).withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ingest.stale_folders(now, ingest.folder_hash(ingest.documents_to_chunks(docs)))


def _event_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id AS chunk_id", "concat('u', user_id) AS source_uri", "event_type AS source_type", "ts AS created_at")


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    return stats.index_status({t: table(spark, sf, t) for t in ("documents", "embeddings", "pages", "conversations", "events", "labels", "benchmark")})


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return stats.group_counts(docs, "lang").unionByName(stats.group_counts(docs, "source"))


def recent_sources(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recent_sources(_event_chunks(spark, sf))


def sources_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return _event_chunks(spark, sf).agg(F.count_distinct("source_uri").alias("n_sources"), F.count("*").alias("n_chunks"))


def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen on the same days, at least twice."""
    each = table(spark, sf, "events").selectExpr("concat('u', user_id) AS source_uri", "cast(ts AS date) AS session_id").distinct()
    return stats.cooccurrence_of(each, 2)


def session_links_union(spark: SparkSession, sf: str) -> DataFrame:
    """Old (user, day) links with new ones of purchases a day later."""
    old = table(spark, sf, "events").selectExpr("user_id AS chunk_id", "cast(cast(ts AS date) AS string) AS session_id").distinct()
    new = table(spark, sf, "events").where("event_type = 'purchase'").selectExpr("user_id AS chunk_id", "cast(date_add(cast(ts AS date), 1) AS string) AS session_id")
    return mutate.inserted(old, new, ["chunk_id", "session_id"])


def backfill_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    chunks = views.documents(spark, sf).selectExpr("doc_id AS chunk_id", "source_uri")
    return ingest.missing_vectors(chunks, table(spark, sf, "embeddings").selectExpr("vec_id AS chunk_id", "'default' AS space"), "default")


def duplicate_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text an earlier one has."""
    docs = views.documents(spark, sf).selectExpr("doc_id AS paper_id", "source_uri", "sha2(text, 256) AS content_hash")
    found = ingest.duplicate_files(docs.select("source_uri", "content_hash"), docs)
    return found.join(docs.select("source_uri", "paper_id"), "source_uri").where("paper_id <> duplicate_of_paper_id").select("source_uri", "duplicate_of_paper_id")


def new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of conversations' texts that no document has."""
    said = table(spark, sf, "conversations").selectExpr("concat('/chat/', conv_id, '-', turn) AS source_uri", "text")
    return ingest.new_chunks(views.chunks(spark, sf), ingest.documents_to_chunks(said)).select("source_uri", "chunk_index", "content_hash")


_EXTENSIONS = (".pdf", ".PDF", ".md", ".txt", ".typ", ".rst", ".py", ".rs", ".cpp", ".c", ".h", ".hpp", ".toml", ".yaml", ".yml", ".json", ".JSON", ".html", ".htm", ".js", ".ts", ".go", ".java", ".rb", ".sh", "", ".tar.gz")


def source_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types and strategies by file name: pages and documents with all sorts of extensions."""
    names = ", ".join(f"'{x}'" for x in _EXTENSIONS)
    paths = table(spark, sf, "pages").selectExpr("concat('/web/', page_id, '.HTML') AS path").unionByName(table(spark, sf, "documents").selectExpr(f"concat('/', source, '/', doc_id, element_at(array({names}), cast(doc_id % {len(_EXTENSIONS)} + 1 AS int))) AS path"))
    typed = paths.select("path", files.source_type("path").alias("source_type"))
    return typed.withColumn("chunk_strategy", ingest.strategy())


# --- papers ------------------------------------------------------------------------------


def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pair_similarity(views.vectors(spark, sf)).select("paper_a", "paper_b", F.round("score", 6).alias("score"), "evidence_chunk_id", "n")


def similar_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.similar_edges(graph.pair_similarity(views.vectors(spark, sf)), 0.3)
    return found.withColumn("confidence", F.round("confidence", 6))


_UNIT = f"list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')}))"
_PAIRS = f"""u AS (SELECT label, vec_id, {_UNIT} AS v FROM embeddings),
s AS (SELECT a.label AS paper_a, b.label AS paper_b, a.vec_id AS ca, b.vec_id AS cb, round({_dot('a.v', 'b.v')}, 9) AS c FROM u a JOIN u b ON a.label < b.label),
t AS (SELECT *, row_number() OVER (PARTITION BY paper_a, paper_b ORDER BY c DESC, ca, cb) AS p FROM s QUALIFY p <= 3),
pairs AS (SELECT paper_a, paper_b, avg(c) AS score, min_by(ca, p) AS evidence_chunk_id, count(*) AS n FROM t GROUP BY ALL)"""


def bounded_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Similar edges at the usual threshold between single vectors and their revisions, which lack the last 16 components."""
    rows = views.vectors(spark, sf).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    short = F.transform("embedding", lambda x, i: F.when(i < 48, x).otherwise(0.0))
    revised = rows.select((F.col("chunk_id") + REVISED).alias("chunk_id"), short.alias("embedding"))
    papers = rows.unionByName(revised).withColumn("paper_id", F.col("chunk_id"))
    found = graph.similar_edges(graph.similar_pairs(papers)[0])
    return found.select("source_paper_id", "target_paper_id", "relation_type", F.round("confidence", 6).alias("confidence"), "evidence_chunk_id")


REVISED = 1_000_000_000
_REVISED_SQL = f"""WITH p AS (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id + {REVISED}, list_transform(embedding, lambda x, i: CASE WHEN i <= 48 THEN x::DOUBLE ELSE 0.0 END) FROM embeddings),
s AS (SELECT a.id AS source_paper_id, b.id AS target_paper_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM p a JOIN p b ON a.id < b.id)
SELECT source_paper_id, target_paper_id, 'similar' AS relation_type, round(least(score, 1.0), 6) AS confidence, source_paper_id AS evidence_chunk_id
FROM s WHERE score >= {graph.PROPOSE}"""


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between nations: who supplies whom."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS source_paper_id")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).selectExpr("o_orderkey AS l_orderkey", "c_nationkey AS target_paper_id")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").join(o, "l_orderkey").groupBy("source_paper_id", "target_paper_id").agg(F.lit("cites").alias("relation_type"), F.round(F.count("*") / 1000, 6).alias("confidence"))


_TRADE = """e AS (SELECT s_nationkey AS source_paper_id, c_nationkey AS target_paper_id, 'cites' AS relation_type, round(count(*) / 1000, 6) AS confidence
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def edge_both_directions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.both_directions(_trade(spark, sf))


def relationships_titles(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").selectExpr("n_nationkey AS paper_id", "n_name AS title")
    return graph.with_titles(_trade(spark, sf), nations).select("source_paper_id", "target_paper_id", "source_title", "target_title", "confidence")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").selectExpr("conv_id * 1000000 + turn AS id", "conv_id", "turn")
    return turns.select("id", F.lead("id").over(Window.partitionBy("conv_id").orderBy("turn")).alias("superseded_by"))


def supersession_chain(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    return graph.chains(links, links.select("id").join(links.selectExpr("superseded_by AS id"), "id", "left_anti"))


def chain_with_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Customers linked by the remainder of a square, which makes cycles and ends."""
    links = table(spark, sf, "customer").selectExpr("c_custkey AS id", "if(c_custkey % 11 = 0, null, (c_custkey * c_custkey + 1) % 97 + 1) AS superseded_by")
    return graph.chains(links, links.select("id"))


def _literature(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents that each name one part, its DOI or a strange one, and an author; parts as papers; some edges."""
    part = table(spark, sf, "part")
    papers = part.selectExpr("p_partkey AS paper_id", "p_name AS title", "array(concat(substring('ABCDE', 1 + cast(p_partkey % 5 AS int), 1), 'author, K.'), p_brand) AS authors", "cast(1990 + p_size % 3 AS int) AS year", "concat('10.5555/p', p_partkey) AS doi")
    docs = table(spark, sf, "documents").selectExpr("doc_id", "text", "doc_id % 97 + 1 AS p_partkey")
    content = "concat(coalesce(text, ''), ' see ', p_name, ', 10.5555/p', doc_id % 150, if(doc_id % 4 = 0, ' (Bauthor et al., 1991)', ' and Cauthor (1992) too'))"
    texts = docs.join(part.select("p_partkey", "p_name"), "p_partkey").selectExpr("doc_id AS paper_id", f"{content} AS content")
    edges = papers.selectExpr("paper_id + 1 AS source_paper_id", "paper_id AS target_paper_id", "'cites' AS relation_type")
    return texts, papers, edges


_LIT = """papers AS (SELECT p_partkey AS paper_id, p_name AS title, [substr('ABCDE', 1 + (p_partkey % 5)::INT, 1) || 'author, K.', p_brand] AS authors, (1990 + p_size % 3)::INT AS year, '10.5555/p' || p_partkey AS doi FROM part),
texts AS (SELECT doc_id AS paper_id, coalesce(text, '') || ' see ' || p_name || ', 10.5555/p' || (doc_id % 150) || CASE WHEN doc_id % 4 = 0 THEN ' (Bauthor et al., 1991)' ELSE ' and Cauthor (1992) too' END AS content FROM documents JOIN part ON p_partkey = doc_id % 97 + 1),
dois AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(content, '10\\.\\d{4,}/[^\\s,;}\\])\"'']+')) AS doi FROM texts),
by_doi AS (SELECT d.doi, d.paper_id, p.paper_id AS target_paper_id FROM dois d LEFT JOIN papers p ON p.doi = d.doi LEFT JOIN papers o ON o.paper_id = d.paper_id WHERE o.doi IS NULL OR o.doi <> d.doi),
cited AS (SELECT paper_id, unnest(regexp_extract_all(content, '\\(([A-Z][a-zA-Z''\\-]+)(?:\\s+(?:et\\s+al\\.|&\\s+[A-Z][a-zA-Z''\\-]+))?,\\s*((?:19|20)\\d{2})\\)')) AS m FROM texts
UNION ALL SELECT paper_id, unnest(regexp_extract_all(content, '([A-Z][a-zA-Z''\\-]+)(?:\\s+et\\s+al\\.)?\\s+\\(((?:19|20)\\d{2})\\)')) FROM texts),
named AS (SELECT DISTINCT paper_id, lower(regexp_extract(m, '[A-Z][a-zA-Z''\\-]+')) AS surname, regexp_extract(m, '(?:19|20)\\d{2}')::INT AS year FROM cited),
author AS (SELECT paper_id, year, unnest(authors) AS a FROM papers),
surnames AS (SELECT DISTINCT paper_id, year, lower(CASE WHEN contains(a, ',') THEN trim(split_part(a, ',', 1)) ELSE split_part(trim(a), ' ', -1) END) AS surname FROM author),
by_author AS (SELECT c.paper_id, n.paper_id AS target_paper_id, c.surname, c.year FROM named c JOIN surnames n ON n.surname = c.surname AND n.year = c.year WHERE c.paper_id <> n.paper_id)"""
# The 29 words that do not count in titles, written out.
_TITLE_STOP = "'a', 'an', 'the', 'of', 'in', 'on', 'at', 'to', 'for', 'and', 'or', 'is', 'are', 'was', 'were', 'be', 'by', 'with', 'from', 'as', 'its', 'this', 'that', 'not', 'but', 'no', 'via', 'using', 'based'"


def _ratio_sql(titles: str, texts: str) -> str:
    """Shares of the words of titles (t, title) in texts (paper_id, content)."""
    return f"""s AS (SELECT t, string_split_regex(trim(title, ' '), '\\s+') AS w FROM ({titles})), w AS (SELECT t, lower(unnest(w)) AS word FROM s WHERE len(w) >= 3),
k AS (SELECT * FROM w WHERE length(word) > 2 AND word NOT IN ({_TITLE_STOP})), n AS (SELECT t, count(*) AS n FROM k GROUP BY t HAVING count(*) >= 2),
x AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM ({texts})), h AS (SELECT paper_id, t, count(*) AS c FROM k JOIN x USING (word) GROUP BY ALL),
ratios AS (SELECT paper_id, t AS target_paper_id, c::DOUBLE / n AS ratio FROM h JOIN n USING (t) WHERE c::DOUBLE / n >= 0.6 AND paper_id <> t)"""


def doi_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    texts, papers, _ = _literature(spark, sf)
    return graph.doi_matches(texts, papers)


def author_year_citations(spark: SparkSession, sf: str) -> DataFrame:
    texts, papers, _ = _literature(spark, sf)
    return graph.author_year_matches(texts, papers)


def title_word_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the benchmark texts' words, as titles, that each document has."""
    titles = table(spark, sf, "benchmark").selectExpr("-1 - item_id AS paper_id", "text AS title")
    texts = table(spark, sf, "documents").selectExpr("doc_id AS paper_id", "text AS content")
    return graph.title_ratios(texts, titles).withColumn("ratio", F.round("ratio", 6))


def suggest_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return graph.suggest(*_literature(spark, sf))


def bibtex_key_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return bibtex.keys(views.papers(spark, sf))


def bibtex_entries(spark: SparkSession, sf: str) -> DataFrame:
    return bibtex.entries(views.papers(spark, sf))


_KEYS_SQL = """p AS (SELECT s_suppkey AS paper_id, s_name AS title, substr('ABCDE', 1 + (s_suppkey % 5)::INT, 1) || 'author, ' || s_name AS a1, (1990 + s_nationkey % 3)::INT AS year, 'Venue ' || s_nationkey AS venue FROM supplier),
b AS (SELECT *, lower(regexp_replace(split_part(a1, ',', 1), '[^a-zA-Z]', '', 'g')) || year AS base FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY paper_id) AS n FROM b),
k AS (SELECT *, base || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr((n + 95)::INT) ELSE (n - 26)::VARCHAR END AS key FROM n)"""


# --- spaces and facts --------------------------------------------------------------------


def _space_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from docloom.functions.vectors import truncated

    v, q = views.vectors(spark, sf), views.query_vectors(spark, sf)
    short = v.withColumn("embedding", truncated("embedding", 32))
    short_q = q.withColumn("qvec", truncated("qvec", 32))
    return retrieval.nearest(q, v, "chunk_id", 10), retrieval.nearest(short_q, short, "chunk_id", 10)


def space_overlap(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.compare_spaces(*_space_results(spark, sf), "chunk_id", 10)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("overlap", "jaccard", "rho")])


def batch_space_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.batch_stats(stats.compare_spaces(*_space_results(spark, sf), "chunk_id", 10))
    return found.select("measure", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "n")


def _ranked_sql(name: str, shape: str) -> str:
    distance = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))"
    return f"""{name}v AS (SELECT vec_id, {shape} AS v FROM embeddings),
{name} AS (SELECT b.vec_id::INT AS query_id, a.vec_id AS chunk_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({distance}, 9), a.vec_id) AS r
  FROM {name}v a, {name}v b WHERE b.vec_id IN (0, 7, 42) QUALIFY r <= 10)"""


_SHORT = f"list_transform(list_slice(embedding, 1, 32), lambda x: x::DOUBLE / sqrt({_dot('list_slice(embedding, 1, 32)', 'list_slice(embedding, 1, 32)')}))"
_COMPARED = f"""{_ranked_sql('a', 'embedding')}, {_ranked_sql('b', _SHORT)},
j AS (SELECT query_id, chunk_id, a.r AS ra, b.r AS rb FROM a FULL JOIN b USING (query_id, chunk_id)),
d AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ra) - row_number() OVER (PARTITION BY query_id ORDER BY rb) AS d FROM j WHERE ra IS NOT NULL AND rb IS NOT NULL),
x AS (SELECT query_id, count(*) AS n, count(ra) AS na, count(rb) AS nb FROM j GROUP BY query_id),
y AS (SELECT query_id, count(*) AS c, sum(d * d) AS d2 FROM d GROUP BY query_id),
z AS (SELECT query_id, coalesce(c, 0)::DOUBLE / least(10, na, nb) AS overlap, coalesce(c, 0)::DOUBLE / n AS jaccard, CASE WHEN c >= 5 THEN 1 - 6 * d2 / (c::DOUBLE * (c::DOUBLE * c - 1)) END AS rho FROM x LEFT JOIN y USING (query_id))"""


def storage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Every label of the vectors as a space, some truncated, some of bytes."""
    dims = table(spark, sf, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("d"))
    return stats.storage_ratio(dims.selectExpr("concat('s', label) AS name", "cast(d div (1 + label % 3) AS int) AS dim", "if(label % 2 = 0, 'float32', 'int8') AS element_type"))


def _fact_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts as datasets of papers, nations as methods, order lines as metrics, suppliers as papers."""
    datasets = table(spark, sf, "part").selectExpr("p_partkey AS id", "concat(p_brand, ' ', p_type) AS name", "p_partkey % 40 AS paper_id")
    methods = table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name")
    metrics = table(spark, sf, "lineitem").selectExpr("l_returnflag AS name", "l_extendedprice AS value", "'usd' AS unit", "l_partkey AS dataset_id", "cast(if(l_orderkey % 7 = 0, null, l_orderkey % 25) AS int) AS method_id", "l_suppkey AS paper_id", "l_orderkey * 10 + l_linenumber AS id")
    return metrics, datasets, methods, table(spark, sf, "supplier").selectExpr("s_suppkey AS paper_id", "s_name AS title")


_FACTS = """ds AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS name, p_partkey % 40 AS paper_id FROM part),
me AS (SELECT l_returnflag AS name, l_extendedprice AS value, l_partkey AS dataset_id, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_orderkey % 25 END AS method_id, l_suppkey AS paper_id, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"""


def shared_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return facts.shared_datasets(_fact_tables(spark, sf)[1])


def metrics_view(spark: SparkSession, sf: str) -> DataFrame:
    metrics, datasets, methods, _ = _fact_tables(spark, sf)
    return facts.metrics_view(metrics, methods, datasets).select("id", F.col("name").alias("metric"), "value", "dataset", "method")


def metric_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The values of each metric on each shared dataset, best first."""
    metrics, datasets, methods, papers = _fact_tables(spark, sf)
    return facts.compare_papers(metrics, datasets, methods, papers)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as facts of papers: types as methods and brands as datasets in several spellings, some blank, some metrics."""
    kind = "CASE WHEN p_partkey % 10 = 9 THEN 'metric' WHEN p_partkey % 2 = 0 THEN 'method' ELSE 'dataset' END AS kind"
    name = "CASE WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 3 = 0 THEN concat(' ', upper(p_type), ' ') WHEN p_partkey % 3 = 1 THEN lower(p_brand) ELSE p_type END AS name"
    told = "CASE WHEN p_size % 4 = 0 THEN null WHEN p_size % 4 = 1 THEN '' ELSE p_type END AS description"
    forms = "if(p_partkey % 4 = 0, null, array(p_brand, p_name)) AS surface_forms"
    return table(spark, sf, "part").selectExpr("p_partkey % 40 AS paper_id", "p_partkey AS chunk_id", kind, name, told, forms)


def _fact_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Brands and what they are called."""
    return table(spark, sf, "part").selectExpr("'dataset' AS kind", "p_brand AS surface", "concat('M', p_brand) AS canonical_name").distinct()


def entity_mentions_fold(spark: SparkSession, sf: str) -> DataFrame:
    return facts.mentions(_facts(spark, sf)).withColumn("surface_forms", F.array_join("surface_forms", "|"))


def canonical_entities(spark: SparkSession, sf: str) -> DataFrame:
    return facts.canonical(_facts(spark, sf), _fact_groups(spark, sf)).withColumn("surface_forms", F.array_join("surface_forms", "|"))


_EX = """f AS (SELECT p_partkey % 40 AS paper_id, p_partkey AS chunk_id, CASE WHEN p_partkey % 10 = 9 THEN 'metric' WHEN p_partkey % 2 = 0 THEN 'method' ELSE 'dataset' END AS kind,
CASE WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 3 = 0 THEN ' ' || upper(p_type) || ' ' WHEN p_partkey % 3 = 1 THEN lower(p_brand) ELSE p_type END AS name,
CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '' ELSE p_type END AS description, CASE WHEN p_partkey % 4 <> 0 THEN [p_brand, p_name] END AS forms FROM part),
g AS (SELECT *, lower(trim(name)) AS key, coalesce(forms, [name]) AS ff FROM f WHERE kind <> 'metric' AND trim(name) <> '')"""


def extraction_estimate(spark: SparkSession, sf: str) -> DataFrame:
    chunks = views.chunks(spark, sf).withColumnRenamed("source_uri", "paper_id")
    return facts.extraction_estimate(chunks)


# --- changes -----------------------------------------------------------------------------


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last purchase of each user in place of the first event of each user and type."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    old = events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"), F.min("event_id").alias("event_id"))
    return mutate.upserted(old, events.where("event_type = 'purchase'"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


def conclusions_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as claims, some superseded by the next."""
    claims = table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS claim", "cast(doc_id % 10 AS double) / 10 AS confidence", "if(doc_id % 4 = 0, doc_id + 1, null) AS superseded_by")
    return mutate.get_conclusions(claims, "Und", 0.5).select("id", "claim", "confidence")


def json_reference_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as conclusions from their parts, when most parts go; each tenth has no evidence."""
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "if(o_orderkey % 3 = 0, o_orderkey + 1, null) AS superseded_by")
    none = F.array().cast("array<long>")
    conclusions = orders.join(parts, "id", "left").withColumn("source_chunk_ids", F.when(F.col("id") % 10 == 0, none).otherwise(F.coalesce(F.col("parts").cast("array<long>"), none))).drop("parts")
    gone = table(spark, sf, "part").where("p_size <= 40").selectExpr("p_partkey AS chunk_id")
    return mutate.cleaned_conclusions(conclusions, gone).select("id", F.array_join(F.array_sort("source_chunk_ids"), ",").alias("chunk_ids"), "superseded_by")


def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs; purchases come again as new ones."""
    jobs = table(spark, sf, "events").selectExpr("event_id AS id", "user_id AS paper_id", "event_type AS job_type", "if(event_id % 5 = 0, null, '{}') AS params", "element_at(array('pending', 'running', 'completed', 'failed'), cast(event_id % 4 + 1 AS int)) AS status")
    new = jobs.where("job_type = 'purchase'").selectExpr("id + 100000000 AS id", "paper_id", "job_type", "params", "'pending' AS status")
    return mutate.job_submitted(jobs, new).select("id", "paper_id", "status")


def space_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far two spaces are filled for all documents."""
    spaces = spark.createDataFrame([("default", "mechanical", "populating"), ("empty", "mechanical", "populating")], "name string, chunk_strategy string, status string")
    chunks = table(spark, sf, "documents").selectExpr("doc_id AS chunk_id", "'mechanical' AS chunk_strategy")
    return mutate.space_progress(spaces, chunks, table(spark, sf, "embeddings").selectExpr("vec_id AS chunk_id", "'default' AS space"))


def miss_log_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Error events of each user, at most one an hour."""
    errors = table(spark, sf, "events").where("event_type = 'error'").selectExpr("user_id", "date_trunc('SECOND', ts) AS detected_at")
    return misses.hourly(errors, ["user_id"]).withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"))


def miss_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Events as search outcomes."""
    outcomes = table(spark, sf, "events").selectExpr("concat('  Query ', user_id % 50, ' ') AS query", "if(event_id % 3 = 0, 'fts', 'hybrid') AS mode", "event_id % 4 AS n_results", "value / 1000 AS top_score", "event_id AS top_chunk_id", "cast(null AS string) AS source_type_filter", "ts")
    return misses.detected(outcomes).groupBy("query", "query_hash", "error_type").agg(F.count("*").alias("n"), F.count("top_score").alias("n_scores"))


# --- figures and pages -------------------------------------------------------------------


def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of boxes made of vector components, a page for each label and hundred."""
    box = lambda i: f"(cast(embedding[{i}] AS double) + 1) / 2"
    boxes = table(spark, sf, "embeddings").selectExpr("label * 1000 + vec_id div 100 AS page", f"{box(0)} AS x1", f"{box(1)} AS y1", f"{box(0)} + 0.01 AS x2", f"{box(1)} + 0.01 AS y2")
    return figures.regions(boxes, 0.02)


_GAPS = """b AS (SELECT label * 1000 + vec_id // 100 AS page, (embedding[1]::DOUBLE + 1) / 2 AS x1, (embedding[2]::DOUBLE + 1) / 2 AS y1, (embedding[1]::DOUBLE + 1) / 2 + 0.01 AS x2, (embedding[2]::DOUBLE + 1) / 2 + 0.01 AS y2 FROM embeddings),
r1 AS (SELECT *, coalesce((y1 - lag(y2) OVER w >= 0.02)::INT, 0) AS j FROM b WINDOW w AS (PARTITION BY page ORDER BY (y1 + y2) / 2, x1, y1, x2, y2)),
r2 AS (SELECT *, sum(j) OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, x1, y1, x2, y2) AS r FROM r1),
c1 AS (SELECT *, coalesce((x1 - lag(x2) OVER w >= 0.02)::INT, 0) AS k FROM r2 WINDOW w AS (PARTITION BY page, r ORDER BY (x1 + x2) / 2, x1, y1, x2, y2)),
c2 AS (SELECT *, sum(k) OVER (PARTITION BY page, r ORDER BY (x1 + x2) / 2, x1, y1, x2, y2) AS c FROM c1),
g AS (SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM c2 GROUP BY page, r, c),
h AS (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM g)"""


def figure_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of their source: those with digits or little text."""
    pages = table(spark, sf, "documents").selectExpr("source AS source_uri", "doc_id AS page", "cast(doc_id % 97 = 0 AS int) AS n_images", "cast(doc_id % 23 AS int) AS n_drawings", "length(text) AS text_len", "text RLIKE 'License' AS has_caption")
    return figures.figure_pages(pages)


def _captioned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents behind an image and, some lines below, a caption; sources as files."""
    content = "concat('intro\\n![x](img/', doc_id % 50, '.png)\\n', repeat('line\\n', cast(doc_id % 6 AS int)), if(doc_id % 7 = 0, 'no caption', concat('Figure ', doc_id, ' shows')), '\\n', coalesce(text, ''))"
    return table(spark, sf, "documents").selectExpr("doc_id AS chunk_id", "concat('/', source, '.pdf') AS source_uri", f"{content} AS content", "array(concat(doc_id % 50, '.png'), concat(doc_id % 3, '.gif')) AS images", "if(doc_id % 5 = 0, cast(array() AS array<int>), array(cast(doc_id % 9 + 2 AS int), 30)) AS pages")


def image_captions(spark: SparkSession, sf: str) -> DataFrame:
    return figures.image_captions(_captioned(spark, sf))


def image_pages(spark: SparkSession, sf: str) -> DataFrame:
    return figures.image_pages(_captioned(spark, sf))


def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of every page."""
    found = html_functions.pages_to_documents(table(spark, sf, "pages"))
    return found.select("source_uri", "title", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"), F.length("text").alias("n_chars"))


# The given pages have their content in one article; the operator is not told so and finds it by its scores.
_ARTICLE_SQL = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"
_ARTICLE_SQL = f"regexp_replace(regexp_replace({_ARTICLE_SQL}, '</?(p|br|h1)>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _mark, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;?", "&")):
    _ARTICLE_SQL = f"regexp_replace({_ARTICLE_SQL}, '{_mark}', '{_char}', 'g')"
_ARTICLE_SQL = f"trim(regexp_replace({_ARTICLE_SQL}, ' *\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


def page_images(spark: SparkSession, sf: str) -> DataFrame:
    return html_functions.page_images(table(spark, sf, "pages").withColumn("html", F.concat("html", F.lit('<img src="/pic/a.png" alt="A chart"><img src="logo/x_logo.png"><picture><source srcset="b.png 1x, c.png 2x"><img src="d.png"></picture>'))))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_structured(views.documents(spark, sf), "source_uri", "text", markdown_chunks).select("source_uri", "chunk_index", F.length("text").alias("n_chars"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_structured(views.documents(spark, sf), "source_uri", "text", section_chunks).select("source_uri", "chunk_index", F.length("text").alias("n_chars"))


def python_source(spark: SparkSession, sf: str) -> DataFrame:
    """A module for each part; each ninth can't be parsed."""
    source = "concat('import os\\n\\n\\ndef f', p_partkey, '(x):\\n    return x\\n\\n\\nclass A', p_partkey, ':\\n    y = 1\\n\\n\\nz = 2\\n', if(p_partkey % 9 = 0, 'def (', ''))"
    return chunk_structured(table(spark, sf, "part").selectExpr("p_partkey AS id", f"{source} AS source"), "id", "source", python_chunks)


def text_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Heading level, short image references and clean strings of documents with such marks."""
    t = "concat(repeat('#', cast(doc_id % 9 AS int)), ' A', chr(doc_id % 31 + 1), 'b ![x](d/e', doc_id, '.png)', chr(127), ' ', coalesce(text, ''))"
    rows = table(spark, sf, "documents").selectExpr("doc_id AS id", f"{t} AS t")
    return rows.select("id", heading_level_of("t").alias("level"), F.sha2(short_image_refs_of("t"), 256).alias("refs"), clean_string(F.col("t"), 200).alias("clean"))


QUERIES = {f.__name__: f for f in (
    folder_hash, folder_summary, stale_folders, index_status, group_counts, recent_sources, sources_distinct, cooccurrence, session_links_union, backfill_anti_join,
    duplicate_files, new_chunks, source_types, pair_similarity, similar_edges, bounded_edges, edge_both_directions, relationships_titles, supersession_chain, chain_with_cycle, doi_unmatched,
    author_year_citations, title_word_ratio, suggest_relationships, bibtex_key_suffix, bibtex_entries, space_overlap, batch_space_stats, storage_ratio, shared_datasets,
    metrics_view, metric_comparison, entity_mentions_fold, canonical_entities, extraction_estimate, upsert_latest, conclusions_filter, json_reference_cleanup, job_queue,
    space_progress, miss_log_hourly, miss_detection, gap_clusters, figure_pages, image_captions, image_pages, page_documents, page_images, python_source, text_cleaning,
)} | {"markdown_chunks": markdown, "section_chunks": sections}

ORACLES = {
    "folder_hash": f"WITH {CHUNKS_SQL} SELECT regexp_replace(source_uri, '/[^/]*$', '') AS folder_path, substr(sha256(string_agg(DISTINCT content_hash, '|' ORDER BY content_hash)), 1, 16) AS content_hash FROM chunks GROUP BY 1",
    "folder_summary": f"WITH {CHUNKS_SQL}, f AS (SELECT source_uri, regexp_replace(source_uri, '/[^/]*$', '') AS folder_path, replace(substr(content, 1, 200), chr(10), ' ') AS s FROM chunks QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY chunk_index) = 1) SELECT folder_path, string_agg(split_part(source_uri, '/', -1) || ': ' || s, chr(10) ORDER BY source_uri) AS summary FROM f GROUP BY 1",
    "stale_folders": "SELECT DISTINCT '/' || source AS folder_path, 'refresh' AS action FROM documents WHERE lang = 'de'",
    "index_status": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "pages", "conversations", "events", "labels", "benchmark")),
    "group_counts": "SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL",
    "recent_sources": "SELECT 'u' || user_id AS source_uri, min_by(event_type, event_id) AS source_type, count(*) AS n_chunks, max(ts) AS last_at FROM events GROUP BY 1 ORDER BY last_at DESC, source_uri LIMIT 5",
    "sources_distinct": "SELECT count(DISTINCT user_id) AS n_sources, count(*) AS n_chunks FROM events",
    "cooccurrence": "WITH e AS (SELECT DISTINCT 'u' || user_id AS u, ts::DATE AS d FROM events) SELECT a.u AS uri_a, b.u AS uri_b, count(*) AS co_sessions FROM e a JOIN e b ON a.d = b.d AND a.u < b.u GROUP BY ALL HAVING count(*) >= 2",
    "session_links_union": "SELECT user_id AS chunk_id, (ts::DATE)::VARCHAR AS session_id FROM events UNION SELECT user_id, (ts::DATE + 1)::VARCHAR FROM events WHERE event_type = 'purchase'",
    "backfill_anti_join": "SELECT doc_id AS chunk_id, '/' || source || '/' || doc_id || '.md' AS source_uri FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "duplicate_files": "SELECT '/' || source || '/' || doc_id || '.md' AS source_uri, first AS duplicate_of_paper_id FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id <> first",
    "new_chunks": f"WITH {CHUNKS_SQL}, v AS (SELECT '/chat/' || conv_id || '-' || turn AS source_uri, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 1000) / 800.0)::BIGINT + 1 END)) AS w FROM conversations WHERE text IS NOT NULL), x AS (SELECT source_uri, w, substr(text, w * 800 + 1, 1000) AS content FROM v), y AS (SELECT source_uri, (row_number() OVER (PARTITION BY source_uri ORDER BY w) - 1)::INT AS chunk_index, substr(sha256(content), 1, 16) AS content_hash FROM x WHERE regexp_matches(content, '\\S')) SELECT * FROM y WHERE content_hash NOT IN (SELECT content_hash FROM chunks) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY source_uri, chunk_index) = 1",
    "source_types": f"WITH n AS (SELECT '/web/' || page_id || '.HTML' AS path FROM pages UNION ALL SELECT '/' || source || '/' || doc_id || ({list(_EXTENSIONS)})[doc_id % {len(_EXTENSIONS)} + 1] FROM documents), p AS (SELECT path, CASE WHEN path ILIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(path), '[.](py|rs|cpp|c|h|hpp|toml|yaml|yml|json)$') THEN 'code' ELSE 'markdown' END AS source_type FROM n) SELECT *, CASE WHEN source_type = 'pdf' THEN 'semantic' ELSE 'mechanical' END AS chunk_strategy FROM p",
    "pair_similarity": f"WITH {_PAIRS} SELECT paper_a, paper_b, round(score, 6) AS score, evidence_chunk_id, n FROM pairs",
    "bounded_edges": _REVISED_SQL,
    "similar_edges": f"WITH {_PAIRS} SELECT paper_a AS source_paper_id, paper_b AS target_paper_id, 'similar' AS relation_type, round(least(score, 1.0), 6) AS confidence, evidence_chunk_id FROM pairs WHERE score >= 0.3",
    "edge_both_directions": f"WITH {_TRADE} SELECT source_paper_id AS paper_id, target_paper_id AS other_paper_id, 'out' AS direction, relation_type, confidence FROM e UNION ALL SELECT target_paper_id, source_paper_id, 'in', relation_type, confidence FROM e",
    "relationships_titles": f"WITH {_TRADE} SELECT source_paper_id, target_paper_id, s.n_name AS source_title, t.n_name AS target_title, confidence FROM e JOIN nation s ON s.n_nationkey = source_paper_id JOIN nation t ON t.n_nationkey = target_paper_id",
    "supersession_chain": "WITH RECURSIVE l AS (SELECT conv_id * 1000000 + turn AS id, lead(conv_id * 1000000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), w AS (SELECT id AS start, id, 0 AS depth FROM l WHERE n = 1 UNION ALL SELECT w.start, l.nx, w.depth + 1 FROM w JOIN l ON l.id = w.id WHERE l.nx IS NOT NULL) SELECT start, id, depth FROM w",
    "chain_with_cycle": "WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * c_custkey + 1) % 97 + 1 END AS nx FROM customer), w AS (SELECT id AS start, id, 0 AS depth, [id] AS seen FROM l UNION ALL SELECT w.start, l.nx, w.depth + 1, list_append(w.seen, l.nx) FROM w JOIN l ON l.id = w.id WHERE l.nx IS NOT NULL AND NOT list_contains(w.seen, l.nx)) SELECT start, id, depth FROM w",
    "doi_unmatched": f"WITH {_LIT} SELECT doi, paper_id, target_paper_id FROM by_doi",
    "author_year_citations": f"WITH {_LIT} SELECT * FROM by_author",
    "title_word_ratio": "WITH " + _ratio_sql("SELECT -1 - item_id AS t, text AS title FROM benchmark", "SELECT doc_id AS paper_id, text AS content FROM documents") + " SELECT paper_id, target_paper_id, round(ratio, 6) AS ratio FROM ratios",
    "suggest_relationships": f"WITH {_LIT}, " + _ratio_sql("SELECT paper_id AS t, title FROM papers", "SELECT * FROM texts") + """, every AS (SELECT paper_id, target_paper_id, 'doi' AS match_method, 0.9::DOUBLE AS confidence, 0 AS o FROM by_doi WHERE target_paper_id IS NOT NULL
UNION ALL SELECT paper_id, target_paper_id, 'title_words', round_even(0.3 + (ratio - 0.6) * 0.75, 2), 1 FROM ratios UNION ALL SELECT DISTINCT paper_id, target_paper_id, 'author_year', 0.4, 2 FROM by_author)
SELECT paper_id, target_paper_id, match_method, confidence FROM every WHERE paper_id <> target_paper_id AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = every.target_paper_id AND every.paper_id = p.paper_id + 1)
QUALIFY row_number() OVER (PARTITION BY paper_id, target_paper_id ORDER BY o) = 1""",
    "bibtex_key_suffix": f"WITH {_KEYS_SQL} SELECT paper_id, key FROM k",
    "bibtex_entries": f"WITH {_KEYS_SQL} SELECT paper_id, key, '% docloom-paper: ' || paper_id || chr(10) || '@article{{' || key || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) || '  author = {{' || a1 || ' and ' || title || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '  journal = {{' || venue || '}},' || chr(10) || '}}' AS entry FROM k".replace("{{", "{").replace("}}", "}"),
    "space_overlap": f"WITH {_COMPARED} SELECT query_id, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, round(rho, 6) AS rho FROM z",
    "batch_space_stats": f"WITH {_COMPARED}, l AS (SELECT 'overlap' AS measure, overlap AS x FROM z UNION ALL SELECT 'jaccard', jaccard FROM z UNION ALL SELECT 'rho', rho FROM z) SELECT measure, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY measure",
    "storage_ratio": "WITH d AS (SELECT label, max(len(embedding)) // (1 + label % 3) * CASE WHEN label % 2 = 0 THEN 4 ELSE 1 END AS bytes FROM embeddings GROUP BY label) SELECT 's' || label AS name, bytes, bytes::DOUBLE / max(bytes) OVER () AS ratio FROM d",
    "shared_datasets": f"WITH {_FACTS} SELECT name, count(DISTINCT paper_id) AS n_papers FROM ds GROUP BY name HAVING count(DISTINCT paper_id) >= 2",
    "metrics_view": f"WITH {_FACTS} SELECT me.id, me.name AS metric, value, ds.name AS dataset, n_name AS method FROM me LEFT JOIN ds ON ds.id = dataset_id LEFT JOIN nation ON n_nationkey = method_id",
    "metric_comparison": f"WITH {_FACTS}, s AS (SELECT name FROM ds GROUP BY name HAVING count(DISTINCT paper_id) >= 2) SELECT ds.name AS dataset, me.name AS metric, value, 'usd' AS unit, n_name AS method, me.paper_id, s_name AS title, (row_number() OVER (PARTITION BY ds.name, me.name ORDER BY value DESC, me.paper_id, me.id))::INT AS place FROM me JOIN ds ON ds.id = dataset_id JOIN s ON s.name = ds.name JOIN supplier ON s_suppkey = me.paper_id LEFT JOIN nation ON n_nationkey = method_id",
    "entity_mentions_fold": f"WITH {_EX}, n AS (SELECT paper_id, kind, key, min_by(name, chunk_id) AS name FROM g GROUP BY ALL), u AS (SELECT DISTINCT paper_id, kind, key, unnest(ff) AS s FROM g) SELECT paper_id, kind, key, name, string_agg(s, '|' ORDER BY s) AS surface_forms FROM n JOIN u USING (paper_id, kind, key) GROUP BY ALL",
    "canonical_entities": f"WITH {_EX}, m AS (SELECT DISTINCT lower(p_brand) AS key, 'M' || p_brand AS canon FROM part), h AS (SELECT g.*, CASE WHEN kind = 'dataset' AND canon IS NOT NULL THEN canon ELSE trim(name) END AS canonical_name FROM g LEFT JOIN m USING (key)), n AS (SELECT paper_id, kind, canonical_name, max_by(description, chunk_id) FILTER (coalesce(description, '') <> '') AS description, max(chunk_id) FILTER (coalesce(description, '') <> '') AS chunk_id FROM h GROUP BY ALL), u AS (SELECT DISTINCT paper_id, kind, canonical_name, unnest(ff) AS s FROM h) SELECT paper_id, kind, canonical_name, description, chunk_id, string_agg(s, '|' ORDER BY s) AS surface_forms FROM n JOIN u USING (paper_id, kind, canonical_name) GROUP BY ALL",
    "extraction_estimate": f"WITH {CHUNKS_SQL} SELECT source_uri AS paper_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars, sum(length(content)) <= 8000 AS single_pass, count(*) * 4 AS seconds FROM chunks GROUP BY 1",
    "upsert_latest": "WITH o AS (SELECT user_id, event_type, min_by(value, event_id) AS value FROM events GROUP BY ALL), n AS (SELECT user_id, event_type, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (user_id, event_type)",
    "conclusions_filter": "SELECT doc_id AS id, text AS claim, (doc_id % 10)::DOUBLE / 10 AS confidence FROM documents WHERE contains(lower(text), 'und') AND doc_id % 10 >= 5 AND doc_id % 4 <> 0",
    "json_reference_cleanup": """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS sup, CASE WHEN o_orderkey % 10 = 0 THEN [] ELSE coalesce((SELECT list(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), []) END AS ids FROM orders),
z AS (SELECT list(p_partkey) AS lost FROM part WHERE p_size <= 40), k AS (SELECT id, sup, ids, list_filter(ids, lambda x: NOT list_contains(lost, x)) AS kept FROM c, z), e AS (SELECT id FROM k WHERE len(ids) > 0 AND len(kept) = 0)
SELECT id, array_to_string(list_sort(kept), ',') AS chunk_ids, CASE WHEN sup NOT IN (SELECT id FROM e) THEN sup END AS superseded_by FROM k WHERE id NOT IN (SELECT id FROM e)""",
    "job_queue": """WITH j AS (SELECT event_id AS id, user_id AS paper_id, event_type AS job_type, CASE WHEN event_id % 5 <> 0 THEN '{}' END AS params, (['pending', 'running', 'completed', 'failed'])[event_id % 4 + 1] AS status FROM events),
n AS (SELECT min(id) + 100000000 AS id, paper_id, job_type, params FROM j WHERE job_type = 'purchase' GROUP BY paper_id, job_type, params)
SELECT id, paper_id, status FROM j UNION ALL SELECT id, paper_id, 'pending' FROM n WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.paper_id = n.paper_id AND j.job_type = n.job_type AND j.params IS NOT DISTINCT FROM n.params AND j.status IN ('pending', 'running'))""",
    "space_progress": "SELECT 'default' AS name, 'populating' AS status, (SELECT count(DISTINCT vec_id) FROM embeddings) AS chunk_count, (SELECT count(*) FROM documents) AS total_chunks UNION ALL SELECT 'empty', 'populating', 0, (SELECT count(*) FROM documents)",
    "miss_log_hourly": "WITH RECURSIVE e AS (SELECT DISTINCT user_id, date_trunc('second', ts) AS t FROM events WHERE event_type = 'error'), k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + INTERVAL 1 HOUR) FROM k WHERE k.t IS NOT NULL) SELECT user_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS detected_at FROM k WHERE t IS NOT NULL",
    "miss_detection": "WITH o AS (SELECT 'query ' || (user_id % 50) AS query, CASE WHEN event_id % 4 = 0 THEN 'no_results' WHEN event_id % 3 <> 0 AND value / 1000 < 0.025 THEN 'low_confidence' END AS error_type FROM events) SELECT query, sha256(query) AS query_hash, error_type, count(*) AS n, count(*) FILTER (error_type = 'low_confidence') AS n_scores FROM o WHERE error_type IS NOT NULL GROUP BY ALL",
    "gap_clusters": f"WITH {_GAPS} SELECT page, CASE WHEN n < 2 THEN 0.0 ELSE x1 END AS x1, CASE WHEN n < 2 THEN 0.0 ELSE y1 END AS y1, CASE WHEN n < 2 THEN 1.0 ELSE x2 END AS x2, CASE WHEN n < 2 THEN 1.0 ELSE y2 END AS y2 FROM h",
    "figure_pages": "WITH p AS (SELECT source AS source_uri, doc_id AS page, avg(length(text)) OVER (PARTITION BY source) AS m, length(text) AS l, text, doc_id FROM documents) SELECT source_uri, page FROM p WHERE doc_id % 97 = 0 OR doc_id % 23 > 10 OR m > 0 AND l < m * 0.5 OR contains(text, 'License')",
    "image_captions": """WITH c AS (SELECT doc_id AS chunk_id, '/' || source || '.pdf' AS source_uri, string_split('intro' || chr(10) || '![x](img/' || (doc_id % 50) || '.png)' || chr(10) || repeat('line' || chr(10), (doc_id % 6)::INT) || CASE WHEN doc_id % 7 = 0 THEN 'no caption' ELSE 'Figure ' || doc_id || ' shows' END || chr(10) || coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT chunk_id, source_uri, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM c),
i AS (SELECT chunk_id, source_uri, line AS spot, split_part(unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)), '/', -1) AS image FROM l),
k AS (SELECT chunk_id, source_uri, line, trim(text) AS caption FROM l WHERE regexp_matches(text, '(?i)(?:Figure|Fig\\.|Table)\\s+\\d+'))
SELECT source_uri, image, caption FROM i JOIN k USING (chunk_id, source_uri) WHERE line <> spot AND abs(line - spot) <= 3 QUALIFY row_number() OVER (PARTITION BY source_uri, image ORDER BY chunk_id, spot, line) = 1""",
    "image_pages": "WITH i AS (SELECT '/' || source || '.pdf' AS source_uri, unnest([(doc_id % 50) || '.png', (doc_id % 3) || '.gif']) AS image, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE (doc_id % 9 + 2)::INT END AS page FROM documents) SELECT source_uri, image, min(page) AS page FROM i GROUP BY ALL",
    "page_images": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS dir FROM pages),
i AS (SELECT page_id, 0 AS at_, host || '/pic/a.png' AS url, 'A chart' AS alt FROM p UNION ALL SELECT page_id, 1, CASE WHEN length(dir) < 9 THEN host || '/' ELSE dir END || 'c.png', '' FROM p)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY at_) - 1)::INT AS n, url, alt FROM i WHERE NOT regexp_matches(url, '(?i)[/_-](logo|favicon|avatar|banner|sprite|spacer|badge)[/_.-]|[/_-]ads?[/_-]|[/_-](tracking[_-]?pixel|1x1)[/_.-]')""",
    "markdown_chunks": f"WITH {CHUNKS_SQL} SELECT source_uri, chunk_index, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS n_chars FROM chunks",
    "section_chunks": """WITH d AS (SELECT '/' || source || '/' || doc_id || '.md' AS source_uri, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')) AS ps FROM documents WHERE regexp_matches(text, '\\S')),
c AS (SELECT source_uri, CASE WHEN length(whole) <= 8000 THEN [whole] ELSE list_reduce(list_transform(ps, lambda p: [p]), lambda a, b: CASE WHEN length(a[-1]) + 2 + length(b[1]) > 8000 THEN list_append(a, b[1]) ELSE list_append(a[1:len(a) - 1], a[-1] || chr(10) || chr(10) || b[1]) END) END AS parts FROM d)
SELECT source_uri, (generate_subscripts(parts, 1) - 1)::INT AS chunk_index, length(regexp_replace(unnest(parts), '^\\s+|\\s+$', '', 'g')) AS n_chars FROM c""",
    "page_documents": f"""WITH l AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS source_uri, html FROM pages
  QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY page_id DESC) = 1),
t AS (SELECT source_uri, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, {_ARTICLE_SQL} AS text FROM l)
SELECT source_uri, title, substr(sha256(text), 1, 16) AS text_hash, length(text) AS n_chars FROM t WHERE length(text) >= 1""",
    "python_source": """WITH p AS (SELECT p_partkey AS id, p_partkey::VARCHAR AS k FROM part WHERE p_partkey % 9 <> 0)
SELECT id, 0 AS chunk_index, 'import os' || repeat(chr(10), 7) || 'z = 2' AS text, '<module>' AS name, 'module' AS type, 1 AS start_line, 12 AS end_line FROM p
UNION ALL SELECT id, 1, 'def f' || k || '(x):' || chr(10) || '    return x', 'f' || k, 'function', 4, 5 FROM p
UNION ALL SELECT id, 2, 'class A' || k || ':' || chr(10) || '    y = 1', 'A' || k, 'class', 8, 9 FROM p""",
    "text_cleaning": """WITH r AS (SELECT doc_id AS id, repeat('#', (doc_id % 9)::INT) AS h, ' A' || chr((doc_id % 31 + 1)::INT) AS a, doc_id, coalesce(text, '') AS text FROM documents)
SELECT id, CASE WHEN length(h) BETWEEN 1 AND 6 THEN length(h)::INT END AS level, sha256(h || a || 'b ![x](e' || doc_id || '.png)' || chr(127) || ' ' || regexp_replace(text, '!\\[([^\\]]*)\\]\\((?:[^)]*/)?([^)/]+)\\)', '![\\1](\\2)', 'g')) AS refs,
  substr(regexp_replace(h || a || 'b ![x](d/e' || doc_id || '.png) ' || text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), 1, 200) AS clean FROM r""",
}
