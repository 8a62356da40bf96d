"""Queries of search: chunks, terms, ranks, vectors, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as text_functions
from docloom.functions.vectors import int8, normalised, truncated
from docloom.operators import cells, ingest, lexical, retrieval
from docloom.operators.index import Index
from docloom.plans import views
from docloom.plans.views import CHUNKS_SQL, WORDS_SQL
from docloom.session import shared_dir, table

TERMS = ((0, "the"), (0, "and"), (0, "of"), (1, "der"), (1, "und"), (2, "eresan"))
_Q = "q(query_id, term) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TERMS) + ")"
_BM25 = f"""{WORDS_SQL}, {_Q},
tf AS (SELECT chunk_id, term, count(*) AS tf FROM toks GROUP BY ALL),
len AS (SELECT chunk_id, count(*) AS len FROM toks GROUP BY chunk_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nn AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) AS words),
bm AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (words::DOUBLE / n)))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (chunk_id), nn GROUP BY ALL)"""


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "query_id int, term string")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE / sqrt({_dot(v, v)}))"


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))"


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return views.chunks(spark, sf).select("source_uri", "chunk_index", "content_hash", F.length("content").alias("n_chars"))


def content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.deduplicated(views.chunks(spark, sf)).select("source_uri", "chunk_index", "content_hash")


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.postings(views.whole_chunks(spark, sf), "chunk_id", "content")
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def _bm25(spark: SparkSession, sf: str, stem: bool = False) -> DataFrame:
    docs = views.whole_chunks(spark, sf)
    return lexical.bm25(_terms(spark), docs, "chunk_id", "content", stem, stem)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top(_bm25(spark, sf), "chunk_id", 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top(_bm25(spark, sf, True), "chunk_id", 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def boolean_match(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.occurrences(views.whole_chunks(spark, sf), "chunk_id", "content")
    return lexical.matching(words, "chunk_id", '("of the" OR und) NOT was')


def _knn(spark: SparkSession, sf: str, k: int, metric: str, shape=lambda c: F.col(c)) -> DataFrame:
    vectors = views.vectors(spark, sf).select("chunk_id", shape("embedding").alias("embedding"))
    queries = views.query_vectors(spark, sf).select("query_id", shape("qvec").alias("qvec"))
    return retrieval.nearest(queries, vectors, "chunk_id", k, metric).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of all vectors for every one whose id is divisible by 100, by cells around pivots."""
    vectors = views.vectors(spark, sf)
    queries = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").cast("int").alias("query_id"), F.col("embedding").alias("qvec"))
    found = cells.MetricIndex.of(vectors, "chunk_id").nearest(queries, 10)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "l2")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "cosine")


def matryoshka_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "l2", lambda c: truncated(c, 16))


def int8_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, 10, "l2", lambda c: int8(normalised(c)))


def _knn_sql(shape: str = "{}", metric: str = "l2", k: int = 10, ids: str = "chunk_id IN (0, 7, 42)") -> str:
    distance = _l2("v", "qv") if metric == "l2" else f"1 - {_dot('v', 'qv')} / (sqrt({_dot('v', 'v')}) * sqrt({_dot('qv', 'qv')}))"
    return f"""WITH e AS (SELECT vec_id AS chunk_id, {shape.format('embedding')} AS v FROM embeddings),
q AS (SELECT chunk_id::INT AS query_id, v AS qv FROM e WHERE {ids}),
s AS (SELECT query_id, chunk_id, round({distance}, 9) AS distance FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM s)
SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= {k}"""


def _legs(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    lexical_leg = lexical.top(_bm25(spark, sf).where("query_id = 0"), "chunk_id", k)
    queries = views.query_vectors(spark, sf, (0,))
    return lexical_leg, retrieval.nearest(queries, views.vectors(spark, sf), "chunk_id", k)


_LEGS = f"""{_BM25},
lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE query_id = 0 QUALIFY rank <= 30),
sv AS (SELECT e.vec_id AS chunk_id, round({_l2('e.embedding', 'q.embedding')}, 9) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0),
vec AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM sv QUALIFY rank <= 30)"""


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: BM25 and vector legs fused, the ten best with their sources."""
    fused = retrieval.fuse(*_legs(spark, sf, 30), "chunk_id").where("place <= 10")
    details = views.whole_chunks(spark, sf).select("chunk_id", "source_uri")
    return fused.join(details, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"), "place", "source_uri")


_FUSED = f"""{_LEGS},
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first
  FROM (SELECT chunk_id, rank, 0 AS leg FROM lex UNION ALL SELECT chunk_id, rank, 1 FROM vec) GROUP BY chunk_id),
g AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, first)::INT AS place FROM f)"""


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf: str) -> Index:
    """The index of all documents by their plain words, built at the first use of a table in a session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INDEXES:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        Index.of(views.whole_chunks(spark, sf), "chunk_id", stem=False, fold=False).save(path)
        _INDEXES[at] = path
    return Index.read(spark, _INDEXES[at], "chunk_id", False, False)


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship search from a built index."""
    terms = _terms(spark).where("query_id = 0")
    found = retrieval.hybrid(_index(spark, sf), views.vectors(spark, sf), terms, views.query_vectors(spark, sf, (0,)))
    return found.select("chunk_id", F.round("score", 6).alias("score"), "place")


def indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All words of every benchmark text as a query: the ten best documents of each by a walk over blocks of postings."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), F.col("text").alias("term"))
    return _index(spark, sf).best(queries, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a query: five intent words and a vector each, in one pass."""
    terms = keywords(spark, sf).select(F.col("query_id").cast("int").alias("query_id"), F.col("keyword").alias("term"))
    count = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("query_id"))
    vectors = views.vectors(spark, sf)
    qvecs = count.join(vectors, F.col("query_id") == F.col("chunk_id")).select("query_id", F.col("embedding").alias("qvec"))
    return retrieval.hybrid(_index(spark, sf), vectors, terms, qvecs).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def single_leg(spark: SparkSession, sf: str) -> DataFrame:
    leg = retrieval.nearest(views.query_vectors(spark, sf), views.vectors(spark, sf), "chunk_id", 10)
    return retrieval.single_leg(leg, "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    means = [F.avg(F.element_at("embedding", i + 1).cast("double")) for i in range(64)]
    return views.vectors(spark, sf).groupBy("paper_id").agg(F.array(*[F.round(m, 6) for m in means]).alias("embedding")).select(F.concat(F.lit("/f"), F.col("paper_id").cast("string")).alias("folder_path"), "embedding")


def folder_boost(spark: SparkSession, sf: str) -> DataFrame:
    queries = views.query_vectors(spark, sf)
    leg = retrieval.single_leg(retrieval.nearest(queries, views.vectors(spark, sf), "chunk_id", 20), "chunk_id")
    uris = views.vectors(spark, sf).selectExpr("chunk_id", "concat('/f', paper_id, '/', chunk_id) AS source_uri")
    return retrieval.folder_boost(leg, uris, _folders(spark, sf), queries, "chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_FOLDER_SQL = f"""WITH q AS (SELECT vec_id::INT AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (0, 7, 42)),
m AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, unnest(range(1, 65)) u(i) GROUP BY ALL),
fo AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
fd AS (SELECT query_id, label, round({_l2('v', 'qv')}, 9) AS d FROM fo, q),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, '/f' || label) AS r, min(d) OVER (PARTITION BY query_id) AS best FROM fd QUALIFY r <= 5),
ok AS (SELECT query_id, label FROM fr WHERE d <= CASE WHEN best > 0 THEN best * 2 ELSE 1e-6 END),
s AS (SELECT query_id, vec_id AS chunk_id, label, round({_l2('embedding', 'qv')}, 9) AS d FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM s QUALIFY rank <= 20)
SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank) * CASE WHEN ok.label IS NULL THEN 1.0 ELSE 1.15 END, 6) AS score
FROM r LEFT JOIN ok USING (query_id, label)"""


def strategy_filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs cut to one strategy before fusion, then the ten best."""
    lex, vec = _legs(spark, sf, 30)
    some = views.whole_chunks(spark, sf).where("chunk_strategy = 'semantic'")
    rank = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy("rank"))
    lex, vec = (leg.join(some.select("chunk_id"), "chunk_id", "left_semi").withColumn("rank", rank) for leg in (lex, vec))
    return retrieval.fuse(lex, vec, "chunk_id").where("place <= 10").select("chunk_id", F.round("score", 6).alias("score"), "place")


def full_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search by plain words, reranked."""
    from docloom.sources.providers import OverlapReranker, reranked

    qvec = views.query_vectors(spark, sf, (0,)).first().qvec
    found = retrieval.search(views.whole_chunks(spark, sf), "the OR of OR and", list(qvec), views.vectors(spark, sf), None, top_k=10, rerank=reranked("the of and", OverlapReranker()), index=_index(spark, sf))
    return found.drop("content")


def stemmed_search(spark: SparkSession, sf: str) -> DataFrame:
    """A lexical search by stems: phrases, prefixes and intent words."""
    found = retrieval.search(views.whole_chunks(spark, sf), "Where are the things of sands and \"the thing\"?", mode="fts", top_k=20, keyword_prefilter=True)
    return found.drop("content")


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Intent words of the benchmark's texts as queries."""
    queries = table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    return text_functions.keywords(queries)


# The words without intent, written out.
_STOP = """'a', 'about', 'above', 'after', 'again', 'against', 'all', 'am', 'an', 'and', 'any', 'are', 'aren''t', 'as', 'at', 'be', 'because', 'been', 'before',
'being', 'below', 'between', 'both', 'but', 'by', 'can', 'could', 'did', 'didn''t', 'do', 'does', 'doesn''t', 'doing', 'don''t', 'down', 'during',
'each', 'few', 'for', 'from', 'further', 'get', 'got', 'had', 'has', 'have', 'having', 'he', 'her', 'here', 'hers', 'herself', 'him', 'himself',
'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'itself', 'just', 'let', 'me', 'more', 'most', 'my', 'myself', 'no', 'nor', 'not', 'of',
'off', 'on', 'once', 'only', 'or', 'other', 'our', 'ours', 'ourselves', 'out', 'over', 'own', 'same', 'she', 'should', 'so', 'some', 'such', 'than',
'that', 'the', 'their', 'theirs', 'them', 'themselves', 'then', 'there', 'these', 'they', 'this', 'those', 'through', 'to', 'too', 'under', 'until',
'up', 'very', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'while', 'who', 'whom', 'why', 'will', 'with', 'would', 'you', 'your', 'yours',
'yourself', 'yourselves', 'also', 'use', 'used', 'using', 'can''t', 'won''t', 'shall', 'may', 'might', 'must', 'need', 'vs', 'best', 'better', 'good',
'well', 'many', 'much', 'several', 'won', 'don', 'doesn', 'didn', 'shouldn', 'couldn', 'wouldn', 'isn', 'aren', 'hasn', 'weren', 'via', 'based'"""
_KEYWORDS_SQL = f"""WITH t AS (SELECT item_id AS query_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_\\-.]*[\\p{{L}}\\p{{N}}_]|[\\p{{L}}\\p{{N}}_]') AS w FROM benchmark),
u AS (SELECT query_id, text, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos FROM t),
k AS (SELECT query_id, keyword, count(*) + CASE WHEN contains(keyword, '-') OR contains(keyword, '.') THEN 0.5 ELSE 0 END AS score, min(pos) AS first FROM u
  WHERE keyword NOT IN ({_STOP}) AND (length(keyword) > 1 OR list_contains(list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\\[\\]{{}}"'']+|[.,;:!?()\\[\\]{{}}"'']+$', '', 'g')), upper(keyword)) AND upper(keyword) <> keyword) GROUP BY query_id, keyword)
SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INT AS rank FROM k QUALIFY rank <= 5"""


def match_query(spark: SparkSession, sf: str) -> DataFrame:
    return text_functions.match_query(keywords(spark, sf))


def pair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a passage behind the one before it as its query, within the tokens of a cross-encoder's input."""
    from docloom.sources.providers import WordTokeniser, cut_pairs

    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = docs.selectExpr("doc_id", "text AS passage").join(docs.selectExpr("doc_id + 1 AS doc_id", "text AS query"), "doc_id")
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = cut_pairs(pairs, WordTokeniser())
    digest = lambda c: F.sha2(F.array_join(words(c), " "), 256)
    return cut.select("doc_id", F.size(words("query")).alias("n_query"), F.size(words("passage")).alias("n_passage"), digest("query").alias("query_sha256"), digest("passage").alias("passage_sha256"))


QUERIES = {
    "pair_tokens": pair_tokens,
    "chunk_text": chunk_text, "content_dedup": content_dedup, "token_stats": token_stats, "bm25_topk": bm25_topk, "bm25_stemmed": bm25_stemmed,
    "boolean_match": boolean_match, "knn_indexed": knn_indexed, "l2_topk": l2_topk, "cosine_topk": cosine_topk, "matryoshka_topk": matryoshka_topk, "int8_topk": int8_topk,
    "rrf_hybrid": rrf_hybrid, "indexed_search": indexed_search, "indexed_topk": indexed_topk, "batch_search": batch_search, "single_leg": single_leg, "folder_boost": folder_boost, "strategy_filtered_search": strategy_filtered_search,
    "full_search": full_search, "stemmed_search": stemmed_search, "keywords": keywords, "match_query": match_query,
}
ORACLES = {
    "chunk_text": f"WITH {CHUNKS_SQL} SELECT source_uri, chunk_index, content_hash, length(content) AS n_chars FROM chunks",
    "content_dedup": f"WITH {CHUNKS_SQL} SELECT source_uri, chunk_index, content_hash FROM chunks QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY source_uri, chunk_index) = 1",
    "token_stats": f"WITH {WORDS_SQL} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS n FROM toks GROUP BY term",
    "bm25_topk": f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bm) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20",
    "boolean_match": "WITH t AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents) SELECT chunk_id FROM t WHERE (contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') OR list_contains(w, 'und')) AND NOT list_contains(w, 'was')",
    "l2_topk": _knn_sql(),
    "knn_indexed": _knn_sql(ids="chunk_id % 100 = 0"),
    "cosine_topk": _knn_sql(metric="cosine"),
    "matryoshka_topk": _knn_sql(_unit("list_slice({0}, 1, 16)").replace("{0}", "{0}")),
    "int8_topk": _knn_sql("list_transform(" + _unit("{0}") + ", lambda x: floor(least(greatest((x + 1) / 2 * 255, 0.0), 255.0) - 128)::TINYINT)"),
    "rrf_hybrid": f"WITH {_FUSED} SELECT g.chunk_id, round(score, 6) AS score, place, '/' || source || '/' || doc_id || '.md' AS source_uri FROM g JOIN documents ON doc_id = chunk_id WHERE place <= 10",
    "indexed_search": f"WITH {_FUSED} SELECT chunk_id, round(score, 6) AS score, place FROM g WHERE place <= 10",
    "indexed_topk": "WITH " + _BM25.replace(_Q, "q AS (SELECT DISTINCT item_id::INT AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark)") + """
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bm QUALIFY rank <= 10""",
    "batch_search": f"""WITH kw AS ({_KEYWORDS_SQL}), {_BM25.replace(_Q, "q AS (SELECT query_id::INT AS query_id, keyword AS term FROM kw)")},
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 30),
sv AS (SELECT q.vec_id::INT AS query_id, e.vec_id AS chunk_id, round({_l2('e.embedding', 'q.embedding')}, 9) AS distance FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM sv QUALIFY rank <= 30),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM lex UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vec) GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first)::INT AS place FROM f QUALIFY place <= 10""",
    "full_search": f"""WITH {_FUSED}, r AS (SELECT g.chunk_id, source, place, 1 / (1 + exp(-(8.0::DOUBLE * len(list_filter(['the', 'of', 'and'], lambda w: list_contains(string_split_regex(lower(text), '\\s+'), w))) / 3 - 4))) AS s FROM g JOIN documents ON doc_id = chunk_id WHERE place <= 20)
SELECT chunk_id, 'markdown' AS source_type, '/' || source || '/' || chunk_id || '.md' AS source_uri, 0 AS chunk_index, round(s, 6) AS score, 'reranked' AS match_type, p AS place FROM (SELECT *, (row_number() OVER (ORDER BY round(s, 12) DESC, place))::INT AS p FROM r) WHERE p <= 10""",
    "single_leg": f"WITH k AS ({_knn_sql()}) SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank AS place FROM k",
    "folder_boost": _FOLDER_SQL,
    "strategy_filtered_search": f"""WITH {_LEGS},
l2 AS (SELECT chunk_id, row_number() OVER (ORDER BY rank) AS rank FROM lex WHERE chunk_id % 2 = 1 AND chunk_id IN (SELECT doc_id FROM documents)),
v2 AS (SELECT chunk_id, row_number() OVER (ORDER BY rank) AS rank FROM vec WHERE chunk_id % 2 = 1 AND chunk_id IN (SELECT doc_id FROM documents)),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM (SELECT *, 0 AS leg FROM l2 UNION ALL SELECT *, 1 FROM v2) GROUP BY chunk_id)
SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, first)::INT AS place FROM f QUALIFY place <= 10""",
    "keywords": _KEYWORDS_SQL,
    "match_query": f"WITH k AS ({_KEYWORDS_SQL}) SELECT query_id, string_agg('\"' || replace(keyword, '\"', '\"\"') || '\"', ' OR ' ORDER BY rank) AS match FROM k GROUP BY query_id",
    "pair_tokens": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT b.doc_id, a.w AS q, b.w AS p, len(a.w) AS nq, len(b.w) AS np, least(len(a.w), len(b.w), 254) AS short FROM d b JOIN d a ON b.doc_id = a.doc_id + 1),
k AS (
  SELECT doc_id, q, p, CASE WHEN nq + np <= 509 THEN nq WHEN nq > np THEN 509 - short ELSE short END AS kq,
    CASE WHEN nq + np <= 509 THEN np WHEN nq > np THEN short ELSE 509 - short END AS kp
  FROM p)
SELECT doc_id, kq::INT AS n_query, kp::INT AS n_passage, sha256(array_to_string(q[1:kq], ' ')) AS query_sha256, sha256(array_to_string(p[1:kp], ' ')) AS passage_sha256 FROM k""",
}
