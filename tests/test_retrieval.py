import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical as L
from docloom.operators import retrieval as R
from docloom.operators.index import Index
from docloom.sources.providers import HashEmbedder, OverlapReranker, embedded, reranked
from tests.conftest import SF
from tests.test_text import fts

TEXTS = ["the quick brown fox", "the lazy dog", "a fox and a dog", "brown bread with butter", "quick quick fox trot", "running dogs"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, t, "pdf" if i % 2 else "web", f"/f{i % 3}/{i}.md", i, "mechanical" if i < 4 else "semantic") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk_id long, content string, source_type string, source_uri string, chunk_index int, chunk_strategy string")


def ids(df):
    return sorted(r.chunk_id for r in df.collect())


@pytest.mark.parametrize(
    "query, want",
    [
        ("fox", [0, 2, 4]), ("fox dog", [2]), ("fox OR dog", [0, 1, 2, 4]), ("fox NOT dog", [0, 4]), ('"brown fox"', [0]), ('"fox brown"', []), ("qui*", [0, 4]),
        ("(fox OR bread) brown", [0, 3]), ("NEAR(quick fox, 1)", [0, 4]), ("NEAR(quick fox, 0)", [4]), ("fox AND dog OR butter", [2, 3]), ("quick + brown", [0]), ('"brown br"*', [3]),
    ],
)
def test_boolean_queries(chunks, query, want):
    words = L.occurrences(chunks, "chunk_id", "content")
    assert ids(L.matching(words, "chunk_id", query)) == want


@pytest.mark.parametrize("query", ["", "fox OR", "(fox", "NOT fox", "fox )", "a ; b"])
def test_bad_queries_find_nothing(chunks, query):
    with pytest.raises(L.QueryError):
        L.parse(query)
    assert R.lexical_leg(Index.of(chunks, "chunk_id"), query, 5).count() == 0


def test_stems_match(spark, chunks):
    words = L.occurrences(chunks, "chunk_id", "content", stem=True)
    assert ids(L.matching(words, "chunk_id", "dog")) == [1, 2, 5]
    index = Index.of(chunks, "chunk_id")
    assert ids(R.lexical_leg(index, "DOGS", 9)) == [1, 2, 5] and ids(R.lexical_leg(index, "run", 9)) == [5]


@pytest.mark.parametrize("query", ["und", '"of the" OR und', "the AND of NOT was", "sand* OR things", "NEAR(the of, 3)", "the the of", '"la de" + la'])
def test_ranks_are_those_of_a_full_text_engine(spark, query, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()]
    con = fts("porter unicode61")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", docs)
    want = {i: -s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    index = Index.of(spark.createDataFrame(docs, "chunk_id long, content string"), "chunk_id")
    index.save(f"{tmp_path}/index")
    for found in (index, Index.read(spark, f"{tmp_path}/index", "chunk_id")):
        got = {r.chunk_id: r.score for r in R.lexical_leg(found, query, 10**6).collect()}
        assert got.keys() == want.keys()
        if "NEAR" not in query:
            assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def legs(spark, lexical, vector):
    make = lambda x: spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(x)], "query_id int, chunk_id long, rank int")
    return make(lexical), make(vector)


def test_fusion_and_ties(spark):
    rows = R.fuse(*legs(spark, [1, 2, 3], [2, 4, 1]), "chunk_id").orderBy("place").collect()
    assert [r.chunk_id for r in rows] == [2, 1, 4, 3]
    assert [r.score for r in rows] == pytest.approx([1 / 62 + 1 / 61, 1 / 61 + 1 / 63, 1 / 62, 1 / 63])
    rows = R.fuse(*legs(spark, [1], [2]), "chunk_id").orderBy("place").collect()
    assert [r.chunk_id for r in rows] == [1, 2]


def test_one_leg_keeps_its_name(chunks):
    rows = R.search(chunks, "butter", mode="hybrid").collect()
    assert [(r.chunk_id, r.match_type) for r in rows] == [(3, "fts")] and rows[0].score == pytest.approx(1 / 61, abs=1e-6)


def test_type_filters_after_the_cut(chunks):
    first = [r.chunk_id for r in R.search(chunks, "fox OR dog OR dogs", mode="fts", top_k=2).collect()]
    kept = [r.chunk_id for r in R.search(chunks, "fox OR dog OR dogs", mode="fts", top_k=2, source_type="pdf").collect()]
    assert kept == [c for c in first if c % 2]
    assert len(R.search(chunks, "fox OR dog OR dogs", mode="fts", top_k=2, source_type="pdf", prefilter=True).collect()) == 2


def test_hybrid_with_boost_and_rerank(spark, chunks):
    provider = HashEmbedder(16)
    vectors = embedded(chunks, "content", provider).select("chunk_id", "embedding")
    folders = vectors.where("chunk_id < 3").select(F.concat(F.lit("/f"), F.col("chunk_id").cast("string")).alias("folder_path"), "embedding")
    qvec = provider.embed(["quick brown fox"])[0]
    plain = R.search(chunks, "fox OR brown", qvec, vectors, top_k=3)
    assert [r.match_type for r in plain.collect()] == ["hybrid"] * 3
    boosted = R.search(chunks, "fox OR brown", qvec, vectors, folders, top_k=3).collect()
    assert boosted[0].score == pytest.approx(plain.first().score * 1.15, abs=1e-6)
    ranked = R.search(chunks, "fox OR brown", qvec, vectors, top_k=3, rerank=reranked("brown fox", OverlapReranker()), rerank_top=2).collect()
    assert ranked[0].match_type == "reranked" and ranked[0].score > 0.9


def test_boost_of_a_perfect_folder(spark):
    folders = spark.createDataFrame([("/a", [1.0, 0.0]), ("/b", [1.0, 0.5])], "folder_path string, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, qvec array<double>")
    ranked = spark.createDataFrame([(0, 1, 0.5, 1), (0, 2, 0.4, 2)], "query_id int, chunk_id long, score double, place int")
    uris = spark.createDataFrame([(1, "/b/x"), (2, "/a/y")], "chunk_id long, source_uri string")
    assert {r.chunk_id: r.score for r in R.folder_boost(ranked, uris, folders, queries, "chunk_id").collect()} == {1: 0.5, 2: 0.4 * 1.15}


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"top_k": 0}, {"top_k": 501}, {"source_type": "x"}, {"chunk_strategy": "x"}])
def test_arguments(chunks, bad):
    with pytest.raises(ValueError):
        R.search(chunks, "fox", **bad)


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_is_the_same_for_any_number_of_terms(spark, chunks, stem):
    terms = spark.createDataFrame([(0, "fox"), (0, "dog"), (1, "quick"), (1, "none")], "query_id int, term string")
    few = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in L.bm25(terms, chunks, "chunk_id", stem=stem).collect())
    many = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in L.bm25(terms, chunks, "chunk_id", stem=stem, most=1).collect())
    assert few == many and len(few) == (7 if stem else 6)


def test_more_queries_than_a_block(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(7)], "chunk_id long, embedding array<float>")
    n = 2 * R.QUERY_BLOCK + 500
    queries = spark.range(n).selectExpr("cast(id as int) as query_id", "array(cast(id % 7 as double), 0.0D) as qvec")
    found = R.nearest(queries, vectors, "chunk_id", 2).collect()
    assert len(found) == 2 * n
    assert {r.query_id: r.chunk_id for r in found if r["rank"] == 1} == {i: i % 7 for i in range(n)}


def test_nearest_measures_few_of_all_pairs(spark, monkeypatch):
    """Copies, ties, nulls, other lengths and numbers without an end: as measuring every pair."""
    monkeypatch.setattr(R, "VECTORS_AT_ONCE", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 2]) for i in range(700)]
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0]), (702, [1.0]), (703, [float("nan"), 0.0, 0.0, 0.0]), (704, [float("inf"), 0.0, 0.0, 0.0]), (705, [])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, rows[i][1]) for i in range(9)], "query_id int, qvec array<float>")
    for k in (5, 2000):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in R.nearest(queries, vectors, "chunk_id", k).where("distance < 1000").collect()}
        want = {}
        for q in range(9):
            each = sorted((round(sum((a - b) ** 2 for a, b in zip(v, rows[q][1], strict=True)) ** 0.5, 9), i) for i, v in rows[:700])
            want |= {(q, n + 1): (i, d) for n, (d, i) in enumerate(each[:k])}
        assert got == want
    assert R.nearest(queries, vectors, "chunk_id", 2000).where("query_id = 0").count() == 702  # what is not finite comes last
    sent = vectors.coalesce(1).mapInArrow(R._possible(np.array([r[1] for r in rows[:9]]), 5, 9), "i int, chunk_id long, embedding array<float>")
    assert sent.count() < 9 * 700 / 2


def test_words_are_counted_within_their_row(spark):
    """Keys that come once need no aggregate by term and key; null keys, repeated ones, empty and null texts count as ever."""
    rows = [(1, "b a b"), (2, "b"), (2, "b c"), (None, "a"), (None, "a d"), (3, ""), (4, None), (5, "x"), (5, "x"), (6, "z " * 3000 + "é 1"), (7, None), (7, "a")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    want = {}
    for key, text in rows:
        for w in (text or "").split():
            want[w, key] = want.get((w, key), 0) + 1
    for most in (L.MOST_KEYS, 2, 0):
        found = L.postings(chunks, "chunk_id", "content", most=most)
        got = [((r.term, r.chunk_id), r.tf) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == want
        assert found.schema.simpleString() == "struct<term:string,chunk_id:bigint,tf:bigint>"
    plan = L.postings(chunks, "chunk_id", "content")._jdf.queryExecution().optimizedPlan().toString()
    once, several = plan.split("Aggregate [term")  # the union's first branch counts nothing by term and key
    assert "inline" in once and "isnull(chunk_id" in several
