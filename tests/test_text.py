import sqlite3

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from tests.conftest import SF


def words(spark, query, most=5):
    df = T.keywords(spark.createDataFrame([(0, query)], "query_id int, query string"), most)
    return [r.keyword for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        ("what is the and of", []),
        ("", []),
        ("ResNet-50 vs GPT-3.5 for images", ["resnet-50", "gpt-3.5", "images"]),
        ("images and transformers and images", ["images", "transformers"]),
        ("Is C, or (R) faster than x", ["c", "r", "faster"]),
        ("naïve Gödel numbers", ["naïve", "gödel", "numbers"]),
        ("a1 b2 c3 d4 e5 f6", ["a1", "b2", "c3", "d4", "e5"]),
    ],
)
def test_keywords(spark, query, want):
    assert words(spark, query) == want


def test_match_query_quotes_everything(spark):
    ranked = spark.createDataFrame([(0, 'a"b', 1), (0, "NOT", 2)], "query_id int, keyword string, rank int")
    assert T.match_query(ranked).first().match == '"a""b" OR "NOT"'


@pytest.mark.parametrize("word, stem", [w.split(":") for w in "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall happy:happi sky:sky relational:relat triplicate:triplic electricity:electr adjustment:adjust adoption:adopt rate:rate controll:control roll:roll be:be generalizations:gener".split()])
def test_porter(word, stem):
    assert T.stem(word) == stem


def fts(tokenizer):
    """A full-text table of SQLite, where it has one."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    return con


def test_terms_are_those_of_a_full_text_engine(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()]
    hard = "possibly archeology naïve running mp3s Straßes caféS ÀÉÎ ộ Ünïcödé e\u0301te\u0301 conditional rationally hopping hoped foo_bar a-b C++ 12.5"
    con = fts("porter unicode61")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate([hard, *docs[:150]], 1)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    want = {}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want.setdefault(doc, []).append(term)
    df = spark.createDataFrame(list(enumerate([hard, *docs[:150]], 1)), "i int, x string")
    for r in df.select("i", T.terms("x", True, True).alias("w")).collect():
        assert r.w == want.get(r.i, [])
    assert T.query_tokens(hard, True, True) == want[1]


def test_names_and_hashes(spark):
    df = spark.createDataFrame([("Vaswani, Ashish", " Some Query\n"), ("Ann B. Lee", "x")], "a string, q string")
    rows = df.select(T.surname(F.col("a")).alias("s"), T.normal_query("q").alias("q"), T.content_hash("q").alias("h")).collect()
    assert [(r.s, r.q, len(r.h)) for r in rows] == [("vaswani", "some query", 16), ("lee", "x", 16)]
    assert spark.range(1).select(T.contains_fold(F.lit("100% Sure_"), F.lit("0% s")).alias("a"), T.contains_fold(F.lit("abc"), F.lit("a%")).alias("b")).first() == (True, False)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0])], "v array<float>, z array<float>")
    r = df.select(V.normalised("v").alias("n"), V.normalised("z").alias("z"), V.truncated("v", 1).alias("t"), V.int8(V.normalised("v")).alias("q"), V.l2("v", "z").alias("d"), V.cosine("v", "z").alias("c"), V.hashed_terms(F.array(F.lit("a"), F.lit("b")), 8).alias("h")).first()
    assert r.n == pytest.approx([0.6, 0.8, 0.0]) and r.z is None and r.t == [1.0] and r.d == 5.0 and r.c is None
    assert r.q == [76, 101, -1] and sum(x * x for x in r.h) == pytest.approx(1)
