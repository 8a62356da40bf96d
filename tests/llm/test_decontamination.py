import random

import numpy as np

from docloom.llm import decontamination as D
from tests.llm.helpers import none, odd, save

ITEMS = "item_id long, text string"


def test_suffix_array_and_index_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300):
        symbols = rng.integers(0, 4, n)
        symbols[0] = 0
        index = D.FMIndex(symbols, 3)
        phrases = rng.integers(1, 4, (30, 4))
        lengths = rng.integers(1, 5, 30)
        low, high = index.ranges(phrases, lengths)
        for p, m, a, b in zip(phrases, lengths, low, high):
            word = p[4 - m :].tolist()
            want = [i for i in range(n - m + 1) if symbols[i : i + m].tolist() == word]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, 200)
    tree = D.WaveletTree(x, 4)
    for c in range(9):
        got = tree.rank(np.full(201, c), np.arange(201))
        assert got.tolist() == [int((x[:i] == c).sum()) for i in range(201)]
    symbol, rank = tree.access_rank(np.arange(200))
    assert (symbol == x).all() and rank.tolist() == [int((x[:i] == x[i]).sum()) for i in range(200)]


def test_shards_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 10, 11, 25])))) for i in range(25)] + [(None, "w1 w2 w1 w2"), (3, None), (3, "w5 w5")]
    items += [(40, items[4][1])]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(vocabulary + ["zz"]) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            text += " , " + (rng.choice(items)[1] or "").upper() + "; x"
        docs.append((i, text))
    docs.append((200, None))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    for shard_words, block_words in ((50, 40), (10_000, 7), (D.SHARD_WORDS, D.BLOCK_WORDS)):
        rows = {r.doc_id: r for r in D.scan(frame, benchmark, shard_words=shard_words, block_words=block_words).collect()}
        for doc_id, text in docs:
            n, hit, digest = D.brute_scan(text, items)
            r = rows[doc_id]
            assert (r.n_words, sum(s.end - s.start for s in r.spans)) == (n, hit)
            assert D.hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest() == digest


def test_removal():
    text = "Keep this. One two, three! And that."
    assert D.remove_spans(text, [(2, 5)]) == "Keep this. ! And that."
    assert D.remove_spans("a b", [(0, 2)]) == ""


def test_odd_table(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    save(spark.createDataFrame([(1, "the QUICK brown fox jumps over the lazy dog again"), (2, "one")], ITEMS), tmp_path, "benchmark")
    rows = D.op4_decontaminate(spark, folder).collect()
    assert len(rows) == 13
    hit = {r.doc_id for r in rows if r.contaminated}
    assert hit == {1, 2, 8, 9}
    kept = D.stage(spark, odd(spark, True), folder)
    assert kept.columns == odd(spark, True).columns and kept.count() == 8


def test_empty_tables(spark, tmp_path):
    folder = save(none(spark), tmp_path, "documents")
    save(none(spark, ITEMS), tmp_path, "benchmark")
    assert D.op4_decontaminate(spark, folder).count() == 0
    save(odd(spark), tmp_path, "documents")
    assert not any(r.contaminated for r in D.op4_decontaminate(spark, folder).collect())


def test_an_item_longer_than_a_block(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(50)}" for _ in range(600)]
    benchmark = spark.createDataFrame([(1, " ".join(w)), (2, "w1 w2")], ITEMS)
    blocks = list(D.read_blocks(benchmark, block_words=100))
    assert len(blocks) > 1 and max(len(b.rows) for b in blocks) < 400
    docs = [(i, " ".join([*("zz" for _ in range(i % 7)), *w[i * 9 : i * 9 + 12]])) for i in range(60)]
    rows = {r.doc_id: r for r in D.scan(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, block_words=100).collect()}
    for i, text in docs:
        n, hit, _ = D.brute_scan(text, [(1, " ".join(w)), (2, "w1 w2")])
        assert (rows[i].n_words, sum(s.end - s.start for s in rows[i].spans)) == (n, hit)


def test_blocks_of_items_without_or_with_equal_ids(spark):
    """10,000 items without an id and as many of one id spread over blocks of counted words; equal ones are dropped."""
    from pyspark.sql import functions as F

    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5000)).cast("string")) for i in range(12)])
    some = spark.range(10_000).select(text.alias("text"))
    benchmark = some.select(F.lit(None).cast("long").alias("item_id"), "text").unionByName(some.select(F.lit(7).cast("long").alias("item_id"), "text"))
    benchmark = benchmark.unionByName(benchmark.limit(5000)).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("item_id"), F.lit("the same words every time").alias("text")))
    held, blocks = D.blocked(benchmark, block_words=20_000)
    sizes = {r.block: (r.n, r.m) for r in held.groupBy("block").agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("m")).collect()}
    assert sum(m for _, m in sizes.values()) == 20_001
    assert set(sizes) == set(range(blocks)) and blocks == 12 and max(n for n, _ in sizes.values()) < 1.1 * 20_000


def test_cleaned_texts_hold_no_window(spark):
    passage = "alpha beta gamma delta one two three four five six seven"
    docs = spark.createDataFrame([(1, f"Keep this. {passage.title()}! And that."), (2, "clean text"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.cleaned(docs, spark.createDataFrame([(1, passage)], ITEMS)).collect()}
    assert out == {1: "Keep this. ! And that.", 2: "clean text", 3: None}
