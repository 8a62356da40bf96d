import zlib
from collections import Counter

import numpy as np

from docloom.llm import sharding
from tests.llm.helpers import none, odd, save


def test_permutation_and_inverse():
    for n in (1, 2, 3, 39, 40, 41, 1000, 4097):
        x = np.arange(n)
        p = sharding.permute(x, n)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, inverse=True) == x).all()
        shard, slot = sharding.place(x, n)
        assert all(sharding.row_of(int(a), int(b), n) == i for i, (a, b) in enumerate(zip(shard[:50], slot[:50])))


def test_odd_table(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    rows = sharding.op7_shard(spark, folder).collect()
    brute(rows, odd(spark).collect())
    again = sharding.op7_shard(spark, folder).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def brute(rows, docs):
    """Numbers by one sort, placed by the permutation."""
    text = lambda d: (d.text or "").encode()
    order = sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0, zlib.crc32(text(d)), len(text(d))))
    shard, slot = sharding.place(np.arange(len(order)), len(order))
    want = Counter((d.doc_id, len(text(d)) + 16, zlib.crc32(text(d)), int(a), int(b)) for d, a, b in zip(order, shard, slot))
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows) == want
    slots = Counter(r.shard for r in rows)
    assert max(slots.values()) - min(slots.values() if len(slots) == 40 else [0]) <= 1
    assert all(r.law == "rows" and r.grown_shard is None and r.slot < slots[r.shard] for r in rows)


def test_real_table(spark):
    from tests.conftest import SF

    brute(sharding.op7_shard(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_empty_table(spark, tmp_path):
    assert sharding.op7_shard(spark, save(none(spark), tmp_path, "documents")).count() == 0


def test_one_key_holds_most_rows(spark, tmp_path):
    df = spark.range(9000).selectExpr("if(id % 3 = 0, id, 5L) AS doc_id", "concat('t', id % 1000) AS text", "'en' AS lang", "'s' AS source", "2L AS n_chars")
    rows = sharding.op7_shard(spark, save(df, tmp_path, "documents")).collect()
    assert sorted((r.slot * 40 + r.shard) for r in rows) == list(range(9000))


def test_stage_replaces_clashing_columns(spark):
    out = sharding.stage(spark, odd(spark, True), "")
    assert out.columns.count("shard") == 1 and dict(out.dtypes)["shard"] == "int"
    assert out.count() == 13


def test_numbers_with_small_buckets(spark):
    from docloom.llm.common import with_row_numbers

    keys = [None, None, -5, 0, 0, 0, 3, 4, 4, 1 << 40, -(1 << 62)] + list(range(100, 160)) + [7] * 50
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, t long")
    for rows in (1, 4, 20_000):
        numbered, total = with_row_numbers(df, "k", "i", ("t",), rows)
        got = sorted((r.i, r.k) for r in numbered.collect())
        assert total == len(keys) and [i for i, _ in got] == list(range(total))
        assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_buckets_keep_their_size_however_keys_lie(spark):
    from pyspark.sql import functions as F

    from docloom.llm.common import bucketed

    clustered = [*range(3000), 1 << 60]
    one_key = [7] * 2000 + [8, 9]
    for keys, ties in ((clustered, clustered), (one_key, range(2002)), (one_key, [1] * 2002), ([1 << i % 60 for i in range(2000)], range(2000))):
        df = spark.createDataFrame(list(zip(keys, ties)), "k long, t long")
        out, sizes, buckets, rows = bucketed(df, "k", "t", "b", 100)
        got = out.groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.min("t").alias("first")).orderBy("b").collect()
        assert rows == len(keys) and buckets == len(got) and max(r.n for r in got) <= 200
        assert {(r.b, r.n) for r in got} == {(r.b, r.n) for r in sizes.collect()}
        assert all(x.high < y.low or x.high == y.low and x["first"] <= y["first"] for x, y in zip(got, got[1:]))
