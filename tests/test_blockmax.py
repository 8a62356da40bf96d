"""Block-max walks give what a full scan gives, and leave blocks unread."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import blockmax
from docloom.operators.index import Index


def lists_of(rng, n, words, mean=40.0, often=0.7):
    """Posting lists of words of falling frequency over n chunks, and their plain postings."""
    sizes = np.array([rng.randrange(5, 80) for _ in range(n)])
    rows, plain = [], []
    for w in range(words):
        keys = np.array(sorted(rng.sample(range(n), max(1, n >> (2 * w)))))
        tf = np.array([1 + min(30, int(rng.expovariate(often) ** 2)) for _ in keys])
        rows.append(packed(keys, tf, sizes[keys]))
        plain.append((keys, tf, sizes[keys]))
    found = []
    for (keys, _, _), row in zip(plain, rows):
        idf = max(np.log((n - len(keys) + 0.5) / (len(keys) + 0.5)), 1e-6)
        found.append(blockmax.PostingList(row, float(idf), mean))
    return found, plain


def packed(keys, tf, size):
    import pyarrow as pa

    entries = [[{"place": int(k), "tf": int(t), "len": int(s)} for k, t, s in zip(keys, tf, size)]]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("tf", pa.int32()), ("len", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["w"]), pa.array([0], pa.int64()), pa.array(entries, kind)], ["term", "shard", "found"])
    (out,) = blockmax._packed(iter([batch]))
    return out.to_pylist()[0]


def scan(lists, plain, k, every, gone=()):
    scores, seen = {}, {}
    for x, (keys, tf, size) in zip(lists, plain):
        for key, s in zip(keys, x.impact(tf, size)):
            scores[key] = scores.get(key, 0.0) + s
            seen[key] = seen.get(key, 0) + 1
    kept = [(key, round(s, 9)) for key, s in scores.items() if seen[key] >= every and key not in gone]
    return sorted(kept, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("every", [1, 3])
def test_walk_equals_scan(every):
    rng = random.Random(1)
    for n, words, k in ((1, 3, 5), (40, 3, 5), (3000, 3, 10), (3000, 3, 1), (9000, 5, 20)):
        for gone in ((), tuple(rng.sample(range(n), n // 3))):
            lists, plain = lists_of(rng, n, words)
            places, scores = blockmax.walk(lists, k, every, np.array(gone, np.int64))
            assert list(zip(places.tolist(), scores.tolist())) == [(int(a), float(b)) for a, b in scan(lists, plain, k, every, set(gone))]


def test_walk_leaves_blocks_unread():
    """Of words that stand once in most chunks and often in a few, most blocks of the frequent ones stay packed."""
    rng = random.Random(2)
    lists, plain = lists_of(rng, 60_000, 4, often=2.0)
    places, _ = blockmax.walk(lists, 10)
    read, all_ = (sum(map(len, x)) for x in ([x.read for x in lists], [x.ends for x in lists]))
    assert len(places) == 10 and read < all_ / 2, (read, all_)
    assert [(int(a)) for a, _ in scan(lists, plain, 10, 1)] == places.tolist()


def test_edges_are_what_nothing_beats():
    rng = np.random.default_rng(3)
    for _ in range(50):
        tf, size = rng.integers(1, 6, 30), rng.integers(1, 9, 30)
        kept = {(int(tf[i]), int(size[i])) for i in blockmax.edges(tf, size)}
        every = {(int(a), int(b)) for a, b in zip(tf, size)}
        assert kept == {(a, b) for a, b in every if not any((c >= a and d <= b) and (c, d) != (a, b) for c, d in every)}


def test_index_with_blocks_equals_one_without(spark, tmp_path):
    """Keys over several ranges, empty and null texts, many queries, some words unknown."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i * 5_000 if i % 7 else i, " ".join(rng.choice(words[: 1 + i % 40]) for _ in range(rng.randrange(30)))) for i in range(300)] + [(900_001, None), (900_002, "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").dropDuplicates(["chunk_id"])
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=4)) if q else "nothing") for q in range(12)], "query_id int, term string")
    plain = Index.of(chunks, "chunk_id")
    plain.save(f"{tmp_path}/index")
    kept = Index.read(spark, f"{tmp_path}/index", "chunk_id")
    assert kept.blocks.select("shard").distinct().count() > 5
    answer = lambda index, **a: sorted(map(tuple, index.best(queries, 7, **a).select("query_id", "chunk_id", "score", "rank").collect()))
    assert answer(kept) == answer(plain)
    assert answer(kept, every=True) == answer(plain, every=True) == answer(kept, every=True, most=3)


def test_gone_chunks_count_nowhere(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(1, 9)))) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    live, gone = chunks.where("chunk_id % 3 > 0"), chunks.where("chunk_id % 3 = 0")
    Index.of(chunks, "chunk_id").save(f"{tmp_path}/index")
    kept = Index.read(spark, f"{tmp_path}/index", "chunk_id")
    minus = blockmax.totals(kept.lengths.join(gone.select("chunk_id"), "chunk_id")).selectExpr("-n AS n", "-words AS words")
    kept.gone, kept.totals = gone.select("chunk_id"), kept.totals.unionByName(minus)
    queries = spark.createDataFrame([(0, "a b"), (1, "f")], "query_id int, term string")
    answer = lambda index: sorted(map(tuple, index.best(queries, 9).select("query_id", "chunk_id", "score", "rank").collect()))
    assert answer(kept) == answer(Index.of(live, "chunk_id"))


def test_an_index_is_saved_from_one_pass_over_its_postings(spark, tmp_path):
    """Ranges are sampled, which must not read the texts again; rows packed together are those packed one by one."""
    seen = spark.sparkContext.accumulator(0)
    texts = [(i, " ".join(f"w{(i * j) % (j + 3)}" for j in range(40))) for i in range(300)]
    index = Index.of(spark.createDataFrame(texts, "chunk_id long, content string"), "chunk_id", stem=False)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    n = index.postings.count()
    index.postings = index.postings.mapInArrow(counted, index.postings.schema)
    index.save(str(tmp_path / "index"))
    assert seen.value == n
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() == n


def test_rows_packed_together():
    rng = np.random.default_rng(3)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("tf", pa.int32()), ("len", pa.int32())]))
    lists = [[{"place": int(p), "tf": int(rng.integers(1, 6)), "len": int(rng.integers(1, 40))} for p in sorted(rng.choice(1 << 16, n, replace=False))] for n in (1, 128, 129, 1000, 1, 256)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(6)]), pa.array(range(6), pa.int64()), pa.array(lists, kind)], ["term", "shard", "found"])
    for part in (batch, batch.slice(2, 3)):
        (got,) = blockmax._packed([part])
        for row in got.to_pylist():
            found = lists[row["shard"]]
            place, tf, size = (np.array([x[c] for x in found]) for c in ("place", "tf", "len"))
            starts = np.arange(0, len(found), blockmax.BLOCK)
            kept = [blockmax.edges(tf[i : i + blockmax.BLOCK], size[i : i + blockmax.BLOCK]) + i for i in starts]
            edge = np.concatenate(kept)
            want = (place, tf, size, place[np.append(starts[1:], len(place)) - 1], tf[edge], size[edge], np.cumsum([0, *map(len, kept)]))
            assert row["n"] == len(found)
            for name, values in zip(("places", "tfs", "lens", "ends", "edge_tf", "edge_len", "edges"), want, strict=True):
                assert blockmax._ints(row[name]).tolist() == values.tolist()


def test_rows_are_packed_as_their_postings_come_in_order(spark):
    """No list of postings is collected; rows that begin in one Arrow batch and end in a later one are whole, null and repeated keys count as ever."""
    rng = random.Random(6)
    words = ["every", *(f"w{i}" for i in range(30))]
    keys = [*range(120), *range(65_530, 65_600), 7, 7, None, 200_000]
    rows = [(k, w, list(range(rng.randrange(1, 4)))) for k in keys for w in words if w == "every" or rng.random() < 0.2]
    postings = spark.createDataFrame(rows, "chunk_id long, term string, positions array<int>")
    sizes = [(k, rng.randrange(1, 50)) for k in keys if k != 200_000]
    lengths = spark.createDataFrame(sizes, "chunk_id long, len int")
    want = {}
    for k, w, at in rows:
        for _, n in (x for x in sizes if k is not None and x[0] == k):
            want.setdefault((w, k >> 16), []).append((k & 65_535, len(at), n))
    packed = lambda rows: {(r.term, r.shard): list(zip(*(blockmax._ints(r[c]).tolist() for c in ("places", "tfs", "lens")), strict=True)) for r in rows.collect()}
    # with the len of their chunk postings are not joined, but for keys of several lengths
    own = spark.createDataFrame([(k, w, at, dict(sizes)[k]) for k, w, at in rows if k != 200_000], "chunk_id long, term string, positions array<int>, len int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = blockmax.block_rows(postings, lengths, "chunk_id")
        got, got_own = packed(found), packed(blockmax.block_rows(own, lengths, "chunk_id"))
        empty = blockmax.block_rows(postings.where("false"), lengths, "chunk_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == got_own == {at: sorted(x) for at, x in want.items()} and not empty
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
