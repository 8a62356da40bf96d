"""Steps of searches work on arrays: the number of their steps and of Python objects does not follow the rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions.text import stem, terms
from docloom.operators import blockmax, cells, index
from tests.test_blockmax import lists_of, scan


def test_a_walk_takes_few_steps(monkeypatch):
    """A walk that reads thousands of stretches does so in batches that double."""
    lists, plain = lists_of(random.Random(7), 30_000, 6, often=0.7)
    steps, scores = [], blockmax._scores
    monkeypatch.setattr(blockmax, "_scores", lambda *a: steps.append(len(a[3])) or scores(*a))
    places, found = blockmax.walk(lists, 500)
    assert [(int(p), float(s)) for p, s in zip(places, found)] == [(int(a), float(b)) for a, b in scan(lists, plain, 500, 1)]
    assert sum(steps) > 100 and len(steps) <= 8, steps


def test_positions_are_put_in_order_in_slices(monkeypatch):
    monkeypatch.setattr(index, "WORDS_AT_ONCE", 5)
    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["b"] * 9), (5, ["c", "a"]), (6, ["é"])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["k", "words"])
    out = list(index._lists("k")(iter([batch, batch.slice(3)])))
    assert len(out) > 3
    want = [(w, k, [i for i, x in enumerate(ws) if x == w]) for k, ws in rows for w in dict.fromkeys(ws or [])]
    got = [(r["term"], r["k"], r["positions"]) for b in out for r in b.to_pylist()]
    assert sorted(got) == sorted(want + [w for w in want if w[1] >= 4])


def test_stems_of_null_and_empty_texts(spark):
    rows = [(0, None), (1, ""), (2, "Running ponies, running"), (3, "naïve relational")]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, t string").select("k", terms(F.col("t"), True, False).alias("t")).collect()}
    assert got == {0: None, 1: [], 2: [stem(w) for w in ("running", "ponies", "running")], 3: [stem("naïve"), stem("relational")]}


def test_vectors_are_sent_once_for_a_block_of_queries(spark, monkeypatch):
    """Few queries are one block, so no part's vectors come twice."""
    sent = []
    visited = cells.MetricIndex._visited
    monkeypatch.setattr(cells.MetricIndex, "_visited", lambda self, asked, k, blocks: sent.append(blocks) or visited(self, asked, k, blocks))
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id < 9").selectExpr("cast(chunk_id as int) as query_id", "embedding as qvec")
    assert cells.MetricIndex.of(vectors, "chunk_id").nearest(queries, 1).where("query_id = chunk_id").count() == 9
    assert sent == [1, 1]
