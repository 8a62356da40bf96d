"""Exact top-k against sorting all scores."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import topk
from tests.llm.helpers import none, same_rows, save

VECTORS = "vec_id long, embedding array<float>, label int"
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def plain(rows, k=5, every=50):
    kept = []
    for vec_id, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [min(max(math.floor(256.0 * float(np.float32(x))), LONG_MIN), LONG_MAX) for x in v]))
    out = []
    for i, (q_id, q) in enumerate(kept):
        if q_id is None or q_id % every:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(q, v)), LONG_MIN), LONG_MAX), vec_id) for j, (vec_id, v) in enumerate(kept) if j != i]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(q_id, r + 1, vec_id, s) for r, (s, vec_id) in enumerate(scored[:k])]
    return out


def answer(spark, folder):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op12_topk(spark, folder).collect()]


def saved(spark, tmp_path, rows, extra=False):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in ("row", "v", "cutoff", "score", "rank", "q", "c", "query_id")})
    return save(df, tmp_path, "embeddings")


ODD = [
    (0, [0.5, -0.25, 1.0]),
    (0, [0.5, -0.25, 1.0]),  # a copy is a candidate, the row itself is not
    (50, [0.1, 0.2]),  # shorter
    (100, []),
    (150, None),
    (200, [0.1, None, 0.3]),
    (250, [float("nan"), 1.0, 1.0]),
    (300, [float("inf"), 1.0, 1.0]),
    (None, [9.0, 9.0, 9.0]),
    (-50, [-1.0, -1.0, -1.0]),
    (7, [0.001, 0.001, 0.001]),
    (8, [-0.001, 0.001, 0.001]),
    (9, [0.5, -0.25, 1.0]),
]


def test_odd_table(spark, tmp_path):
    got = answer(spark, saved(spark, tmp_path, ODD, True))
    assert len(got) == 25 and same_rows(got, plain(ODD))


def test_huge_components(spark, tmp_path):
    rows = [(0, [3e38, 1.0]), (1, [3e38, -3e38]), (2, [-3e38, 2.0]), (50, [1e6, 1e6]), (3, [1e6, 1e5]), (4, [2e12, 1e12])]
    assert same_rows(answer(spark, saved(spark, tmp_path, rows)), plain(rows))


def test_few_and_none(spark, tmp_path):
    assert answer(spark, saved(spark, tmp_path / "a", [(0, [1.0])])) == []
    rows = [(0, [1.0]), (3, [2.0]), (4, [-1.0])]
    assert answer(spark, saved(spark, tmp_path / "b", rows)) == [(0, 1, 3, 131072), (0, 2, 4, -65536)]
    assert answer(spark, save(none(spark, VECTORS), tmp_path / "c", "embeddings")) == []


def test_many_copies_and_ties_over_blocks(spark, tmp_path, monkeypatch):
    """Blocks of a few rows, a third of them one vector, negative scores, ties at the last rank."""
    monkeypatch.setattr(topk, "LEAST_BLOCK", 16)
    monkeypatch.setattr(topk, "MOST_BLOCK", 32)
    rng = random.Random(5)
    hot = [rng.uniform(-1, 1) for _ in range(10)]
    rows = []
    for i in range(400):
        v = hot if i % 3 == 0 else [rng.choice((-1.0, 0.0, 1.0)) for _ in range(10)] if i % 3 == 1 else [rng.gauss(0, 1) for _ in range(10)]
        rows.append((i // 2 if i % 10 == 0 else i, v))
    assert same_rows(answer(spark, saved(spark, tmp_path, rows)), plain(rows))


def test_uniform_threshold_keeps_every_best_entry():
    """Whatever the signs, an entry at the cutoff has a slice at the threshold."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        partial = [rng.integers(-50, 50, 60) for _ in range(topk.SLICES)]
        total, allowed = np.sum(partial, axis=0), np.ones(60, bool)
        cutoff = int(np.sort(total)[-5])
        assert set(np.flatnonzero(total >= cutoff)) <= set(topk.sufficient(partial, allowed, cutoff))
        found = topk.gathered(partial, np.arange(60), allowed, 5)
        assert np.sort(total[found])[-5] <= cutoff


def test_partial_scores_beyond_doubles_are_exact():
    a, b = np.array([[(1 << 40) + 1, 3]]), np.array([[(1 << 40) - 1, -7]])
    assert sum(p[0][0] for p in topk.partial_scores(a, b)) == ((1 << 40) + 1) * ((1 << 40) - 1) - 21
