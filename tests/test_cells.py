"""Nearest vectors by cells equal those of measuring all."""

import numpy as np
import pytest

from docloom.operators import cells, graph


def saved(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "chunk_id long, embedding array<float>")


def clusters(n=600, dim=8, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    rows = [(i, centres[i % groups] + rng.normal(size=dim) * 0.2) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(200)]  # one vector many times
    rows += [(n + 200 + i, np.zeros(dim)) for i in range(3)]
    return rows


def plain(rows, queries, k, metric="l2"):
    keys, v = np.array([i for i, _ in rows]), np.array([np.float32(x) for _, x in rows]).astype(np.float64)
    out = []
    for q_id, q in queries:
        q = np.float32(q).astype(np.float64)
        if metric == "l2":
            d, ids = np.sqrt(((v - q) ** 2).sum(1)), keys
        else:
            size = np.linalg.norm(v, axis=1)
            ids, d = keys[size > 0], 1 - (v[size > 0] @ q) / (size[size > 0] * np.linalg.norm(q))
        d = np.round(d, 9)
        for r, i in enumerate(np.lexsort((ids, d))[:k]):
            out.append((q_id, int(ids[i]), r + 1))
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_to_measuring_all(spark, metric):
    rows = clusters()
    queries = [(i, v) for i, v in rows if i % 60 == 0 and i < 600] + [(10_000, np.full(8, 0.3))]
    index = cells.MetricIndex.of(saved(spark, rows), "chunk_id", metric, part=50)
    asked = saved(spark, queries).selectExpr("cast(chunk_id as int) as query_id", "embedding as qvec")
    got = sorted((r.query_id, r.chunk_id, r["rank"]) for r in index.nearest(asked, 7).collect())
    assert got == plain(rows, queries, 7, metric)
    assert index.parts.agg({"n": "max"}).first()[0] < 150  # copies are dealt out
    if metric == "l2":
        read = [r["read"] for r in index.nearest(asked, 7, counted=True).collect()]
        assert len(read) == len(queries) and sum(read) < 0.5 * len(rows) * len(queries), read


def test_fewer_vectors_than_asked_and_nulls(spark):
    df = saved(spark, [(1, [1, 2]), (2, [3, 4])]).union(spark.createDataFrame([(3, None)], "chunk_id long, embedding array<float>"))
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, None)], "query_id int, qvec array<double>")
    got = [(r.query_id, r.chunk_id, r["rank"]) for r in cells.nearest(asked, df, "chunk_id", 5).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert cells.nearest(asked, df.limit(0), "chunk_id", 5).count() == 0


def test_similar_edges_with_skipped_blocks(spark):
    """Edges at a threshold equal those of all pairs; far blocks never meet."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for paper in range(24):
        for c in range(1 + paper % 5):
            rows.append((paper, len(rows), [float(x) for x in centres[paper % 6] + rng.normal(size=16) * (0.05 if paper % 4 else 0.6)]))
    rows.append((99, 1000, [0.0] * 16))
    vectors = spark.createDataFrame(rows, "paper_id long, chunk_id long, embedding array<double>")
    whole = graph.similar_edges(graph.pair_similarity(vectors), 0.82)
    found, skipped = graph.similar_pairs(vectors, 0.82, block=8)
    row = lambda df: sorted((r.source_paper_id, r.target_paper_id, round(r.confidence, 9), r.evidence_chunk_id) for r in df.collect())
    assert row(graph.similar_edges(found, 0.82)) == row(whole) != []
    pairs = skipped.first()
    assert 0 < pairs.met < pairs.every, pairs


def test_cosines_below_the_threshold_stay_in_their_tile(spark):
    """Single vectors: only pairs at the threshold leave a pair of tiles, though all blocks meet."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(60, 16))
    rows = [(i, i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([near, near + rng.normal(size=near.shape) * 0.05, rng.normal(size=(180, 16))]))]
    vectors = spark.createDataFrame(rows, "paper_id long, chunk_id long, embedding array<double>")
    unit = np.array([v for _, _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if round(float(unit[i] @ unit[j]), 9) >= 0.82}
    found = {(r.paper_a, r.paper_b) for r in graph.similar_pairs(vectors, 0.82, block=20)[0].collect()}
    assert found == want and len(want) >= 60


def test_best_pairs_are_alike_for_any_tiles(spark):
    """Papers of many vectors, with ties, whose best three pairs lie in several strips and tiles."""
    rng = np.random.default_rng(6)
    rows = [(i % 4, i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(700)]
    vectors = spark.createDataFrame(rows, "paper_id int, chunk_id long, embedding array<float>")
    row = lambda df: sorted((r.paper_a, r.paper_b, round(r.score, 9), r.evidence_chunk_id, r.n) for r in df.collect())
    v = np.array([x for _, _, x in rows])
    norm = np.linalg.norm(v, axis=1)
    ok = np.flatnonzero(norm > 0)
    want = []
    for a in range(4):
        for b in range(a + 1, 4):
            best = sorted((-round(float(v[i] @ v[j] / norm[i] / norm[j]), 9), i, j) for i in ok if i % 4 == a for j in ok if j % 4 == b)[:3]
            want.append((a, b, round(-sum(x[0] for x in best) / 3, 9), best[0][1], 3))
    assert row(graph.pair_similarity(vectors)) == row(graph.pair_similarity(vectors, block=90)) == want
    of = spark.createDataFrame([(0,), (3,)], "paper_id int")
    assert row(graph.pair_similarity(vectors, block=90, of=of)) == [w for w in want if {w[0], w[1]} & {0, 3}]
