import zlib

import numpy as np

from docloom.llm import quality
from tests.llm.helpers import LONG, none, odd, save

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scores[r.doc_id].held_out]
    assert all(scores[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    right = [scores[r.doc_id].predicted == r.quality for r in labels]
    assert np.mean(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())


def test_labels_of_held_out_rows_are_never_used(spark):
    rows = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(5, 0, 0), (None, 1, 0), (6, None, 0), (7, 2, 0)], LABELS)
    used = {r.doc_id for r in quality.training_rows(rows).collect()}
    assert used == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 and i != 5}
    assert quality.training_rows(rows, 10).count() == 10


WORDS = np.random.default_rng(5).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)


def plain_features(text):
    """Features token by token."""
    tokens, shapes = text.split(), quality.shape_vectors()
    if not tokens:
        return np.zeros(quality.FEATURES)
    place = lambda t: np.concatenate([WORDS[zlib.crc32(quality.word_of(t)) % quality.BUCKETS], shapes[zlib.crc32(quality.shape_of(t)) % quality.SHAPE_BUCKETS]])
    rows = np.array([place(t) for t in tokens], np.float64)
    mean, n = rows.mean(axis=0), len(tokens)
    again = sum(x == y for x, y in zip(tokens, tokens[1:])) / max(1, n - 1)
    share = np.sqrt(sum((tokens.count(t) / n) ** 2 for t in set(tokens)))
    half = quality.DIMS
    return np.concatenate([mean, rows.std(axis=0), [np.linalg.norm(mean[:half]), np.linalg.norm(mean[half:]), np.log1p(n), again, share]])


def test_features_by_the_plain_rule(monkeypatch):
    texts = [b"", b"one", b"One one ONE!! one two, two", LONG[:4000].encode() + b" ONE!! a-b-c x1y22 \xc3\xa9t\xc3\xa9", b"((!!)) 12.5% a_b"]
    want = [plain_features(t) for t in texts]
    for piece, kept in ((quality.PIECE, quality.KEPT_TOKENS), (2, 2)):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality, "KEPT_TOKENS", kept)
        codes = quality.Codes()
        for t, w in zip(texts, want):
            assert np.allclose(quality.features(codes.of(t), WORDS, quality.shape_vectors()), w, atol=1e-5)
    assert quality.shape_of(b"Hello,World99!!") == b"Xx,Xx0!"


def test_word_vectors_by_the_plain_rule(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["The!!", "\u00e9t\u00e9", "(x)"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 30))) for _ in range(40)] + [None, "", "one"]
    index, want = quality.index_vectors(quality.BUCKETS, quality.SEED), np.zeros((quality.BUCKETS, quality.DIMS))
    for text in texts:
        ids = [zlib.crc32(quality.word_of(t)) % quality.BUCKETS for t in (text or "").encode().split()]
        for i, w in enumerate(ids):
            for j in range(max(0, i - quality.CONTEXT), min(len(ids), i + quality.CONTEXT + 1)):
                want[w] += index[ids[j]] if j != i else 0
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert np.allclose(quality.word_vectors(docs), want, atol=1e-6)


def test_gradients_of_the_network():
    """One step of training goes down the loss that finite differences measure."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(90, 6)), (rng.random(90) > 0.5).astype(float)
    loss = lambda n: np.logaddexp(0, np.where(y > 0, -n.logit(x), n.logit(x))).mean()
    trained = [loss(quality.Network(x, y, epochs=e)) for e in (0, 1, 20, 400)]
    assert trained == sorted(trained, reverse=True) and trained[-1] < trained[0] - 0.1


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    logit = np.where(y > 0, 1, -1) * 1.0 + rng.normal(0, 1, 2000)
    loss = lambda t: np.logaddexp(0, np.where(y > 0, -logit * 6, logit * 6) / t).mean()
    t = quality.temperature(logit * 6, y)
    assert t > 1 and loss(t) < loss(1.0)


def test_odd_and_empty_tables(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    save(spark.createDataFrame([(i, i % 2, 0) for i in range(-3, 10)] + [(None, 1, 1)], LABELS), tmp_path, "labels")
    rows = quality.op9_quality(spark, folder).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    out = quality.stage(spark, odd(spark, True), folder)
    assert out.columns == odd(spark, True).columns
    save(none(spark, LABELS), tmp_path, "labels")
    assert {r.score for r in quality.op9_quality(spark, folder).collect()} == {0.5}
    save(none(spark), tmp_path, "documents")
    assert quality.op9_quality(spark, folder).count() == 0
