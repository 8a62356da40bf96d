"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Words are hashed to ``BUCKETS`` buckets, each with a sparse ternary index vector. A bucket's
word vector is the sum of the index vectors of its words' neighbours over all documents
(random indexing), so no word is left out and the table has one size whatever the corpus. A
token's shape (letter case, digits and punctuation, runs shortened) has an index vector of its
own. A document is the mean of its tokens' vectors, their spread, the norms of the mean, its
length, and how far its tokens repeat. A two-layer network gives a logit, and a temperature
fitted on rows kept apart from training makes it a probability.

The network is fitted on a bounded sample: at most ``TRAIN_ROWS`` labelled documents, chosen
by hash of the id among those whose CRC-32 of the id modulo 5 is not 0. Features are computed
on executors from whole texts; the driver gets the sample's features and the table of word
vectors, both of bounded size. Every document is scored.

Cases: null and empty texts have zero features and the score that follows from them; rows
without an id count as held out and never train; labels that are null, contradictory or of
missing documents are left out of the fit; of repeated ids one row trains; without both
classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.llm.common import sliced, utf8
from docloom.session import table

DIMS = 32
NONZERO = 4
CONTEXT = 2
#: Powers of two: buckets of words and of shapes.
BUCKETS, SHAPE_BUCKETS = 1 << 15, 1 << 12
TRAIN_ROWS = 8000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
SEED = 9
#: Tokens whose codes a task keeps; beyond that it starts anew, with equal results.
KEPT_TOKENS = 200_000
#: Tokens that are looked up in the tables at once.
PIECE = 1 << 16

#: Mean and spread of both vectors, two norms, log length, adjacent repeats, concentration.
FEATURES = 4 * DIMS + 5

#: Shape classes of bytes: upper, lower, digit, each ASCII mark by itself, the rest as letters.
SHAPES = bytes(
    88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_RUN = re.compile(rb"(.)\1+", re.S)


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: NONZERO random places of each row get +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIMS), np.int8)
    at, sign = rng.integers(0, DIMS, (rows, NONZERO)), rng.choice(np.array([-1, 1], np.int8), (rows, NONZERO))
    np.add.at(out, (np.arange(rows)[:, None], at), sign)
    return out


def shape_of(token: bytes) -> bytes:
    """Character classes of a token with runs shortened to one."""
    return _RUN.sub(rb"\1", token.translate(SHAPES))


def word_of(token: bytes) -> bytes:
    return token.strip(MARKS).lower()


class Codes(dict):
    """token -> its own hash, its word's bucket and its shape's bucket in one integer."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        word, shape = zlib.crc32(word_of(token)) % BUCKETS, zlib.crc32(shape_of(token)) % SHAPE_BUCKETS
        code = zlib.crc32(token, 1) << 28 | word << 12 | shape
        self[token] = code
        return code

    def of(self, text: bytes) -> np.ndarray:
        tokens = text.split()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def words_of(codes: np.ndarray) -> np.ndarray:
    return codes >> 12 & (BUCKETS - 1)


def pooled(table: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``at`` of a table and of their squares, each row so many times."""
    total, square = np.zeros(DIMS), np.zeros(DIMS)
    for i in range(0, len(at), PIECE):
        rows, n = table[at[i : i + PIECE]].astype(np.float64), counts[i : i + PIECE].astype(np.float64)
        total += n @ rows
        square += n @ np.square(rows)
    return total, square


def features(codes: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Pooled features of a whole text: mean, spread, norms, length and repeats."""
    out, n = np.zeros(FEATURES, np.float32), len(codes)
    if not n:
        return out
    distinct, counts = np.unique(codes, return_counts=True)
    sums = [pooled(words, words_of(distinct), counts), pooled(shapes, distinct & (SHAPE_BUCKETS - 1), counts)]
    mean, square = (np.concatenate(x) / n for x in zip(*sums))
    out[: 2 * DIMS], out[2 * DIMS : 4 * DIMS] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    share = (codes[1:] == codes[:-1]).mean() if n > 1 else 0, np.sqrt(np.square(counts / n).sum())
    out[4 * DIMS :] = np.linalg.norm(mean[:DIMS]), np.linalg.norm(mean[DIMS:]), np.log1p(n), *share
    return out


class Network:
    """Two layers, tanh between them, trained by Adam on log loss; standardised inputs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = self.standard(x)
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                a = np.tanh(x[part] @ self.p[0] + self.p[1])
                d = (sigmoid(a @ self.p[2] + self.p[3]) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - a * a)
                grads = [x[part].T @ back + 1e-3 * self.p[0], back.sum(axis=0), a.T @ d + 1e-3 * self.p[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes log loss least on held-apart rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.logaddexp(0, np.where(y > 0, -logit, logit) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(y) else 1.0


class Model:
    """Word vectors, network and temperature."""

    def __init__(self, words: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.words, self.shapes, self.network, self.t = words, shape_vectors(), None, 1.0
        self.base = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) == 2:
            apart = np.arange(len(y)) % 6 == 0
            if len(np.unique(y[~apart])) == 2:
                self.network = Network(x[~apart], y[~apart])
                self.t = temperature(self.network.logit(x[apart]), y[apart])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.base) if self.network is None else sigmoid(self.network.logit(x) / self.t)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never train: CRC-32 of the id's text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def training_rows(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled ids that may train, chosen by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    once = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").drop("z")
    return once.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def shape_vectors() -> np.ndarray:
    return index_vectors(SHAPE_BUCKETS, SEED + 1).astype(np.float32)


def contexts(ids: np.ndarray, index: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sums) for the words low to high: of each bucket, the index vectors of all words at most CONTEXT places away.

    Bucket ``BUCKETS`` stands between texts; its index vector is zero.
    """
    vectors = index[ids].astype(np.int32)
    near = np.zeros_like(vectors)
    for k in range(1, CONTEXT + 1):
        near[k:] += vectors[:-k]
        near[:-k] += vectors[k:]
    ids, near = ids[low:high], near[low:high]
    order = np.argsort(ids, kind="stable")
    found, starts = np.unique(ids[order], return_index=True)
    return found, np.add.reduceat(near[order], starts)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of the word buckets, from their neighbours in all documents; a row of them for each bucket."""
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, gap = Codes(), np.full(CONTEXT, BUCKETS)
        index = np.concatenate([index_vectors(BUCKETS, SEED), np.zeros((1, DIMS), np.int8)])
        sums = np.zeros((BUCKETS + 1, DIMS), np.int64)
        for batch in sliced(batches, 0, 1 << 20):
            ids = np.concatenate([x for t in utf8(batch.column(0)) for x in (words_of(codes.of(t)), gap)])
            # in pieces, each with the words around it
            for at in range(0, len(ids), PIECE):
                low, high = max(0, at - CONTEXT), min(len(ids), at + PIECE + CONTEXT)
                found, near = contexts(ids[low:high], index, at - low, min(len(ids), at + PIECE) - low)
                sums[found] += near
        sums[BUCKETS] = 0
        kept = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(kept), *(pa.array(np.ascontiguousarray(sums[kept, i])) for i in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *names])

    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    summed = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    if summed.num_rows:
        vectors[summed["bucket"].to_numpy()] = np.stack([summed[n].to_numpy() for n in names], axis=1)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from word vectors of all documents and at most ``train_rows`` labelled ones."""
    rows = F.broadcast(training_rows(labels, train_rows))  # at most train_rows rows of 12 bytes
    first = Window.partitionBy("doc_id").orderBy(F.md5("text"))
    sample = docs.select("doc_id", "text").join(rows, "doc_id").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    words = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shapes = Codes(), shape_vectors()
        for batch in sliced(batches, 1):
            x = [features(codes.of(t), sent.value, shapes).tolist() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = sample.select("doc_id", "text", F.col("y").cast("int")).mapInArrow(run, f"doc_id {id_type}, y int, x array<float>").toArrow()
    order = np.argsort([zlib.crc32(str(i).encode(), SEED) for i in found["doc_id"].to_pylist()], kind="stable")
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, FEATURES)
    return Model(words, x[order], found["y"].to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score in ``out``, in place of a column of that name."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes = sent.value, Codes()
        for batch in sliced(batches, at):
            x = np.stack([features(codes.of(t), model.words, model.shapes) for t in utf8(batch.column(at))]).astype(np.float64)
            columns = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x), pa.float64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents the classifier rejects go."""
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), "__score")
    return scored.where(F.col("__score") >= THRESHOLD).select(*docs.columns)
