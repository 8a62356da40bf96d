"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task, up to ``SHARD_WORDS`` words. Its words become
symbols of the benchmark's alphabet; words that no phrase has, and stretches too short to
hold the shortest phrase, become separators, so the index covers what a phrase can touch
and nothing it could match is left out. The index is the Burrows-Wheeler transform of the
symbols in a wavelet tree. All phrases are searched backwards at once through its ranks,
and their occurrences are located by walking to sampled suffix positions. Occurrences are
merged into removal spans.

The benchmark's phrases go to the tasks in blocks of about ``BLOCK_WORDS`` words, one block
at a time: what is found with a block is written before the next one is sent. A long item is
cut into pieces that overlap by a window less one word, so neither a broadcast nor a task's
memory grows with the benchmark.

Cases: null texts have no words; an item without words has no window; an item of fewer than
``WINDOW`` words is one window; items without an id mark words but are not named; repeated
ids count once; empty tables on either side give clean documents; other columns pass
through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.llm.common import SCAN_TABLE, WORD_BREAKS, ascii_lower, scan_words, sliced, sql_words, utf8, written
from docloom.session import table

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 200_000
SAMPLE = 8
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class WaveletTree:
    """Access and rank over integers below ``1 << depth``, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.n = depth, len(symbols)
        self.bits, self.ones, self.zeros = [], [], []
        level = symbols
        for d in range(depth - 1, -1, -1):
            bit = (level >> d & 1).astype(np.int8)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append(bit)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        low, high = np.zeros_like(i), i
        for k, d in enumerate(range(self.depth - 1, -1, -1)):
            one, ones, zeros = (symbol >> d & 1).astype(bool), self.ones[k], self.zeros[k]
            low, high = np.where(one, zeros + ones[low], low - ones[low]), np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol, low, at = np.zeros_like(i), np.zeros_like(i), i
        for k in range(self.depth):
            one, ones, zeros = self.bits[k][at].astype(bool), self.ones[k], self.zeros[k]
            symbol = symbol << 1 | one
            low, at = np.where(one, zeros + ones[low], low - ones[low]), np.where(one, zeros + ones[at], at - ones[at])
        return symbol, at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; separators (0) sort among themselves by position."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    apart = np.flatnonzero(symbols == 0)
    rank[symbols > 0] += len(apart)
    rank[apart] = np.arange(len(apart))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])]) if n else sorted_rank
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Count and locate words of a text of symbols 1..sigma, in which 0 separates."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        bwt = symbols[order - 1] if len(symbols) else symbols  # the text begins with a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))]).astype(np.int64)
        self.tree = WaveletTree(bwt.astype(np.int64), max(1, int(sigma).bit_length()))
        # every sample-th position and the word after each separator, so a walk never crosses one
        sampled = order % sample == 0
        sampled |= bwt == 0
        self.sampled, self.order = sampled, np.where(sampled, order, -1)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each phrase (rows of symbols, right-aligned)."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.tree.n, np.int64)
        for step in range(width):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            out[open_[done]] = self.order[rows[open_[done]]] + steps
            open_ = open_[~done]
            symbol, rank = self.tree.access_rank(rows[open_])
            rows[open_] = self.first[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        known: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = scan_words((text or "").encode())
            for i in range(max(1, len(words) - window + 1) if words else 0):
                known.setdefault(tuple(words[i : i + window]), set()).add(item)
        vocabulary = sorted({w for p in known for w in p})
        self.symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.sigma = len(vocabulary)
        self.lengths = np.array([len(p) for p in known], np.int64)
        self.items = [sorted(x for x in found if x is not None) for found in known.values()]
        self.shortest = int(self.lengths.min()) if known else 0
        self.rows = np.zeros((len(known), window), np.int64)
        for row, p in zip(self.rows, known):
            row[window - len(p) :] = [self.symbol[w] for w in p]

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all occurrences in the symbols of a shard, whose documents 0 separates."""
        none = np.empty(0, np.int64)
        if not self.sigma:
            return none, none
        # stretches of benchmark words between others
        edge = np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return none, none
        # the stretches, each after one separator
        lengths = ends - starts + 1
        place = np.repeat(starts - 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        head = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        text = symbols[np.maximum(place, 0)]
        text[head] = 0
        index = FMIndex(text, self.sigma)
        low, high = index.ranges(self.rows, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return phrase, place[index.locate(rows)]


def search_shard(texts: list[bytes], block: Phrases, had: list[tuple[list, list]] | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[list]]:
    """Words, merged removal spans and named items of each document; ``had`` are spans and items found before."""
    words = [scan_words(x) for x in texts]
    n = [len(w) for w in words]
    # one place before each document, so spans of two never touch
    begins = np.cumsum([1] + [x + 1 for x in n[:-1]]) if n else np.empty(0, np.int64)
    total = int(sum(n)) + len(n)
    hit = np.zeros(total + 1, np.int32)
    named: list[set] = [set() for _ in texts]
    for d, (spans, items) in enumerate(had or []):
        named[d].update(items)
        for span in spans:
            hit[begins[d] + span["start"]] += 1
            hit[begins[d] + span["end"]] -= 1
    get = block.symbol.get
    symbols = np.zeros(total, np.int64)
    for begin, w in zip(begins, words):
        symbols[begin : begin + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
    phrase, start = block.search(symbols)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + block.lengths[phrase], -1)
    doc = np.searchsorted(begins, start, side="right") - 1
    for pair in np.unique(doc * np.int64(len(block.items) + 1) + phrase):
        d, p = divmod(int(pair), len(block.items) + 1)
        named[d].update(block.items[p])
    covered = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for d, a, b in zip((np.searchsorted(begins, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
        spans[d].append((a - int(begins[d]), b - int(begins[d])))
    return n, spans, [sorted(x) for x in named]


def pieces(benchmark: DataFrame, window: int, words: int) -> DataFrame:
    """(item_id, words) of the items: distinct runs of at most ``words`` words and a window, which hold every window once or more."""
    split = F.filter(F.split(ascii_lower("text"), WORD_BREAKS), lambda w: w != "")
    items = benchmark.select("item_id", split.alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"sequence(0, greatest(0, size(w) - {window}), {words})")
    each = items.select("item_id", "w", F.explode(starts).alias("at"))
    return each.select("item_id", F.slice("w", F.col("at") + 1, F.lit(words + window - 1)).alias("words")).distinct()


def blocked(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """(item_id, words, block) of the benchmark's pieces and how many blocks there are.

    Blocks are cut where the words counted so far pass ``block_words``, so each has at most
    one piece more, whatever the ids. Pieces are counted in buckets by their hash.
    """
    held = written(pieces(benchmark, window, max(window, block_words // 16)).withColumn("n", F.size("words")), "pieces")
    blocks = int(-(-(held.agg(F.sum("n").alias("n")).first().n or 0) // block_words)) or 1
    if blocks == 1:
        return held.select("item_id", "words", F.lit(0).cast("long").alias("block")), 1
    held = written(held.withColumn("bucket", F.pmod(F.xxhash64("item_id", "words"), F.lit(4 * blocks))), "pieces")
    sizes = held.groupBy("bucket").agg(F.sum("n").alias("m"))
    starts = sizes.select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("start"))  # a row for each bucket
    running = F.sum("n").over(Window.partitionBy("bucket").orderBy("words", "item_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = held.withColumn("before", running).join(starts, "bucket")
    placed = placed.select("item_id", "words", F.floor((F.col("start") + F.col("before")) / block_words).alias("block"))
    placed = written(placed.repartitionByRange("block").sortWithinPartitions("block"), "pieces")  # a block is read alone
    return placed, placed.agg(F.max("block").alias("last")).first().last + 1


def read_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The phrases in blocks of about ``block_words`` words, one after the other."""
    held, blocks = blocked(benchmark, window, block_words)
    for i in range(blocks):
        part = held.where(F.col("block") == i) if blocks > 1 else held
        yield Phrases([(r["item_id"], " ".join(r["words"])) for r in part.select("item_id", "words").collect()], window)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (merged word ranges of benchmark passages) and ``items``.

    The names get ``prefix``; they take the place of columns so named.
    """
    names = [prefix + n for n in ("n_words", "spans", "items")]
    out, plain = None, docs.drop(*names)
    for block in read_blocks(benchmark, window, block_words):
        found = plain if out is None else written(out, "decontaminated")
        out = _search(found, block, names, benchmark.schema["item_id"].dataType, shard_words)
    return out


def _search(docs: DataFrame, block: Phrases, names: list[str], item_type: T.DataType, shard_words: int) -> DataFrame:
    """``docs`` with the three columns, added or completed by what a block has."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    width, again = len(docs.columns), names[0] in docs.columns
    width -= 3 * again
    added = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), SPAN, T.ArrayType(item_type)))])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema.fields[:width]], *added])
    arrow = to_arrow_schema(schema)
    text_at = docs.columns.index("text")

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for b in held for x in utf8(b.column(text_at))]
        had = [pair for b in held for pair in zip(b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist())] if again else None
        n, spans, items = search_shard(texts, sent.value, had)
        at = 0
        for b in held:
            part = slice(at, at + b.num_rows)
            at += b.num_rows
            new = [
                pa.array(n[part], pa.int64()),
                pa.array([[{"start": x, "end": y} for x, y in s] for s in spans[part]], arrow.field(width + 1).type),
                pa.array(items[part], arrow.field(width + 2).type),
            ]
            yield pa.RecordBatch.from_arrays([*[c.cast(arrow.field(i).type) for i, c in enumerate(b.columns[:width])], *new], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in sliced(batches, text_at, 6 * max(1, shard_words // 16)):
            held.append(part)
            size += part.column(text_at).nbytes // 6
            if size >= shard_words:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, schema)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of its removal spans, and without what stands between them."""
    raw = text.encode()
    plain = raw.translate(SCAN_TABLE)
    bounds = np.diff(np.concatenate([[0], (np.frombuffer(plain, np.uint8) != 32).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts; the others pass as they are."""
    cut = F.udf(lambda text, spans: remove_spans(text, spans) if spans else text, "string", useArrow=True)
    found = scan(docs, benchmark, prefix="__", **settings)
    return found.withColumn("text", cut("text", "__spans")).select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    return scan(docs, table(spark, sf_dir, "benchmark"), prefix="__").where(F.size("__spans") == 0).select(*docs.columns)


def brute_scan(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, str]:
    """(n_words, n_hit, items_sha256) by comparing every window with every place; for tests."""
    words = scan_words((text or "").encode())
    hit, named = set(), set()
    for item, other in items:
        w = scan_words((other or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    named.add(item)
    names = ",".join(sorted(str(x) for x in named if x is not None))
    return len(words), len(hit), hashlib.sha256(names.encode()).hexdigest()


OP4_SQL = f"""
WITH b AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark),
v AS (SELECT item_id, unnest(list_transform(range(0, greatest(1, len(w) - {WINDOW - 1})), lambda i: w[i + 1:i + {WINDOW}])) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, len(p) AS m, array_to_string(p, ' ') AS p FROM v),
d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
g AS (SELECT r, m, unnest(range(0, len(w) - m + 1)) AS i, w FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
h AS (SELECT DISTINCT r, i, g.m, item_id FROM (SELECT r, m, i, array_to_string(w[i + 1:i + m], ' ') AS p FROM g) g JOIN bw ON bw.m = g.m AND bw.p = g.p),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, m FROM h), unnest(range(0, m)) u(k) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
