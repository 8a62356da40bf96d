"""Top-k search over block-max postings.

The postings of a term within a range of ``SHARD`` keys are one row: places, frequencies and
lengths of chunks side by side, in blocks of ``BLOCK`` of them. Of each block the row keeps the
(frequency, length) pairs that no other pair of the block beats in both, so the most that a
block can add to a score is known for whatever number and mean length of chunks there are.

A search takes the rows of its words and cuts each range of keys where any word's block ends.
In the stretches between the cuts the blocks' bounds add up to a bound for every chunk. The
stretches are visited from the highest bound down, and once k scores are at least the next
bound the rest is left unread. Ranges are independent of each other, so a search spreads over
tasks and a frequent word is never one task's. Scores, ranks and ties are those of a full scan.

Totals (n chunks, words) are rows to be summed, one for each addition or removal, so a search
reads no chunk's length. Chunks in ``gone`` are in no result and count in no frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.lexical import B, K1, LEAST_IDF, come_again, top

BLOCK, SHARD = 128, 1 << 16
#: Postings that are packed at once.
AT_ONCE = 1 << 20
#: Postings that a task puts in order, about.
TASK_POSTINGS = 1 << 19
#: Stretches of a walk's first batch.
FIRST = 16
#: Digits to which scores are compared, as in ``lexical.top``.
DIGITS = 9
ROWS = "term string, shard long, n int, places binary, tfs binary, lens binary, ends binary, edge_tf binary, edge_len binary, edges binary"


def edges(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the pairs that no other pair has more of and less of: rising frequency, rising length."""
    order = np.lexsort((size, -tf))
    best = np.minimum.accumulate(size[order])
    return order[np.append(True, best[1:] < best[:-1])]


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of values as bytes of 32-bit numbers; ``starts`` has their beginnings and the end."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(values.astype(np.uint32))])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of one row or about ``AT_ONCE`` postings."""
    ends, at = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS from (term, shard, postings as a list of (place, tf, len)); many rows at once."""
    for batch in (part for whole in batches for part in _cut(whole)):
        found = batch.column(2)
        n = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if not n.sum():
            continue
        place, tf, size = (found.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        starts = np.append(0, np.cumsum(n))
        blocks = -(-n // BLOCK)
        of_row = np.append(0, np.cumsum(blocks))
        # the block of each posting
        within = np.arange(len(place)) - np.repeat(starts[:-1], n)
        block = np.repeat(of_row[:-1], n) + within // BLOCK
        last = np.append(np.flatnonzero(np.diff(block)), len(block) - 1)
        # edges of all blocks: a block's sizes are lowered below those of the blocks before, so one running minimum serves all
        order = np.lexsort((size, -tf, block))
        best = np.minimum.accumulate(size[order] - block[order] * (size.max() + 1))
        edge = order[np.append(True, best[1:] < best[:-1])]
        counts = np.bincount(block[edge], minlength=of_row[-1])
        upto = np.append(0, np.cumsum(counts))
        # of each row a 0 and the sums of its blocks' edges
        row_of = np.repeat(np.arange(len(n)), blocks + 1)
        k = np.arange(len(row_of)) - np.repeat(of_row[:-1] + np.arange(len(n)), blocks + 1)
        sums = upto[of_row[row_of] + k] - upto[of_row[row_of]]
        edge_starts = upto[of_row]
        columns = [
            batch.column(0), batch.column(1), pa.array(n, pa.int32()), _binaries(place, starts), _binaries(tf, starts), _binaries(size, starts), _binaries(place[last], of_row),
            _binaries(tf[edge], edge_starts), _binaries(size[edge], edge_starts), _binaries(sums, of_row + np.arange(len(of_row))),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in ROWS.split(", ")])


def _shard(key: str) -> Column:
    return F.shiftright(F.col(key).cast("long"), SHARD.bit_length() - 1)


def _place(key: str) -> Column:
    return F.col(key).cast("long").bitwiseAND(F.lit(SHARD - 1)).cast("int")


def parts(n: int) -> int:
    """Tasks to put n postings in order."""
    return max(1, -(-n // TASK_POSTINGS))


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where the groups of rows in the order of (term, shard) begin."""
    term, shard = rows.column(0).dictionary_encode().indices.to_numpy(), rows.column(1).to_numpy()
    return np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(shard) != 0)))


def _listed(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """(term, shard, postings as a list) of rows (term, shard, place, tf, len) with the groups' starts."""
    postings = pa.StructArray.from_arrays(rows.columns[2:], ["place", "tf", "len"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), postings)
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(starts)) for c in rows.columns[:2]), lists], ["term", "shard", "found"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of rows in order; the last group of a batch waits for the next, which may go on with it."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    of = lambda batch, i: (batch.column(0)[i], batch.column(1)[i])
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if of(held[0], 0) == of(batch, batch.num_rows - 1):
            continue
        rows = whole()
        starts = _starts(rows)
        yield _listed(rows.slice(0, starts[-1]), starts[:-1])
        held = [rows.slice(starts[-1])]
    if held:
        yield _listed(whole(), np.zeros(1, np.int64))


def _sized(postings: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, len) of postings and lengths (key, len).

    Postings may have the len of their chunk already; then only those of keys with several
    lengths are joined with them.
    """
    tf = F.size("positions").alias("tf")
    again = come_again(lengths, key) if "len" in postings.columns else None
    if again is None:
        return postings.select("term", key, tf).join(lengths, key)
    joined = postings.where(again).select("term", key, tf).join(lengths.where(again), key)
    return postings.where(~again).select("term", key, tf, "len").unionByName(joined.select("term", key, "tf", "len"))


def block_rows(postings: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Rows of ROWS from postings (term, key, positions), with len or not, and lengths (key, len); a row has at most SHARD postings.

    Postings are dealt by term and shard and put in order once, by tasks of about the same size
    however many there are; a row is packed when its last posting has been read.
    """
    each = _sized(postings, lengths, key)
    order = ("term", "shard", "place", "tf", "len")
    entries = each.select("term", _shard(key).alias("shard"), _place(key).alias("place"), F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
    dealt = entries.repartition(parts(postings.count()), "term", "shard").sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda batches: _packed(_grouped(batches)), ROWS)


def totals(lengths: DataFrame) -> DataFrame:
    """(n, words) of chunks: one row."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("words"))


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.int64)


class PostingList:
    """One word's postings in a range of keys, of which blocks are decoded when a walk asks for them."""

    def __init__(self, row: dict, idf: float, mean: float):
        self.row, self.idf, self.mean = row, idf, mean
        self.ends = _ints(row["ends"])
        most = self.impact(_ints(row["edge_tf"]), _ints(row["edge_len"]))
        self.bounds = np.maximum.reduceat(most, _ints(row["edges"])[:-1])
        self.read: set[int] = set()

    def impact(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """BM25 of the word for frequencies and lengths."""
        return self.idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of blocks."""
        self.read.update(which.tolist())
        whole = len(self.ends) == len(which)
        part = slice(None) if whole else (which[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
        place, tf, size = (np.frombuffer(self.row[c], np.uint32) for c in ("places", "tfs", "lens"))
        if not whole:
            part = part[part < len(place)]
        return place[part].astype(np.int64), self.impact(tf[part].astype(np.float64), size[part].astype(np.float64))


def walk(lists: list[PostingList], k: int, every: int = 0, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best chunks of a range of keys, ties to the smaller; ``every`` is how many words they need.

    Stretches are visited in batches that double, so a walk that reads much takes few steps of
    whole arrays, and one that ends early has read little.
    """
    cuts = np.unique(np.concatenate([x.ends for x in lists]))  # a stretch reaches to its cut, that included
    bound, words = np.zeros(len(cuts)), np.zeros(len(cuts), np.int64)
    at = [np.searchsorted(x.ends, cuts) for x in lists]
    for x, i in zip(lists, at, strict=True):
        bound += np.append(x.bounds, 0.0)[i]
        words += i < len(x.ends)
    order = np.argsort(-bound, kind="stable")
    order = order[words[order] >= max(every, 1)]
    places, scores, visited, some = np.zeros(0, np.int64), np.zeros(0), 0, FIRST
    while visited < len(order):
        least = scores[-1] - 10.0**-DIGITS if len(scores) == k else -1.0
        batch = order[visited : visited + some]
        batch = batch[bound[batch] >= least]
        if not len(batch):
            break
        visited, some = visited + some, 2 * some
        place, score = _scores(lists, at, cuts, batch, every, least)
        if gone is not None and len(place):
            kept = ~np.isin(place, gone)
            place, score = place[kept], score[kept]
        places, scores = np.append(places, place), np.append(scores, np.round(score, DIGITS))
        best = np.lexsort((places, -scores))[:k]
        places, scores = places[best], scores[best]
    return places, scores


def _scores(lists: list[PostingList], at: list[np.ndarray], cuts: np.ndarray, batch: np.ndarray, every: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the chunks of some stretches; of a stretch whose words so far and to come can't reach ``least`` the rest stays unread."""
    order = np.sort(batch)
    stretch = np.full(len(cuts), -1)
    stretch[order] = np.arange(len(order))
    left = sum(np.append(x.bounds, 0.0)[i[order]] for x, i in zip(lists, at, strict=True)) + 10.0**-DIGITS
    top = np.zeros(len(order))
    score, n = np.zeros(SHARD), np.zeros(SHARD, np.int32)
    # the rarest words first: where they are not, or not enough, the blocks of the others stay as they are
    for x, i in sorted(zip(lists, at, strict=True), key=lambda x: -x[0].bounds.max()):
        here = i[order]
        live = (here < len(x.ends)) & (top + left >= least)
        blocks = np.unique(here[live])
        if len(blocks):
            place, impact = x.blocks(blocks)
            of = stretch[np.searchsorted(cuts, place)]
            inside = of >= 0
            inside[inside] = live[of[inside]]
            place, impact, of = place[inside], impact[inside], of[inside]
            score[place] += impact
            n[place] += 1
            np.maximum.at(top, of, score[place])
        left -= np.append(x.bounds, 0.0)[here]
    place = np.flatnonzero(n >= max(every, 1))
    return place, score[place]


def _live(n: pd.Series, places: pd.Series, gone: pd.Series) -> pd.Series:
    """How many postings of a row are of chunks that are there."""
    return pd.Series([int(m if g is None else m - np.isin(_ints(p), np.asarray(g, np.int64)).sum()) for m, p, g in zip(n, places, gone, strict=True)], dtype="int64")


def _walked(k: int) -> Callable[[pa.Table], pa.Table]:
    def of(rows: pa.Table) -> pa.Table:
        found = rows.to_pylist()
        first, lists = found[0], []
        for row in found:
            idf = max(float(np.log((row["chunks"] - row["df"] + 0.5) / (row["df"] + 0.5))), LEAST_IDF)
            lists.append(PostingList(row, idf, row["words"] / row["chunks"]))
        gone = None if first["gone"] is None else np.asarray(first["gone"], np.int64)
        places, scores = walk(lists, k, first["asked"], gone)
        columns = [pa.array([first["query_id"]] * len(places), rows.schema.field("query_id").type), pa.array(places + first["shard"] * SHARD), pa.array(scores)]
        return pa.table(columns, names=["query_id", "key", "score"])

    return of


def best(
    rows: DataFrame, counted: DataFrame, wanted: DataFrame, key: str, k: int, found: Column | None = None, gone: DataFrame | None = None, every: bool = False,
) -> DataFrame:
    """(query_id, key, score, rank): the k best chunks by BM25 for distinct words (query_id, term) of any number of queries.

    ``counted`` has the totals to be summed, ``gone`` the keys that count no more. ``found`` is
    a filter on term that the scan takes; without it the rows are joined with the words.
    """
    asked = wanted.withColumn("asked", F.lit(1)) if not every else wanted.join(wanted.groupBy("query_id").agg(F.count("*").cast("int").alias("asked")), "query_id")
    hits = rows.where(found) if found is not None else rows.join(wanted.select("term").distinct(), "term", "left_semi")
    if gone is None:
        hits = hits.withColumns({"gone": F.lit(None).cast("array<int>"), "live": F.col("n").cast("long")})
    else:
        removed = gone.groupBy(_shard(key).alias("shard")).agg(F.collect_set(_place(key)).alias("gone"))
        hits = hits.join(removed, "shard", "left")
        hits = hits.withColumn("live", F.when(F.col("gone").isNull(), F.col("n")).otherwise(F.pandas_udf(_live, "long")("n", "places", "gone")))
    df = hits.groupBy("term").agg(F.sum("live").alias("df"))
    whole = counted.agg(F.sum("n").alias("chunks"), F.sum("words").alias("words"))
    met = hits.drop("live", "n").join(df, "term").where("df > 0").join(asked, "term").crossJoin(F.broadcast(whole))  # one row
    kind = wanted.schema["query_id"].dataType.simpleString()
    scored = met.groupBy("query_id", "shard").applyInArrow(_walked(k), f"query_id {kind}, key long, score double")
    return top(scored.withColumnRenamed("key", key), key, k, DIGITS)
