"""Search indexes as tables: postings with positions by term, lengths of chunks, vectors as they are.

The index is built once and read by every search. A search reads the postings of its words
alone: they are ordered by term, so Parquet statistics leave all but a few row groups unread.
How many chunks a word is in is counted among those. An index with block-max rows and totals
answers queries of words by a walk that leaves blocks unread; without them, and for phrases,
the number and length of all chunks come from the lengths. Adding chunks means adding rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import terms, tokens
from docloom.operators import blockmax
from docloom.operators.lexical import Node, Phrase, impact, phrases, top
from docloom.session import scratch, written


#: Words of chunks that are put in order at once.
WORDS_AT_ONCE = 1 << 20


def _lists(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, key, positions, len) of (key, words): words are numbers in arrays, not Python's strings."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
                some, n = batch.slice(at, stop - at), sizes[at:stop]
                at = stop
                words = some.column(1).flatten().dictionary_encode()
                if not len(words):
                    continue
                chunk = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(chunk)) - np.repeat(np.cumsum(n) - n, n)
                name = chunk * len(words.dictionary) + words.indices.to_numpy().astype(np.int64)
                order = np.argsort(name, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(name[order]) != 0))
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
                one = pa.array(order[first])
                of_chunk = chunk[order[first]]
                columns = [words.dictionary.take(words.indices.take(one)), some.column(0).take(pa.array(of_chunk)), positions, pa.array(n[of_chunk], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["term", key, "positions", "len"])

    return of


def posting_lists(chunks: DataFrame, key: str, text: str, stem: bool = True, fold: bool = True, sized: bool = False) -> DataFrame:
    """(term, key, positions) of chunks; no shuffle, as a chunk's words are together. ``sized`` adds len, the words of the chunk."""
    kind = chunks.schema[key].dataType.simpleString()
    lists = chunks.select(key, terms(F.col(text), stem, fold).alias("words")).mapInArrow(_lists(key), f"term string, {key} {kind}, positions array<int>, len int")
    return lists if sized else lists.drop("len")


def lengths(chunks: DataFrame, key: str, text: str, fold: bool = True) -> DataFrame:
    """(key, len): words of each chunk."""
    return chunks.select(key, F.greatest(F.coalesce(F.size(tokens(F.col(text), fold)), F.lit(0)), F.lit(0)).alias("len"))


@dataclass
class Index:
    """Postings (term, key, positions) and lengths (key, len) of chunks; keys without a length are gone.

    Postings that are not read from a table have the len of their chunk, too.

    ``blocks``, ``totals`` and ``gone`` are those of ``blockmax``: rows of postings in blocks,
    (n, words) to be summed, and keys whose rows count no more.
    """

    postings: DataFrame
    lengths: DataFrame
    key: str
    stem: bool = True
    fold: bool = True
    blocks: DataFrame | None = None
    totals: DataFrame | None = None
    gone: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame, key: str, text: str = "content", stem: bool = True, fold: bool = True) -> Index:
        """An index that is computed when it is read."""
        return cls(posting_lists(chunks, key, text, stem, fold, True), lengths(chunks, key, text, fold), key, stem, fold)

    def save(self, path: str) -> None:
        """Writes the index; postings are ordered by term, and those of a frequent term lie in several files."""
        spark = self.postings.sparkSession
        self.lengths.write.parquet(f"{path}/lengths")
        sizes = spark.read.parquet(f"{path}/lengths")
        with scratch(spark, 0):
            # ranges are sampled before rows are dealt, so what goes into them is computed and written first
            lists = written(self.postings, "postings")
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blockmax.parts(lists.count()))
            ordered = lists.drop("len").repartitionByRange(parts, "term", self.key).sortWithinPartitions("term", self.key)
            ordered.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
            rows = written(blockmax.block_rows(lists, sizes, self.key), "blocks")
            rows = rows.repartitionByRange(parts, "term", "shard").sortWithinPartitions("term", "shard")
            rows.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/blocks")
        blockmax.totals(sizes).write.parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str, stem: bool = True, fold: bool = True) -> Index:
        postings, sizes = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        return cls(postings, sizes, key, stem, fold, spark.read.schema(blockmax.ROWS).parquet(f"{path}/blocks"), spark.read.schema("n long, words long").parquet(f"{path}/totals"))

    def asked(self, tree: Phrase | Node) -> DataFrame:
        """The postings of a query's words; the scan takes the filter."""
        every = phrases(tree)
        whole = {w for p in every for w in (p.words[:-1] if p.prefix else p.words)}
        found = F.col("term").isin(sorted(whole)) if whole else F.lit(False)
        for start in {p.words[-1] for p in every if p.prefix and p.words}:
            found = found | F.col("term").startswith(start)
        return self.postings.where(found)

    def best(self, queries: DataFrame, k: int, most: int = 200, every: bool = False) -> DataFrame:
        """(query_id, key, score, rank): the k best chunks by BM25 for the words (query_id, term) of any number of queries.

        Few words become a filter that the scan takes; more are joined. ``every`` asks for
        chunks that have all words of a query.
        """
        return self.best_of(queries.select("query_id", F.explode(terms("term", self.stem, self.fold)).alias("term")).distinct(), k, most, every)

    def best_of(self, wanted: DataFrame, k: int, most: int = 200, every: bool = False) -> DataFrame:
        """The same for distinct words as the index has them."""
        known = [r.term for r in wanted.select("term").distinct().limit(most + 1).collect()]
        few = F.col("term").isin(known) if len(known) <= most else None
        if self.blocks is not None:
            return blockmax.best(self.blocks, self.totals, wanted, self.key, k, few, self.gone, every)
        hits = self.postings.where(few) if few is not None else self.postings.join(wanted.select("term").distinct(), "term", "left_semi")
        hits = hits.select("term", self.key, F.size("positions").alias("tf")).join(self.lengths, self.key)
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        whole = F.broadcast(self.lengths.agg(F.count("*").alias("n"), F.sum("len").alias("words")))  # one row
        scored = hits.join(df, "term").crossJoin(whole).select("term", self.key, impact().alias("impact")).join(wanted, "term")
        summed = scored.groupBy("query_id", self.key).agg(F.sum("impact").alias("score"), F.count("*").alias("found"))
        if every:
            summed = summed.join(wanted.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id").where("found = asked")
        return top(summed.select("query_id", self.key, "score"), self.key, k)
