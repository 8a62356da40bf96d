"""Grouping of spelling variants by a symmetric-delete join.

Words are counted over all texts, within each slice of texts before any is shuffled. Every
word then emits one key for itself and one for each distinct word that a single deletion
makes of it. Words that share a key are candidates; their distance is verified exactly. A
word's form is its most frequent near word, if that is at least ``RATIO`` times as frequent,
and the root is found by doubling: each round a word takes over the root of its root.

Keys are 64-bit sums of code points times powers of a number, which give all deletions of a
word in one pass; equal deletions have equal keys, so no near pair is lost, and pairs that
meet by chance fail the check. A key has at most (letters of the alphabet) x (length + 1)
words, so no group grows with the collection. Words are known by the number they got when
their table was written, so that a long word is not copied into each of its keys.

Cases: null texts have no words; a null id counts as empty in the hash; repeated rows count
as often as they stand; words of any length take part; ties of the form go to the smallest
word in code-point order; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import LETTER_TABLE, LOWER, UPPER, pieces, sliced, utf8, written
from docloom.llm.sharding import crc_sql
from docloom.session import removed, stored, table

#: Least code points and occurrences of a word, and how often a form outnumbers its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many distinct runs of a text loses a code point.
SLIP = 31
#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 200_000
#: An odd number whose powers weigh the code points of a key, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Runs that are long enough; shorter ones hold none.
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def slipped(doc: bytes, run: str) -> str:
    """A run of a document, without one code point if the CRC-32 of document and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of slices of (id, text)."""
    words: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for part in sliced(batches, 1):
        for doc, text in zip(utf8(part.column(0)), utf8(part.column(1)), strict=True):
            runs: Counter[str] = Counter()
            for piece in pieces(text, LETTER_TABLE):
                runs.update(RUN.findall(piece.decode()))
            for run, n in runs.items():
                word = slipped(doc, run)
                if len(word) >= LEAST_LENGTH:
                    words[word] += n
            if len(words) > MOST_COUNTED:
                yield flushed()
    yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n) of the words of at least ``LEAST_COUNT`` occurrences, as a written table."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    each = texts.mapInArrow(counted, "word string, n long")
    words = each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of every word (id, word) itself and of its distinct single deletions."""
    for part in sliced(batches, 1):
        words = part.column(1).to_pylist()
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        at = np.arange(len(codes)) - np.repeat(starts, lengths)
        powers = np.full(int(lengths.max()), BASE, np.uint64)
        powers[0] = 1
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * np.cumprod(powers)[at], out=sums[1:])
        own = np.repeat(np.arange(len(words)), lengths)
        # one deletion for each stretch of equal letters
        cut = np.flatnonzero((at == 0) | (codes != np.roll(codes, 1)))
        word = own[cut]
        left = sums[cut] - sums[starts[word]]
        right = (sums[ends[word]] - sums[cut + 1]) * np.uint64(INVERSE)
        keys = np.concatenate([sums[ends] - sums[starts], left + right])
        ids = part.column(0).to_numpy()[np.concatenate([np.arange(len(words)), word])]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], ["key", "id"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of ``words`` at distance one, each once, as structs (id, word, n)."""
    keys = words.select("id", "word").mapInArrow(keyed, "key long, id long")
    met = keys.alias("x").join(keys.alias("y"), "key").where("x.id < y.id").selectExpr("x.id AS i", "y.id AS j").distinct()
    row = F.struct("id", "word", "n")
    pairs = met.join(words.select(F.col("id").alias("i"), row.alias("a")), "i").join(words.select(F.col("id").alias("j"), row.alias("b")), "j")
    return pairs.where(F.levenshtein("a.word", "b.word", 1) == 1).select("a", "b")


def with_forms(words: DataFrame) -> DataFrame:
    """Words with n_near, and the id, word and count of their form, null without one."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a.id").alias("id"), F.col("b").alias("to")), F.struct(F.col("b.id").alias("id"), F.col("a").alias("to")))).alias("x"))
    best = F.min(F.struct((-F.col("x.to.n")).alias("less"), F.col("x.to.word").alias("word"), F.col("x.to.id").alias("to")))
    near = both.groupBy("x.id").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= RATIO * F.col("n")
    out = words.join(near, "id", "left")
    return out.select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.to")).alias("form_id"),
        F.when(taken, F.col("best.word")).alias("form"),
        F.when(taken, -F.col("best.less")).cast("long").alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of the words that have a form: where following forms ends.

    Counts rise tenfold with each form, so there is no cycle and a chain is short.
    """
    spark, last = forms.sparkSession, None
    links = forms.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("to"), F.col("form").alias("root"))
    while True:
        path = stored(links, "roots")
        if last is not None:
            removed(spark, last)
        last, links = path, spark.read.schema(links.schema).parquet(path)
        on = links.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("root").alias("further"))
        if links.join(on, "to", "left_semi").isEmpty():
            return links.select("id", "root")
        joined = links.join(on, "to", "left")
        links = joined.select("id", F.coalesce("next", "to").alias("to"), F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of documents."""
    forms = written(with_forms(vocabulary(docs)), "forms")
    out = forms.join(roots(forms), "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``."""
    return variants(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Replacements by words with a gap at the same place, the other distances by deletions that are words."""
    octets = "list_filter(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS run FROM documents),
c AS (SELECT id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, {octets} AS bytes FROM c),
h AS (SELECT run, n, {crc_sql('bytes')} AS h FROM b),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT word, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM i),
less AS (SELECT DISTINCT g.word, v.word AS other FROM gaps g JOIN v ON v.word = g.l || g.r),
near AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION ALL SELECT word, other FROM less UNION ALL SELECT other, word FROM less),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form,
    CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""


OP11_SQL = _sql()
