"""Helpers of the training-data operators: shared folders, distributed ranks, tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.session import shared_dir, written  # noqa: F401

#: Words of the scanning operators: maximal runs outside ASCII punctuation, space and control characters.
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the mixing and fingerprint operators: maximal runs outside ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Byte table of the scanning words: letters A-Z lowered, ASCII outside 0-9a-z to spaces, the rest kept.
SCAN_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Byte table of letters: A-Z lowered, a-z and all bytes of other alphabets kept, the rest to spaces.
LETTER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_words(text: bytes) -> list[bytes]:
    """Lower-cased scanning words of a UTF-8 text."""
    return text.translate(SCAN_TABLE).split()


def sql_words(text: str) -> str:
    """DuckDB list of the scanning words of a text column."""
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD_BREAKS}'), lambda x: x <> '')"


def ascii_lower(column: Column | str) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(column, UPPER, LOWER)


#: Rows of a bucket of a global order, and key ranges that the driver handles.
BUCKET_ROWS, MOST_RANGES = 20_000, 1000
#: Parts into which a bucket that is too large is cut at once.
CUTS = 32
#: Buckets up to which a table with one row for each is broadcast: 16 bytes a row.
MOST_BROADCAST = 1_000_000


def range_bounds(df: DataFrame, key: str, ranges: int) -> list:
    """At most ``ranges - 1`` rising cut points of a numeric key, from its approximate quantiles.

    The driver gets only the cut points. They steer balance, never results.
    """
    if ranges < 2:
        return []
    points = ", ".join(f"{i / ranges:.9f}D" for i in range(1, ranges))
    row = df.select(F.expr(f"percentile_approx({key}, array({points}), {max(1000, 20 * ranges)})").alias("q")).first()
    return sorted({x for x in (row.q or []) if x is not None})


def cut_at(cuts: Column, x: Column) -> Column:
    """A number that rises with x: 2 for each cut point below it, and 1 more if it is one."""
    return (F.size(F.filter(cuts, lambda c: c <= x)) + F.size(F.filter(cuts, lambda c: c < x))).cast("long")


def bucketed(df: DataFrame, key: str, tie: str, out: str, rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, int, int]:
    """Adds bucket numbers that rise with (key, tie), two long columns without nulls.

    Returns the rows, a table of (bucket, n), and how many buckets and rows there are. Keys
    are cut at their quantiles into ranges; a range with over twice ``rows`` rows is cut
    again at its own quantiles, one key at those of the tie, and rows equal in both are dealt
    at random, until none is left. So no bucket grows with the data, however the keys lie.
    """
    ranges = max(1, min(MOST_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = F.array(*[F.lit(b).cast("long") for b in range_bounds(df, key, ranges)]).cast("array<long>")
    df = df.withColumn(out, cut_at(bounds, F.col(key)))
    while True:
        ends = [f(c).alias(n) for n, f, c in (("low", F.min, key), ("high", F.max, key), ("first", F.min, tie), ("last", F.max, tie))]
        sizes = written(df.groupBy(out).agg(F.count("*").alias("n"), *ends), "buckets")
        big = F.col("n") > 2 * rows
        equal = big & (F.col("low") == F.col("high")) & (F.col("first") == F.col("last"))
        found = sizes.agg(F.count("*").alias("buckets"), F.sum("n").alias("rows"), F.count_if(big).alias("big"), F.count_if(equal).alias("equal")).first()
        if not found.big:
            return df, sizes.select(out, "n"), found.buckets, found.rows or 0
        over = small(sizes.where(big).select(F.col(out).alias("__big"), (F.col("low") < F.col("high")).alias("__wide"), equal.alias("__equal")), found.big)
        if found.equal:  # the random numbers must not be drawn twice
            df = written(df.withColumn("__deal", F.floor(F.rand() * CUTS).cast("long")), "dealt")
        value = F.when(F.col("__wide"), F.col(key)).otherwise(F.col(tie))
        points = ", ".join(f"{i / CUTS:.9f}D" for i in range(1, CUTS))
        cut = df.join(over, F.col(out) == F.col("__big")).select("__big", "__wide", "__equal", value.alias("v"))
        cuts = cut.groupBy("__big", "__wide", "__equal").agg(F.expr(f"array_distinct(percentile_approx(v, array({points}), 1000))").alias("__cuts"))
        cuts = small(written(cuts, "cuts"), found.big)
        part = cut_at(F.col("__cuts"), value)
        if found.equal:
            part = F.when(F.col("__equal"), F.col("__deal")).otherwise(part)
        number = F.col(out) * (2 * CUTS) + F.when(F.col("__big").isNull(), 0).otherwise(part)
        df = df.join(cuts, F.col(out) == F.col("__big"), "left").withColumn(out, number).drop("__big", "__wide", "__equal", "__cuts", "__deal")

def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of a known number of narrow rows, if they are few enough."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def with_row_numbers(df: DataFrame, key: str, out: str, ties: tuple[str, ...], rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """Adds gapless numbers from 0 in the order of a long key (nulls first) and of ``ties``, and returns the row count.

    Each bucket of the order is numbered by itself and shifted by the rows before it, so no
    task gets the whole order. The first tie is a long.
    """
    df = df.withColumns({"__k": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "__t": F.coalesce(F.col(ties[0]).cast("long"), F.lit(-(1 << 63)))})
    df, sizes, buckets, total = bucketed(df, "__k", "__t", "__b", rows)
    before = F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("__shift"))
    w = Window.partitionBy("__b").orderBy("__k", *[F.col(c).asc_nulls_first() for c in ties])
    numbered = df.withColumn("__i", F.row_number().over(w).cast("long") - 1).join(small(shifts, buckets), "__b")
    return numbered.withColumn(out, F.col("__i") + F.col("__shift")).drop("__b", "__k", "__t", "__i", "__shift"), total


def split_join(left: DataFrame, right: DataFrame, key: str, n: str, rows: int, parts: int = 1000) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each, with the number ``n`` of its rows in ``left``.

    Keys of more than a thousandth of all ``rows`` are under a thousand, so they are
    broadcast, and no key's rows meet in one task.
    """
    hot = F.broadcast(right.where(F.col(n) > max(1000, rows // parts)))
    rest = right.where(F.col(n) <= max(1000, rows // parts))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


#: Bytes of text that a Python worker turns into Python objects at once.
SLICE_BYTES = 1 << 22


def sliced(batches: Iterator[pa.RecordBatch], text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text column; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of a column as UTF-8 bytes, nulls as empty, without decoding them."""
    column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def pieces(text: bytes, table: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text translated by a byte table that makes spaces of breaks, in pieces of about ``most`` bytes that end at a break."""
    at = 0
    while at < len(text):
        part = text[at : at + most].translate(table)
        at += len(part)
        if at < len(text) and (cut := part.rfind(b" ")) >= 0:
            at -= len(part) - cut - 1
            part = part[:cut]
        else:  # no break so far: on to the next one
            while at < len(text) and not part.endswith(b" "):
                more = text[at : at + most].translate(table)
                cut = more.find(b" ")
                more = more if cut < 0 else more[: cut + 1]
                at, part = at + len(more), part + more
        yield part
