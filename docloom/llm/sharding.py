"""Reproducible shuffle into shards: a Feistel permutation with cycle walking.

Rows are numbered from 0 in the order of doc_id. A balanced Feistel network on the smallest
even number of bits that holds all numbers permutes them; a number that leaves the range is
permuted again until it falls inside. The permuted number gives shard (modulo the shard
count) and slot (the quotient), so both can be computed for a row number without the data,
and the inverse finds the row number of a shard and slot. The law is ``rows``: shards differ
by one row at most and slots have no gaps.

Cases: null texts count no bytes, and their CRC is that of empty text; null ids come first;
repeated ids are told apart by CRC and size, and rows equal in all of these are
interchangeable; empty tables give empty results. Equal texts are not kept together: the
method places single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import with_row_numbers, written
from docloom.session import table

SHARDS = 40
SEED = 71
ROUNDS = 4
PRIME = (1 << 31) - 1


def half_bits(n: int) -> int:
    """Bits of each half: the smallest for which all numbers below n fit."""
    bits = 1
    while 1 << (2 * bits) < n:
        bits += 1
    return bits


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """A multiplier and an addend below 2**31 for every round."""
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME))) for _ in range(ROUNDS)]


def _mixed(half: np.ndarray, key: tuple[int, int], mask: int) -> np.ndarray:
    x = (half % PRIME * key[0] + key[1]) % PRIME
    return (x ^ (x >> 15)) & mask


def _forward(x: np.ndarray, bits: int, keys: list[tuple[int, int]]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return left << bits | right


def _backward(x: np.ndarray, bits: int, keys: list[tuple[int, int]]) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys):
        left, right = right ^ _mixed(left, key, mask), left
    return left << bits | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of range(n), or its inverse, at ``numbers``."""
    bits, keys, step = half_bits(n), round_keys(seed), _backward if inverse else _forward
    out = step(np.asarray(numbers, np.int64), bits, keys)
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = step(out[outside], bits, keys)
    return out


def place(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    p = permute(numbers, n, seed)
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def shard_rows(df: DataFrame, key: str, ties: tuple[str, ...], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` to ``df``, in place of columns so named."""
    df = df.drop("shard", "slot")
    numbered, n = with_row_numbers(df, key, "__row", ties)
    if not n:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).drop("__row")

    @F.pandas_udf("shard int, slot long")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            shard, slot = place(x.to_numpy(np.int64), n, shards, seed)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    out = numbered.withColumn("__at", placed("__row"))
    return out.withColumns({"shard": F.col("__at.shard"), "slot": F.col("__at.slot")}).drop("__at", "__row")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of documents: UTF-8 bytes plus 16, and the text's CRC-32."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 and slots of ``documents``."""
    rows = written(measured(table(spark, sf_dir, "documents")), "shard")
    out = shard_rows(rows, "doc_id", ("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its shard and slot."""
    marked = docs.withColumn("__crc", F.crc32(F.coalesce("text", F.lit(""))))
    return shard_rows(marked, "doc_id", ("__crc",)).drop("__crc")


def crc_sql(octets: str) -> str:
    """DuckDB's CRC-32 of a list of two-digit hex strings, by half bytes."""
    table = [0]
    for i in range(1, 16):
        c = i
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = "xor({t}[(xor({c}, {b}) & 15) + 1], {c} >> 4)"
    half = step.format(t="T", c="c", b="b")
    whole = step.format(t="T", c=f"({half})", b="(b >> 4)").replace("T", f"({table})")
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform({octets}, lambda x: ('0x' || x)::BIGINT)), lambda c, b: {whole}))"


def _sql() -> str:
    """CRC-32, row numbers, and the permutation walked until no number lies outside."""
    rounds, left, right = [], "l0", "r0"
    for i, (a, b) in enumerate(round_keys()):
        x = f"(({right} % {PRIME}) * {a} + {b}) % {PRIME}"
        rounds.append(f"f{i} AS (SELECT *, {right} AS l{i + 1}, xor({left}, xor({x}, ({x}) >> 15) & mask) AS r{i + 1} FROM {'s' if not i else f'f{i - 1}'})")
        left, right = f"l{i + 1}", f"r{i + 1}"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> '') AS bytes FROM documents),
e AS (SELECT doc_id, size::BIGINT AS size, {crc_sql('bytes')} AS text_crc32 FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i, count(*) OVER () AS n FROM e),
h AS (SELECT i, n, greatest(1, ceil(log2(n) / 2))::BIGINT AS bits FROM o),
walk AS (SELECT i, n, bits, i AS x, 0 AS steps FROM h UNION ALL
  (WITH s AS (SELECT i, n, bits, steps, (1 << bits) - 1 AS mask, x >> bits AS l0, x & ((1 << bits) - 1) AS r0 FROM walk WHERE steps = 0 OR x >= n),
  {', '.join(rounds)} SELECT i, n, bits, ({left} << bits) | {right}, steps + 1 FROM f{len(round_keys()) - 1})),
p AS (SELECT i, x FROM walk WHERE steps > 0 AND x < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INT AS shard, x // {SHARDS} AS slot, NULL::INT AS grown_shard FROM o JOIN p USING (i)
"""


OP7_SQL = _sql()
