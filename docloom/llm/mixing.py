"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document of a source is expected
``target / source_size`` times; the expected copies are prefix-summed within the source in
order of size, one random offset is added, and a copy is emitted for each integer boundary
the sum crosses. Ordering by size keeps the words taken within about one largest document
of the target. Documents of one size are ordered by a hash of id and text.

As all documents of a source are expected equally often, a prefix sum is a row number times
that expectation; rows are numbered in buckets that keep their size however large a source
or a size of it is. What a document holds may stay apart from that: by size, the last bucket of
a source has its longest texts, so the pipeline stage sorts numbers alone and adds the texts
after, by the number of their row. The table of sources has one row for each and is ordered by one task,
which is meant for up to some millions of sources.

Cases: null texts have size 0; a null source is a source of its own and comes last; empty
tables give empty results; repeated rows are sampled as rows of their own, and those equal
in id and text are interchangeable; other columns pass through if asked for. A source
without words has target 0 and takes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_WORD, small, with_row_numbers, written
from docloom.session import table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240
#: Expected copies are integers of this unit, so the sums and their floors are exact.
UNIT = 1 << 28

def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _hex(column: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size) -> with target: weighted shares of all words, capped at ``cap`` times the size.

    A capped source's excess is reshared by weight. The level L at which sum(min(weight * L,
    cap)) is all words is the greatest of (all words - caps of a prefix) / (weights after the
    prefix), over the prefixes in order of cap / weight. The table has one row for a source.
    """
    place = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(weights))) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), place.cast("int")).cast("long"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = ranked.withColumn("level", left.cast("double") / weight_left.cast("double"))
    levelled = levelled.withColumn("level", F.max("level").over(every))
    return levelled.select("key", "source_size", F.least(F.col("weight") * F.col("level"), F.col("most").cast("double")).alias("target"))


def placed(docs: DataFrame, keep: tuple[str, ...], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, apart: bool = False) -> DataFrame:
    """The ``keep`` columns of ``docs``, named k_ and their name, with ``size``, ``source_size``, ``target`` and ``copies``.

    ``apart``: they aren't sorted, but joined to what is taken of them; rows not taken are left out.
    """
    name = F.coalesce(F.concat(F.lit("0"), F.col("doc_id").cast("string")), F.lit("1"))
    rows = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep],
        *[F.monotonically_increasing_id().alias("row")] * apart,
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("key"),
        word_count().alias("size"),
        _hex(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), F.coalesce(F.md5("text"), F.lit(""))), 15).alias("mark"),
    )
    rows = held = written(rows, "mix")
    if apart:
        rows = rows.drop(*[f"k_{c}" for c in keep])
    sizes = written(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    shares = targets(sizes.drop("n"), weights, cap).withColumn(
        "step", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long")
    )
    shares = shares.withColumn("offset", _hex(F.concat(F.lit(f"{seed}:"), F.col("key")), 7))  # below UNIT
    by_key = Window.orderBy("key")
    starts = sizes.select("key", F.row_number().over(by_key).alias("rank"), (F.sum("n").over(by_key) - F.col("n")).alias("start"))
    shares = written(shares.join(starts, "key"), "shares")
    rows = rows.join(small(shares, shares.count()), "key")
    # sources in turn, sizes of a source rising
    rows = rows.withColumn("place", F.shiftleft(F.col("rank").cast("long"), 32).bitwiseOR(F.col("size")))
    numbered, _ = with_row_numbers(rows, "place", "i", ("mark",))
    i = F.col("i") - F.col("start")
    whole, part = F.expr(f"step div {UNIT}"), F.pmod("step", F.lit(UNIT))

    def crossed(i: Column) -> Column:
        """Boundaries passed up to i; whole steps apart, so nothing overflows below 2**35 rows of a source."""
        return F.floor(F.shiftright(i * part + F.col("offset"), 28))

    copies = (whole + crossed(i + 1) - crossed(i)).cast("long")
    own = ["size", "source_size", "target", "copies"]
    numbered = numbered.withColumn("copies", copies)
    if apart:  # the table of numbers is hashed, so texts pass by it unsorted
        numbered = held.select("row", *[f"k_{c}" for c in keep]).join(numbered.where("copies > 0").select("row", *own).hint("shuffle_hash"), "row")
    return numbered.select(*[f"k_{c}" for c in keep], *own)


def mix(docs: DataFrame, keep: tuple[str, ...], **settings) -> DataFrame:
    """The ``keep`` columns with ``size``, ``source_size``, ``target`` and ``copies``; kept columns so named give way."""
    own = ("size", "source_size", "target", "copies")
    keep = tuple(c for c in keep if c not in own)
    return placed(docs, keep, **settings).select(*[F.col(f"k_{c}").alias(c) for c in keep], *own)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document of ``documents`` gives to the mix."""
    mixed = mix(table(spark, sf_dir, "documents"), ("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    columns = tuple(docs.columns)
    mixed = placed(docs, columns, apart=True)
    repeated = mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"k_{c}").alias(c) for c in columns])


OP1_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5('{SEED}/' || coalesce('0' || doc_id::VARCHAR, '1') || '/' || coalesce(md5(text), '')), 1, 15))::BIGINT AS mark FROM documents),
sizes AS (SELECT key, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY key),
ranked AS (SELECT key, source_size, {CAP} * source_size AS most,
    ([5, 2, 1])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight FROM sizes),
levels AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(most) OVER w, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE) AS level FROM ranked
  WINDOW w AS (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT key, source_size, least(weight * (SELECT max(level) FROM levels), most::DOUBLE) AS target FROM levels),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT} + 0.5) ELSE 0 END::BIGINT AS step,
    ('0x' || substr(md5('{SEED}:' || key), 1, 7))::BIGINT AS off FROM shares),
placed AS (SELECT m.*, s.source_size, s.target, s.step, s.off,
    row_number() OVER (PARTITION BY m.key ORDER BY m.size, m.mark) AS i
  FROM rows_ m JOIN steps s USING (key))
SELECT doc_id, size, source_size, target,
  (size * ((i::HUGEINT * step + off) // {UNIT} - ((i - 1)::HUGEINT * step + off) // {UNIT}))::BIGINT AS taken
FROM placed
"""
