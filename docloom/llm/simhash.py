"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is set if it is set in over half of the XXH64 hashes of the text's word
shingles. Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Every distinct
fingerprint emits the variants within half the radius, one flipped bit, and meets others on
equal variants. The odd third bit is covered by masking: the 64 bits are cut into three
groups, and the variants are taken once without each group. Of three differing bits at
least one lies in some group; without that group at most two remain, one for each side. So
each pair within the radius shares a variant, and each colliding pair is verified.

Exact copies share a fingerprint and are merged before anything is emitted. Components are
found by large-star and small-star steps on tables in the shared folder; the driver gets
counts only.

Cases: a null or empty text has no shingles and fingerprint zero, which links like any
other; a text of fewer words is one shingle; null ids are kept and belong to the component
of their fingerprint; repeated rows stay; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import sliced, split_join, utf8, written
from docloom.session import scratch, table

SHINGLE = 3
RADIUS = 3
HASH_SEED = 42
#: Bit groups that are masked in turn.
GROUPS = ((0, 21), (21, 42), (42, 64))


#: Shingles hashed and summed at a time, so a long text holds no more than its hashes.
PIECE = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text, repeats included, in pieces; none for a text without words."""
    words = text.lower().split()
    if not words:
        return
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts, stops = (ends - lengths + 1)[:n], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        part = slice(at, at + PIECE)
        yield np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts[part].tolist(), stops[part].tolist())], "<u8")


def majority(pieces: Iterable[np.ndarray]) -> int:
    """Fingerprint of hashes: the bits set in over half of them."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64) if len(bits) < 256 else _column_sums(bits)
        n += len(hashes)
    return sum(1 << int(i) for i in np.flatnonzero(2 * total > n))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle))


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 bytes by column: eight columns to a word, 255 rows at a time, so no sum overflows."""
    words = bits.view(np.uint64)
    whole = len(words) // 255 * 255
    parts = words[:whole].reshape(-1, 255, 8).sum(axis=1)
    total = parts.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of documents; fp is the fingerprint as a signed long."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            fp = np.array([fingerprint(x, shingle) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variant_masks() -> list[tuple[int, int, int]]:
    """(group, bits kept, bits flipped): what is emitted for a fingerprint."""
    out = []
    for g, (low, high) in enumerate(GROUPS):
        keep = ((1 << 64) - 1) & ~(((1 << high) - 1) ^ ((1 << low) - 1))
        out.append((g, _signed(keep), 0))
        out += [(g, _signed(keep), _signed(1 << b)) for b in range(64) if not low <= b < high]
    return out


def meetings(distinct: DataFrame) -> DataFrame:
    """(fp, g, variant) of the variants that several of the distinct fingerprints ``fp`` emit.

    Variants are shuffled once; most of them meet nothing and end here.
    """
    masks = F.array(*[F.struct(F.lit(g).cast("tinyint").alias("g"), F.lit(k).cast("long").alias("k"), F.lit(x).cast("long").alias("x")) for g, k, x in variant_masks()])
    # few bytes become many rows here, so the fingerprints are spread over all partitions first
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    emitted = spread.select("fp", F.explode(masks).alias("m")).select(
        "fp", F.col("m.g").alias("g"), F.col("fp").bitwiseAND(F.col("m.k")).bitwiseXOR(F.col("m.x")).alias("variant")
    )
    several = F.count("*").over(Window.partitionBy("g", "variant")) > 1
    return emitted.withColumn("met", several).where("met").drop("met")


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def classes(distinct: DataFrame) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fp`` that link to another, by components of links.

    Fingerprints that meet on a variant differ in two of the kept bits at most. Those whose
    masked bits agree too are linked, all of them, so a star to the least one stands for the
    pairs. What is not connected by that is compared with the rest of its variant, and only
    there, so a family of near fingerprints costs no square of its size.
    """
    met = written(meetings(distinct), "met")
    masked = F.element_at(F.array(*[F.lit(_signed(((1 << high) - 1) ^ ((1 << low) - 1))) for low, high in GROUPS]), F.col("g") + 1)
    star = Window.partitionBy("g", "variant", "masked")
    stars = met.withColumn("masked", F.col("fp").bitwiseAND(masked)).withColumn("least", F.min("fp").over(star)).where("fp <> least")
    stars = written(stars.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    linked = components(stars)
    rows = met.join(linked, met["fp"] == linked["node"], "left").select("fp", "g", "variant", F.coalesce("root", "fp").alias("root"))
    bucket = Window.partitionBy("g", "variant")
    rows = rows.withColumns({"low": F.min("root").over(bucket), "high": F.max("root").over(bucket)}).where("low < high")
    rows = written(rows.select("fp", "g", "variant", "root"), "mixed")
    main = rows.groupBy("g", "variant", "root").agg(F.count("*").alias("n")).groupBy("g", "variant").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    others = rows.join(main, ["g", "variant"]).where("root <> main").select("g", "variant", F.col("fp").alias("a"), F.col("root").alias("x"))
    pairs = others.join(rows.select("g", "variant", F.col("fp").alias("b"), F.col("root").alias("y")), ["g", "variant"]).where((F.col("x") != F.col("y")) & near("a", "b"))
    more = written(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "more")
    if more.isEmpty():
        return linked
    return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


#: Edges up to which the edges of a node meet in one task; beyond, those of hubs are joined by broadcast.
WINDOWED = 1_000_000


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours."""
    if rows <= WINDOWED:
        return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return split_join(edges, least, "u", "n", rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the smallest node reachable.

    Large-star links each larger neighbour to the smallest neighbour, small-star does so
    among smaller ones; both keep components and end in stars after some log(n) rounds.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        seen = Observation()
        out = written(df.distinct().observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        return out, (seen.get["n"], seen.get["x"])

    with scratch(edges.sparkSession):
        edges, mark = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.distinct() if mark[0] > WINDOWED else large
            near = _with_least(large, mark[0]).select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select("u", F.col("m").alias("v"))
            before, (edges, mark) = mark, kept(near)
            if mark == before:
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> with component_id, the smallest doc_id reachable by links."""
    prints = written(prints, "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = classes(distinct.select("fp"))
    # every node of a component has an edge to its root but the root itself
    roots = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = written(rooted.join(ids, "root").select("fp", "component_id"), "simhash")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of all ``documents``."""
    found = with_components(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    """Components by comparing all pairs; for tests."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= RADIUS:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return reduce(lambda out, i: out | {i: find(i)}, ids, {})
