"""Pipeline stage: one document of each group of near copies stays.

Documents link if their sets of five-word shingles have a Jaccard similarity of 4/5 or more;
groups are the components of these links, so a chain of links is one group. SimHash proposes
the families of texts whose fingerprints lie within three bits, and every pair it proposes is
counted on the whole sets. Three bits of 64 are far nearer than 4/5, so a set-similarity join
finds what SimHash leaves apart, with no loss: shingles are ordered by the number of texts
that have them, rarest first. Of two linked sets of sizes m <= n the larger has a shared
shingle among its first n - ceil(4n/5) + 1, and the smaller has it among its first
m - ceil(8m/9) + 1. Shingles of one text alone come first in the order and meet nothing, so
most texts have no other shingle in that prefix and end there, without ever being compared.

Two passes count. The first takes one in ``RATE`` shingles, by hash, as 32 bits in packed
rows: a text with as many of them alone as its prefix is long can't link and ends there, and
its text is not read again. The second pass counts all shingles of the rest among these. Such
an order, with shingles known to be alone first, is as good as any, so no link is lost.
Shingles that a sample shows to be frequent take their place in the order from the sample and
are dealt over ``SALTS`` tasks each. What several texts share goes to its text; a link can be
counted on that alone. Before, a pair is held against the filters of such a join: by length,
by position in the order, and by ``WORDS`` longs of bits, one for each shingle by hash, as a
text can't share a shingle whose bit the other lacks.

A shingle of many texts is not joined all with all, as a family of near copies would make pairs
by the square of its size. One of its texts is compared with all others, and texts that are
connected by then need no further comparison. Such rounds go on, ``MOST_ROUNDS`` at most, while
what those texts meet tells that all pairs would be more than ``PAIRS`` for each row. The count
steers cost alone: afterwards all pairs that are not connected are compared.

Cases: null texts are empty; empty texts are equal texts; a text of fewer than five words is
one shingle; of a group the row with the smallest id stays (null ids come last), and among
equal ids the one with the smallest digest; rows equal in id and text are one document, of
which one row stays; different texts of one id are different documents; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import small, written
from docloom.llm.simhash import classes, components, majority, shingle_hashes
from docloom.session import scratch

SHINGLE = 5
#: Texts whose shingles are counted for the frequent ones, in how many of them one is frequent, and how many go to every task.
SAMPLE, FREQUENT, MOST_COMMON = 20_000, 4, 200_000
#: Tasks over which a frequent shingle's texts are dealt.
SALTS = 256
#: Pairs for each row of the join from which on one text of a shingle is first compared with the others, and rounds of that.
PAIRS, MOST_ROUNDS = 1, 8
#: Turns of naming texts anew that share 64 bits.
NAMINGS = 8
#: Longs of a text's bits, and texts of a shingle that meet in one task.
WORDS, BLOCK = 16, 2000
BITS = [f"b{i}" for i in range(WORDS)]
SEED = 5
#: Bytes of text a task turns into shingles at once, and digests it remembers to skip exact copies.
SLICE_BYTES, REMEMBERED = 1 << 20, 1 << 20
#: One in so many shingles is counted first; bytes of text for each task that counts, and parts of the hashes for each of these.
RATE, TASK_BYTES, PARTS = 2, 100 << 20, 4
NO_WORDS = -7046029254386353131  # stands for the shingle of a text without words


def digest() -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def half(first: int) -> Column:
    """64 bits of the column ``key`` from a hex digit on."""
    return F.conv(F.substring(F.hex("key"), first, 16), 16, -10).cast("long")


def node() -> Column:
    """64 bits of a digest: texts are compared under this name."""
    return half(1)


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, node) of documents: equal texts have one node, different texts never share one.

    Where several texts have the same 64 bits they are named anew, until no two are left that
    share a name. Of 10^10 texts some six need it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest().alias("key")).withColumn("node", node())
    halves = [f(half(first)).alias(name) for first, f, name in ((1, F.min, "a1"), (1, F.max, "a2"), (17, F.min, "b1"), (17, F.max, "b2"))]
    for turn in range(NAMINGS):
        shared = written(rows.groupBy("node").agg(*halves).where("a1 < a2 or b1 < b2").select("node", F.lit(True).alias("__shared")), "shared")
        if shared.isEmpty():
            return rows
        rows = rows.join(small(shared, shared.count()), "node", "left")
        rows = rows.withColumn("node", F.when(F.col("__shared"), F.xxhash64("key", F.lit(turn))).otherwise(F.col("node"))).select("doc_id", "text", "key", "node")
    raise RuntimeError("texts share their names in every turn")


def keyed(docs: DataFrame) -> DataFrame:
    """(node, text) of named documents."""
    return docs.select("node", "text")


def shingled(text: bytes) -> tuple[np.ndarray, int]:
    """Sorted hashes of a text's distinct five-word shingles, and its SimHash."""
    pieces = list(shingle_hashes(text, SHINGLE))
    if not pieces:
        return np.array([NO_WORDS]), 0
    return np.unique(np.concatenate(pieces).view(np.int64)), majority(pieces)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of a text's distinct five-word shingles."""
    pieces = list(shingle_hashes(text, SHINGLE))
    return np.unique(np.concatenate(pieces).view(np.int64)) if pieces else np.array([NO_WORDS])


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """(nodes, texts) of about ``most`` bytes each, without texts that the task has had already."""
    seen: set[int] = set()
    nodes, texts, held = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            if name in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(name)
            raw = text.as_py()
            nodes.append(name)
            texts.append(raw)
            held += len(raw)
            if held >= most:
                yield nodes, texts
                nodes, texts, held = [], [], 0
    if nodes:
        yield nodes, texts


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of texts, sorted, and the number of texts of the whole that have them, by estimate."""
    rate = max(1, total // SAMPLE)
    sampled = keyed(docs).where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(rate)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found, n = np.unique(np.concatenate([shingles(t) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["h", "n"])

    counted = sampled.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    found, n = rows["h"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(found)
    return found[order], np.minimum(n[order] * rate, (1 << 31) - 1)


def among(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes are among sorted keys."""
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else np.zeros(len(h), bool)


def packed(nodes: list[int], texts: list[bytes], keys: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(part, nodes, counts, hashes) of one in RATE shingles of texts: for each part of the hashes its runs of equal node.

    One more row, of a part beyond the last, has for each node its shingles, those taken, and
    those of them that are frequent, which are not sent.
    """
    sent, info = [], np.zeros((len(texts), 3), np.int32)
    for row, text in zip(info, texts):
        h = shingles(text)
        taken = h[h % RATE == 0]
        common = among(keys, taken)
        row[:] = len(h), len(taken), np.count_nonzero(common)
        sent.append(taken[~common])
    h, names = np.concatenate(sent).view(np.uint64), np.array(nodes, np.int64)
    owner = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    part = (h >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, owner, h = part[order], owner[order], (h[order] >> np.uint64(4)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(h))).astype(np.int32)
    runs = np.searchsorted(part[starts], np.arange(parts + 1))
    ends = np.append(starts, len(h))
    for p in range(parts):
        a, b = runs[p], runs[p + 1]
        if a < b:
            yield p, names[owner[starts[a:b]]].tobytes(), counts[a:b].tobytes(), h[ends[a] : ends[b]].tobytes()
    yield parts + abs(nodes[0]) % parts, names.tobytes(), info.tobytes(), b""


def may_have_links(docs: DataFrame, keys: np.ndarray, octets: int) -> DataFrame:
    """(node) of the texts that are left after the first pass."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), octets // TASK_BYTES + 1)
    parts, sent = PARTS * tasks, spark.sparkContext.broadcast(keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in slices(batches, 8 * SLICE_BYTES):
            columns = zip(*packed(nodes, texts, sent.value, parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "nodes", "counts", "hashes"])

    def dealt(nodes: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
        """Rows (bucket, nodes, info), one for each bucket of nodes."""
        bucket = nodes.view(np.uint64) % np.uint64(tasks)
        order = np.argsort(bucket, kind="stable")
        nodes, info = nodes[order], info[order]
        found, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts, len(nodes))[1:]
        columns = [found.astype(np.int32), [nodes[a:b].tobytes() for a, b in zip(starts, ends)], [info[a:b].tobytes() for a, b in zip(starts, ends)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "nodes", "info"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text its shingles, those taken and those frequent, where told, and how many taken ones another text has."""
        keys, names, infos = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        for batch in batches:
            for part, nodes, counts, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                nodes = np.frombuffer(nodes, np.int64)
                if part >= parts:
                    infos.append((nodes, np.pad(np.frombuffer(counts, np.int32).reshape(-1, 3), ((0, 0), (0, 1)))))
                    continue
                keys.append(np.uint64(part) << np.uint64(32) | np.frombuffer(hashes, np.uint32).astype(np.uint64))
                names.append(np.repeat(nodes, np.frombuffer(counts, np.int32)))
        key, name = np.concatenate(keys), np.concatenate(names)
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        once = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))[: len(key)]
        key, name = key[once], name[once]  # of copies of a text one is left
        same = key[1:] == key[:-1]
        shared = np.append(same, False)[: len(key)] | np.append(False, same)[: len(key)]
        found, n = np.unique(name[shared], return_counts=True)
        infos.append((found, np.pad(n.astype(np.int32)[:, None], ((0, 0), (3, 0)))))
        yield dealt(np.concatenate([x for x, _ in infos]), np.concatenate([x for _, x in infos]))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts whose taken shingles that stand alone are fewer than their prefix."""
        nodes, info = np.empty(0, np.int64), np.empty((0, 4), np.int32)

        def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            names, values = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(names, kind="stable")
            found, starts = np.unique(names[order], return_index=True)
            if not len(found):
                return found, values
            most = np.maximum.reduceat(values[order][:, :3], starts)  # equal in all copies
            return found, np.concatenate([most, np.add.reduceat(values[order][:, 3:], starts)], axis=1)

        held, size = [(nodes, info)], 0
        for batch in batches:
            for _, names, values in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((np.frombuffer(names, np.int64), np.frombuffer(values, np.int32).reshape(-1, 4)))
                size += len(names)
                if size >= 16 * SLICE_BYTES:
                    held, size = [merged(held)], 0
        nodes, info = merged(held)
        n, taken, common, shared = info.T.astype(np.int64)
        prefix = n - (4 * n + 4) // 5 + 1
        yield pa.RecordBatch.from_arrays([pa.array(nodes[taken - common - shared < prefix])], ["node"])

    rows = keyed(docs).mapInArrow(pack, "part int, nodes binary, counts binary, hashes binary").repartition(tasks, "part")
    counted = rows.mapInArrow(count, "bucket int, nodes binary, info binary").repartition(tasks, "bucket")
    return counted.mapInArrow(left, "node long")


def incidences(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, node, tag): the shingles of each text (node, text).

    ``tag`` is 0, or minus the estimated number of texts of a frequent shingle. One more row
    of each text has its SimHash as ``h`` and its number of shingles as ``tag``.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        for nodes, part in slices(batches):
            found = [shingled(t) for t in part]
            n = np.array([len(s) for s, _ in found])
            h = np.concatenate([s for s, _ in found])
            tag = np.zeros(len(h), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                tag = np.where(keys[at] == h, -counts[at], tag)
            prints = np.array([fp for _, fp in found], np.uint64).view(np.int64)
            names = np.array(nodes, np.int64)
            columns = np.concatenate([h, prints]), np.concatenate([np.repeat(names, n), names]), np.concatenate([tag, n]).astype(np.int32)
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "tag"])
            yield from (whole.slice(at, 1 << 16) for at in range(0, whole.num_rows, 1 << 16))

    return texts.mapInArrow(run, "h long, node long, tag int")


def sets(docs: DataFrame) -> DataFrame:
    """(node, size, fp, alone, shared) of the texts that can have a link.

    ``shared`` holds the shingles of several texts in the order, after the ``alone`` shingles
    that no other text has.
    """
    sums = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("octets")).first()
    common = common_shingles(docs, sums.n)
    left = written(may_have_links(docs, common[0], sums.octets or 0), "left")
    left = small(left.withColumnRenamed("node", "__node"), left.count())
    rows = incidences(keyed(docs).join(left, F.col("node") == F.col("__node"), "left_semi"), common)
    one = Window.partitionBy("h", F.expr(f"CASE WHEN tag < 0 THEN pmod(node, {SALTS}) ELSE 0 END"))
    named = F.when(F.col("tag") <= 0, F.col("node"))
    counted = rows.withColumns({"low": F.min(named).over(one), "high": F.max(named).over(one), "n": F.count(named).over(one)})
    kept = counted.where("tag <> 0 or low < high").select("node", "h", "tag", F.when(F.col("tag") < 0, -F.col("tag")).otherwise(F.col("n")).cast("int").alias("n"))
    shared = F.collect_set(F.when(F.col("tag") <= 0, F.struct("n", "h")))
    grouped = kept.groupBy("node").agg(F.max("tag").alias("size"), F.max(F.when(F.col("tag") > 0, F.col("h"))).alias("fp"), F.sort_array(shared).alias("shared"))
    each = grouped.select("node", "size", "fp", (F.col("size") - F.size("shared")).alias("alone"), F.col("shared.h").alias("shared"))
    return each.where(f"alone < {PREFIX}")


#: Shingles of the order among which a text has one of any text it links to, and of any text it links to that is no smaller.
PREFIX, INNER = "(size - (4 * size + 4) div 5 + 1)", "(size - (8 * size + 8) div 9 + 1)"


def prefixes(texts: DataFrame) -> DataFrame:
    """(node, size, alone, h, pos, inner, b0, b1, ...): shared shingles in the prefix of each text, and whether they are in the inner one.

    The b columns are the bits that the text's shared shingles set, each one by its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield from rows(batch.slice(at, 1024))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        for name, n, alone, shared in zip(*(c.to_pylist() for c in batch.select(["node", "size", "alone"]).columns), batch.column("shared")):
            h = shared.values.to_numpy()
            bits = np.zeros(WORDS, np.uint64)
            place = h.view(np.uint64) >> np.uint64(8)
            np.bitwise_or.at(bits, (place >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (place & np.uint64(63)))
            first = h[: max(0, n - (4 * n + 4) // 5 + 1 - alone)]
            pos = alone + np.arange(len(first))
            same = lambda x: np.full(len(first), x)
            out.append([same(name), same(n), same(alone), first, pos, pos < n - (8 * n + 8) // 9 + 1, *map(same, bits.view(np.int64))])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*out), kinds)], names)

    names = ["node", "size", "alone", "h", "pos", "inner", *BITS]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *(pa.int64() for _ in BITS)]
    schema = "node long, size int, alone int, h long, pos int, inner boolean, " + ", ".join(f"{b} long" for b in BITS)
    return texts.select("node", "size", "alone", "shared").mapInArrow(run, schema)


def ordered_pairs(met: DataFrame, left: str, right: str) -> DataFrame:
    return met.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where("a <> b").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that link, counted on their whole sets; what no other text has can't be common."""
    side = lambda name, n: texts.select(F.col("node").alias(name), F.col("size").alias(f"n{n}"), F.col("shared").alias(f"s{n}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    return written(both.where("9L * size(array_intersect(s1, s2)) >= 4L * (n1 + n2)").select("a", "b"), "links")


def may_link(x: str, y: str) -> Column:
    """Filters of two rows that meet on their first shared shingle: what is left of either order, and of either set without the bits the other lacks."""
    need = f"4L * ({x}.size + {y}.size)"
    lacks = lambda p, q: " + ".join(f"bit_count({p}.{b} & ~{q}.{b})" for b in BITS)
    return F.expr(
        f"9L * least({x}.size - {x}.pos, {y}.size - {y}.pos) >= {need} AND 9L * ({x}.size - {x}.alone - ({lacks(x, y)})) >= {need} AND 9L * ({y}.size - {y}.alone - ({lacks(y, x)})) >= {need}"
    )


def with_roots(rows: DataFrame, linked: DataFrame) -> DataFrame:
    return rows.drop("root").join(linked.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn("root", F.coalesce("root", "node")).drop("__node")


def live(rows: DataFrame) -> DataFrame:
    """The rows (node, size, h, pos, inner, root) of shingles on which texts of different roots meet."""
    mixed = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("inner").alias("any")).where("low < high and any").select("h")
    return rows.join(mixed, "h", "left_semi")


def per_shingle(rows: DataFrame) -> DataFrame:
    """(h, n, main, apart): rows of each shingle, its most frequent root and the rows that are of another."""
    roots = rows.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    return roots.select("h", "n", F.col("top.root").alias("main"), (F.col("n") - F.col("top.n")).alias("apart"))


def simhash_links(texts: DataFrame) -> DataFrame:
    """Links between each text and the first of its SimHash class."""
    linked = classes(texts.select("fp").distinct())
    found = texts.select("node", "fp").join(linked.withColumnRenamed("node", "__fp"), F.col("fp") == F.col("__fp"), "left").withColumn("root", F.coalesce("root", "fp"))
    heads = found.groupBy("root").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    return verified(ordered_pairs(found.join(heads, "root"), "node", "head"), texts)


def near_links(texts: DataFrame) -> DataFrame:
    """(node, root) of texts (node, size, fp, alone, shared) with a link."""
    edges = simhash_links(texts)
    linked = components(edges)
    rows = written(live(with_roots(prefixes(texts), linked)), "near")
    for turn in range(MOST_ROUNDS):
        sums = per_shingle(rows).agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("apart")).alias("pairs")).first()
        if not sums.rows:
            return linked
        if sums.pairs <= PAIRS * sums.rows:
            break
        # one text of each shingle is compared with the others
        head = F.min(F.when(F.col("inner"), F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size", "alone", "pos", "root", *BITS))).alias("head")
        heads = rows.groupBy("h").agg(head, F.count("*").alias("n")).select("h", "head.*", "n")
        met = rows.alias("r").join(heads.alias("o"), "h").where(F.expr("r.root <> o.root") & may_link("r", "o"))
        met = written(met.select(F.col("r.node").alias("x"), F.col("o.node").alias("y"), "n"), "met")
        expected = met.agg(F.sum("n").alias("n")).first().n or 0
        edges = edges.unionByName(verified(ordered_pairs(met, "x", "y"), texts))
        linked = components(edges)
        # a head has met all of its shingle
        rest = rows.join(heads.select("h", "node"), ["h", "node"], "left_anti")
        rows = written(live(with_roots(rest, linked)), "near")
        if expected <= PAIRS * sums.rows:  # each text of a shingle meets as many as its head did
            break
    # all pairs of a shingle that are not connected: one of the two is outside its main group; a large shingle meets in pairs of blocks
    main = per_shingle(rows).select("h", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = written(rows.join(main, "h"), "dealt")
    left = dealt.where("root <> main").withColumns({"i": own, "j": F.explode(every)})
    right = dealt.withColumns({"j": own, "i": F.explode(every)})
    order = "(x.inner and x.size <= y.size or y.inner and y.size <= x.size)"
    met = left.alias("x").join(right.alias("y"), ["h", "i", "j"]).where(F.expr(f"x.root <> y.root and {order}") & may_link("x", "y"))
    new = verified(ordered_pairs(met, "x.node", "y.node"), texts)
    return linked if new.isEmpty() else components(edges.unionByName(new))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root): documents with equal roots are near copies; ``key`` is the text's digest."""
    spark = docs.sparkSession
    docs = named(docs)
    with scratch(spark):
        with scratch(spark):
            texts = written(sets(docs), "sets")
        linked = written(near_links(texts).distinct(), "near")
    return with_roots(docs.select("doc_id", "key", "node"), small(linked, linked.count())).select("doc_id", "key", "root")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest id of each group of near copies stays."""
    with scratch(spark, 2):
        groups = written(near_groups(docs), "near")
        rows = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
        best = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__best"))
        drops = rows.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__best")), "left_anti")
        drops = written(drops.select("doc_id", "key"), "drops")
        twice = written(rows.where("n > 1").select("doc_id", "key"), "twice")
    marked = docs.withColumn("__key", digest())

    def without(df: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        listed = small(listed.select(F.col("doc_id").alias("__id"), F.col("key").alias("__drop")), listed.count())
        return df.join(listed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__drop")), how)

    kept = without(marked, drops, "left_anti")
    if twice.isEmpty():
        return kept.drop("__key")
    repeated = without(kept, twice, "left_semi").dropDuplicates(["doc_id", "__key"])
    return without(kept, twice, "left_anti").unionByName(repeated).drop("__key")
