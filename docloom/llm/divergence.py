"""Audit of how the sources of a language diverge, by sorted runs of terms.

Sources are numbered within their language. Slices of texts hand on, for each language and term,
a run of documents: the first of them, how many there are, and packed for each source how many
of its documents have the term and how often. A row for each term, not one for each of its
sources, is what is shuffled and sorted. The runs are range-partitioned and sorted by (term,
lang, document), so a term of any frequency is spread over as many tasks as it needs, and one
scan of the sorted rows adds up document frequency and counts. A term that begins and ends
within a batch is complete there and is dropped before it is unpacked if too few documents
have it; only what touches a batch's edges is merged after.

A second scan, over the kept terms of all sources side by side, emits sums for pairs of
sources and each source's candidate terms. For a pair (a, b) a term that neither source has
adds the same each time, and one that only a has depends on its count alone, so

    value = V f(za, zb) + sum over terms of a (f(pa, zb) - f(za, zb)) + the same of b
          + sum over terms of both (f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb))

with z the share of a term that does not occur. Runs yield the last line; the second sums come
from a histogram of counts for each source. All arithmetic is in integers.

Cases: null text, lang and source are empty strings; each row is a document, repeated ids or
not; a source without terms is a group with count 0; a language without kept terms has value
0 for its pairs; empty tables give empty results; other columns are not read. The table of
groups has one row for each source of a language, the result one for each pair of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import LETTER_TABLE, LOWER, UPPER, pieces, sliced, small, utf8, written
from docloom.session import table

#: Documents of its language that a kept term has, unit of shares, ranks of terms.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Distinct (group, term) that a task counts before it makes them arrays, such array rows and sums of pairs that it holds before it hands them on.
MOST_COUNTED, MOST_HELD, MOST_PAIRS = 200_000, 1 << 21, 1 << 22
#: Parts of a group's histogram.
PARTS = 64
RUN = "lang string, term string, first long, docs long, sources binary"
#: A source's part of a run.
SOURCE = np.dtype([("no", "<i4"), ("docs", "<i4"), ("n", "<i8")])
#: Runs of a batch that a task hands on.
BATCH_RUNS = 20_000


def added(of: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(of, SOURCE) of rows of the same (of, no) added up, in that order."""
    no, docs, n = rows
    key = of.astype(np.int64) << 32 | no
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out = np.empty(len(starts), SOURCE)
    out["no"], out["docs"], out["n"] = key[starts] & 0xFFFFFFFF, np.add.reduceat(docs[order], starts), np.add.reduceat(n[order], starts)
    return key[starts] >> 32, out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of terms of slices of (lang, no, doc_id, text)."""
    groups: dict[tuple[str, int], tuple[Counter, Counter]] = {}
    held: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]] = {}
    first: dict[str, int | None] = {}

    def settled() -> int:
        """Counters become arrays, a tenth as large."""
        rows = 0
        for (lang, no), (docs, counts) in groups.items():
            n = len(counts)
            numbers = np.full(n, no, np.int32), np.fromiter(map(docs.__getitem__, counts), np.int32, n), np.fromiter(counts.values(), np.int64, n)
            held.setdefault(lang, []).append((pa.array(counts.keys(), pa.binary()), *numbers))
            rows += max(n, held[lang][-1][0].nbytes // 32)  # long terms count as several
        groups.clear()
        return rows

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            terms = pa.concat_arrays([part[0] for part in parts]).dictionary_encode()
            if not len(terms):
                continue
            code, sources = added(terms.indices.to_numpy(), [np.concatenate([part[i] for part in parts]) for i in (1, 2, 3)])
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))  # codes are 0 and on, none left out
            ends = (np.append(starts, len(code)) * SOURCE.itemsize).astype(np.int32)
            n = len(starts)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(sources)])
            docs = np.add.reduceat(sources["docs"].astype(np.int64), starts)
            columns = [pa.array([lang] * n, pa.string()), terms.dictionary.cast(pa.string()), pa.array([first[lang]] * n, pa.int64()), pa.array(docs), packed]
            whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "first", "docs", "sources"])
            for at in range(0, n, BATCH_RUNS):
                yield whole.slice(at, BATCH_RUNS)
        held.clear()
        first.clear()

    counting = rows = 0
    for part in sliced(batches, 3):
        for lang, no, doc, text in zip(*(part.column(i).to_pylist() for i in range(3)), utf8(part.column(3)), strict=True):
            first.setdefault(lang, doc)
            docs, counts = groups.setdefault((lang, no), (Counter(), Counter()))
            before, seen = len(counts), set()
            for piece in pieces(text, LETTER_TABLE):
                terms = piece.split()
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            counting += max(len(counts) - before, len(text) >> 8)
            if counting > MOST_COUNTED:
                rows, counting = rows + settled(), 0
                if rows > MOST_HELD:
                    yield from flushed()
                    rows = 0
    settled()
    yield from flushed()


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Places at which a sorted table's key changes, its first row included."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, no, docs, n) of sorted runs, without the terms that are seen whole and have too few documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, term, docs, sources = (batch.column(c) for c in ("lang", "term", "docs", "sources"))
        starts = changes([term, lang])
        kept = np.add.reduceat(docs.to_numpy(), starts) >= LEAST_DOCS
        kept[0] = kept[-1] = True  # they may go on in another batch
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        rows = np.flatnonzero(kept[of])
        sources = sources.take(pa.array(rows))
        each = np.frombuffer(b"".join(sources.to_pylist()), SOURCE)
        of = np.repeat(of[rows], pc.binary_length(sources).to_numpy() // SOURCE.itemsize)
        of, each = added(of, [each["no"], each["docs"].astype(np.int64), each["n"]])
        at = pa.array(starts[of])
        columns = [lang.take(at), term.take(at), *(pa.array(each[c].astype(np.int64)) for c in ("no", "docs", "n"))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "no", "docs", "n"])


def numbered(docs: DataFrame) -> DataFrame:
    """(lang, source, no) of every occurring group; numbers from 1 in each language."""
    found = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return written(found.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source"))), "numbers")


def term_runs(docs: DataFrame, numbers: DataFrame, groups: int) -> DataFrame:
    """(lang, term, no, n, total, head) of the kept terms: total over the language, head 1 for one source of each term."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.col("doc_id").cast("long").alias("doc"), "text")
    texts = texts.join(small(numbers, groups), ["lang", "source"]).select("lang", "no", "doc", "text")
    runs = written(texts.mapInArrow(counted, RUN), "runs")
    order = ("term", "lang", "first")
    merged = runs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scanned, "lang string, term string, no long, docs long, n long")
    each = merged.repartition("lang", "term").groupBy("lang", "term", "no").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    each = each.withColumns({"docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "head": F.row_number().over(term.orderBy("no"))})
    return written(each.where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "no", "n", "total", (F.col("head") == 1).cast("long").alias("head")), "kept")


def share(count: str, size: str) -> Column:
    """1 + floor(UNIT * (count + 2) / size), a thousandth at a time, so nothing overflows below 2**53 terms."""
    left, parts = f"({count} + 2L)", []
    for scale in (UNIT // 1000, UNIT // 1_000_000, 1):
        parts.append(f"({left} * 1000L) div {size} * {scale}L")
        left = f"(({left} * 1000L) % {size})"
    return F.expr(f"1L + {' + '.join(parts)}")


def gap(p: str, q: str) -> str:
    """f of two shares."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def groups_of(numbers: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, no, size, lang_size, terms, zero) of every occurring group; sizes are the divisors N + 2 V."""
    sums = kept.groupBy("lang", "no").agg(F.sum("n").alias("n"), F.sum("head").alias("heads"))
    lang = Window.partitionBy("lang")
    rows = numbers.join(sums, ["lang", "no"], "left").fillna(0, ["n", "heads"])
    rows = rows.withColumns({"terms": F.sum("heads").over(lang), "lang_n": F.sum("n").over(lang)})
    rows = rows.select("lang", "source", "no", "terms", *[F.greatest(F.col(c) + 2 * F.col("terms"), F.lit(2)).alias(name) for c, name in (("n", "size"), ("lang_n", "lang_size"))])
    return written(rows.withColumn("zero", share("0L", "size")), "groups")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values added up by key."""
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    return key[starts], np.add.reduceat(value[order], starts) if len(key) else value


def compared(top: int, most: int = MOST_PAIRS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scan of kept terms (lang, term, no, p, q, zero) sorted by lang and term.

    Yields (lang, a, b, null, value) with the sum over terms of both sources of a pair a < b,
    as far as a task knows it, and (lang, a, null, term, f) with the best ``top`` of each batch.
    """

    def rows(lang: str, a: np.ndarray, b: np.ndarray | None, term: pa.Array | None, value: np.ndarray) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(len(a), kind)
        columns = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, none(pa.string()) if term is None else term, pa.array(value, pa.int64())], ["lang", "a", "b", "term", "value"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, lang, keys, values, held = None, "", [], [], 0

        def pairs() -> Iterator[pa.RecordBatch]:
            nonlocal keys, values, held
            if keys:
                key, value = summed(keys, values)
                yield rows(lang, key >> 32, key & 0xFFFFFFFF, None, value)
            keys, values, held = [], [], 0

        def terms(name: str, part: pa.Table) -> Iterator[pa.RecordBatch]:
            no, p, q = (part.column(c).to_numpy() for c in ("no", "p", "q"))
            over = np.flatnonzero(p > q)
            if not len(over):
                return
            no, f, term = no[over], _f(p[over], q[over]), part.column("term").combine_chunks().take(pa.array(over))
            place = pc.rank(term, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
            order = np.lexsort((place, -f, no))
            starts = np.flatnonzero(np.append(True, np.diff(no[order]) != 0))
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            best = order[rank < top]
            yield rows(name, no[best], None, term.take(pa.array(best)), f[best])

        def met(part: pa.Table) -> None:
            nonlocal held
            no, p, z = (part.column(c).to_numpy() for c in ("no", "p", "zero"))
            starts = changes([part.column("term").combine_chunks()])
            ends = np.append(starts[1:], part.num_rows)
            for k in np.unique(ends - starts):  # terms that as many sources have, side by side
                at = starts[ends - starts == k]
                step = max(1, (1 << 20) // int(k * k))
                for i in range(0, len(at) if k > 1 else 0, step):
                    own = at[i : i + step, None] + np.arange(k)
                    x, y = np.triu_indices(int(k), 1)
                    a, b = own[:, x].ravel(), own[:, y].ravel()
                    keys.append(no[a] << 32 | no[b])
                    values.append(_f(p[a], p[b]) - _f(p[a], z[b]) - _f(z[a], p[b]) + _f(z[a], z[b]))
                    held += len(a)
                    if held > most:  # sums of pairs take the place of single terms
                        key, value = summed(keys, values)
                        keys[:], values[:], held = [key], [value], len(key)

        def of_langs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal lang
            starts = changes([table.column("lang").combine_chunks()])
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                part = table.slice(int(a), int(b - a)).combine_chunks()
                name = part.column("lang")[0].as_py()
                if name != lang:
                    yield from pairs()
                    lang = name
                yield from terms(name, part)
                met(part)
                if held > most // 2:
                    yield from pairs()

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.table(batch)
            whole = (whole if carried is None else pa.concat_tables([carried, whole])).combine_chunks()
            last = int(changes([whole.column("lang").chunk(0), whole.column("term").chunk(0)])[-1])
            carried = whole.slice(last)
            if last:
                yield from of_langs(whole.slice(0, last).combine_chunks())
        if carried is not None:
            yield from of_langs(carried)
        yield from pairs()

    return scan


def divergences(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of documents."""
    numbers = numbered(docs)
    n = numbers.count()
    kept = term_runs(docs, numbers, n)
    groups = groups_of(numbers, kept)
    named = kept.join(small(groups, n), ["lang", "no"])
    shares = named.select("lang", "term", F.col("no").cast("long").alias("no"), share("n", "size").alias("p"), share("total", "lang_size").alias("q"), "zero")
    scanned_rows = shares.repartition("lang", "term").sortWithinPartitions("lang", "term", "no").mapInArrow(compared(top), "lang string, a long, b long, term string, value long")
    found = written(scanned_rows, "compared")

    a, b = (small(groups.select("lang", *[F.col(c).alias(x + c) for c in ("source", "no", "zero", "terms")]), n) for x in "ab")
    pairs = a.join(b, "lang").where("ano <> bno")
    bare = pairs.select("lang", F.col("ano").alias("a"), F.col("bno").alias("b"), F.expr(f"terms * {gap('azero', 'bzero')}".replace("terms", "aterms")).alias("v"))
    # terms that a source has, by its count of them: each part of a histogram against every other source
    counts = named.groupBy("lang", "no", "zero", "n", "size").agg(F.count("*").alias("m"))
    parts = counts.groupBy("lang", F.col("no").alias("ano"), F.col("zero").alias("azero"), F.pmod("n", F.lit(PARTS)).alias("part"))
    parts = parts.agg(F.collect_list(F.struct(share("n", "size").alias("p"), "m")).alias("h"))
    own = f"aggregate(h, 0L, (s, x) -> s + x.m * ({gap('x.p', 'bzero')} - {gap('azero', 'bzero')}))"
    single = parts.join(b, "lang").where("ano <> bno").select("lang", F.col("ano").alias("a"), F.col("bno").alias("b"), F.expr(own).alias("v"))
    shared = found.where("b IS NOT NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("v"))
    both = single.unionByName(shared)
    turned = both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")
    values = bare.unionByName(both).unionByName(turned).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    paired = values.join(a.select("lang", F.col("ano").alias("a"), F.col("asource").alias("source")), ["lang", "a"])
    paired = paired.join(b.select("lang", F.col("bno").alias("b"), F.col("bsource").alias("item")), ["lang", "b"])
    termed = found.where("term IS NOT NULL").join(a.select("lang", F.col("ano").alias("a"), F.col("asource").alias("source")), ["lang", "a"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    paired = paired.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    termed = termed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order))
    return paired.unionByName(termed.where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the sources of all ``documents``."""
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
o AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(o.c), 0) AS n FROM g LEFT JOIN o USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS c, 1 + {UNIT}::HUGEINT * (coalesce(o.c, 0) + 2) // (s.n + 2 * l.v)::HUGEINT AS p,
    1 + {UNIT}::HUGEINT * (k.c + 2) // (l.n + 2 * l.v)::HUGEINT AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
