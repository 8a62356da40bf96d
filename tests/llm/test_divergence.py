"""Divergences of sources against a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import divergence
from tests.llm.helpers import DOCS, LONG, none, odd, same_rows, save

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = [t.translate(LOWERED) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        size = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: share(counts[lang, s][t], size[s]) for t in kept} for s in own}
        q = {t: share(sum(counts[lang, s][t] for s in own), sum(size.values())) for t in kept}
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < 10]
    return out


def answer(spark, folder):
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.op13_divergence(spark, folder).collect()]


def rows_of(df):
    return [(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()]


def test_odd_table(spark, tmp_path):
    """Nothing is frequent enough here, so pairs have value 0 and there are no terms."""
    df = odd(spark, True)
    got = answer(spark, save(df, tmp_path, "documents"))
    assert same_rows(got, plain(rows_of(df))) and {r[4] for r in got} == {0}


def test_empty_table(spark, tmp_path):
    assert answer(spark, save(none(spark), tmp_path, "documents")) == []


def corpus(n=400):
    rng, docs = random.Random(11), []
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Éa", "漢字", "ü", "the", "The"]
    for i in range(n):
        lang = rng.choice(("en", "en", "de", None, ""))
        source = rng.choice(("hot", "hot", "hot", "a", "b", "é", None))
        bias = hash_of(source)
        text = " ".join(["the"] * rng.randrange(4) + [words[min(int(rng.expovariate(0.05) + bias), len(words) - 1)] for _ in range(rng.randrange(30))])
        docs.append((rng.choice((i, 3, None)), rng.choice((text, text, text.replace(" ", "-1\t"))), lang, source, 1))
    docs += [(1, None, "en", "without", 0), (2, "", "xx", "s1", 0), (2, "9 8 7", "xx", "s2", 0), (9, LONG, "en", "a", 1)]
    docs += [(5, "same words every time", "la", "one", 1)] * 12
    return docs


def hash_of(source):
    return len(source or "") * 3


def test_corpus(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "first", "no", "p", "q", "zero", "a", "b")})
    got, want = answer(spark, save(df.repartition(7), tmp_path, "documents")), plain([(d[1], d[2], d[3]) for d in docs])
    assert same_rows(got, want)
    assert {r[2] for r in got} == {"pair", "term"}


def test_runs_over_tiny_batches(spark, tmp_path, monkeypatch):
    """Batches of three rows, tasks that hand on early and many ranges: runs break at every edge."""
    docs = corpus(150)
    folder = save(spark.createDataFrame(docs, DOCS).repartition(5), tmp_path, "documents")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = answer(spark, folder)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert same_rows(got, plain([(d[1], d[2], d[3]) for d in docs]))


def test_a_task_hands_on_a_row_for_each_term(monkeypatch):
    """Not one for each source of a term; also if counters are turned into arrays after each document."""
    texts = ["one two two", "Two three", "漢字 one"] * 40
    columns = [pa.array(["en"] * 120), pa.array([i % 40 + 1 for i in range(120)], pa.int32()), pa.array([None, *range(119)], pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["lang", "no", "doc", "text"])
    for most in (divergence.MOST_COUNTED, 0):
        monkeypatch.setattr(divergence, "MOST_COUNTED", most)
        runs = list(divergence.counted(iter([batch])))
        assert sum(b.num_rows for b in runs) == 4 and sum(b.column("docs").to_pylist().count(80) for b in runs) == 2
        runs = pa.Table.from_batches(runs).sort_by([("term", "ascending")]).combine_chunks().to_batches()
        got = Counter({(r["term"], r["no"]): (r["docs"], r["n"]) for b in divergence.scanned(iter(runs)) for r in b.to_pylist()})
        want = {(t, no): (sum(t in x for x in own), sum(x.count(t) for x in own)) for no in range(1, 41) for own in [[x.lower().split() for i, x in enumerate(texts) if i % 40 + 1 == no]] for t in {w for x in own for w in x}}
        assert got == want


def test_long_terms_are_handed_on_early(monkeypatch):
    """A task holds so many bytes of terms, not only so many terms."""
    monkeypatch.setattr(divergence, "MOST_COUNTED", 1000)
    monkeypatch.setattr(divergence, "MOST_HELD", 10_000)
    texts = [chr(97 + i // 26) + chr(97 + i % 26) * 100_000 for i in range(40)]
    columns = [pa.array(["en"] * 40), pa.array([1] * 40, pa.int32()), pa.array(range(40), pa.int64()), pa.array(texts)]
    runs = list(divergence.counted(iter([pa.RecordBatch.from_arrays(columns, ["lang", "no", "doc", "text"])])))
    assert len(runs) > 5 and sorted(t for b in runs for t in b.column("term").to_pylist()) == sorted(texts)


def test_pair_sums_are_handed_on_early():
    """A scan that holds few sums yields the same pairs in more parts."""
    rng = np.random.default_rng(4)
    rows = sorted({(t, int(no)) for t in range(300) for no in rng.integers(1, 9, 5)})
    n = len(rows)
    p = rng.integers(1, 10**9, n)
    columns = [pa.array([f"l{t // 200}" for t, _ in rows]), pa.array([f"t{t:04}" for t, _ in rows]), pa.array([no for _, no in rows], pa.int64())]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array(p[::-1].copy()), pa.array(p // 2 + 1)], ["lang", "term", "no", "p", "q", "zero"])

    def sums(most, size):
        total, parts = Counter(), 0
        for out in divergence.compared(10, most)(batch.slice(i, size) for i in range(0, n, size)):
            for r in out.to_pylist():
                if r["b"] is not None:
                    total[r["lang"], r["a"], r["b"]] += r["value"]
                    parts += 1
        return total, parts

    whole, few = sums(1 << 20, n)
    small, many = sums(16, 7)
    assert whole == small and many > few > 0


def test_share_is_exact(spark):
    rng = random.Random(8)
    cases = [(0, 2), (0, 4), (10**13, 10**14 + 7), (3, 7)] + [(rng.randrange(10**12), rng.randrange(10**12, 10**15)) for _ in range(50)]
    df = spark.createDataFrame(cases, "c long, d long").withColumn("p", divergence.share("c", "d"))
    assert all(r.p == 1 + 10**9 * (r.c + 2) // r.d for r in df.collect())
