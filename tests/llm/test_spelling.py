"""Spelling variants against a plain version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from docloom.llm import spelling
from docloom.llm.common import LETTER_TABLE, pieces
from tests.llm.helpers import DOCS, none, odd, same_rows, save

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows) -> list[tuple]:
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def answer(spark, folder):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling(spark, folder).collect()]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_odd_table(spark, tmp_path):
    df = odd(spark, True).withColumns({c: F.lit("clash") for c in ("word", "n", "id", "key", "doc")})
    got = answer(spark, save(df, tmp_path, "documents"))
    assert got == plain(rows_of(df)) == []  # no word of seven letters stands twice


def test_empty_table(spark, tmp_path):
    assert answer(spark, save(none(spark), tmp_path, "documents")) == []


def crowded():
    """Many words near each other, chains of forms, equal letters, accents and breaks."""
    rng, docs = random.Random(3), []
    stems = ["aaaaaaaa", "abababab", "häuserna", "connection", "ÀÉÎÕÜàéîõü", "zzzzzzz"]
    for i in range(250):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems))
            for _ in range(rng.choice((0, 0, 0, 0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                kind = rng.random()
                w[at : at + 1] = [] if kind < 0.3 else [rng.choice("abcé")] if kind < 0.7 else [w[at], rng.choice("abz")]
            words.append("".join(w))
        docs.append((rng.choice((i, i, 5, None)), rng.choice((" ", "-", " ß9", "\n漢")).join(words)))
    # counts that rise tenfold twice: chains of two forms
    docs.append((1000, " ".join(["linkedwords"] * 300 + ["linkedword"] * 25 + ["linkeword"] * 2)))
    return docs


def test_crowded_words(spark, tmp_path):
    docs = crowded()
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in docs], DOCS)
    got, want = answer(spark, save(df, tmp_path, "documents")), plain(docs)
    assert same_rows(got, want)
    assert any(form != root and form for _, form, root, *_ in got)
    assert max(r[4] for r in got) > 20


def test_small_slices(spark, tmp_path, monkeypatch):
    docs = crowded()[:40]
    counts = Counter()
    monkeypatch.setattr(spelling, "MOST_COUNTED", 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["" if d is None else str(d) for d, _ in docs]), pa.array([t for _, t in docs])], ["doc", "text"])
    out = list(spelling.counted(iter([batch])))
    assert len(out) > 5
    for b in out:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[w] += n
    assert {w: n for w, n in counts.items() if n >= 2} == {r[0]: r[3] for r in plain(docs)}


def test_long_word(spark):
    """Words of 30,000 letters: keys are made in one pass and none holds a copy of the word."""
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    text = " ".join([long] * 30 + [long[:500] + long[501:]] * 2 + [long[:9] + "z" + long[10:]] * 2)
    rows = spelling.variants(spark.createDataFrame([(7, text, "en", "a", 1)], DOCS)).collect()
    assert sorted((r.n, r.n_near, r.form_n) for r in rows) == [(2, 1, 30), (2, 1, 30), (30, 2, None)]


def test_keys_of_equal_deletions_are_equal():
    import pyarrow as pa

    words = ["aaab", "aab", "abc", "xabc", "b", "é漢\U0001f600"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words)], ["id", "word"])
    (out,) = spelling.keyed(iter([batch]))
    keys = {}
    for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
        keys.setdefault(i, []).append(k)
    made = {i: {w} | {w[:j] + w[j + 1 :] for j in range(len(w))} for i, w in enumerate(words)}
    by_text = {}
    for i in made:
        assert len(keys[i]) == len(set(keys[i])) == len(made[i])
    for i in made:
        for j in made:
            assert len(set(keys[i]) & set(keys[j])) == len(made[i] & made[j]), (i, j, by_text)


def test_pieces_end_at_breaks():
    text = ("word " * 50 + "x" * 90 + " tail").encode()
    for most in (1, 7, 64, 1000):
        parts = list(pieces(text, LETTER_TABLE, most))
        assert [w for p in parts for w in p.split()] == text.split()
