import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from docloom.llm import near_dedup

VOCABULARY = [f"w{i}" for i in range(5000)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def cut(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts):
    """Groups by comparing all pairs, as the smallest number of each text's group."""
    sets, root = [cut(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.root for r in near_dedup.near_groups(docs).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(found[i], i)
    return [first[found[i]] for i in range(len(texts))]


def test_pairs_at_the_threshold(spark):
    rng, texts = random.Random(1), []
    # of 396 shingles the last 44 differ: similarity 0.8; more lie below it
    for replaced in [44] * 30 + [38] * 10 + [45] * 10 + [55] * 20 + [68] * 10:
        base = words(rng, 400)
        texts += [" ".join(base), " ".join(base[: 400 - replaced] + words(rng, replaced))]
    expected = brute(texts)
    assert len(set(expected)) == len(texts) - 40
    assert groups(spark, texts) == expected


@pytest.mark.parametrize("share, rounds", [(0.75, 4), (0.8, 4), (0.87, 1), (0.95, 1), (0.8, 0)])
def test_near_copies_among_texts_with_one_passage(spark, monkeypatch, share, rounds):
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", rounds)
    rng, texts = random.Random(2), []
    passage = words(rng, int(400 * share))
    own = 400 - len(passage)
    for _ in range(60):
        base = words(rng, own) + passage
        texts += [" ".join(base), " ".join(base + words(rng, rng.randrange(60, 99)))]
    assert groups(spark, texts) == brute(texts)


def test_chains_and_rings_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    monkeypatch.setattr(near_dedup, "MOST_ROUNDS", 1)
    rng, texts = random.Random(4), []
    for edits in (2, 5, 7, 9, 11):
        base = words(rng, 200)
        for _ in range(25):
            copy = list(base)
            for at in rng.sample(range(200), rng.randrange(edits + 1)):
                copy[at] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    assert groups(spark, texts) == brute(texts)


def test_whole_table_against_all_pairs(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    distinct = list(dict.fromkeys(texts))
    sets = [cut(t) for t in distinct]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(i, j) for group in where.values() if len(group) < 200 for i, j in combinations(group, 2)}
    linked = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert groups(spark, distinct) == [min({i} | reached(linked, i)) for i in range(len(distinct))]


def reached(linked, i):
    found, rest = {i}, {i}
    while rest:
        rest = {b for a, b in linked if a in rest} | {a for a, b in linked if b in rest}
        rest -= found
        found |= rest
    return found


def test_frequent_shingles_from_the_sample(spark, monkeypatch):
    """All shingles frequent, none frequent and a small sample give the same groups."""
    rng, texts = random.Random(7), []
    passage = words(rng, 60)
    for _ in range(30):
        base = words(rng, 30) + passage
        texts += [" ".join(base), " ".join(base[3:])]
    want = brute(texts)
    for frequent, sample in ((1, 20_000), (10_000, 20_000), (2, 10)):
        monkeypatch.setattr(near_dedup, "FREQUENT", frequent)
        monkeypatch.setattr(near_dedup, "SAMPLE", sample)
        assert groups(spark, texts) == want


def test_hot_copies(spark):
    rng = random.Random(8)
    base = words(rng, 50)
    near = " ".join([*base[:-1], "other"])
    rows = [(i, " ".join(base)) for i in range(3000)] + [(3000, near), (3001, " ".join(words(rng, 50)))]
    out = near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 3001]


def test_texts_that_share_a_name_are_named_anew(spark, monkeypatch):
    rng, texts = random.Random(8), []
    for _ in range(12):
        base = words(rng, 120)
        texts += [" ".join(base), " ".join(base[:-4] + words(rng, 4))]
    texts += [texts[0], "", "short"]
    monkeypatch.setattr(near_dedup, "node", lambda: F.pmod(F.length("text"), F.lit(3)).cast("long"))
    assert groups(spark, texts) == brute(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, node string")
    rows = near_dedup.named(docs).collect()
    assert len({r.node for r in rows}) == len({r.key for r in rows}) == len({r.text for r in rows}) and len(rows) == len(texts) + 1
    assert near_dedup.named(docs.limit(0)).count() == 0


def test_a_family_is_not_compared_all_with_all(spark, monkeypatch):
    """Of families of 30 and 60 near copies a text is compared with a few others, however large the family is."""
    rng, texts, compared = random.Random(11), [], []
    for size in (30, 60):
        base = words(rng, 400)
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(400), 4):
                copy[at] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    count = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, of: (compared.append(pairs.count()), count(pairs, of))[1])
    assert groups(spark, texts) == brute(texts)
    assert sum(compared) <= 8 * len(texts), compared
