import random
import re

import xxhash

from docloom.llm import near_dedup, simhash
from tests.llm.helpers import none, odd, save


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_the_plain_rule():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "É é", "a\x1cb c d e"] + [" ".join(rng.choice(["ab", "Cd", "é", "x"]) for _ in range(n)) for n in (3, 4, 255, 256, 257, 700)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_classes_are_those_of_all_pairs_within_three_bits(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:30]:
        for k in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), k)))
    # three bits in one group, and across groups
    prints += [prints[0] ^ 0b111, prints[1] ^ (1 << 20 | 1 << 41 | 1 << 63), prints[2] ^ (7 << 61), 0, 7]
    prints = sorted(set(prints))
    signed = [simhash._signed(p) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in simhash.classes(df).collect()}
    want = simhash.brute_components({s: s & (1 << 64) - 1 for s in signed})
    assert {s: found.get(s, s) for s in signed} == want
    assert {k for k, v in found.items() if k == v} == set()


def test_a_dense_family_meets_without_all_pairs(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(5))) for _ in range(800)}
    signed = sorted(simhash._signed(p) for p in prints)
    found = {r.node: r.root for r in simhash.classes(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert {s: found.get(s, s) for s in signed} == simhash.brute_components({s: s & (1 << 64) - 1 for s in signed})


def test_components_of_chains_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201 + i) for i in range(50)] + [(300, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(1, 9)) and all(got[201 + i] == 200 for i in range(50))


def test_query_against_all_pairs(spark):
    from tests.conftest import SF

    rows = simhash.op2_simhash(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    want = simhash.brute_components(prints)
    assert all(r.component_id == want[r.doc_id] for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(plain_fingerprint(texts[r.doc_id]) == prints[r.doc_id] for r in rows[:60])


def test_odd_table(spark, tmp_path):
    rows = simhash.op2_simhash(spark, save(odd(spark, True), tmp_path, "documents")).collect()
    assert len(rows) == 13
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by[3, zero] == 3 and by[4, zero] == 3 and by[5, zero] == 3 and by[None, zero] == 3
    assert len({r.component_id for r in rows if r.doc_id in (1, 2)}) == 1


def test_empty_table(spark, tmp_path):
    assert simhash.op2_simhash(spark, save(none(spark), tmp_path, "documents")).count() == 0


def similarity(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, doc_id = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(200)]
        rows.append((doc_id, " ".join(base)))
        doc_id += 1
        for _ in range(2):
            edited = list(base)
            edited[rng.randrange(200)] = "changed"
            assert similarity(" ".join(base), " ".join(edited)) >= 0.8
            rows.append((doc_id, " ".join(edited)))
            doc_id += 1
    rows += [(doc_id + i, " ".join(rng.choice(vocabulary) for _ in range(100))) for i in range(60)]
    kept = {r.doc_id for r in near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i * 3 for i in range(40)} | {doc_id + i for i in range(60)}


def test_stage_odd_and_empty(spark):
    docs = odd(spark, True)
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [-3, 1, 3, 6, 7, 8, 9]
    assert [r.text for r in rows if r.doc_id is None] == ["no id here"]
    assert near_dedup.stage(spark, none(spark), "").count() == 0


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(9999)}" for _ in range(30)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (None, texts[0]), (None, "alone"), (None, "alone")]
    out = near_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, "alone")]))
