import re
from collections import Counter, defaultdict

from docloom.llm import mixing
from tests.llm.helpers import none, odd, save


def fill(sizes: dict, weights=(5, 2, 1), cap=3) -> dict:
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left, total = {}, set(sizes), sum(sizes.values())
    while left:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > cap * sizes[s]}
        if not over:
            return fixed | {s: rest * weight[s] / w for s in left}
        fixed |= {s: cap * sizes[s] for s in over}
        left -= over
    return fixed


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    sizes, source = defaultdict(int), {}
    for d in docs:
        sizes[d.source] += words(d.text)
    want = fill(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    by_id = defaultdict(list)
    for d in docs:
        by_id[d.doc_id].append(d)
    for r in rows:
        d = by_id[r.doc_id].pop()
        taken[d.source] += r.taken
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    for d in docs:
        largest[d.source] = max(largest[d.source], words(d.text))
        source[d.source] = want[d.source]
    for s, target in source.items():
        assert abs(taken[s] - target) <= largest[s] + 1, (s, taken[s], target)
    return want


def test_odd_table(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    rows = mixing.op1_mix(spark, folder).collect()
    # ids repeat and are null here, so sources are compared as wholes
    sizes = defaultdict(int)
    for d in odd(spark).collect():
        sizes[d.source] += words(d.text)
    want = fill(sizes)
    assert len(rows) == 13
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in want.values()}
    assert all(r.taken <= 3 * r["size"] for r in rows)
    again = mixing.op1_mix(spark, folder).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_targets_and_words_taken(spark):
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = check(mixing.op1_mix(spark, SF).collect(), docs)
    assert abs(sum(want.values()) - sum(words(d.text) for d in docs)) < 1e-3


def test_empty_table(spark, tmp_path):
    assert mixing.op1_mix(spark, save(none(spark), tmp_path, "documents")).count() == 0


def test_hot_source_and_one_size(spark, tmp_path):
    df = spark.range(6000).selectExpr("id AS doc_id", "'a b c d' AS text", "'en' AS lang", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "7L AS n_chars")
    folder = save(df, tmp_path, "documents")
    check(mixing.op1_mix(spark, folder).collect(), df.collect())


def test_stage_repeats_rows_and_keeps_columns(spark):
    docs = odd(spark, True)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    n = out.count()
    assert 0 < n <= 3 * docs.count()


def test_all_null_sources(spark):
    df = spark.createDataFrame([(i, "a b", None) for i in range(5)], "doc_id long, text string, source string")
    rows = mixing.mix(df, ("doc_id",)).collect()
    assert all(r.copies == 1 and r.target == 10 for r in rows)


def test_rows_without_ids_and_one_id_of_many_texts(spark, tmp_path):
    texts = [f"{'w ' * (i % 3 + 1)}t{i}" for i in range(900)]
    df = spark.createDataFrame([(None if i % 2 else 5, t, "en", "s" if i % 3 else None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = save(df, tmp_path, "documents")
    rows = mixing.op1_mix(spark, folder).collect()
    sizes = defaultdict(int)
    for d in df.collect():
        sizes[d.source] += words(d.text)
    want = fill(sizes)
    assert len(rows) == 900 and all(r.taken <= 3 * r["size"] for r in rows)
    for s, target in want.items():
        taken = sum(r.taken for r in rows if r.source_size == sizes[s])
        assert abs(taken - target) <= 5
    kept = lambda: sorted(r.text for r in mixing.stage(spark, df.repartition(3), "").collect())
    assert kept() == kept()


def test_stage_sorts_no_texts(spark):
    """What the stage takes is what the operator says, and no window or sort holds a text."""
    df = spark.createDataFrame([(i if i % 5 else None, f"w{i % 40} " * (i % 11), "en", "abc"[i % 3] if i % 7 else None, i) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.stage(spark, df.repartition(4), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    want = Counter({(r.doc_id, r.text): 0 for r in df.collect()})
    for r in mixing.mix(df.repartition(3), ("doc_id", "text")).collect():
        want[r.doc_id, r.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want
    below = plan[plan.index("Window [") :]
    assert "Join" in plan[: plan.index("Window [")] and "k_text" in plan and "k_text" not in below
