import shutil

import corpus_pipeline
from docloom.llm import decontamination, queries
from tests.conftest import SF
from tests.llm.helpers import none, odd, save


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*columns, "shard", "slot"]
    rows = out.collect()
    assert 0 < len(rows) and {r.doc_id for r in rows} < before
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(decontamination.brute_scan(r.text, items)[1] for r in rows[:40])
    texts = {r.doc_id: r.text for r in rows}
    assert len(set(texts.values())) == len(texts)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_and_empty(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    save(spark.createDataFrame([(1, 1, 0), (7, 1, 0), (6, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, "one")], "item_id long, text string"), tmp_path, "benchmark")
    corpus_pipeline.run(spark, folder).count()
    save(none(spark), tmp_path, "documents")
    assert corpus_pipeline.run(spark, folder).count() == 0
    shutil.rmtree(tmp_path)


def test_every_operator_is_registered():
    names = sorted(queries.QUERIES)
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
