"""Folder summaries are kept up from the documents that changed."""

import pytest
from pyspark.sql import functions as F

from docloom import engine as engine_module
from docloom.engine import Engine
from docloom.settings import Settings
from docloom.sources.providers import HashEmbedder

DOCS = "source_uri string, source_type string, text string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings(embed_dim=8), embedder=HashEmbedder(8))
    docs = [(f"/top/f{i % 6}/{i}.txt", "note", f"text number {i}") for i in range(18)] + [("/top/f1/deeper/x.txt", "note", "deeper text"), ("bare.txt", "note", "no folder")]
    e.ingest_documents(spark.createDataFrame(docs, DOCS), "s1")
    return e


def summaries(engine):
    return {r.folder_path: (r.summary, r.content_hash, tuple(r.embedding)) for r in engine.table("folder_summaries").collect()}


def rebuilt(engine):
    """What a full pass over all chunks gives."""
    kept = engine.table("folder_summaries")
    before = summaries(engine)
    engine.save("folder_summaries", kept.limit(0))
    engine.update_folder_summaries()
    after = summaries(engine)
    assert len(before) == kept.count()
    return before, after


def test_an_added_document_touches_its_folder_alone(spark, engine):
    before = {r.folder_path: r.updated_at for r in engine.table("folder_summaries").collect()}
    engine.ingest_documents(spark.createDataFrame([("/top/f1/new.txt", "note", "a new text")], DOCS))
    after = {r.folder_path: r.updated_at for r in engine.table("folder_summaries").collect()}
    assert before.keys() == after.keys() and {f for f in after if after[f] != before[f]} == {"/top/f1"}
    left, right = rebuilt(engine)
    assert left == right and "new.txt: a new text" in right["/top/f1"][0]


def test_only_the_folder_is_asked_of_the_scan(spark, engine, capsys):
    folders = spark.createDataFrame([("/top/f2",), ("bare.txt",)], "folder_path string")
    found = engine._in_folders(folders)
    found.explain("formatted")
    assert "StringStartsWith(source_uri,/top/f2/)" in capsys.readouterr().out
    assert {r.source_uri for r in found.collect()} == {"/top/f2/2.txt", "/top/f2/8.txt", "/top/f2/14.txt", "bare.txt"}


def test_many_folders_are_joined(spark, engine, monkeypatch):
    folders = spark.createDataFrame([("/top/f2",), ("/top/f1",)], "folder_path string")
    few = sorted(r.source_uri for r in engine._in_folders(folders).collect())
    monkeypatch.setattr(engine_module, "MOST_FOLDERS", 1)
    assert sorted(r.source_uri for r in engine._in_folders(folders).collect()) == few and "/top/f1/deeper/x.txt" not in few


def test_replaced_and_emptied_folders(spark, engine):
    engine.reingest(spark.createDataFrame([("/top/f3/3.txt", "note", "other words")], DOCS))
    assert "3.txt: other words" in summaries(engine)["/top/f3"][0]
    engine.drop_chunks(engine.table("chunks").where(F.col("source_uri").startswith("/top/f4/")))
    done = engine.update_folder_summaries(spark.createDataFrame([("/top/f4",), ("/top/f5",)], "folder_path string")).collect()
    assert [(r.folder_path, r.action) for r in done] == [("/top/f4", "drop")]
    left, right = rebuilt(engine)
    assert left == right and "/top/f4" not in right and len(right) == 7
