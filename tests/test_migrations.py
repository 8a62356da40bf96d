"""The chain of schema steps: older stores, interruption, repetition, refusal."""

import pytest
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.operators import migrations
from docloom.sources.snapshots import Store


def older(spark, folder):
    """A store of before sessions had a table, facts an origin, spaces an element type and papers paths."""
    store = Store(spark, folder)
    chunks = [(1, None, "first text", "C:\\docs\\a.md", "s1"), (2, "kept", "second text", "/docs/b.md", "s1"), (3, None, "third text", "/docs/c.md", None)]
    store.write("chunks", spark.createDataFrame(chunks, "chunk_id long, content_hash string, content string, source_uri string, session_id string").withColumns({"source_type": F.lit("markdown"), "chunk_index": F.lit(0)}))
    store.write("chunk_sessions", spark.createDataFrame([(2, "s1")], "chunk_id long, session_id string"))
    store.write("papers", spark.createDataFrame([(1, "P", 1), (2, "Q", 2), (3, "R", None)], "paper_id long, title string, abstract_chunk_id long"))
    store.write("paper_paths", spark.createDataFrame([(2, "D:\\q.pdf", True)], "paper_id long, path string, is_primary boolean"))
    store.write("embed_spaces", spark.createDataFrame([("default", "hash", "local", 64, "active")], "name string, model string, provider string, dim int, status string"))
    store.write("methods", spark.createDataFrame([(1, "m", 1)], "id long, name string, paper_id long"))
    return store


def state(store):
    read = lambda name, *columns: sorted((tuple(r) for r in store.read(name).select(*columns).collect()), key=repr)
    return (
        read("chunks", "chunk_id", "content_hash", "source_uri", "chunk_strategy", "metadata"), read("chunk_sessions", "chunk_id", "session_id"),
        read("paper_paths", "paper_id", "path", "is_primary"), read("embed_spaces", "name", "element_type", "chunk_strategy"), read("methods", "id", "source"),
    )


def test_an_older_store_converges_twice_and_after_an_interruption(spark, tmp_path, monkeypatch):
    store = older(spark, str(tmp_path / "a"))
    names = [s.__name__.lstrip("_") for s in migrations.STEPS]
    assert migrations.opened(store, True) == names
    want = state(store)
    chunks, links, paths, spaces, methods = want
    assert [c[2:] for c in chunks] == [("C:/docs/a.md", "mechanical", "{}"), ("/docs/b.md", "mechanical", "{}"), ("/docs/c.md", "mechanical", "{}")]
    assert chunks[1][1] == "kept" and all(len(c[1]) == 16 for c in (chunks[0], chunks[2]))
    assert links == [(1, "s1"), (2, "s1")] and methods == [(1, "user")] and spaces == [("default", "float32", "mechanical")]
    assert paths == [(1, "C:/docs/a.md", True), (2, "D:/q.pdf", True)]
    versions = {t: store.current(t) for t in ("chunks", "paper_paths", "chunk_sessions", "methods")}
    assert migrations.opened(store, True) == []
    migrations.migrated(store)  # every step once more changes no table
    assert state(store) == want and versions == {t: store.current(t) for t in versions}

    broken = older(spark, str(tmp_path / "b"))

    def stops(store):
        store.write("chunks", store.read("chunks").limit(0))
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(migrations, "STEPS", (*migrations.STEPS[:3], stops, *migrations.STEPS[4:]))
        with pytest.raises(RuntimeError, match="stopped"):
            migrations.opened(broken, True)
    assert migrations.noted(broken)[0] == 3 and broken.read("chunks").count() == 3
    assert migrations.opened(broken, True) == names[3:]
    assert state(broken) == want


def test_stores_of_other_builds(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "s"))
    assert e.migrated == [] and migrations.noted(e.store) == (len(migrations.STEPS),) * 2
    ran = []
    with monkeypatch.context() as m:
        m.setattr(migrations, "STEPS", (*migrations.STEPS, ran.append))
        with pytest.raises(migrations.SchemaError, match="behind"):
            Engine(spark, str(tmp_path / "s"))
        assert Engine(spark, str(tmp_path / "s"), migrate=True).migrated == ["append"] and len(ran) == 1
    with pytest.raises(migrations.SchemaError, match="newer"):
        Engine(spark, str(tmp_path / "s"), migrate=True)


def test_an_older_store_opens_as_an_engine(spark, tmp_path):
    older(spark, str(tmp_path / "s"))
    e = Engine(spark, str(tmp_path / "s"))
    assert len(e.migrated) == len(migrations.STEPS)
    assert {r.folder_path for r in e.table("folder_summaries").collect()} == {"C:/docs", "/docs"}
    assert [r.path for r in e.get_paper_paths(1).collect()] == ["C:/docs/a.md"]
