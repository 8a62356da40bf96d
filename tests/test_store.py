"""Changes of several tables: together or not at all, and never over another writer's."""

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.engine import Engine
from docloom.settings import Settings
from docloom.sources import snapshots
from docloom.sources.providers import HashEmbedder
from docloom.sources.snapshots import ConflictError, Store


def ids(store, name="t"):
    return sorted(r.id for r in store.read(name).collect())


def test_a_second_writer_is_told(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.write("t", spark.range(1))
    began = two._state("t")
    one.append("t", spark.range(1, 2))
    with pytest.raises(ConflictError):
        two._point("t", [two._added("t", spark.range(9))], began[0])
    assert ids(two) == [0, 1] and two.versions("t") == [1, 2]
    assert not [p for p in (tmp_path / "_pointers" / "t").iterdir() if p.name.startswith("draft")]


def test_an_append_goes_again_from_the_new_version(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.append("t", spark.range(1))
    state, raced = two._state, []

    def stale(name):
        found = state(name)
        if not raced:
            raced.append(one.append("t", spark.range(1, 2)))
        return found

    monkeypatch.setattr(two, "_state", stale)
    two.append("t", spark.range(2, 3))
    assert raced and ids(one) == [0, 1, 2]


def test_changes_are_seen_together(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    with store.changes():
        store.append("t", spark.range(3, 5))
        store.delete("t", spark.range(1), "id")
        store.write("u", store.read("t"))
        with store.changes():
            store.append("u", spark.range(9, 10))
        assert ids(store) == [1, 2, 3, 4] and ids(store, "u") == [1, 2, 3, 4, 9]
        assert ids(other) == [0, 1, 2] and other.current("u") is None
    assert ids(other) == [1, 2, 3, 4] and ids(other, "u") == [1, 2, 3, 4, 9]
    assert other.versions("t") == [1, 2]  # one step for the whole block


def test_a_failing_block_and_a_conflict_change_nothing(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    with pytest.raises(ZeroDivisionError), store.changes():
        store.write("t", spark.range(1))
        1 / 0
    assert ids(store) == [0, 1, 2]
    with pytest.raises(ConflictError), store.changes():
        store.write("u", spark.range(1))
        store.write("t", spark.range(1))
        other.append("t", spark.range(3, 4))
    assert ids(store) == [0, 1, 2, 3] and store.current("u") is None


def test_many_appends_put_small_folders_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 4)
    store = Store(spark, str(tmp_path))
    store.append("t", spark.range(50_000).coalesce(1))
    large = store.folders("t")[0]
    for i in range(6):
        store.append("t", spark.range(100_000 + i, 100_001 + i).coalesce(1))
    assert large in store.folders("t") and len(store.folders("t")) <= 5 and store.read("t").count() == 50_006


class Failing(HashEmbedder):
    """An embedder that can be told to fail."""

    broken = False

    def embed(self, texts):
        if self.broken:
            raise RuntimeError("no model")
        return super().embed(texts)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), Settings(embed_dim=16), embedder=Failing(16))
    docs = [("/a/one.txt", "note", "alpha beta gamma. Method Foo."), ("/a/two.txt", "note", "delta beta epsilon"), ("/b/three.txt", "note", "zeta eta theta")]
    e.ingest_documents(spark.createDataFrame(docs, "source_uri string, source_type string, text string"), "s1")
    return e


def state(engine):
    return {t: (engine.store.current(t), engine.table(t).count()) for t in schemas.TABLES}


def test_a_failing_reingest_changes_no_table(spark, engine):
    chunk = engine.table("chunks").where("source_uri = '/a/one.txt'").first().chunk_id
    paper = engine.register_paper("Paper", path="/a/one.txt")
    engine.record_conclusion("claim", 0.5, [chunk])
    before = state(engine)
    docs = spark.createDataFrame([("/a/one.txt", "note", "alpha changed. Method Foo.")], "source_uri string, source_type string, text string")
    engine.embedder.broken = True
    try:
        with pytest.raises(Exception, match="no model"):
            engine.reingest(docs)
    finally:
        engine.embedder.broken = False
    assert state(engine) == before
    assert engine.table("papers").where(F.col("paper_id") == paper).first().abstract_chunk_id == chunk
    new = engine.reingest(docs).collect()
    assert len(new) == 1 and engine.table("chunk_sessions").where(F.col("chunk_id") == new[0].chunk_id).where("session_id = 's1'").count() == 1


def test_search_by_blocks_after_replacement_and_compaction(spark, engine):
    """Dropped chunks are in no result and no count, before and after the index is compacted."""

    def scores():
        found = engine.index().best(spark.createDataFrame([(0, "beta alpha")], "query_id int, term string"), 5)
        return [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()]

    index = engine.index()
    assert index.blocks is not None and index.gone is not None
    index.blocks = None
    whole = [(r.chunk_id, r.score) for r in index.best(spark.createDataFrame([(0, "beta alpha")], "query_id int, term string"), 5).orderBy("rank").collect()]
    assert scores() == whole and len(whole) == 2
    assert engine.search_index("beta OR alpha", mode="fts").count() == 2
    engine.compact_index()
    assert engine.table("gone_chunks").count() == 0 and scores() == whole
    live = {r.chunk_id for r in engine.table("chunks").collect()}
    assert {r.chunk_id for r in engine.table("postings").select("chunk_id").distinct().collect()} == live


def test_single_rows_are_appended(engine):
    folders = lambda t: len(engine.store.folders(t)) if engine.store.current(t) else 0
    engine.add_relationship(1, 2, "cites", 0.5)
    n = folders("relationships")
    engine.add_relationship(1, 3, "cites", 0.5)
    assert folders("relationships") == n + 1
    engine.add_relationship(1, 3, "cites", 0.7)  # in place of the other
    assert [r.confidence for r in engine.table("relationships").where("target_paper_id = 3").collect()] == [0.7]
    with pytest.raises(ValueError):
        engine.add_relationship(1, 4, "cites", 1.5)


def test_keys_of_dropped_chunks_are_not_given_again(spark, engine):
    last = engine.table("chunks").orderBy(F.desc("chunk_id")).first()
    engine.drop_chunks(engine.table("chunks").where(F.col("chunk_id") == last.chunk_id))
    docs = spark.createDataFrame([("/b/four.txt", "note", "omicron pi rho")], "source_uri string, source_type string, text string")
    (new,) = engine.ingest_documents(docs).collect()
    assert new.chunk_id > last.chunk_id
    assert [r.chunk_id for r in engine.search_index("omicron", mode="fts").collect()] == [new.chunk_id]
