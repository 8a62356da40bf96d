import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.engine import Engine
from docloom.settings import Settings, resolved
from docloom.sources.providers import HashEmbedder

FILES = {
    "a/one.md": "# Sparse retrieval\nSparse retrieval of deep graphs with BM25. See 10.1234/abc and (Lee, 2020).",
    "a/two.md": "# Dense vectors\nDense vectors find neighbours of graphs.",
    "b/three.txt": "Cooking pasta takes water and salt.",
    "b/code.py": "import os\n\ndef search(query):\n    return query\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    for name, text in FILES.items():
        (root / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "docs" / name).write_text(text)
    model = lambda text: '{"methods": [{"name": "BM25", "description": "ranking"}], "datasets": [{"name": "Graphs"}], "metrics": [{"metric": "f1", "value": 0.9, "method": "BM25", "dataset": "Graphs"}]}'
    e = Engine(spark, str(root / "store"), Settings(embed_dim=32), model=model)
    e.docs = str(root / "docs")
    e.ingest(e.docs, "s1")
    return e


def test_ingest_is_idempotent(engine):
    n = engine.table("chunks").count()
    assert n >= 5 and engine.table("chunk_vec").count() == n and engine.table("chunk_sessions").count() == n
    engine.ingest(engine.docs, "s1")
    assert engine.table("chunks").count() == n
    assert engine.table("folder_summaries").count() == 2
    assert {r.source_type for r in engine.table("chunks").collect()} == {"markdown", "code"}


def test_search_and_misses(engine):
    found = engine.search_index("sparse retrieval").collect()
    assert found[0].content.startswith("# Sparse") and found[0].match_type == "hybrid"
    assert engine.search_index("sparse", mode="fts", source_type="code").count() == 0
    assert engine.search_index("retrieve", mode="fts").first().content.startswith("# Sparse")  # by its stem
    assert engine.search_index("what about the deep graphs?", mode="fts", keyword_prefilter=True).count() == 2
    assert engine.search_index("neighbor* OR pastas", mode="fts").first().content.startswith("Cooking")
    assert engine.search_index("zzz", mode="fts").count() == 0 and engine.search_index(" ZZZ", mode="fts").count() == 0
    errors = engine.list_prediction_errors().collect()
    assert sorted((r.error_type, r["query"], r.source_type_filter) for r in errors if r["query"] == "zzz") == [("no_results", "zzz", None)]
    engine.resolve_prediction_error(errors[0].id)
    assert engine.list_prediction_errors().count() == len(errors) - 1


def test_papers_edges_and_bibtex(engine, tmp_path, monkeypatch):
    uris = {r.source_uri.rsplit("/", 1)[1]: r.source_uri for r in engine.table("chunks").collect()}
    one = engine.register_paper("Sparse retrieval of graphs", ["Ann Bee"], 2019, path=uris["one.md"])
    two = engine.register_paper("Unrelated", ["Kim Lee"], 2020, doi="10.1234/abc", path=uris["two.md"])
    with pytest.raises(ValueError):
        engine.register_paper("Again", doi="10.1234/abc")
    assert [(r.target_paper_id, r.match_method) for r in engine.suggest_relationships(one).collect()] == [(two, "doi")]
    engine.add_relationship(one, two, "cites", 0.9)
    assert engine.suggest_relationships(one).count() == 0
    assert [r.direction for r in engine.get_relationships(two).collect()] == ["in"]
    with pytest.raises(ValueError):
        engine.add_relationship(one, two, "likes")
    assert engine.get_paper(title="SPARSE").first().paths == [uris["one.md"]]
    engine.scan_relationships()
    monkeypatch.chdir(tmp_path)
    assert engine.sync_bibtex("refs.bib") == 2 and engine.sync_bibtex("refs.bib") == 0
    assert "@article{bee2019," in (tmp_path / "refs.bib").read_text()
    with pytest.raises(ValueError):
        engine.sync_bibtex("refs.txt")


def test_conclusions(engine):
    chunk = engine.table("chunks").first().chunk_id
    first = engine.record_conclusion("Graphs help", 0.8, [chunk])
    second = engine.supersede_conclusion(first, "Graphs help a lot")
    assert [r.id for r in engine.get_conclusion_chain(second).collect()] == [first, second]
    assert [r.id for r in engine.get_conclusions("GRAPHS").collect()] == [second]
    with pytest.raises(ValueError):
        engine.supersede_conclusion(first, "x")
    with pytest.raises(ValueError):
        engine.record_conclusion("x", 1.0, [10**9])


def test_facts_and_jobs(engine):
    engine.record_method("Mine", 1, "by hand")
    engine.submit_job(1, "extract_structure")
    engine.submit_job(1, "extract_structure")
    assert engine.run_jobs() == 3 and {r.status for r in engine.list_jobs().collect()} == {"completed"}
    assert sorted(r.job_type for r in engine.list_jobs().collect()) == ["auto_relate", "auto_relate", "extract_structure"]
    assert engine.get_job_status(1).status == "completed"
    with pytest.raises(ValueError):
        engine.get_job_status(99)
    assert [(r.name, r.value, r.method) for r in engine.get_metrics(1).collect()] == [("f1", 0.9, "BM25")]
    assert [r.name for r in engine.get_datasets(1).collect()] == ["Graphs"] and engine.extraction_estimate(1).first().single_pass
    assert sorted(r.name for r in engine.table("methods").collect()) == ["BM25", "Mine"]
    engine.extract_structure(1)
    assert engine.table("methods").count() == 2 and engine.table("metrics").first().method_id is not None
    assert {r.canonical_name for r in engine.get_entities(1).collect()} == {"BM25", "Graphs"}
    engine.record_dataset("Graphs", 2)
    assert [r.value for r in engine.compare_papers([1, 2]).collect()] == [0.9]


def test_spaces(engine):
    engine.create_embed_space("short", 8, base_dim=32)
    engine.backfill_embed_space("short")
    engine.create_embed_space("bytes", element_type="int8")
    engine.backfill_embed_space("bytes")
    progress = {r.name: (r.chunk_count, r.total_chunks) for r in engine.list_embed_spaces().collect()}
    assert progress["short"][0] == progress["short"][1] > 0
    rows = engine.compare_spaces(["sparse graphs", "salt water"], "default", "bytes", 3).collect()
    assert len(rows) == 2 and all(r.overlap > 0.5 for r in rows)
    assert engine.batch_compare_spaces(["sparse"], "default", "short", 3).count() == 2
    bench = {r.space: r for r in engine.benchmark_spaces(sample_queries=3, top_k=3).collect()}
    assert bench["bytes"].storage_ratio == 0.25 and bench["short"].storage_ratio == 0.25 and bench["bytes"].overlap > 0.5 and bench["short"].error is None
    engine.promote_embed_space("bytes")
    assert engine.active_space().name == "bytes"
    assert engine.search_index("sparse retrieval", mode="vec", log=False).first().content.startswith("# Sparse")
    engine.cleanup_embed_space("default")
    engine.re_embed("other", HashEmbedder(16))
    assert engine.active_space().name == "other" and engine.table("folder_summaries").count() == 2


def test_reingest_keeps_sessions_and_repairs(engine, spark):
    uri = next(r.source_uri for r in engine.table("chunks").collect() if r.source_uri.endswith("three.txt"))
    old = engine.table("chunks").where(f"source_uri = '{uri}'").first().chunk_id
    id_ = engine.record_conclusion("Pasta", 1.0, [old])
    engine.reingest(spark.createDataFrame([(uri, "markdown", "Cooking rice takes water.")], "source_uri string, source_type string, text string"), "s2")
    new = engine.table("chunks").where(f"source_uri = '{uri}'").collect()
    assert [r.content for r in new] == ["Cooking rice takes water."]
    assert {r.session_id for r in engine.table("chunk_sessions").where(f"chunk_id = {new[0].chunk_id}").collect()} == {"s1", "s2"}
    assert engine.table("conclusions").where(f"id = {id_}").isEmpty()
    assert engine.co_occurrence().count() > 0 and engine.status().where("value is null").count() == len(schemas.TABLES)


def test_pages(engine, spark):
    pages = spark.createDataFrame([(1, "https://e.org/x#top", "<html><head><title>T</title></head><body><p>Quantum &amp; chips</p></body></html>")], "page_id long, url string, html string")
    engine.ingest_pages(pages)
    assert engine.search_index("quantum", mode="fts").first().source_uri == "https://e.org/x"


def test_adding_a_document_writes_its_own_rows(engine, spark):
    before = {n: engine.store.folders(n) for n in ("chunks", "chunk_vec", "postings", "chunk_lengths", "chunk_sessions")}
    docs = spark.createDataFrame([("/n/new.md", "markdown", "Fresh words about zebras."), ("/n/same.md", "markdown", "Fresh words about zebras.")], "source_uri string, source_type string, text string")
    assert engine.ingest_documents(docs, "s3").count() == 1
    for name, folders in before.items():
        assert engine.store.folders(name)[:-1] == folders and engine.store.read(name).count() > 0
    assert engine.search_index("zebra", mode="fts").first().source_uri == "/n/new.md"
    engine.compact_index()
    assert engine.search_index("zebra", mode="fts").count() == 1 and len(engine.store.folders("postings")) == 1
    assert engine.list_chunks(after=1, limit=2).count() == 2


def test_a_failing_reranker_keeps_the_order(engine):
    class Broken:
        def score(self, query, texts):
            raise RuntimeError("no model")

    kept, engine.reranker = engine.reranker, Broken()
    found = engine.search_index("sparse retrieval", rerank=True).collect()
    engine.reranker = kept
    assert found and found[0].match_type != "reranked"


def test_report_and_relinked_facts(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "p.md").write_text("# One\nIntro.\n" + "word " * 300 + "\n# Two\nThe BM25 model ranks.\n")
    (tmp_path / "docs" / "copy.md").write_text((tmp_path / "docs" / "p.md").read_text())
    e = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16))
    report = {r.source_uri.rsplit("/", 1)[1]: r for r in e.ingest(str(tmp_path / "docs"), "s1").collect()}
    assert report["copy.md"].chunks_added == report["p.md"].chunks_skipped > 0
    uri = next(r.source_uri for r in e.table("chunks").collect())
    paper = e.register_paper("One", path=uri)
    assert {r.duplicate_of_paper_id for r in e.ingest(str(tmp_path / "docs"), "s2").collect()} == {paper}
    last = e.table("chunks").orderBy("chunk_index", ascending=False).first()
    e.append("methods", spark.createDataFrame([(1, "BM25", paper, last.chunk_id)], "id long, name string, paper_id long, chunk_id long"))
    text = "# Zero\nNothing.\n" + "word " * 300 + "\n# Three\nBM25 again.\n"
    e.reingest(spark.createDataFrame([(uri, "markdown", text)], "source_uri string, source_type string, text string"), "s3")
    now = e.table("chunks").collect()
    assert e.get_methods(paper).first().chunk_id == next(r.chunk_id for r in now if "BM25" in r.content)
    assert e.get_paper(paper).first().abstract_chunk_id == min((r.chunk_index, r.chunk_id) for r in now)[1]
    assert {r.session_id for r in e.table("chunk_sessions").collect()} == {"s1", "s2", "s3"}


def test_figures_of_a_paper(spark, tmp_path):
    class Eyes:
        def describe(self, image, prompt):
            return [{"description": f"a chart of {len(image)} bytes"}, {"description": " "}]

        def recognise(self, image):
            return [{"type": "text", "content": "axis label"}]

    for name, size in (("a.png", 3), ("b.png", 5), ("other.png", 7)):
        (tmp_path / name).write_bytes(b"x" * size)
    e = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16), describer=Eyes(), recogniser=Eyes())
    text = "# P\n![x](img/a.png)\nFigure 1 shows growth\n\n![y](b.png)\n" + "filler " * 40
    e.ingest_documents(spark.createDataFrame([("/p.md", "markdown", text)], "source_uri string, source_type string, text string"))
    paper = e.register_paper("P", path="/p.md")
    e.submit_job(paper, "extract_figures", f'{{"folder": "{tmp_path}"}}')
    assert e.run_jobs() == 2 and {r.status for r in e.list_jobs().collect()} == {"completed"}
    found = {r.chunk_index: r.content for r in e.table("chunks").where("source_type = 'figure'").collect()}
    assert found[1_001_000].startswith("[Caption] Figure 1 shows growth\n\n[Description] a chart of 3 bytes") and "axis label" in found[1_001_001]
    assert e.extract_figures(paper, str(tmp_path), [1]).count() == 2 and e.table("chunks").where("source_type = 'figure'").count() == 2
    assert e.search_index("charts", mode="fts", source_type="figure").count() == 2
    assert e.extract_figures(paper, str(tmp_path), [7]).count() == 0 and e.table("chunks").where("source_type = 'figure'").count() == 2


def test_configuration_is_kept(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16))
    e.configure(chunk_strategy="semantic", auto_relate_propose_threshold="0.5")
    again = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16))
    assert again.settings.chunk_strategy == "semantic" and again.settings.auto_relate_propose_threshold == 0.5
    assert again.config().where("stored").count() == 2 and again.schema().where("table = 'chunks'").count() == 9
    with pytest.raises(ValueError):
        e.configure(colour="red")
    other = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16), embedder=HashEmbedder(8))
    with pytest.raises(ValueError):
        other.ingest_documents(spark.createDataFrame([("/x.md", "markdown", "text")], "source_uri string, source_type string, text string"))


def test_pages_of_a_pdf(spark, tmp_path):
    class Reader:
        def pages(self, content):
            return content.decode().split("|")

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "p.pdf").write_text("# One\nfirst page " + "a " * 200 + "|# Two\nsecond page " + "b " * 200)
    e = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16), pdf_reader=Reader())
    e.ingest(str(tmp_path / "docs"))
    assert [r.metadata for r in e.table("chunks").orderBy("chunk_index").collect()] == ['{"pages":[1]}', '{"pages":[2]}']


def test_paths_files_and_states(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), Settings(embed_dim=16))
    docs = [("/a.md", "markdown", "Alpha text about 10.9999/zz things."), ("/b.md", "markdown", "Beta text.")]
    e.ingest_documents(spark.createDataFrame(docs, "source_uri string, source_type string, text string"))
    one = e.register_paper("Alpha", ["Ann Bee"], 2020, path="/a.md")
    assert [r.doi for r in e.unmatched_dois().collect()] == ["10.9999/zz"]
    known = e.get_paper_paths(one).first().content_hash
    with pytest.raises(ValueError):
        e.relocate_paper("/a.md", "/c.md", "other")
    e.relocate_paper("/a.md", "/c.md", known)
    assert e.get_paper(one).first().paths == ["/c.md"] and e.table("chunks").where("source_uri = '/c.md'").count() == 1
    beta = e.table("chunks").where("source_uri = '/b.md'").first().chunk_id
    e.append("papers", spark.createDataFrame([(9, "Beta", beta)], "paper_id long, title string, abstract_chunk_id long"))
    assert e.backfill_paths() == 1 and e.get_paper_paths(9).first().path == "/b.md" and e.backfill_paths() == 0
    e.record_method("M", one)
    e.record_metric("f1", 0.5, one, method_id=1)
    assert [(r.name, r.value, r.method) for r in e.get_metrics(one).collect()] == [("f1", 0.5, "M")]
    e.save("jobs", e.table("jobs").withColumn("status", F.lit("running")))
    e.recover_jobs()
    assert {r.status for r in e.list_jobs().collect()} == {"pending"}
    e.create_embed_space("spare")
    e.deprecate_embed_space("spare")
    assert e.benchmark_spaces().count() == 0
    e.export_bibtex(str(tmp_path / "refs"), [one])
    assert spark.read.text(str(tmp_path / "refs")).where("value like '%Alpha%'").count() >= 1


def test_command_line(spark, tmp_path, capsys):
    from docloom.__main__ import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("Zebras run in herds.")
    store = ["--store", str(tmp_path / "store")]
    assert main([*store, "ingest", str(tmp_path / "docs")], spark) == 0
    main([*store, "search", "zebra", "--mode", "fts", "--keywords"], spark)
    main([*store, "configure", "chunk_strategy=semantic"], spark)
    main([*store, "status"], spark)
    out = capsys.readouterr().out
    assert "a.md" in out and "semantic" in out and "chunk_lengths" in out
    main([*store, "restore", "config", "1"], spark)
    main([*store, "vacuum", "config"], spark)
    main([*store, "jobs", "--limit", "1"], spark)
    main([*store, "migrate"], spark)
    main([*store, "reingest", str(tmp_path / "docs")], spark)
    spark.createDataFrame([(1, "https://e.org/p", "<p>Okapis live in the forests of the north and eat leaves.</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    main([*store, "ingest-pages", str(tmp_path / "pages")], spark)
    assert capsys.readouterr().out.split() == ["2", "[]", "0", "nothing", "to", "do", "1", "1"]


def test_settings(monkeypatch):
    monkeypatch.setenv("DOCLOOM_EMBED_DIM", "12")
    monkeypatch.setenv("DOCLOOM_CHUNK_STRATEGY", " ")
    assert resolved().embed_dim == 12 and resolved(embed_dim=5).embed_dim == 5 and resolved().chunk_strategy == "mechanical"
    with pytest.raises(ValueError):
        Settings(chunk_strategy="x")
