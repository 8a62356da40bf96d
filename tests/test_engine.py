"""Changes, facts, figures, sources and snapshots on small tables."""


import pytest
from pyspark.sql import functions as F

from docloom.functions import html
from docloom.operators import facts, figures, graph, ingest, mutate, stats
from docloom.sources import bibtex, files
from docloom.sources.providers import described
from docloom.sources.snapshots import Store


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.current("t") is None
    store.write("t", spark.range(3))
    store.write("t", store.read("t").where("id > 0"))  # from itself
    assert store.read("t").count() == 2 and store.read("t", 1).count() == 3
    store.restore("t", 1)
    assert store.current("t") == 3 and rows(store.report(["t"])) == [("t", 3, 2, 3)]
    assert store.vacuum("t") == [1] and store.versions("t") == [2, 3]


def test_appended_rows_and_deleted_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("t", spark.range(3))
    store.append("t", spark.range(3, 5).withColumn("more", F.lit("x")))
    assert rows(store.read("t")) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]
    kept = store.folders("t")[0]
    store.delete("t", spark.createDataFrame([(4,), (9,)], "id long"), "id")
    assert store.folders("t")[0] == kept and rows(store.read("t"), "id") == [(0,), (1,), (2,), (3,)]
    assert store.delete("t", spark.createDataFrame([(9,)], "id long"), "id") == store.current("t") == 3
    assert store.read("t", 2).count() == 5 and store.vacuum("t", 1) == [1, 2] and store.read("t").count() == 4


def test_ingest_chain(spark):
    docs = spark.createDataFrame([("/a/1.md", "same text"), ("/a/2.md", "same text"), ("/b/3.md", "other")], "source_uri string, text string")
    first = ingest.deduplicated(ingest.documents_to_chunks(docs))
    assert rows(first, "source_uri") == [("/a/1.md",), ("/b/3.md",)]
    keyed = ingest.numbered(first, ["source_uri", "chunk_index"], 10)
    assert rows(keyed, "chunk_id", "source_uri") == [(10, "/a/1.md"), (11, "/b/3.md")]
    again = spark.createDataFrame([("/b/3.md", "other now"), ("/b/3.md", "same text")], "source_uri string, text string")
    incoming = ingest.documents_to_chunks(again.limit(1))
    new = ingest.replaced(first, incoming, "/b/3.md")
    assert sorted(r.content for r in new.collect()) == ["other now", "same text"]


def test_sessions_survive_a_replacement(spark):
    links = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s1"), (3, "s9")], "chunk_id long, session_id string")
    old = spark.createDataFrame([(1, "/a"), (3, "/b")], "chunk_id long, source_uri string")
    new = spark.createDataFrame([(7, "/a"), (8, "/a"), (9, "/b")], "chunk_id long, source_uri string")
    assert rows(ingest.preserved_sessions(old, new, links)) == [(7, "s1"), (7, "s2"), (8, "s1"), (8, "s2"), (9, "s9")]


def test_names_find_whole_words(spark):
    named = spark.createDataFrame([(1, "BERT", "/a"), (2, "BERT large", "/a"), (3, "C++ (x", "/a"), (4, "BERT", "/b"), (5, "a\\Eb", "/a")], "id long, name string, source_uri string")
    texts = [(10, 0, "/a", "ROBERTSON bert"), (11, 1, "/a", "uses BERT."), (12, 2, "/a", "BERT large wins; C++ (x) a\\Eb"), (13, 0, "/b", "none")]
    chunks = spark.createDataFrame(texts, "chunk_id long, chunk_index int, source_uri string, content string")
    assert rows(ingest.relinked(named, chunks)) == [(1, 11), (2, 12), (3, 12), (5, 12)]


def test_ingest_report(spark):
    incoming = spark.createDataFrame([("/a",), ("/a",), ("/b",)], "source_uri string")
    files = spark.createDataFrame([("/a", "h1"), ("/b", "h2")], "source_uri string, content_hash string")
    paths = spark.createDataFrame([(7, "h2"), (8, "h1")], "paper_id long, content_hash string")
    assert rows(ingest.ingest_report(incoming, incoming.where("source_uri = '/a'").limit(1), files, paths)) == [("/a", 1, 1, None), ("/b", 0, 1, 7)]


def test_reference_repair(spark):
    t = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, chunk_id long")
    gone = spark.createDataFrame([(5,)], "chunk_id long")
    assert rows(mutate.nulled(t, "chunk_id", gone, "chunk_id")) == [(1, None), (2, 6), (3, None)]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (None, "m"), (2, "c")], "k long, v string")
    assert rows(mutate.upserted(old, new, ["k"])) == [(1, "b"), (2, "c"), (None, "m")]
    assert rows(mutate.inserted(old, new, ["k"])) == [(1, "a"), (2, "c"), (None, "n")]
    edge = spark.createDataFrame([(1, 2, "similar", 1.5)], "source_paper_id long, target_paper_id long, relation_type string, confidence double")
    with pytest.raises(Exception, match="confidence"):
        mutate.with_relationship(edge.limit(0), edge).collect()


def test_spaces_go_through_their_states(spark):
    spaces = mutate.space_created(spark.createDataFrame([], mutate.SPACES), "a", "m", "p", 8)
    chunks = spark.createDataFrame([(1, "mechanical"), (2, "mechanical")], "chunk_id long, chunk_strategy string")
    half = spark.createDataFrame([("a", 1)], "space string, chunk_id long")
    full = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "space string, chunk_id long")
    with pytest.raises(ValueError):
        mutate.space_promoted(spaces, mutate.space_progress(spaces, chunks, half), "a")
    spaces = mutate.space_promoted(spaces, mutate.space_progress(spaces, chunks, full), "a")
    spaces = mutate.space_created(spaces, "b", "m", "p", 4, base_dim=8)
    spaces = mutate.space_promoted(spaces, mutate.space_progress(spaces, chunks, full), "b")
    assert rows(spaces, "name", "status") == [("a", "deprecated"), ("b", "active")]
    with pytest.raises(ValueError):
        mutate.space_deprecated(spaces, "b")
    left, vectors = mutate.spaces_cleaned(spaces, full, "a")
    assert rows(left, "name") == [("b",)] and vectors.count() == 2
    with pytest.raises(ValueError):
        mutate.space_created(spaces, "c", "m", "p", 8, base_dim=8)


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "pending", "2024-01-02"), (2, "pending", "2024-01-01"), (3, "running", "2023-01-01")], "id long, status string, created_at string")
    assert rows(mutate.job_claimed(jobs), "id", "status") == [(1, "pending"), (2, "running"), (3, "running")]
    assert rows(mutate.jobs_recovered(jobs), "id", "status")[2] == (3, "pending")


def test_papers_and_paths(spark):
    schema = "paper_id long, path string, content_hash string, is_primary boolean, added_at timestamp"
    paths, taken = mutate.registered(None, spark.createDataFrame([], schema), 1, "/a", "h1")
    assert taken is None and rows(paths, "path", "is_primary") == [("/a", True)]
    same, taken = mutate.registered(None, paths, 2, "/a", "h1")
    assert taken == 1 and same.count() == 1


def test_pair_similarity_rules(spark):
    v = [(1, 10, [1.0, 0.0]), (1, 11, [0.9, 0.1]), (2, 20, [1.0, 0.0]), (2, 21, [2.0, 0.0]), (3, 10, [1.0, 0.0]), (4, 40, [0.0, 1.0]), (4, 41, [0.0, 0.0])]
    pairs = graph.pair_similarity(spark.createDataFrame(v, "paper_id long, chunk_id long, embedding array<float>"))
    found = {(r.paper_a, r.paper_b): r for r in pairs.collect()}
    assert (1, 3) not in found and found[1, 2].score == pytest.approx((1 + 1 + 0.993884) / 3, abs=1e-5) and found[1, 2].evidence_chunk_id == 10
    old = spark.createDataFrame([(1, 4, "similar", 0.9, None), (1, 4, "cites", 0.9, None)], "source_paper_id long, target_paper_id long, relation_type string, confidence double, evidence_chunk_id long")
    edges = graph.refreshed_edges(old, pairs)
    assert rows(edges, "source_paper_id", "target_paper_id", "relation_type") == [(1, 2, "similar"), (1, 4, "cites"), (2, 3, "similar")]


def test_chain_through_one(spark):
    links = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, None), (9, None)], "id long, superseded_by long")
    assert [r.id for r in graph.chain_of(links, 3).collect()] == [1, 3, 4]


def test_extraction(spark):
    answers = {"good": '<think>{"x"}</think> ```json\n{"methods": [{"name": " A\\u0001 ", "description": 3}, 5, {"name": " "}], "metrics": [{"metric": "f1", "value": "0.5"}, {"metric": "f1", "value": "nan"}]}\n```', "bad": "no", "list": "[1]"}
    chunks = spark.createDataFrame([(1, i, k) for i, k in enumerate(answers)], "paper_id long, chunk_id long, content string")
    found = facts.extract(chunks, lambda text: answers[text])
    assert rows(found, "kind", "name", "value") == [("method", "A", None), ("metric", "f1", 0.5)]
    with pytest.raises(ValueError):
        facts.validated({"methods": 3})
    assert facts.model_json("<think>so {not} [2] then {\"a\": 1} end</think>") == {"a": 1}


def test_resolution(spark):
    answer = '{"groups": [{"canonical": "BERT", "type": "method", "members": ["bert", " Bert-Base "]}, {"canonical": null, "members": ["x"]}, 3, {"canonical": "Q", "type": "odd", "members": "q"}]}'
    assert facts.resolution(answer) == [("method", "bert", "BERT"), ("method", "bert-base", "BERT")]
    found = spark.createDataFrame([(1, 10, "method", "bert", None, None)], "paper_id long, chunk_id long, kind string, name string, description string, surface_forms array<string>")
    assert rows(facts.resolved_groups(found, lambda prompt: answer)) == [("method", "bert", "BERT"), ("method", "bert-base", "BERT")]
    assert facts.resolved_groups(found, lambda prompt: 1 / 0).count() == 0
    chunks = spark.createDataFrame([(1, 11, 1, "b"), (1, 10, 0, "a"), (2, 20, 0, "x" * 9000)], "paper_id long, chunk_id long, chunk_index int, content string")
    assert rows(facts.whole_papers(chunks).selectExpr("paper_id", "chunk_id", "substring(content, 1, 4) AS c")) == [(1, 10, "a\n\nb"), (2, 20, "xxxx")]


def test_spaces_compared_with_few_results(spark):
    make = lambda ids: spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id long, rank int")
    r = stats.compare_spaces(make([1, 2, 3, 4, 5, 6]), make([6, 5, 4, 3, 2, 1]), "chunk_id", 10).first()
    assert (r.overlap, r.jaccard, r.rho) == (1.0, 1.0, -1.0)
    r = stats.compare_spaces(make([1, 2]), make([2, 3]), "chunk_id", 10).first()
    assert (r.overlap, round(r.jaccard, 6), r.rho) == (0.5, 0.333333, None)
    one = stats.batch_stats(stats.compare_spaces(make([1]), make([1]), "chunk_id", 10))
    assert {(m.measure, m.std) for m in one.collect()} == {("overlap", 0.0), ("jaccard", 0.0)}


def test_figures(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 0.1), (1, 0.6, 0.05, 0.7, 0.1), (1, 0.0, 0.6, 0.1, 0.5), (2, 0.1, 0.1, 0.2, 0.2)], "page int, x1 double, y1 double, x2 double, y2 double")
    found = figures.regions(boxes)
    assert rows(found) == [(1, 0.0, 0.0, 0.1, 0.1), (1, 0.0, 0.5, 0.1, 0.6), (1, 0.6, 0.05, 0.7, 0.1), (2, 0.0, 0.0, 1.0, 1.0)]
    assert figures.elements_in(boxes, found).count() == 4
    assert figures.outside(boxes, found.where("page = 1").limit(1)).count() == 3
    texts = spark.createDataFrame([("c", "d", None), (None, "d", ""), (None, None, None)], "a string, b string, c string")
    assert [r[0] for r in texts.select(figures.assembled("a", "b", "c")).collect()] == ["[Caption] c\n\n[Description] d", "d", ""]
    elements = spark.createDataFrame([(1, 0, "text", " Hello "), (1, 1, "text", "hello"), (1, 2, "icon", "Save"), (1, 3, "text", "x"), (2, 0, "text", "y" * 600)], "k int, pos int, type string, content string")
    got = {r.k: r.ocr for r in figures.ocr_text(elements, "k").collect()}
    assert got[1] == 'Detected text: "Hello"\nDetected elements: "Save"' and len(got[2]) == 500 and got[2].endswith("…")


def test_html():
    assert html.best_source("a.png 1x, b.png 2x", "s.png") == "b.png" and html.best_source("a.png 1x", "s.png") == "s.png"
    assert html.best_source("a.png 100w, b.png 300w, c.svg 900w, d.png 9x") == "b.png" and html.best_source("data:x") is None and html.best_source("a, b") == "b"
    page = '<img src="a.png" width="50" height="200"><img src="a.png"><img src="/a.png"><img src="http://10.0.0.1/x.png"><img src="/site/logo.png" ><img alt="an icon" src="i.png"><picture><source media="x" srcset="m.png"><source srcset="n.png 1x, o.png 2x"><img src="p.png"></picture>'
    assert [c["url"] for c in html.image_candidates(page, "https://e.org/")] == ["https://e.org/a.png", "https://e.org/o.png"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "sub" / "b.TXT").write_text("two")
    (tmp_path / "c.bin").write_bytes(b"x")
    found = files.text_files(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in found) == ["ok \ufffd", "two"] and all(len(r.file_hash) == 16 for r in found)
    path = spark.createDataFrame([("/x/My file.PDF", "h" * 16)], "p string, h string")
    assert path.select(files.source_type("p").alias("t"), files.image_dir("p", "h").alias("d")).first() == ("pdf", "My_file_" + "h" * 16)


def test_bibtex(spark, tmp_path):
    papers = spark.createDataFrame(
        [(1, "T", ["Ann Lee"], 2020, None, None, None), (2, "U", ["Lee, Bo"], 2020, "V", "10.1/x", None), (3, "W", [], None, None, None, "@misc{own, title={W}}"), (4, "X", ["Lee"], 2020, None, None, None)],
        "paper_id long, title string, authors array<string>, year int, venue string, doi string, bibtex string",
    )
    found = bibtex.entries(papers)
    assert rows(found, "paper_id", "key") == [(1, "lee2020"), (2, "lee2020a"), (3, "own"), (4, "lee2020b")]
    bibtex.export(found.where("paper_id < 3"), str(tmp_path / "bib"))
    lines = spark.read.text(str(tmp_path / "bib"))
    assert rows(bibtex.missing_entries(found, lines), "paper_id") == [(3,), (4,)]
    entry = found.where("paper_id = 2").first().entry
    assert "  doi = {10.1/x}," in entry and entry.endswith("}") and "  journal = {V}," in entry


def test_descriptions(spark):
    class Model:
        def describe(self, image, prompt):
            return [{"description": image.decode()}, {"description": " "}, {}]

    images = spark.createDataFrame([(1, b"x")], "k long, image binary")
    assert rows(described(images, Model())) == [(1, 0, "x")]
