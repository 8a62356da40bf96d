"""Products that come near to a square: what is shuffled and what meets in one task stays bounded."""

from docloom.operators import graph, ingest, stats


def test_citations_meet_in_blocks(spark, monkeypatch):
    """One surname and year that most texts cite and most papers have; two surnames of one paper give one proposal."""
    monkeypatch.setattr(graph, "CITED_BLOCK", 7)
    texts = [(i, "(Adams, 1991) and Brown (1991) too, 10.5555/p3" if i % 3 else "(Adams, 1991)") for i in range(40)]
    papers = [(i, f"title {i}", ["Adams, A.", "Bob Brown"] if i % 2 else ["Adams, A."], 1991, f"10.5555/p{i}") for i in range(30)]
    texts_df = spark.createDataFrame(texts, "paper_id long, content string")
    papers_df = spark.createDataFrame(papers, "paper_id long, title string, authors array<string>, year int, doi string")
    edges = spark.createDataFrame([(4, 5, "cites"), (4, 6, "extends")], "source_paper_id long, target_paper_id long, relation_type string")
    want = [(t, p, s) for t, _ in texts for p, *_ in papers if t != p for s in ("adams", "brown") if s == "adams" or (t % 3 and p % 2)]
    found = graph.author_year_matches(texts_df, papers_df)
    assert sorted((r.paper_id, r.target_paper_id, r.surname) for r in found.collect()) == sorted(want)
    proposed = sorted((r.paper_id, r.target_paper_id, r.match_method) for r in graph.suggest(texts_df, papers_df, edges).collect())
    assert proposed == sorted({(t, p, "doi" if t % 3 and p == 3 else "author_year") for t, p, _ in want} - {(4, 5, "author_year")})
    met = graph._met(texts_df.selectExpr("paper_id", "'adams' AS surname", "1991 AS year"), papers_df.selectExpr("paper_id AS target_paper_id", "'adams' AS surname", "year"))
    assert met.count() == 40 * 30 - 30
    joined = str(met._jdf.queryExecution().optimizedPlan())
    assert "pmod(xxhash64(paper_id" in joined and "pmod(xxhash64(target_paper_id" in joined


def test_sessions_of_any_size(spark, monkeypatch):
    """Small sessions, large ones over several blocks, and both: counts are those of all pairs."""
    monkeypatch.setattr(stats, "SESSION_BLOCK", 4)
    large = {s: range(s, 30, 1 + s % 3) for s in range(9)}
    small = {100 + s: (s, s + 1, 40 + s % 2) for s in range(20)}
    for sessions in (large, small, large | small):
        for most in (0, 5, 300):
            monkeypatch.setattr(stats, "SMALL_SESSION", most)
            each = spark.createDataFrame([(f"u{u}", s) for s, us in sessions.items() for u in us], "source_uri string, session_id int")
            counts = {}
            for us in sessions.values():
                names = sorted(f"u{u}" for u in us)
                for i, a in enumerate(names):
                    for b in names[i + 1 :]:
                        counts[a, b] = counts.get((a, b), 0) + 1
            got = {(r.uri_a, r.uri_b): r.co_sessions for r in stats.cooccurrence_of(each, 2).collect()}
            assert got == {k: n for k, n in counts.items() if n >= 2}


def test_documents_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    """What is shuffled does not grow with the square of the documents, and counted pairs are not shuffled at all."""
    monkeypatch.setattr(stats, "SESSION_BLOCK", 2)
    monkeypatch.setattr(stats, "SMALL_SESSION", 20)
    monkeypatch.setattr(stats, "SESSION_TILES", 3)
    monkeypatch.setattr(stats, "FEW_PAIRS", 3)
    monkeypatch.setattr(stats, "ROWS_OUT", 7)
    sent = []
    tiled = stats._tiled
    monkeypatch.setattr(stats, "_tiled", lambda packed, tiles: sent.append(tiled(packed, tiles)) or sent[-1])
    sessions = {1: range(60), 2: range(10, 50), 3: range(55, 70), 4: range(0, 60, 5), 5: (66, 67, 3), 6: (66, 67, 3), 7: (8, 9)}
    each = spark.createDataFrame([(f"u{u}", s) for s, us in sessions.items() for u in us], "source_uri string, session_id int")
    counts = {}
    for us in sessions.values():
        names = sorted(f"u{u}" for u in us)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                counts[a, b] = counts.get((a, b), 0) + 1
    for least in (1, 2, 3):
        found = stats.cooccurrence_of(each, least)
        assert sorted((r.uri_a, r.uri_b, r.co_sessions) for r in found.collect()) == sorted((*k, n) for k, n in counts.items() if n >= least)
        documents = sent[-1].select("source_uri").distinct().count()
        assert documents > 30
        assert sent[-1].count() <= documents * 3  # every tile with every tile, itself once
        assert "sum(co_sessions" not in str(found._jdf.queryExecution().optimizedPlan())


def test_names_are_looked_up_once_in_a_document(spark):
    """Many facts of one name and one document; a name ends where ``\\b`` says so."""
    named = [(i, "Brand#7" if i % 2 else "Brand#8", "/a") for i in range(50)] + [(90, "x7", "/a"), (91, "Brand#7", "/b"), (92, "Brand#9", "/a")]
    chunks = [(1, 5, "/a", "Brand#7"), (2, 3, "/a", "see Brand#7, Brand#8x"), (3, 9, "/a", "Brand#8"), (4, 1, "/a", "7 Brand 8 Brand#77"), (5, 7, "/a", "x7² y"), (6, 0, "/b", "Brand 7")]
    found = ingest.relinked(spark.createDataFrame(named, "id long, name string, source_uri string"), spark.createDataFrame(chunks, "chunk_id long, chunk_index long, source_uri string, content string"))
    assert {r.id: r.chunk_id for r in found.collect()} == {i: 2 if i % 2 else 3 for i in range(50)} | {90: 5}
