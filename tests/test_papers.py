import random

import pytest
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.operators import papers

PATHS = "paper_id long, path string, content_hash string"


def plain_moves(asked, paths):
    rows, known, out = set(asked), {}, set()
    for _, path, h in paths:
        known.setdefault(path, set()).add(h)
    right = set()
    for old, new, h in rows:
        if old is None or old not in known or new is None:
            out.add((old, new, "unknown"))
        elif h is None or h not in known[old]:
            out.add((old, new, "other"))
        else:
            right.add((old, new))
    least = {old: min(n for o, n in right if o == old) for old, _ in right}
    rest = {(o, n) for o, n in right if least[o] == n and n not in known}
    to = {new: min(o for o, n in rest if n == new) for _, new in rest}
    for old, new in right:
        status = "repeated" if least[old] != new else "taken" if new in known or to[new] != old else "moved"
        out.add((old, new, status))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_moves_equal_the_plain_ones(spark, seed):
    r = random.Random(seed)
    name = lambda n: r.choice([None, *map(str, range(n))])
    paths = [(i, str(r.randrange(12)), str(r.randrange(2))) for i in range(15)]
    asked = [(name(14), name(20), name(2)) for _ in range(80)]
    found = papers.moves(spark.createDataFrame(asked, "old string, new string, content_hash string"), spark.createDataFrame([*paths, (99, None, "0")], PATHS))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_moves(asked, paths)))


@pytest.mark.parametrize("seed", range(3))
def test_registrations_equal_the_plain_ones(spark, seed):
    r = random.Random(seed)
    asked = [(n, r.choice([None, *"abcdef"]), r.choice([None, *"pqrstu"])) for n in range(40)]
    held, owners = {"a", "b"}, {"p": 3}
    dois, taken, want = set(held), set(owners), []
    for n, doi, path in asked:
        status = "doi" if doi in dois else "added"
        dois |= {doi} - {None}
        free = status == "added" and path is not None and path not in taken
        taken |= {path} if free else set()
        want.append((n, status, owners.get(path), free))
    known = spark.createDataFrame([(3, "p", "h"), (7, "p", "h"), (8, None, "h")], PATHS)
    found = papers.registrations(spark.createDataFrame(asked, "n long, doi string, path string"), spark.createDataFrame([("a",), ("b",), (None,)], "doi string"), known)
    assert [tuple(x) for x in found.orderBy("n").select("n", "status", "path_owner", "path_free").collect()] == want


def test_engine_registers_and_moves_many(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    docs = [(f"/a/{i}.md", "markdown", f"# T{i}\nbody of {i}") for i in range(6)]
    e.ingest_documents(spark.createDataFrame(docs, "source_uri string, source_type string, text string"))
    asked = [(i, f"T{i}", "10.1/x" if i > 3 else None, f"/a/{i}.md" if i else None) for i in range(6)]
    asked = spark.createDataFrame(asked, "n long, title string, doi string, path string")
    done = {r.n: r for r in e.register_papers(asked).collect()}
    assert [done[i].status for i in range(6)] == ["added"] * 5 + ["doi"] and sorted(done[i].paper_id for i in range(5)) == [1, 2, 3, 4, 5]
    one = e.get_paper(done[1].paper_id).first()
    assert one.paths == ["/a/1.md"] and one.abstract_chunk_id == e.table("chunks").where("source_uri = '/a/1.md'").first().chunk_id
    assert e.list_jobs("pending").count() == 5 and e.paper_chunks().count() == 4
    assert {r.path_owner for r in e.register_papers(asked.where("n = 2")).collect()} == {done[2].paper_id}

    before = set(e.store.folders("chunk_vec"))
    hashes = e.file_hashes().where("source_uri in ('/a/1.md', '/a/2.md')")
    moves = hashes.select(F.col("source_uri").alias("old"), F.concat(F.lit("/b"), F.col("source_uri")).alias("new"), "content_hash")
    moves = moves.union(spark.createDataFrame([("/a/3.md", "/b/3.md", "other"), ("/none", "/b/4.md", "h")], moves.schema))
    assert {(r.old, r.status) for r in e.relocate_papers(moves).collect()} == {("/a/1.md", "moved"), ("/a/2.md", "moved"), ("/a/3.md", "other"), ("/none", "unknown")}
    assert {r.source_uri for r in e.table("chunks").collect()} == {"/a/0.md", "/a/3.md", "/a/4.md", "/a/5.md", "/b/a/1.md", "/b/a/2.md"}
    assert e.get_paper(done[2].paper_id).first().paths == ["/b/a/2.md"] and set(e.store.folders("chunk_vec")) == before
    assert {r.folder_path for r in e.table("folder_summaries").collect()} == {"/a", "/b/a"}
    assert e.file_hashes().count() == 6 and e.relocate_papers(moves).where("status = 'moved'").isEmpty()
