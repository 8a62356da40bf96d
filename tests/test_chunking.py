import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions import chunking as C
from tests import plain_chunks as P


@pytest.mark.parametrize("n, windows", [(0, 0), (1, 1), (999, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3), (2600, 3)])
def test_window_counts(spark, n, windows):
    assert len(C.chunk_text("x" * n)) == windows
    df = spark.createDataFrame([(1, "x" * n)], "k int, text string")
    assert C.chunk_windows(df, "k").count() == windows


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n", max_size=80), st.integers(-1, 20), st.integers(0, 25))
def test_windows_cover_the_text(text, size, overlap):
    chunks = C.chunk_text(text, size, overlap)
    assert all(c.strip() for c in chunks)
    size, overlap = C._sizes(size, overlap)
    start, want = 0, []
    while True:
        want.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    assert chunks == [w for w in want if w.strip()]


def test_blank_windows_are_dropped_before_numbering(spark):
    text = "a" * 8 + " " * 20 + "b" * 4
    rows = C.chunk_windows(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "k int, text string"), "k", size=8, overlap=0).orderBy("chunk_index").collect()
    assert [(r.k, r.chunk_index, r.content) for r in rows] == [(1, 0, "a" * 8), (1, 1, "    bbbb")]
    assert C.chunk_text(text, 8, 0) == ["a" * 8, "    bbbb"]


def test_markdown_sections_merge_only_with_deeper_ones():
    text = "intro\n# A\none\n## B\ntwo\n# C\nthree\n"
    assert [t for t, _ in P.chunk_markdown(text)] == ["intro", "# A\none\n## B\ntwo", "# C\nthree"]


def test_markdown_keeps_tables_whole_and_the_heading_once():
    table = "\n".join(f"| a{i} | b{i} |" for i in range(120))
    text = f"# Long\n{'prose ' * 250}\n{table}\nend"
    chunks = [t for t, _ in P.chunk_markdown(text)]
    assert chunks[0].startswith("# Long\nprose") and sum("# Long" in c for c in chunks) == 1
    assert table in chunks and chunks[-1] == "end"


def test_pages_and_images():
    text = "# A\n" + "x" * 300 + "\n# B\n![f](/tmp/dir/f.png) " + "y" * 300
    chunks = P.chunk_markdown(text, pages={0: 1, 310: 2})
    assert [p for _, p in chunks] == [[1], [1, 2]] or [p for _, p in chunks] == [[1], [2]]
    assert "![f](f.png)" in chunks[1][0]
    assert P.pages_of(0, 5, [10, 20], {10: 1, 20: 2}) == []
    assert P.pages_of(12, 25, [10, 20], {10: 1, 20: 2}) == [1, 2]


def test_sections():
    text = "# T\n\n## U\nbody\n\n## V\n" + ("para " * 300 + "\n\n") * 8
    chunks = [t for t, _ in P.chunk_sections(text)]
    assert chunks[0] == "## U\nbody" and len(chunks) == 3 and all(len(c) <= 8000 for c in chunks)
    assert [t for t, _ in P.chunk_sections("no heading")] == ["no heading"]
    deep = "## A\n### x\n" + "q" * 5000 + "\n### y\n" + "r" * 5000
    assert [t[:5] for t, _ in P.chunk_sections(deep)] == ["### x", "### y"]


def test_python_source():
    source = "import os\n\ndef f():\n    return 1\n\nclass A:\n    x = 1\ny = 2\n"
    assert [(c["name"], c["type"], c["start_line"], c["end_line"]) for c in C.chunk_python(source)] == [("<module>", "module", 1, 8), ("f", "function", 3, 4), ("A", "class", 6, 7)]
    assert C.chunk_python("def (") == [] and C.chunk_python(" ") == []
    long = "def g():\n" + "".join(f"    a{i} = {i}\n" for i in range(200))
    assert [c["name"] for c in C.chunk_python(long)][:2] == ["g[0]", "g[1]"]


def native(spark, texts, chunker, *more, pages=None):
    rows = [(i, t, pages) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, text string, pages map<int, int>").select("k", chunker("text", "pages", *more).alias("c"))
    found = {r.k: [(c.text, c.pages) for c in r.c] for r in df.collect()}
    return [found[i] for i in range(len(texts))]


PARTS = ["# A", "## B", "### C", "####### no", "#none", "|x|y|", "|x", "| |", "", "", "", " ", "\u00a0", "ab", "é𝄞 wörd " * 3, "![a b](x/y/z.png) t", "q" * 30, "\r", "a\x1c", " # late", "## "]
LINES = st.lists(st.sampled_from(PARTS), max_size=60).map("\n".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(LINES, min_size=20, max_size=40), st.integers(8, 90), st.integers(0, 30), st.dictionaries(st.integers(0, 300), st.integers(1, 9), max_size=6))
def test_expressions_equal_the_plain_chunkers(spark, texts, size, overlap, pages):
    for pages in (pages, None):
        assert native(spark, texts, C.markdown_chunks, size, overlap, pages=pages) == [P.chunk_markdown(t, size, overlap, pages) for t in texts]
        assert native(spark, texts, C.section_chunks, size, pages=pages) == [P.chunk_sections(t, size, pages) for t in texts]


def test_many_sections_long_runs_and_missing_texts(spark):
    hostile = ["# \n" * 60_000, "|a|\n" * 60_000, "x\n\n" * 60_000, " " * 200_000 + "x", "# h\n" + "\n".join(["|t|", "p"] * 20_000), None, "", " \n", "w " * 500_000]
    for native_one, plain in ((C.markdown_chunks, P.chunk_markdown), (C.section_chunks, P.chunk_sections)):
        assert native(spark, hostile, native_one) == [plain(t or "") for t in hostile]
    numbered = C.chunk_structured(spark.createDataFrame([(1, "# A\nx", "e")], "k int, text string, chunk_index string").drop("chunk_index"), "k", "text", C.markdown_chunks)
    assert [tuple(r) for r in numbered.collect()] == [(1, 0, "# A\nx", [])]
