"""Inline images of pages: heads of images, where bytes come from, what a page that comes again keeps."""

import json
import struct

import pytest

from docloom.engine import Engine
from docloom.functions.images import sides
from docloom.operators import web_images

PAGES = "page_id long, url string, html string"
WORDS = "<article><p>" + "The picture shows how the rate of growth falls with depth. " * 8 + "</p></article>"


def png(width, height, more=b""):
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", width, height) + more


def jpeg(width, height):
    head = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF".ljust(14, b"\0")
    return head + b"\xff\xff\xc4" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, height, width)


class Marked:
    """Tells what stands behind the head of an image; fails at one."""

    def describe(self, image, prompt):
        text = image[24:].decode()
        if text == "fails":
            raise RuntimeError("no answer")
        return [{"description": t, "title": t.upper()} for t in text.split("|")]


def page(*images, words=WORDS):
    return "<html><body>" + words + "".join(f'<img src="/{i}.png" alt="{i}">' for i in images) + "</body></html>"


def urls(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "url string")


def test_sides():
    webp = b"RIFF\0\0\0\0WEBP"
    assert sides(png(640, 480)) == (640, 480)
    assert sides(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9)
    assert sides(b"BM".ljust(18, b"\0") + struct.pack("<ii", 30, -40)) == (30, 40)
    assert sides(jpeg(320, 200)) == (320, 200)
    assert sides(webp + b"VP8X".ljust(12, b"\0") + (99).to_bytes(3, "little") + (199).to_bytes(3, "little")) == (100, 200)
    assert sides(webp + b"VP8 ".ljust(14, b"\0") + struct.pack("<HH", 150, 120)) == (150, 120)
    assert sides(webp + b"VP8L".ljust(8, b"\0") + b"\x2f" + struct.pack("<I", 149 | 119 << 14)) == (150, 120)
    for broken in (b"", b"text", png(1, 2)[:20], jpeg(5, 5)[:-3], b"\xff\xd8\xff", webp + b"VP8L", webp):
        assert sides(broken) is None


@pytest.mark.parametrize("whole", [png(3, 4), jpeg(3, 4), b"BM".ljust(18, b"\0") + struct.pack("<ii", 3, 4)])
def test_every_cut_head_is_refused_or_read(whole):
    assert {sides(whole[:n]) for n in range(len(whole) + 1)} == {None, (3, 4)}


def test_sources_leave_out_large_and_missing(spark, tmp_path):
    asked = urls(spark, "https://e.org/a/x.png?v=1", "https://e.org/big.png", "https://e.org/none.png")
    (tmp_path / "e.org" / "a").mkdir(parents=True)
    (tmp_path / "e.org" / "a" / "x.png").write_bytes(b"12345")
    (tmp_path / "e.org" / "big.png").write_bytes(b"1" * 11)
    mirrored = web_images.MirroredImages(spark, str(tmp_path), 10).images(asked)
    assert [(r.url, bytes(r.image)) for r in mirrored.collect()] == [("https://e.org/a/x.png?v=1", b"12345")]
    kept = spark.createDataFrame([("https://e.org/big.png", b"1" * 11), ("https://e.org/none.png", b"1" * 10), ("other", b"1")], "url string, image binary")
    assert [r.url for r in web_images.ImageTable(kept, 10).images(asked).collect()] == ["https://e.org/none.png"]


class Web:
    """Leads to a private host, fails, has nothing, is too large, or gives the path."""

    def fetch(self, url, most):
        name = url.rsplit("/", 1)[1]
        if name == "fails":
            raise TimeoutError
        return {"private": ("http://127.0.0.1/x", b"1"), "none": None, "large": (url, b"1" * (most + 1))}.get(name, (url, name.encode()))


def test_fetched_images(spark):
    names = [f"https://e.org/{n}" for n in ("private", "fails", "none", "large", "good", "good")]
    got = web_images.FetchedImages(Web(), 10).images(urls(spark, *names)).collect()
    assert [(r.url, bytes(r.image)) for r in got] == [("https://e.org/good", b"good")]


def test_candidates_of_rendered_and_broken_pages(spark):
    rows = [
        (1, "https://e.org/p#x", page("a"), page("a", "b"), None),
        (2, "https://e.org/p", page("c"), page("c", "d"), "https://f.org/q/"),
        (3, "https://e.org/broken", "<p>x</p><![bad]><img src='m.png'><![CDATA[x]]>", None, None),
        (4, "https://e.org/none", None, None, None),
        (5, "https://e.org/odd", '<img src="http://[x/y.png"><img src="k.png">', None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES + ", rendered string, base_url string")
    got = {r.source_uri.rsplit("/", 1)[1]: r.images and [i.url for i in r.images] for r in web_images.wanted_images(pages).collect()}
    assert got == {"p": ["https://f.org/c.png", "https://f.org/d.png"], "broken": ["https://e.org/m.png"], "none": [], "odd": ["https://e.org/k.png"]}
    assert [len(r.images) for r in web_images.wanted_images(pages, 1).where("source_uri LIKE '%/p'").collect()] == [1]


def test_a_page_that_comes_again(spark, tmp_path):
    images = {n: png(200, 100, n.encode()) for n in ("one", "two|more", "fails")} | {"small": png(99, 500, b"small"), "torn": b"no image"}
    rows = [(f"https://e.org/{n.split('|')[0]}.png", image) for n, image in images.items()]
    source = web_images.ImageTable(spark.createDataFrame(rows, "url string, image binary"))
    e = Engine(spark, str(tmp_path / "store"), describer=Marked(), image_source=source)

    def after(*names, words=WORDS):
        e.ingest_pages(spark.createDataFrame([(1, "https://e.org/p", page(*names, words=words))], PAGES))
        rows = e.table("chunks").where("source_type = 'figure'").orderBy("chunk_index").collect()
        ids = {r.chunk_id for r in e.table("chunks").collect()}
        assert ids == {r.chunk_id for r in e.table("chunk_vec").collect()} == {r.chunk_id for r in e.table("chunk_lengths").collect()}
        return [(r.chunk_index, r.content) for r in rows]

    assert after("small", "torn", "one", "two") == [(2_000_000, "one"), (2_000_001, "two"), (2_000_002, "more")]
    meta = json.loads(e.table("chunks").where("content = 'more'").first().metadata)
    assert meta == {"figure_type": "web_image", "image_url": "https://e.org/two.png", "alt_text": "two", "original_source_type": "web", "source_url": "https://e.org/p", "vision_model": "none", "title": "MORE"}
    assert e.search_index("more", mode="fts").first().chunk_index == 2_000_002
    assert after("two") == [(2_000_000, "two"), (2_000_001, "more")]
    assert after("fails", "absent") == [(2_000_000, "two"), (2_000_001, "more")]  # what can't be had or told changes nothing
    assert after() == []
    # another page with the same picture adds no chunk of the same content
    assert after("one") == [(2_000_000, "one")]
    e.ingest_pages(spark.createDataFrame([(2, "https://e.org/q", page("one", words="<article><p>Other words.</p></article>"))], PAGES))
    assert e.table("chunks").where("content = 'one'").count() == 1
    # figures of a document's own pages lie in another range and stay
    assert e.table("chunks").where(web_images.is_inline()).count() == 1


def test_nothing_is_described_twice_and_nothing_breaks_on_empty_tables(spark):
    none, settled = web_images.inline_figures(spark.createDataFrame([], PAGES), web_images.ImageTable(spark.createDataFrame([], "url string, image binary")), Marked())
    assert none.count() == settled.count() == 0
    pages = spark.createDataFrame([(i, f"https://e.org/d/{i}", page("all")) for i in range(50)], PAGES)
    table = spark.createDataFrame([("https://e.org/all.png", png(100, 100, b"all"))], "url string, image binary")
    found, settled = web_images.inline_figures(pages, web_images.ImageTable(table), Marked())
    assert found.count() == settled.count() == 50
    assert {(r.chunk_index, r.content) for r in found.collect()} == {(2_000_000, "all")}


def test_a_failing_embedder_leaves_the_figures(spark, tmp_path):
    class Broken:
        dim = 64

        def embed(self, texts):
            raise RuntimeError("no vectors")

    table = spark.createDataFrame([(f"https://e.org/{n}.png", png(100, 100, n.encode())) for n in ("a", "b")], "url string, image binary")
    e = Engine(spark, str(tmp_path / "store"), describer=Marked(), image_source=web_images.ImageTable(table))
    e.ingest_pages(spark.createDataFrame([(1, "https://e.org/p", page("a"))], PAGES))
    e.embedder = Broken()
    with pytest.raises(Exception, match="no vectors"):
        e.ingest_pages(spark.createDataFrame([(1, "https://e.org/p", page("b"))], PAGES))
    assert [r.content for r in e.table("chunks").where(web_images.is_inline()).collect()] == ["a"]
