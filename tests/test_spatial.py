"""Joins of boxes by cells of a grid, and of lines by bands, against plain products."""

import random
import re
import time

from pyspark.sql import functions as F

from docloom.operators import figures, spatial

BOX = "page int, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, n, pages=3):
    """Boxes of all sizes, also none, turned over, outside the unit square, repeated, and with nulls."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w, h = (r.choice([0.0, 10 ** r.uniform(-8, 1), 10 ** r.uniform(-1, 0.3), 10 ** r.uniform(-1, 0.3), 0.25]) for _ in "wh")
        x, y = (r.choice([r.uniform(-2, 2), 0.25 * r.randrange(-4, 5)]) for _ in "xy")
        box = [x, y, x + w, y + h]
        if r.random() < 0.2:
            box = [box[2], box[3], box[0], box[1]]
        if r.random() < 0.05:
            box[r.randrange(4)] = None
        out.append((r.choice([None, *range(pages)]), *box))
    return out + out[:5]


def test_points_and_overlaps_equal_the_product(spark):
    for seed in (1, 2):
        a, b = boxes(seed, 250), boxes(seed + 10, 40)
        full = lambda p, q: p[0] is not None and p[0] == q[0] and None not in p and None not in q
        held = lambda p, q: full(p, q) and q[1] <= (p[1] + p[3]) / 2 <= q[3] and q[2] <= (p[2] + p[4]) / 2 <= q[4]
        meets = lambda p, q: full(p, q) and p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
        da, db = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
        # a box with a null still has a centre on the other axis, but no pair needs it
        whole = da.where(" AND ".join(f"{c} IS NOT NULL" for c in spatial.SIDES))
        got = [tuple(r) for r in figures.elements_in(whole, db).collect()]
        assert sorted(got) == sorted((*p, *q[1:]) for p in a for q in b if held(p, q)) and len(got) > 5
        key = lambda rows: sorted(rows, key=repr)
        free = [p for p in a if not any(meets(p, q) for q in b)]
        assert key(tuple(r) for r in figures.outside(da, db).collect()) == key(free) and 20 < len(free) < len(a) - 20


def test_empty_sides_and_other_columns(spark):
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], BOX).withColumn("level", F.lit("own")).withColumn("cx", F.lit("too"))
    none = some.limit(0)
    assert figures.elements_in(some, none).isEmpty() and figures.elements_in(none, some).isEmpty()
    assert figures.outside(some, none).count() == 1 and figures.outside(none, some).isEmpty()


def test_a_page_of_very_many_boxes(spark):
    """10^5 boxes against 2 x 10^4 on one page: a product would be 2 x 10^9 pairs."""
    grid = lambda n, side, step: spark.range(n).selectExpr("1 AS page", f"(id % 400) * {step} AS x1", f"(id div 400) * {step} AS y1", f"(id % 400) * {step} + {side} AS x2", f"(id div 400) * {step} + {side} AS y2")
    small, zones = grid(100_000, "0.4D", "1D"), grid(20_000, "1.1D", "2D")
    start = time.time()
    assert figures.elements_in(small, zones).count() == sum(1 for i in range(100_000) if i % 400 % 2 == 0 and i // 400 % 2 == 0 and i // 400 // 2 < 50)
    hit = lambda at, n: any(at < 2 * z + 1.1 and 2 * z < at + 0.4 for z in range(n))  # noqa: E731  # axis by axis
    columns, lines = [hit(i, 400) for i in range(400)], [hit(i, 50) for i in range(250)]
    assert figures.outside(small, zones).count() == 100_000 - sum(columns) * sum(lines) == 60_000
    assert time.time() - start < 120


def test_captions_by_bands_equal_the_product(spark):
    r = random.Random(5)
    rows = []
    for chunk in range(40):
        lines = [r.choice(["text", "![a](x/%d.png)" % r.randrange(12), "Figure %d shows" % r.randrange(99), " table 3 ", "![b](1.png) Fig. 2"]) for _ in range(r.randrange(40))]
        rows.append((f"/d{chunk % 5}", chunk, "\n".join(lines)))
    best = {}
    for uri, chunk, content in rows:
        lines = content.split("\n")
        for at, line in enumerate(lines):
            for ref in re.findall(figures.IMAGE_REF, line):
                for i, text in enumerate(lines):
                    if 0 < abs(i - at) <= 3 and re.search(figures.CAPTION, text):
                        key = (uri, ref.rsplit("/", 1)[-1])
                        best[key] = min(best.get(key, (1e9,)), (chunk, at, i, text.strip(" ")))
    got = {(x.source_uri, x.image): x.caption for x in figures.image_captions(spark.createDataFrame(rows, "source_uri string, chunk_id long, content string")).collect()}
    assert got == {k: v[3] for k, v in best.items()} and len(got) > 20
