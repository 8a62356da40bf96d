"""Joins of boxes that lie in each other or overlap, by the cells of a grid of many levels.

A level's cells have a power of two as their side. A box belongs to the level whose cells are
as large as its larger side, or up to twice as large, so it touches four cells at most, however
large it is, and a page of any number of boxes is spread over its cells. Two boxes
can only meet in a cell of the larger one's level. Sides may be given in either order;
coordinates are finite, and a box with a null meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smaller boxes are put among those of this level.
LEAST_LEVEL = -20
SIDES = ("x1", "y1", "x2", "y2")


def _levelled(boxes: DataFrame) -> DataFrame:
    side = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return boxes.withColumn("level", F.greatest(F.coalesce(F.ceil(F.log2(side)), F.lit(LEAST_LEVEL)), F.lit(LEAST_LEVEL)).cast("int"))


def _cells(low: str, high: str, level: Column) -> Column:
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), level))
    return F.explode(F.sequence(cell(F.least(low, high)), cell(F.greatest(low, high))))


def _touched(boxes: DataFrame) -> DataFrame:
    """A row for each cell (cx, cy) of its level that a box touches."""
    whole = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in SIDES))
    return whole.withColumn("cx", _cells("x1", "x2", F.col("level"))).withColumn("cy", _cells("y1", "y2", F.col("level")))


def _levels(boxes: DataFrame) -> DataFrame:
    """(page, levels) that a page's boxes have; some dozens at most, as a number has no more exponents that occur."""
    return boxes.groupBy("page").agg(F.collect_set("level").alias("levels"))


def points_in(points: DataFrame, boxes: DataFrame, x: str, y: str) -> DataFrame:
    """Points (page, ...) with the boxes (page, x1, y1, x2, y2) of their page that hold (x, y), borders included; each pair once.

    The sides of a box come as rx1, ry1, rx2, ry2.
    """
    held = _levelled(boxes.select("page", *SIDES))
    cells = _touched(held).select("page", "level", "cx", "cy", *[F.col(c).alias(f"r{c}") for c in SIDES])
    cell = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("level")))
    placed = points.withColumns({"__x": F.expr(x), "__y": F.expr(y)}).join(_levels(held), "page").withColumn("level", F.explode("levels")).withColumns({"cx": cell("__x"), "cy": cell("__y")})
    inside = F.expr("__x BETWEEN rx1 AND rx2 AND __y BETWEEN ry1 AND ry2")
    return placed.join(cells, ["page", "level", "cx", "cy"]).where(inside).select(*points.columns, *[f"r{c}" for c in SIDES])


def _upwards(boxes: DataFrame, others: DataFrame, above: str) -> DataFrame:
    """Boxes at the levels of the page's other boxes that are ``above`` (> or >=) their own."""
    levels = F.filter("levels", lambda x: x > F.col("level") if above == ">" else x >= F.col("level"))
    return _touched(boxes.join(_levels(others), "page").withColumn("level", F.explode(levels)))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct boxes (page, x1, y1, x2, y2) of ``a`` that share more than a border with a box of ``b``."""
    a, b = (_levelled(df.select("page", *SIDES).distinct()) for df in (a, b))
    named = lambda df: df.select("page", "level", "cx", "cy", *[F.col(c).alias(f"z{c}") for c in SIDES])
    met = F.expr("x1 < zx2 AND zx1 < x2 AND y1 < zy2 AND zy1 < y2")
    keys = ["page", "level", "cx", "cy"]
    smaller = _upwards(a, b, ">=").join(named(_touched(b)), keys).where(met)
    larger = _touched(a).join(named(_upwards(b, a, ">")), keys).where(met)
    return smaller.select("page", *SIDES).unionByName(larger.select("page", *SIDES)).distinct()
