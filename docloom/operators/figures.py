"""Figures: regions by gap clustering, captions near images, page features, assembled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import spatial

# Caption lines and image references of extracted markdown.
CAPTION = r"(?i)(?:Figure|Fig\.|Table)\s+\d+"
IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"
CAPTION_LINES, OCR_CHARS, DRAWINGS = 3, 500, 10
GAP = 0.15


def regions(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """(page, x1, y1, x2, y2): bounding boxes of groups of boxes, cut where a gap of at least ``gap`` opens, by y and then by x.

    A page with fewer than two boxes, or one group, is one region of the whole page.
    """
    b = boxes.select("page", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))

    def cut(df: DataFrame, by: list[str], low: str, high: str, out: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.expr(f"({low} + {high}) / 2"), "x1", "y1", "x2", "y2")
        jump = (F.col(low) - F.lag(high).over(order) >= gap).cast("int")
        return df.withColumn("jump", F.coalesce(jump, F.lit(0))).withColumn(out, F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")

    grouped = cut(cut(b, ["page"], "y1", "y2", "row"), ["page", "row"], "x1", "x2", "cell")
    found = grouped.groupBy("page", "row", "cell").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    alone = F.count("*").over(Window.partitionBy("page")) < 2
    whole = {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}
    return found.withColumn("alone", alone).select("page", *[F.when(F.col("alone"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in whole.items()])


#: Least gap between elements of two figures of a picture, and the margin of a cut-out figure.
ELEMENT_GAP, MARGIN = 0.08, 0.02


def padded(regions_: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Regions with a margin of a share of their sides, within the page."""
    grown = lambda low, high, sign: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(high if sign > 0 else low) + sign * margin * (F.col(high) - F.col(low))))
    return regions_.select("page", grown("x1", "x2", -1).alias("x1"), grown("y1", "y2", -1).alias("y1"), grown("x1", "x2", 1).alias("x2"), grown("y1", "y2", 1).alias("y2"))


def figure_texts(images: DataFrame, captions: DataFrame, descriptions: DataFrame, ocr: DataFrame) -> DataFrame:
    """(image, page, figure, text): one figure for each description of an image, or one for an image with a caption or texts only.

    ``images`` has (image, page), ``captions`` (image, caption), ``descriptions`` (image, n,
    description) and ``ocr`` (image, ocr). Figures are numbered within their page, by image.
    """
    each = images.select("image", "page").join(descriptions, "image", "left").join(captions.select("image", "caption"), "image", "left").join(ocr, "image", "left")
    told = each.withColumn("text", assembled("caption", "description", "ocr")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy("page").orderBy("image", "n")) - 1
    return told.select("image", "page", order.alias("figure"), "text")


def in_pages(index: str, pages: list[int]) -> Column:
    """Whether a chunk index is that of a figure of one of the pages: one range for each."""
    from docloom.operators.ingest import FIGURE_BASE, FIGURES_PER_PAGE  # ingest imports search, which is not needed here

    out = F.lit(False)
    for page in pages:
        first = FIGURE_BASE + page * FIGURES_PER_PAGE
        out = out | F.col(index).between(first, first + FIGURES_PER_PAGE - 1)
    return out


def elements_in(elements: DataFrame, regions_: DataFrame) -> DataFrame:
    """Elements whose centre lies in a region of their page, with the region's sides; they meet by cells of a grid."""
    return spatial.points_in(elements, regions_, "(x1 + x2) / 2", "(y1 + y2) / 2")


def outside(rects: DataFrame, zones: DataFrame) -> DataFrame:
    """Rectangles that overlap no zone of their page; they meet by cells of a grid."""
    return rects.join(spatial.overlapping(rects, zones), ["page", *spatial.SIDES], "left_anti").select(rects.columns)


def image_captions(chunks: DataFrame) -> DataFrame:
    """(source_uri, image, caption): the first caption line within three lines of an image reference, of the first reference that has one.

    Lines meet by bands as wide as a reference can see: a caption lies in one of them, a
    reference looks into two at most.
    """
    lines = chunks.select("source_uri", "chunk_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    images = lines.select("source_uri", "chunk_id", F.col("line").alias("at"), F.explode(F.regexp_extract_all("text", F.lit(IMAGE_REF), F.lit(1))).alias("ref")).withColumn("image", F.substring_index("ref", "/", -1))
    captions = lines.where(F.col("text").rlike(CAPTION)).select("source_uri", "chunk_id", "line", F.trim("text").alias("caption"))
    band = lambda line: F.floor(line / (2 * CAPTION_LINES + 1))
    images = images.withColumn("band", F.explode(F.sequence(band(F.col("at") - CAPTION_LINES), band(F.col("at") + CAPTION_LINES))))
    near = images.join(captions.withColumn("band", band(F.col("line"))), ["source_uri", "chunk_id", "band"])
    near = near.where((F.abs(F.col("line") - F.col("at")) <= CAPTION_LINES) & (F.col("line") != F.col("at")))
    first = near.groupBy("source_uri", "image").agg(F.min(F.struct("chunk_id", "at", "line", "caption")).alias("first"))
    return first.select("source_uri", "image", "first.caption")


def page_captions(chunks: DataFrame) -> DataFrame:
    """(source_uri, page, captions): distinct caption lines for each page of their chunk, pages from 0."""
    lines = chunks.select("source_uri", "pages", F.explode(F.split("content", "\n")).alias("text")).where(F.col("text").rlike(CAPTION))
    return lines.select("source_uri", F.explode(F.transform("pages", lambda p: p - 1)).alias("page"), F.trim("text").alias("caption")).groupBy("source_uri", "page").agg(F.array_sort(F.collect_set("caption")).alias("captions"))


def image_pages(chunks: DataFrame) -> DataFrame:
    """(source_uri, image, page): the earliest page of each image, from chunk metadata (images, pages); page 1 without pages."""
    first = F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(1))
    return chunks.select("source_uri", F.explode("images").alias("image"), first.alias("page")).groupBy("source_uri", "image").agg(F.min("page").alias("page"))


def figure_pages(pages: DataFrame) -> DataFrame:
    """Pages that likely hold figures: images, many drawings, half the mean text or less, or a caption; all pages if none does.

    ``pages`` has (source_uri, page, n_images, n_drawings, text_len, has_caption).
    """
    of = Window.partitionBy("source_uri")
    mean = F.avg("text_len").over(of)
    likely = (F.col("n_images") > 0) | (F.col("n_drawings") > DRAWINGS) | ((mean > 0) & (F.col("text_len") < mean * 0.5)) | F.col("has_caption")
    marked = pages.withColumn("likely", likely.cast("int"))
    return marked.withColumn("any", F.max("likely").over(of)).where("likely = 1 OR any = 0").select("source_uri", "page")


def vector_pages(pages: DataFrame) -> DataFrame:
    """Pages with many drawings and no extracted image."""
    return pages.where((F.col("n_drawings") > DRAWINGS) & (F.col("n_images") == 0)).select("source_uri", "page")


def assembled(caption: str, description: str, ocr: str) -> Column:
    """A figure's text: its layers, marked if there are two or more."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lit(m).alias("m"), F.col(c).alias("t"))) for m, c in (("[Caption]", caption), ("[Description]", description), ("[OCR]", ocr))]
    live = F.filter(F.array(*parts), lambda x: x.isNotNull())
    marked = F.array_join(F.transform(live, lambda x: F.concat(x["m"], F.lit(" "), x["t"])), "\n\n")
    return F.when(F.size(live) == 0, "").when(F.size(live) == 1, F.element_at(live, 1)["t"]).otherwise(marked)


def ocr_text(elements: DataFrame, key: str) -> DataFrame:
    """(key, ocr): recognised texts and elements of a figure, each once letter case aside, in order, within 500 characters.

    ``elements`` has (key, pos, type, content).
    """
    kept = elements.withColumn("content", F.trim("content")).where(F.length("content") >= 2)
    first = F.row_number().over(Window.partitionBy(key, F.lower("content")).orderBy("pos"))
    kept = kept.withColumn("n", first).where("n = 1").withColumn("quoted", F.concat(F.lit('"'), "content", F.lit('"')))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "quoted")))), lambda x: x["quoted"])
    both = kept.groupBy(key).agg(listed(F.col("type") == "text").alias("texts"), listed(F.col("type") != "text").alias("icons"))
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    cut = lambda c, most: F.when(F.length(c) > most, F.concat(F.substring(c, F.lit(1), most - 1), F.lit("…"))).otherwise(c)
    both = both.withColumn("a", cut(line("Detected text: ", "texts"), F.lit(OCR_CHARS)))
    left = F.lit(OCR_CHARS) - F.coalesce(F.length("a"), F.lit(0))
    both = both.withColumn("b", F.when(left > 20, cut(line("Detected elements: ", "icons"), left)))
    return both.select(key, F.concat_ws("\n", "a", "b").alias("ocr"))
