"""Inline images of web pages as figures: where their bytes come from, which are described, what a page's chunks become.

An image is fetched and described once, however many pages show it; what pages and
descriptions meet on are addresses and short texts, never bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.html import LEAST_SIDE, MOST_IMAGES, images_of, last_pages, public_host
from docloom.functions.images import sides
from docloom.functions.text import content_hash
from docloom.session import written
from docloom.sources.providers import Describer

# Chunk indexes of inline images, and the largest image that is read.
IMAGE_BASE, IMAGE_END = 2_000_000, 3_000_000
MOST_BYTES = 10 * 1024 * 1024
PROMPT = "Describe the picture of a web page: what it shows, as a list of figures with description and title."


class ImageSource(Protocol):
    """Bytes of images: (url) -> (url, image), without those that are missing or too large."""

    def images(self, urls: DataFrame) -> DataFrame: ...


class Fetcher(Protocol):
    """Gives (final address, bytes) of an address, none where it can't; it may stop behind ``most`` bytes."""

    def fetch(self, url: str, most: int) -> tuple[str, bytes] | None: ...


class ImageTable:
    """Images that a table (url, image) holds."""

    def __init__(self, table: DataFrame, most: int = MOST_BYTES):
        self.table, self.most = table, most

    def images(self, urls: DataFrame) -> DataFrame:
        small = self.table.where(F.octet_length("image") <= self.most).select("url", "image")
        return small.join(urls.select("url").distinct(), "url", "left_semi")


class MirroredImages:
    """Images of a mirror: the file of an address lies at ``folder``/host/path, without query and fragment.

    Sizes are known from the listing, so a file that is too large is never opened.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = MOST_BYTES):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def images(self, urls: DataFrame) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder).where(F.col("length") <= self.most)
        place = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[A-Za-z]+://", "")
        below = F.substring_index("path", f"{self.folder}/", -1)
        return files.select(below.alias("__at"), F.col("content").alias("image")).join(urls.select("url", place.alias("__at")).distinct(), "__at").select("url", "image")


class FetchedImages:
    """Images by a fetcher, each address once; an address that leads to a private host gives nothing, nor does one that fails."""

    def __init__(self, fetcher: Fetcher, most: int = MOST_BYTES):
        self.fetcher, self.most = fetcher, most

    def _fetched(self, url: str) -> bytes | None:
        try:
            got = self.fetcher.fetch(url, self.most)
        except Exception:  # any address may fail in any way, and takes nothing but its own image along
            return None
        if got is None or not public_host(got[0]) or len(got[1]) > self.most:
            return None
        return got[1]

    def images(self, urls: DataFrame) -> DataFrame:
        fetched = self._fetched

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for url in part["url"]:  # one image at a time in memory
                    if (image := fetched(url)) is not None:
                        yield pd.DataFrame([(url, image)], columns=["url", "image"])

        return urls.select("url").distinct().mapInPandas(run, "url string, image binary")


class SidesDescriber:
    """Says an image's kind, sides and size: an offline default that reads the bytes alone."""

    def describe(self, image: bytes, prompt: str) -> list[dict]:
        width, height = sides(image) or (0, 0)
        kind = next((name for head, name in ((b"\x89PNG", "PNG"), (b"GIF8", "GIF"), (b"BM", "BMP"), (b"\xff\xd8", "JPEG")) if image.startswith(head)), "WebP")
        return [{"description": f"{kind} image of {width} x {height} pixels, {len(image)} bytes", "title": ""}]


def told(images: DataFrame, describer: Describer, least: int = LEAST_SIDE) -> DataFrame:
    """(url, image) -> (url, k, description, title): figures of images whose sides are ``least`` pixels or more.

    An image whose head can't be read or at which the describer fails has none.
    """

    def figures(image: bytes) -> list[dict]:
        found = sides(image)
        if found is None or min(found) < least:
            return []
        try:
            return describer.describe(image, PROMPT)
        except Exception:  # a model may fail in any way at one image; the others go on
            return []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url, image in zip(part["url"], part["image"]):
                each = [f for f in figures(bytes(image)) if isinstance(f.get("description"), str) and f["description"].strip()]
                rows += [(url, k, f["description"].strip(), str(f.get("title") or "")) for k, f in enumerate(each)]
            yield pd.DataFrame(rows, columns=["url", "k", "description", "title"])

    return images.where("image is not null").select("url", "image").mapInPandas(run, "url string, k int, description string, title string")


def wanted_images(pages: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """(source_uri, images): up to ``most`` candidates (url, alt) of each page in order.

    ``pages`` has (page_id, url, html); a column ``rendered`` adds the images of the HTML after
    scripts have run, and ``base_url`` is where a redirected page was found. Of one URL the page
    with the largest id counts.
    """
    last = last_pages(pages)
    base = F.coalesce("base_url", "url") if "base_url" in pages.columns else F.col("url")
    seen = last.select("source_uri", images_of("html", base).alias("images"))
    if "rendered" in pages.columns:
        seen = last.select("source_uri", images_of("html", base).alias("first"), images_of("rendered", base).alias("more"))
        known = F.transform("first", lambda i: i["url"])
        seen = seen.select("source_uri", F.concat("first", F.filter("more", lambda i: ~F.array_contains(known, i["url"]))).alias("images"))
    return seen.select("source_uri", F.slice("images", 1, most).alias("images"))


def inline_figures(pages: DataFrame, source: ImageSource, describer: Describer, model: str = "none") -> tuple[DataFrame, DataFrame]:
    """(figures, settled): figures of pages' inline images, and the pages whose earlier ones go.

    ``figures`` has (source_uri, chunk_index, content, content_hash, metadata), indexes from
    IMAGE_BASE on in order of the page. Settled pages (source_uri) have a figure now, or no
    candidate at all; a page whose images can't be had or described keeps what it has.
    """
    found = written(wanted_images(pages), "images")
    wanted = found.select("source_uri", F.posexplode("images").alias("n", "i")).select("source_uri", "n", "i.url", "i.alt")
    shown = written(told(source.images(wanted.select("url").distinct()), describer), "told")
    place = F.row_number().over(Window.partitionBy("source_uri").orderBy("n", "k")) - 1
    meta = F.to_json(F.struct(
        F.lit("web_image").alias("figure_type"), F.col("url").alias("image_url"), F.col("alt").alias("alt_text"), F.lit("web").alias("original_source_type"),
        F.col("source_uri").alias("source_url"), F.lit(model).alias("vision_model"), "title",
    ))
    figures = wanted.join(shown, "url").select("source_uri", (F.lit(IMAGE_BASE) + place).alias("chunk_index"), F.col("description").alias("content"), content_hash("description").alias("content_hash"), meta.alias("metadata"))
    figures = written(figures, "figures")
    bare = found.where(F.size("images") == 0).select("source_uri")
    return figures, figures.select("source_uri").distinct().unionByName(bare)


def is_inline(index: Column | str = "chunk_index", kind: Column | str = "source_type") -> Column:
    """Whether a chunk is the figure of an inline image."""
    kind, index = (F.col(c) if isinstance(c, str) else c for c in (kind, index))
    return (kind == "figure") & (index >= IMAGE_BASE) & (index < IMAGE_END)
