"""File sources: recursive scans, type detection, text decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = ("pdf", "md", "txt", "typ", "rst")
# Source types by extension; others are markdown.
TYPES = {
    "pdf": ("pdf",),
    "code": ("py", "rs", "cpp", "c", "h", "hpp", "toml", "yaml", "yml", "json"),
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(path: Column | str) -> Column:
    out = F.lit("markdown")
    for kind, names in TYPES.items():
        out = F.when(extension(path).isin(list(names)), kind).otherwise(out)
    return out


def scan_directory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content, file_hash, source_type) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kept = files.where(extension("path").isin(list(extensions)))
    return kept.select("path", "content", F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"), source_type("path").alias("source_type"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 text; bytes that are none are replaced."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def text_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt", "typ", "rst")) -> DataFrame:
    """(source_uri, text, file_hash, source_type) of text files."""
    found = scan_directory(spark, folder, extensions)
    return found.select(F.col("path").alias("source_uri"), decoded("content").alias("text"), "file_hash", "source_type")


def pdf_documents(spark: SparkSession, folder: str, reader) -> DataFrame:
    """(source_uri, text, pages, file_hash, source_type) of PDFs by a reader of pages; ``pages`` maps offsets in the text to page numbers from 1."""

    @F.pandas_udf("text string, pages map<int,int>")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in content:
            parts = reader.pages(bytes(raw))
            starts = [sum(len(p) + 2 for p in parts[:i]) for i in range(len(parts))]
            rows.append(("\n\n".join(parts), {at: i + 1 for i, at in enumerate(starts)}))
        return pd.DataFrame(rows, columns=["text", "pages"])

    found = scan_directory(spark, folder, ("pdf",)).withColumn("r", read("content"))
    return found.select(F.col("path").alias("source_uri"), "r.text", "r.pages", "file_hash", "source_type")


def image_dir(path: Column | str, file_hash: Column | str) -> Column:
    """Folder name of a file's images: its stem, made safe and cut to 64 characters, and its hash."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_\-]", "_"), 1, 64), F.lit("_"), file_hash)


def unix_paths(path: Column | str) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
