"""Papers and their files: registering and moving many at once, chunks of papers, papers as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_first(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Rows with whether they are the first of their key; null keys have no first."""
    firsts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__least"))
    return rows.join(firsts, key, "left").withColumn(out, F.coalesce(F.struct(*order) == F.col("__least"), F.lit(False))).drop("__least")


def registrations(asked: DataFrame, papers: DataFrame, paths: DataFrame) -> DataFrame:
    """``asked`` (n, doi, path, ...), n unique and not null, with status, path_owner and path_free.

    A paper is refused (status ``doi``) if a paper or a row of smaller n has its DOI; all others
    are ``added``. A path belongs to the first that names it: ``path_owner`` is the registered
    paper that has it, and ``path_free`` holds for the added row that gets it. Null DOIs and paths
    never meet.
    """
    held = papers.where("doi is not null").select("doi").distinct().withColumn("__held", F.lit(True))
    owners = paths.where("path is not null").groupBy("path").agg(F.min("paper_id").alias("path_owner"))
    rows = _with_first(asked, "doi", ["n"], "__first").join(held, "doi", "left")
    refused = F.col("doi").isNotNull() & (F.coalesce("__held", F.lit(False)) | ~F.col("__first"))
    rows = rows.withColumn("status", F.when(refused, "doi").otherwise("added"))
    rows = _with_first(rows.withColumn("__path", F.when(F.col("status") == "added", F.col("path"))), "__path", ["n"], "__first").join(owners, "path", "left")
    return rows.withColumn("path_free", F.col("__first") & F.col("path_owner").isNull()).select(*asked.columns, "status", "path_owner", "path_free")


def moves(asked: DataFrame, paths: DataFrame) -> DataFrame:
    """(old, new, status) of asked moves (old, new, content_hash) of registered files.

    ``unknown``: no such path, or a null place; ``other``: the file at the new place has another
    hash; ``repeated``: the same file is asked to a smaller place too; ``taken``: a path is
    registered there, or a smaller one of the other files goes there. All others are ``moved``.
    Equal rows count once.
    """
    known = paths.where("path is not null").groupBy("path").agg(F.collect_set("content_hash").alias("__hashes"))
    there = known.select(F.col("path").alias("new"), F.lit(True).alias("__there"))
    rows = asked.select("old", "new", "content_hash").distinct().join(known.withColumnRenamed("path", "old"), "old", "left").join(there, "new", "left")
    same = F.coalesce(F.array_contains("__hashes", F.col("content_hash")), F.lit(False))
    rows = rows.withColumn("status", F.when(F.col("__hashes").isNull() | F.col("new").isNull(), "unknown").when(~same, "other"))
    wrong, right = rows.where("status is not null"), rows.where("status is null")
    right = _with_first(right, "old", ["new"], "__one").withColumn("status", F.when(~F.col("__one"), "repeated").when(F.col("__there"), "taken"))
    right = _with_first(right.withColumn("__to", F.when(F.col("status").isNull(), F.col("new"))), "__to", ["old"], "__one")
    last = right.withColumn("status", F.coalesce("status", F.when(F.col("__one"), "moved").otherwise("taken")))
    return wrong.select("old", "new", "status").unionByName(last.select("old", "new", "status")).distinct()


def moved(rows: DataFrame, column: str, done: DataFrame) -> DataFrame:
    """Rows of moved files (old, new) alone, with their new place in ``column``."""
    at = done.select(F.col("old").alias(column), F.col("new").alias("__new"))
    return rows.join(at, column).withColumn(column, F.col("__new")).drop("__new").select(*rows.columns)


def paper_chunks(papers: DataFrame, paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, content, chunk_index): chunks of the papers' files but figures; of papers without one, the abstract."""
    chunks, columns = chunks.where("source_type <> 'figure'"), ["paper_id", "chunk_id", "content", "chunk_index"]
    by_path = paths.select("paper_id", F.col("path").alias("source_uri")).join(chunks, "source_uri")
    bare = papers.join(by_path.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.col("abstract_chunk_id").alias("chunk_id"))
    return by_path.select(*columns).unionByName(bare.join(chunks, "chunk_id").select(*columns))
