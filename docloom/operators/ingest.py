"""From documents to chunks: deduplication, folders, sessions, the ingest and replace pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.chunking import chunk_windows
from docloom.functions.text import content_hash
from docloom.operators.retrieval import parent_folder
from docloom.session import written

FIGURE_BASE, FIGURES_PER_PAGE = 1_000_000, 1_000
SNIPPET = 200


def documents_to_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(source_uri, chunk_index, content, content_hash) of (source_uri, text)."""
    return chunk_windows(docs, "source_uri", "text", size, overlap).withColumn("content_hash", content_hash("content"))


def deduplicated(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content hash, over all documents, in order of uri and index.

    Grouped with a partial minimum, so a text that a third of all chunks share costs no more
    than any other.
    """
    first = chunks.groupBy("content_hash").agg(F.min(F.struct("source_uri", "chunk_index")).alias("f"))
    return chunks.join(first, "content_hash").where((F.col("source_uri") == F.col("f.source_uri")) & (F.col("chunk_index") == F.col("f.chunk_index"))).drop("f")


def new_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming chunks whose content is not there yet."""
    return deduplicated(incoming).join(existing.select("content_hash"), "content_hash", "left_anti")


def duplicate_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_uri, duplicate_of_paper_id): files whose hash a registered path has."""
    known = paths.groupBy("content_hash").agg(F.min("paper_id").alias("duplicate_of_paper_id"))
    return files.join(known, "content_hash").select("source_uri", "duplicate_of_paper_id")


def folder_hash(chunks: DataFrame) -> DataFrame:
    """(folder_path, content_hash): 16 hex digits over the sorted distinct hashes of a folder's direct children."""
    return chunks.groupBy(parent_folder().alias("folder_path")).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set("content_hash")), "|"), 256), 1, 16).alias("content_hash"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(source_uri, content) of each document's first chunk."""
    return chunks.groupBy("source_uri").agg(F.min_by("content", "chunk_index").alias("content"))


def folder_summary(chunks: DataFrame) -> DataFrame:
    """(folder_path, summary): a line `name: snippet` for each document of a folder, by uri."""
    snippet = F.translate(F.substring("content", 1, SNIPPET), "\n", " ")
    line = F.concat(F.substring_index("source_uri", "/", -1), F.lit(": "), snippet)
    lines = first_chunks(chunks).select(parent_folder().alias("folder_path"), F.struct("source_uri", line.alias("line")).alias("x"))
    return lines.groupBy("folder_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("summary"))


def stale_folders(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(folder_path, action): folders to refresh, and stored ones that are empty now, to drop."""
    now, was = current.select("folder_path", F.col("content_hash").alias("now")), stored.select("folder_path", F.col("content_hash").alias("was"))
    both = now.join(was, "folder_path", "full")
    action = F.when(F.col("now").isNull(), "drop").when(F.col("was").isNull() | (F.col("now") != F.col("was")), "refresh")
    return both.select("folder_path", action.alias("action")).where("action is not null")


def strategy(source_type: str = "source_type", asked: str = "semantic"):
    """Chunks of PDFs may be semantic; all others are mechanical."""
    return F.when((F.col(source_type) == "pdf") & F.lit(asked == "semantic"), "semantic").otherwise("mechanical")


def figure_index(page: str, figure: str):
    return F.lit(FIGURE_BASE) + F.col(page) * FIGURES_PER_PAGE + F.col(figure)


def chunk_metadata(pages: str = "pages", images: str = "images"):
    """JSON of pages and images; an empty object without any."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return F.to_json(F.struct(some(pages).alias("pages"), some(images).alias("images")))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Chunks that have no vector in a space yet."""
    return chunks.join(vectors.where(F.col("space") == space).select("chunk_id"), "chunk_id", "left_anti")


def numbered(rows: DataFrame, order: list[str], start: int, out: str = "chunk_id") -> DataFrame:
    """Rows with keys from ``start`` on, in a natural order.

    The order is cut into ranges that are numbered by themselves and shifted by the rows
    before them.
    """
    parts = max(1, min(1000, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("low")).orderBy("__p").collect()
    total, shift = start, []
    for c in counts:
        shift += [F.lit(c["__p"]), F.lit(total - c["low"])]
        total += c["n"]
    number = F.col("__i") + F.create_map(*shift)[F.col("__p")] if shift else F.col("__i")
    return ranged.withColumn(out, number).drop("__p", "__i")


def replaced(old: DataFrame, incoming: DataFrame, uri: str) -> DataFrame:
    """Chunks after one document's are replaced: its old ones go, its new ones come, content that others have is skipped."""
    kept = old.where(F.col("source_uri") != uri)
    return kept.unionByName(new_chunks(kept, incoming.where(F.col("source_uri") == uri)), allowMissingColumns=True)


def ingest_report(incoming: DataFrame, new: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_uri, chunks_added, chunks_skipped, duplicate_of_paper_id) of ingested files.

    A file of which nothing is new may be a copy of a registered one: ``files`` has
    (source_uri, content_hash), ``paths`` those of papers.
    """
    added = new.groupBy("source_uri").agg(F.count("*").alias("chunks_added"))
    every = incoming.groupBy("source_uri").agg(F.count("*").alias("n")).join(added, "source_uri", "left").withColumn("chunks_added", F.coalesce("chunks_added", F.lit(0)))
    out = every.join(duplicate_files(files, paths), "source_uri", "left")
    return out.select("source_uri", "chunks_added", (F.col("n") - F.col("chunks_added")).alias("chunks_skipped"), F.when((F.col("chunks_added") == 0) & (F.col("n") > 0), F.col("duplicate_of_paper_id")).alias("duplicate_of_paper_id"))


def preserved_sessions(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """(chunk_id, session_id): every session of a document's replaced chunks holds for all its new ones.

    ``old`` and ``new`` have (chunk_id, source_uri).
    """
    sessions = links.join(old.select("chunk_id", "source_uri"), "chunk_id").select("source_uri", "session_id").distinct()
    return new.select("chunk_id", "source_uri").join(sessions, "source_uri").select("chunk_id", "session_id")


def relinked(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id): the first chunk of its document, by index, in which a name stands as whole words.

    ``named`` has (id, name, source_uri), ``chunks`` (chunk_id, chunk_index, source_uri,
    content). Each name is looked up once in a document, in the chunks that have the rarest of
    its words; only the texts of those chunks are read again.
    """
    words_of = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0)))).alias("word")
    names = named.select("name", "source_uri").distinct().select("name", "source_uri", words_of("name"))
    words = chunks.select("chunk_id", "source_uri", words_of("content"))
    met = written(words.join(names.select("source_uri", "word").distinct(), ["source_uri", "word"], "left_semi"), "words")
    often = met.groupBy("source_uri", "word").agg(F.count("*").alias("n"))
    rarest = names.join(often, ["source_uri", "word"], "left").groupBy("source_uri", "name").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    asked = met.join(rarest, ["source_uri", "word"]).select("source_uri", "name", "chunk_id")
    found = asked.join(chunks.select("chunk_id", "chunk_index", "content"), "chunk_id").where(F.regexp_like("content", quoted))
    first = found.groupBy("source_uri", "name").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("first"))
    return named.select("id", "name", "source_uri").join(first, ["source_uri", "name"]).groupBy("id").agg(F.min("first").alias("f")).select("id", F.col("f.chunk_id").alias("chunk_id"))
