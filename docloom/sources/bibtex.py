"""BibTeX: keys, entries, export and incremental append."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = r"@\w+\s*\{\s*([^,\s]+)"
MARKER = "% docloom-paper: "


def base_key(authors: Column | str, year: Column | str) -> Column:
    """Letters of the first author's surname, lower case, and the year."""
    first = F.try_element_at(F.col(authors) if isinstance(authors, str) else authors, F.lit(1))
    last = F.when(first.contains(","), F.trim(F.substring_index(first, ",", 1))).otherwise(F.substring_index(F.trim(first), " ", -1))
    name = F.when(first.isNull(), "unknown").otherwise(F.lower(F.regexp_replace(last, "[^a-zA-Z]", "")))
    return F.concat(name, F.coalesce(F.nullif(F.col(year), F.lit(0)).cast("string"), F.lit("nd")))


def suffix(n: Column) -> Column:
    """Nothing for the first paper of a key, then a to z, then 2, 3, and on."""
    return F.when(n == 1, "").when(n <= 27, F.char(n + 95)).otherwise((n - 26).cast("string"))


def keys(papers: DataFrame) -> DataFrame:
    """(paper_id, key): keys that no two papers share, in order of id."""
    n = F.row_number().over(Window.partitionBy("base").orderBy("paper_id"))
    return papers.select("paper_id", base_key("authors", "year").alias("base")).select("paper_id", F.concat("base", suffix(n)).alias("key"))


def entries(papers: DataFrame) -> DataFrame:
    """(paper_id, key, entry): stored entries as they are, others made from the metadata; one for each key."""
    fields = [F.concat(F.lit("  title = {"), "title", F.lit("},"))]
    fields.append(F.when(F.size("authors") > 0, F.concat(F.lit("  author = {"), F.array_join("authors", " and "), F.lit("},"))))
    for label, column in (("year", "year"), ("journal", "venue"), ("doi", "doi")):
        value = F.nullif(F.col(column).cast("string"), F.lit("0" if column == "year" else ""))
        fields.append(F.when(value.isNotNull(), F.concat(F.lit(f"  {label} = {{"), value, F.lit("},"))))
    made = F.concat_ws("\n", F.concat(F.lit(MARKER), F.col("paper_id").cast("string")), F.concat(F.lit("@article{"), "key", F.lit(",")), *fields, F.lit("}"))
    stored = F.nullif(F.regexp_extract(F.coalesce("bibtex", F.lit("")), KEY, 1), F.lit(""))
    every = papers.join(keys(papers), "paper_id").select("paper_id", F.coalesce(stored, "key").alias("key"), F.coalesce(F.nullif(F.trim("bibtex"), F.lit("")), made).alias("entry"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("paper_id"))
    return every.withColumn("n", first).where("n = 1").drop("n")


def export(found: DataFrame, folder: str) -> None:
    """Writes entries as text, in order of id."""
    found.orderBy("paper_id").select(F.concat("entry", F.lit("\n")).alias("value")).write.mode("overwrite").text(folder)


def missing_entries(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries that a file's lines (value) do not have yet, by key or by paper marker."""
    there = lines.select(F.explode(F.regexp_extract_all("value", F.lit(KEY), F.lit(1))).alias("key"))
    marked = lines.where(F.col("value").startswith(MARKER)).select(F.regexp_extract("value", r"(\d+)\s*$", 1).cast("long").alias("paper_id"))
    return found.join(there, "key", "left_anti").join(marked, "paper_id", "left_anti")


def checked_path(path: str) -> Path:
    """A bibliography file's path: .bib or .bibtex, below home or the working folder."""
    found = Path(path).expanduser().resolve()
    if found.suffix.lower() not in (".bib", ".bibtex"):
        raise ValueError("a bibliography ends in .bib or .bibtex")
    if not any(found.is_relative_to(top.resolve()) for top in (Path.home(), Path.cwd())):
        raise ValueError("a bibliography lies below the home or the working folder")
    return found
