"""Changes as next versions of tables: upserts, reference repair, spaces, jobs, registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Old rows with new ones in their place; of new rows with equal keys the last by ``order`` counts."""
    if order:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("__n", last).where("__n = 1").drop("__n")
    else:
        new = new.dropDuplicates(keys)
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, same, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose keys are not there."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    fresh = new.dropDuplicates(keys)
    return old.unionByName(fresh.join(old, [fresh[k].eqNullSafe(old[k]) for k in keys], "left_anti"), allowMissingColumns=True) if same else old


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def nulled(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """References to rows that are gone become null."""
    lost = gone.select(F.col(key).alias("__gone")).distinct()
    return df.join(lost, df[column] == F.col("__gone"), "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).drop("__gone")


def cleaned_conclusions(conclusions: DataFrame, gone: DataFrame) -> DataFrame:
    """Conclusions without references to chunks that are gone.

    A conclusion left without evidence goes, and what it superseded is no longer superseded.
    Those without evidence from the start stay.
    """
    lost = gone.select(F.col("chunk_id").alias("c")).distinct()
    each = conclusions.select("id", F.explode("source_chunk_ids").alias("c"))
    hit = each.join(lost, "c").groupBy("id").agg(F.collect_set("c").alias("lost"))
    marked = conclusions.join(hit, "id", "left").withColumn("source_chunk_ids", F.when(F.col("lost").isNull(), F.col("source_chunk_ids")).otherwise(F.array_except("source_chunk_ids", "lost")))
    empty = marked.where(F.col("lost").isNotNull() & (F.size("source_chunk_ids") == 0)).select("id")
    return nulled(without(marked.drop("lost"), empty, "id"), "superseded_by", empty, "id")


def superseded(conclusions: DataFrame, old: int, new: int) -> DataFrame:
    """A conclusion that no other supersedes yet gets its successor."""
    free = (F.col("id") == old) & F.col("superseded_by").isNull()
    return conclusions.withColumn("superseded_by", F.when(free, F.lit(new)).otherwise(F.col("superseded_by")))


def get_conclusions(conclusions: DataFrame, word: str | None = None, least: float = 0.0, current: bool = True) -> DataFrame:
    out = conclusions.where(F.col("confidence") >= least)
    if word:
        out = out.where(F.contains(F.lower("claim"), F.lit(word.lower())))
    return out.where("superseded_by is null") if current else out


def hydrated(conclusions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Conclusions with the contents of their chunks, in the order they name them."""
    each = conclusions.select("id", F.posexplode("source_chunk_ids").alias("i", "chunk_id")).join(chunks.select("chunk_id", "content"), "chunk_id")
    listed = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "chunk_id", "content"))).alias("evidence"))
    return conclusions.join(listed, "id", "left")


# --- papers ----------------------------------------------------------------------------


def registered(papers: DataFrame, paths: DataFrame, paper_id: int, path: str, file_hash: str) -> tuple[DataFrame, int | None]:
    """Paths with one more, primary if it is the paper's first, and the other paper that has the path, if any."""
    spark = paths.sparkSession
    owner = paths.where(F.col("path") == path).select("paper_id").first()
    if owner is not None:
        return paths, owner.paper_id if owner.paper_id != paper_id else None
    first = paths.where(F.col("paper_id") == paper_id).isEmpty()
    row = spark.createDataFrame([(paper_id, path, file_hash, first)], "paper_id long, path string, content_hash string, is_primary boolean")
    return paths.unionByName(row.withColumn("added_at", F.current_timestamp()), allowMissingColumns=True), None


def with_relationship(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones put in; confidence must lie between 0 and 1."""
    checked = new.withColumn("confidence", F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence must lie between 0 and 1"))))
    return upserted(edges, checked, ["source_paper_id", "target_paper_id", "relation_type"])


def paper_view(papers: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers with their paths, primary first, and their relationships from both ends."""
    from docloom.operators.graph import both_directions

    files = paths.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("n"), "added_at", "path"))), lambda x: x["path"]).alias("paths"))
    near = both_directions(edges).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("other_paper_id", "direction", "relation_type", "confidence"))).alias("relationships"))
    return papers.join(files, "paper_id", "left").join(near, "paper_id", "left")


def backfilled_paths(papers: DataFrame, chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """(paper_id, path): paths of papers without one, from their abstract chunk."""
    uri = chunks.select(F.col("chunk_id").alias("abstract_chunk_id"), F.col("source_uri").alias("path"))
    return papers.join(uri, "abstract_chunk_id").join(paths.select("paper_id"), "paper_id", "left_anti").select("paper_id", "path")


# --- embedding spaces ------------------------------------------------------------------

SPACES = "name string, model string, provider string, dim int, chunk_strategy string, status string, element_type string, matryoshka_base_dim int, created_at timestamp"


def space_created(spaces: DataFrame, name: str, model: str, provider: str, dim: int, strategy: str = "mechanical", element_type: str = "float32", base_dim: int | None = None) -> DataFrame:
    if not spaces.where(F.col("name") == name).isEmpty():
        raise ValueError(f"space {name} is there")
    if element_type not in ("float32", "int8") or base_dim is not None and base_dim <= dim:
        raise ValueError("element type is float32 or int8, and a base dimension exceeds the dimension")
    row = spaces.sparkSession.createDataFrame([(name, model, provider, dim, strategy, "populating", element_type, base_dim)], ", ".join(SPACES.split(", ")[:-1]))
    return spaces.unionByName(row.withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)


def space_progress(spaces: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, chunk_count, total_chunks): counted, never stored."""
    total = chunks.groupBy("chunk_strategy").agg(F.count("*").alias("total_chunks"))
    done = vectors.groupBy(F.col("space").alias("name")).agg(F.count_distinct("chunk_id").alias("chunk_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spaces.join(total, "chunk_strategy", "left").join(done, "name", "left").select("name", "status", zero("chunk_count"), zero("total_chunks"))


def space_promoted(spaces: DataFrame, progress: DataFrame, name: str) -> DataFrame:
    """A complete space becomes the active one, and the active one deprecated."""
    row = progress.where(F.col("name") == name).first()
    if row is None or row.status == "active" or row.chunk_count < row.total_chunks:
        raise ValueError(f"space {name} is missing, active or incomplete")
    status = F.when(F.col("name") == name, "active").when(F.col("status") == "active", "deprecated").otherwise(F.col("status"))
    return spaces.withColumn("status", status)


def space_deprecated(spaces: DataFrame, name: str) -> DataFrame:
    if not spaces.where((F.col("name") == name) & (F.col("status") == "active")).isEmpty():
        raise ValueError("the active space can't be deprecated; promote another one")
    return spaces.withColumn("status", F.when(F.col("name") == name, "deprecated").otherwise(F.col("status")))


def spaces_cleaned(spaces: DataFrame, vectors: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spaces and vectors without a deprecated space."""
    if spaces.where((F.col("name") == name) & (F.col("status") == "deprecated")).isEmpty():
        raise ValueError(f"space {name} is not deprecated")
    return spaces.where(F.col("name") != name), vectors.where(F.col("space") != name)


def active_space(spaces: DataFrame) -> DataFrame:
    return spaces.where("status = 'active'")


# --- jobs and misses -------------------------------------------------------------------


def job_submitted(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new ones, but for those of which an equal one waits or runs; of equal new ones the one with the smallest id."""
    keys = ["paper_id", "job_type", "params"]
    live = jobs.where(F.col("status").isin("pending", "running"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    fresh = new.withColumn("__n", first).where("__n = 1").drop("__n")
    return jobs.unionByName(fresh.join(live, [fresh[k].eqNullSafe(live[k]) for k in keys], "left_anti"), allowMissingColumns=True)


def job_claimed(jobs: DataFrame) -> DataFrame:
    """The oldest pending job runs."""
    first = jobs.where("status = 'pending'").orderBy("created_at", "id").limit(1).select(F.col("id").alias("__id"))
    marked = jobs.join(F.broadcast(first), jobs["id"] == F.col("__id"), "left")  # one row
    return marked.withColumn("status", F.when(F.col("__id").isNotNull(), "running").otherwise(F.col("status"))).drop("__id")


def jobs_recovered(jobs: DataFrame) -> DataFrame:
    """Jobs that ran when the service stopped wait again."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def open_misses(misses: DataFrame, since: str | None = None, unresolved: bool = True) -> DataFrame:
    out = misses.where("resolved_at is null") if unresolved else misses
    out = out.where(F.col("detected_at") >= F.to_timestamp(F.lit(since))) if since else out
    return out.orderBy(F.desc("detected_at"), F.desc("id"))


def miss_resolved(misses: DataFrame, id_: int) -> DataFrame:
    return misses.withColumn("resolved_at", F.when((F.col("id") == id_) & F.col("resolved_at").isNull(), F.current_timestamp()).otherwise(F.col("resolved_at")))
