"""The engine as one object: tables in a store, and the operations a user calls.

Every change makes the next version of its tables; nothing is updated in place. Added rows
are written by themselves, and removed ones only with the folders that held them. What ingests
or replaces documents and figures changes all its tables together, or none if a step fails.
Results are DataFrames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import schemas
from docloom.functions import html
from docloom.functions.chunking import chunk_structured, chunk_windows, markdown_chunks, python_chunks, section_chunks
from docloom.functions.text import content_hash
from docloom.functions.vectors import int8, normalised, truncated
from docloom.operators import blockmax, facts, figures, graph, ingest, migrations, mutate, papers, retrieval, stats, web_images
from docloom.operators.index import Index, lengths, posting_lists
from docloom.session import written
from docloom.settings import Settings
from docloom.sources import bibtex, files
from docloom.sources.providers import Describer, Embedder, HashEmbedder, OverlapReranker, PdfReader, Recogniser, Renderer, Reranker, Tokeniser, described, embedded, recognised, reranked
from docloom.sources.snapshots import Store
from docloom.streaming import misses

DEFAULT_SPACE = "default"
TEXT_FILES = ("md", "txt", "typ", "rst", *files.TYPES["code"])
FACTS = ("methods", "datasets", "metrics")
#: Folders that a filter names; more are joined.
MOST_FOLDERS = 100


class Engine:
    def __init__(
        self, spark: SparkSession, folder: str, settings: Settings | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None,
        model: Callable[[str], str] | None = None, describer: Describer | None = None, recogniser: Recogniser | None = None, pdf_reader: PdfReader | None = None,
        renderer: Renderer | None = None, image_source: web_images.ImageSource | None = None, tokeniser: Tokeniser | None = None, migrate: bool = False,
    ):
        self.spark, self.store = spark, Store(spark, folder)
        #: Steps of the schema's chain that ran when the store was opened.
        self.migrated = migrations.opened(self.store, any(self.store.current(t) is not None for t in schemas.TABLES), migrate)
        self.settings = (settings or Settings()).changed(**{r.key: r.value for r in self.table("config").collect()})  # a row for each setting
        self.embedder, self.reranker, self.model = embedder or HashEmbedder(self.settings.embed_dim), reranker or OverlapReranker(), model
        self.describer, self.recogniser, self.pdf_reader, self.renderer, self.image_source, self.tokeniser = describer, recogniser, pdf_reader, renderer, image_source, tokeniser
        if self.store.current("embed_spaces") is None:
            spaces = mutate.space_created(self.table("embed_spaces"), DEFAULT_SPACE, self.settings.embed_model, self.settings.embed_provider, self.embedder.dim)
            self.save("embed_spaces", spaces.withColumn("status", F.lit("active")))
        if self.migrated:
            self.update_folder_summaries()  # folders may have other names now

    # --- tables ---

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` with the columns of a table; those it lacks are null."""
        target = T.StructType.fromDDL(schemas.TABLES[name])
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])

    def table(self, name: str) -> DataFrame:
        """A table as it is now; columns that an older version lacks are null."""
        if self.store.current(name) is None:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self._shaped(name, self.store.read(name))

    def save(self, name: str, df: DataFrame) -> None:
        self.store.write(name, self._shaped(name, df))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows; only they are written."""
        self.store.append(name, self._shaped(name, df))

    def _put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Puts rows in place of those with the same keys; where there are none, only they are written."""
        if self.table(name).join(rows.select(keys), keys, "left_semi").isEmpty():
            self.append(name, rows)
        else:
            self.save(name, mutate.upserted(self.table(name), rows, keys))

    def schema(self) -> DataFrame:
        """(table, column, type) of all tables."""
        rows = [(t, f.name, f.dataType.simpleString()) for t, ddl in schemas.TABLES.items() for f in T.StructType.fromDDL(ddl)]
        return self.spark.createDataFrame(rows, "table string, column string, type string")

    def next_id(self, name: str, column: str = "id") -> int:
        return (self.table(name).agg(F.max(column).alias("m")).first().m or 0) + 1

    def add(self, name: str, /, **values) -> int:
        """Appends one row with the next id."""
        id_ = self.next_id(name)
        types = dict(x.split(" ", 1) for x in schemas.TABLES[name].split(", "))
        row = {"id": id_} | values
        df = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[k]}" for k in row))
        if "created_at" in types:
            df = df.withColumn("created_at", F.current_timestamp())
        self.append(name, df)
        return id_

    # --- settings ---

    def configure(self, **changes) -> Settings:
        """Changes settings and keeps them in the store."""
        self.settings = self.settings.changed(**changes)
        rows = self.spark.createDataFrame([(k, str(v)) for k, v in changes.items()], "key string, value string")
        self.save("config", mutate.upserted(self.table("config"), rows, ["key"]))
        return self.settings

    def config(self) -> DataFrame:
        """(key, value, stored) of all settings."""
        stored = {r.key for r in self.table("config").collect()}  # a row for each setting
        return self.spark.createDataFrame([(f.name, str(getattr(self.settings, f.name)), f.name in stored) for f in fields(Settings)], "key string, value string, stored boolean")

    # --- ingest ---

    def _chunked(self, docs: DataFrame) -> DataFrame:
        """(source_uri, source_type, text, pages) -> chunks without keys; code by its structure, markdown by sections, the rest by windows."""
        semantic = F.lit(self.settings.chunk_strategy == "semantic")
        code = docs.where(F.col("source_uri").endswith(".py"))
        parsed = chunk_structured(code, "source_uri", "text", python_chunks).select("source_uri", "chunk_index", F.col("text").alias("content"), F.to_json(F.struct("name", "type", "start_line", "end_line")).alias("metadata"))
        unparsed = docs.where(F.col("source_type").isin("code", "web", "note")).join(parsed.select("source_uri"), "source_uri", "left_anti")
        windows = chunk_windows(unparsed, "source_uri").withColumn("metadata", F.lit("{}"))
        marked = docs.where(F.col("source_type").isin("markdown", "pdf"))
        sections = chunk_structured(marked.where(semantic & (F.col("source_type") == "pdf")), "source_uri", "text", section_chunks, "pages")
        plain = chunk_structured(marked.where(~(semantic & (F.col("source_type") == "pdf"))), "source_uri", "text", markdown_chunks, "pages")
        names = F.transform(F.regexp_extract_all("text", F.lit(figures.IMAGE_REF), F.lit(1)), lambda x: F.substring_index(x, "/", -1))
        paged = sections.unionByName(plain).withColumn("images", F.array_distinct(names))
        paged = paged.select("source_uri", "chunk_index", F.col("text").alias("content"), ingest.chunk_metadata().alias("metadata"))
        every = parsed.unionByName(windows).unionByName(paged)
        typed = every.join(docs.select("source_uri", "source_type"), "source_uri")
        return typed.select("source_uri", "source_type", "chunk_index", "content", content_hash("content").alias("content_hash"), ingest.strategy(asked=self.settings.chunk_strategy).alias("chunk_strategy"), "metadata", F.current_timestamp().alias("created_at"))

    def _add_chunks(self, new: DataFrame, order: list[str]) -> DataFrame:
        """Gives chunks their keys and adds them with their postings, lengths and vectors; returns them."""
        first = max(self.next_id("chunks", "chunk_id"), self.next_id("gone_chunks", "chunk_id"))  # postings may still name dropped keys
        new = written(self._shaped("chunks", ingest.numbered(new, order, first)), "chunks")
        if new.isEmpty():
            return new
        blocked = self.store.current("posting_blocks") is not None or self.store.current("chunks") is None  # else compact_index makes them of all
        self.append("chunks", new)
        found, sizes = written(posting_lists(new, "chunk_id", "content"), "postings"), written(lengths(new, "chunk_id", "content"), "lengths")
        self.append("postings", found.sortWithinPartitions("term", "chunk_id"))
        self.append("chunk_lengths", sizes)
        if blocked:
            self.append("posting_blocks", blockmax.block_rows(found, sizes, "chunk_id").sortWithinPartitions("term", "shard"))
            self.append("index_totals", blockmax.totals(sizes))
        self.backfill_embed_space(self.active_space().name, new)
        return new

    def _ingested(self, docs: DataFrame, session_id: str | None) -> tuple[DataFrame, DataFrame]:
        with self.store.changes():
            return self._with_ingested(docs, session_id)

    def _with_ingested(self, docs: DataFrame, session_id: str | None) -> tuple[DataFrame, DataFrame]:
        session_id = session_id or uuid.uuid4().hex
        if "pages" not in docs.columns:
            docs = docs.withColumn("pages", F.lit(None).cast("map<int,int>"))
        if "file_hash" not in docs.columns:
            docs = docs.withColumn("file_hash", content_hash("text"))
        chunked, old = written(self._chunked(docs), "chunks"), self.table("chunks")
        new = self._add_chunks(ingest.new_chunks(old, chunked), ["source_uri", "chunk_index"])
        # the session holds for known chunks of the same content too
        known = old.select("chunk_id", "content_hash").join(chunked.select("content_hash"), "content_hash", "left_semi")
        links = new.select("chunk_id").unionByName(known.select("chunk_id")).withColumn("session_id", F.lit(session_id))
        links = written(links.join(self.table("chunk_sessions"), ["chunk_id", "session_id"], "left_anti"), "links")
        if not links.isEmpty():
            self.append("chunk_sessions", links)
        self.append("sources", docs.select("source_uri", "file_hash", F.current_timestamp().alias("ingested_at")))
        self.update_folder_summaries(docs.select(retrieval.parent_folder().alias("folder_path")))
        return new, chunked

    def ingest_documents(self, docs: DataFrame, session_id: str | None = None) -> DataFrame:
        """Adds (source_uri, source_type, text): chunks that are new, their postings, vectors, session links, folder summaries. Returns the new chunks."""
        return self._ingested(docs, session_id)[0]

    def file_hashes(self) -> DataFrame:
        """(source_uri, content_hash): the hash of each document as it was ingested last."""
        return self.table("sources").groupBy("source_uri").agg(F.max_by("file_hash", "ingested_at").alias("content_hash"))

    def ingest(self, folder: str, session_id: str | None = None) -> DataFrame:
        """Text files below a folder, and PDFs if there is a reader; (source_uri, chunks_added, chunks_skipped, duplicate_of_paper_id)."""
        found = self._files(folder)
        new, chunked = self._ingested(found, session_id)
        return ingest.ingest_report(chunked, new, found.select("source_uri", F.col("file_hash").alias("content_hash")), self.table("paper_paths"))

    def _files(self, folder: str) -> DataFrame:
        found = files.text_files(self.spark, folder, TEXT_FILES).withColumn("pages", F.lit(None).cast("map<int,int>"))
        if self.pdf_reader is not None:
            pdfs = files.pdf_documents(self.spark, folder, self.pdf_reader)
            found = found.unionByName(pdfs.select(found.columns))
        return written(found, "files")

    def reingest_files(self, folder: str, session_id: str | None = None) -> DataFrame:
        """Files below a folder in place of their earlier chunks; returns the new chunks."""
        return self.reingest(self._files(folder), session_id)

    def ingest_pages(self, pages: DataFrame, session_id: str | None = None) -> DataFrame:
        """Web pages (page_id, url, html) by their main text; short ones are rendered, if there is a renderer.

        With a describer and a source of images their inline images become figures, in place of
        earlier ones of the page. Returns the new chunks, figures included.
        """
        docs = html.pages_to_documents(pages, renderer=self.renderer).select("source_uri", F.lit("web").alias("source_type"), "text")
        with self.store.changes():
            new = self.ingest_documents(docs, session_id)
            if self.describer is None or self.image_source is None:
                return new
            return new.unionByName(self._with_inline_figures(pages))

    def _with_inline_figures(self, pages: DataFrame) -> DataFrame:
        """Puts the figures of pages' inline images in place of their earlier ones; content that another chunk has is skipped."""
        found, settled = web_images.inline_figures(pages, self.image_source, self.describer, self.settings.vision_model)
        settled = written(settled, "pages")
        old = self.table("chunks").where(web_images.is_inline()).join(settled, "source_uri", "left_semi")
        self.drop_chunks(written(old, "old"))
        fixed = {"source_type": F.lit("figure"), "chunk_strategy": F.lit("mechanical"), "created_at": F.current_timestamp()}
        added = self._add_chunks(ingest.new_chunks(self.table("chunks"), found).withColumns(fixed), ["source_uri", "chunk_index"])
        self.update_folder_summaries(settled.select(retrieval.parent_folder().alias("folder_path")))
        return added

    def reingest(self, docs: DataFrame, session_id: str | None = None) -> DataFrame:
        """Documents in place of their earlier chunks; sessions stay, references are linked anew by name, similar edges of their papers are found anew.

        If a step fails, every table is as it was.
        """
        with self.store.changes():
            return self._replaced(docs, session_id)

    def _replaced(self, docs: DataFrame, session_id: str | None) -> DataFrame:
        uris = docs.select("source_uri").distinct()
        gone = written(self.table("chunks").join(uris, "source_uri", "left_semi"), "gone")
        at = gone.select("chunk_id", "source_uri")
        kept = written(self.table("chunk_sessions").join(at, "chunk_id", "left_semi"), "sessions")
        papers = written(self.table("papers").join(at, F.col("abstract_chunk_id") == F.col("chunk_id")).select("paper_id", "source_uri"), "papers")
        named = {t: written(self.table(t).join(at, "chunk_id").select("id", "name", "source_uri"), "named") for t in FACTS}
        self.drop_chunks(gone)
        new = self.ingest_documents(docs, session_id)
        links = ingest.preserved_sessions(at, new, kept).join(self.table("chunk_sessions"), ["chunk_id", "session_id"], "left_anti")
        self.append("chunk_sessions", links)
        first = new.groupBy("source_uri").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
        self._link("papers", "paper_id", "abstract_chunk_id", papers.join(first, "source_uri").select(F.col("paper_id").alias("id"), "chunk_id"))
        for t in FACTS:
            self._link(t, "id", "chunk_id", ingest.relinked(named[t], new))
        paths = self.table("paper_paths")
        hashes = self.file_hashes().join(uris, "source_uri", "left_semi").select(F.col("source_uri").alias("path"), F.col("content_hash").alias("now"))
        if not paths.join(hashes, "path", "left_semi").isEmpty():
            self.save("paper_paths", paths.join(hashes, "path", "left").withColumn("content_hash", F.coalesce("now", "content_hash")))
        changed = written(self.table("paper_paths").join(uris, F.col("path") == F.col("source_uri"), "left_semi").select("paper_id").distinct(), "papers")
        if not changed.isEmpty():
            self.relate(changed)
        return new

    def _link(self, name: str, key: str, column: str, found: DataFrame) -> None:
        """Sets a reference where ``found`` (id, chunk_id) has one."""
        found = written(found.select(F.col("id").alias("__id"), F.col("chunk_id").alias("__new")), "found")
        if not found.isEmpty():
            table = self.table(name)
            self.save(name, table.join(found, table[key] == F.col("__id"), "left").withColumn(column, F.coalesce("__new", column)))

    def drop_chunks(self, gone: DataFrame) -> None:
        """Removes chunks and what hangs on them; only folders and tables that name one are written anew."""
        with self.store.changes():
            self._dropped(gone)

    def _dropped(self, gone: DataFrame) -> None:
        if self.store.current("posting_blocks") is not None:
            out = written(self.table("chunk_lengths").join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi"), "gone")
            self.append("gone_chunks", out.select("chunk_id"))
            self.append("index_totals", blockmax.totals(out).selectExpr("-n AS n", "-words AS words"))
        for name in ("chunks", "chunk_vec", "chunk_sessions", "chunk_lengths", "entity_mentions"):
            self.store.delete(name, gone, "chunk_id")
        for name, column in (("papers", "abstract_chunk_id"), ("relationships", "evidence_chunk_id"), *((t, "chunk_id") for t in FACTS)):
            table = self.table(name)
            if not table.join(gone.select(F.col("chunk_id").alias(column)), column, "left_semi").isEmpty():
                self.save(name, mutate.nulled(table, column, gone, "chunk_id"))
        if self.store.current("conclusions") is not None:
            self.save("conclusions", mutate.cleaned_conclusions(self.table("conclusions"), gone))

    def compact_index(self) -> None:
        """Writes the postings of chunks that are there in one folder, ordered by term, and their blocks."""
        with self.store.changes():
            self._compacted()

    def _compacted(self) -> None:
        live = self.table("postings").join(self.table("chunk_lengths").select("chunk_id"), "chunk_id", "left_semi")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.save("postings", live.repartitionByRange(parts, "term", "chunk_id").sortWithinPartitions("term", "chunk_id"))
        sizes = self.table("chunk_lengths")
        blocks = blockmax.block_rows(self.table("postings"), sizes, "chunk_id")
        self.save("posting_blocks", blocks.repartitionByRange(parts, "term", "shard").sortWithinPartitions("term", "shard"))
        self.save("index_totals", blockmax.totals(sizes))
        self.save("gone_chunks", self.table("gone_chunks").limit(0))

    def list_chunks(self, after: int = 0, limit: int = 100, source_uri: str | None = None) -> DataFrame:
        """The next chunks by key, behind the last one that was read."""
        rows = self.table("chunks").where(F.col("chunk_id") > after)
        return (rows.where(F.col("source_uri") == source_uri) if source_uri else rows).orderBy("chunk_id").limit(limit)

    def _in_folders(self, folders: DataFrame) -> DataFrame:
        """Chunks that lie directly in these folders; of a few folders only the row groups that may name them are read."""
        names = [r.folder_path for r in folders.select("folder_path").distinct().limit(MOST_FOLDERS + 1).collect()]
        chunks = self.table("chunks")
        if len(names) > MOST_FOLDERS:
            return chunks.join(folders.select("folder_path").distinct(), retrieval.parent_folder() == F.col("folder_path"), "left_semi")
        below = F.lit(False)
        for name in names:  # a uri without a slash is its own folder
            below = below | F.col("source_uri").startswith(f"{name}/") | (F.col("source_uri") == name)
        return chunks.where(below).where(retrieval.parent_folder().isin(names) if names else F.lit(False))

    def update_folder_summaries(self, folders: DataFrame | None = None) -> DataFrame:
        """Refreshes folders whose content changed and drops empty ones; returns what was done.

        With ``folders`` (folder_path) only these are read, hashed and written.
        """
        chunks, stored = self.table("chunks"), self.table("folder_summaries")
        if folders is not None:
            folders = written(folders.select("folder_path").distinct(), "folders")
            chunks, stored = self._in_folders(folders), stored.join(folders, "folder_path", "left_semi")
        now = ingest.folder_hash(chunks)
        todo = written(ingest.stale_folders(now, stored), "folders")
        if todo.isEmpty():
            return todo
        fresh = ingest.folder_summary(chunks.join(todo.where("action = 'refresh'").select("folder_path"), retrieval.parent_folder() == F.col("folder_path"), "left_semi")).join(now, "folder_path")
        fresh = written(embedded(fresh, "summary", self.embedder).withColumn("updated_at", F.current_timestamp()), "summaries")
        with self.store.changes():
            self.store.delete("folder_summaries", todo, "folder_path")
            self.append("folder_summaries", fresh)
        return todo

    # --- search ---

    def vectors(self, space: str | None = None) -> DataFrame:
        return self.table("chunk_vec").where(F.col("space") == (space or self.active_space().name)).select("chunk_id", "embedding")

    def _query_vector(self, query: str, space) -> list[float]:
        v = self.embedder.embed([query])[0]
        df = self.spark.createDataFrame([(v,)], "v array<float>")
        shaped = truncated("v", space.dim) if space.matryoshka_base_dim else normalised("v")
        return [float(x) for x in df.select((int8(shaped) if space.element_type == "int8" else shaped).alias("v")).first().v or [0.0] * space.dim]

    def index(self) -> Index:
        gone = self.table("gone_chunks")
        parts = (self.table("posting_blocks"), self.table("index_totals"), None if gone.isEmpty() else gone) if self.store.current("posting_blocks") is not None else ()
        return Index(self.table("postings"), self.table("chunk_lengths"), "chunk_id", True, True, *parts)

    def search_index(
        self, query: str, top_k: int = 10, mode: str = "hybrid", source_type: str | None = None, chunk_strategy: str | None = None, rerank: bool = False,
        space: str | None = None, log: bool = True, keyword_prefilter: bool = False, rerank_top: int = retrieval.RERANK_TOP,
    ) -> DataFrame:
        """The best chunks, words by the kept index; a miss is logged."""
        row = self.space(space) if space else self.active_space()
        folders = self.table("folder_summaries").where("embedding is not null") if row.status == "active" and not row.matryoshka_base_dim and row.element_type == "float32" else None
        scorer = reranked(query, self.reranker, self.tokeniser) if rerank else None
        found = retrieval.search(self.table("chunks"), query, self._query_vector(query, row) if mode != "fts" else None, self.vectors(row.name), folders, top_k, mode, source_type, chunk_strategy, scorer, rerank_top, index=self.index(), keyword_prefilter=keyword_prefilter)
        found = self.spark.createDataFrame(found.collect(), found.schema).orderBy("place")  # top_k rows
        if log:
            self.log_miss(query, mode, found, source_type)
        return found

    def log_miss(self, query: str, mode: str, found: DataFrame, source_type: str | None) -> None:
        top = found.first()
        outcome = self.spark.createDataFrame([(query, mode, 0 if top is None else 1, top and top.score, top and top.chunk_id, source_type)], "query string, mode string, n_results int, top_score double, top_chunk_id long, source_type_filter string").withColumn("ts", F.current_timestamp())
        miss = misses.detected(outcome, self.settings.prediction_error_threshold)
        known = self.table("prediction_errors")
        recent = known.where(F.col("detected_at") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR"))
        fresh = miss.join(recent, [miss[k].eqNullSafe(recent[k]) for k in misses.KEYS], "left_anti")
        if not fresh.isEmpty():
            self.append("prediction_errors", fresh.withColumn("id", F.lit(self.next_id("prediction_errors"))))

    def list_prediction_errors(self, since: str | None = None, unresolved: bool = True) -> DataFrame:
        return mutate.open_misses(self.table("prediction_errors"), since, unresolved)

    def resolve_prediction_error(self, id_: int) -> None:
        self.save("prediction_errors", mutate.miss_resolved(self.table("prediction_errors"), id_))

    def co_occurrence(self, least: int = 1) -> DataFrame:
        return stats.cooccurrence(self.table("chunk_sessions"), self.table("chunks"), least).orderBy(F.desc("co_sessions"), "uri_a", "uri_b")

    def status(self) -> DataFrame:
        """(name, value, n): rows of each table, and chunks by type and strategy."""
        counts = stats.index_status({name: self.table(name) for name in schemas.TABLES}).select("name", F.lit(None).cast("string").alias("value"), "n")
        chunks = self.table("chunks")
        return counts.unionByName(stats.group_counts(chunks, "source_type")).unionByName(stats.group_counts(chunks, "chunk_strategy"))

    def recent_sources(self) -> DataFrame:
        return stats.recent_sources(self.table("chunks"))

    # --- papers ---

    def register_paper(self, title: str, authors: list[str] | None = None, year: int | None = None, venue: str | None = None, doi: str | None = None, bib: str | None = None, path: str | None = None) -> int:
        papers, id_ = self.table("papers"), self.next_id("papers", "paper_id")
        if doi and not papers.where(F.col("doi") == doi).isEmpty():
            raise ValueError(f"a paper with DOI {doi} is there")
        first = self.table("chunks").where(F.col("source_uri") == (path or "")).orderBy("chunk_index").select("chunk_id").first()
        row = self.spark.createDataFrame([(id_, title, authors or [], year, venue, doi, bib, first.chunk_id if first else None)], ", ".join(schemas.TABLES["papers"].split(", ")[:-1]))
        self.append("papers", row.withColumn("added_at", F.current_timestamp()))
        if path:
            known = self.file_hashes().where(F.col("source_uri") == path).first()
            paths, owner = mutate.registered(papers, self.table("paper_paths"), id_, path, known.content_hash if known else "")
            if owner is None:
                self.save("paper_paths", paths)
        self.submit_job(id_, "auto_relate")
        return id_

    def backfill_paths(self) -> int:
        """Paths of papers that have none, from their abstract's document; returns how many."""
        found = written(mutate.backfilled_paths(self.table("papers"), self.table("chunks"), self.table("paper_paths")), "paths")
        rows = found.join(self.file_hashes().withColumnRenamed("source_uri", "path"), "path", "left").withColumns({"is_primary": F.lit(True), "added_at": F.current_timestamp()})
        n = found.count()
        if n:
            self.append("paper_paths", rows)
        return n

    def get_paper(self, paper_id: int | None = None, title: str | None = None, doi: str | None = None) -> DataFrame:
        found = mutate.paper_view(self.table("papers"), self.table("paper_paths"), self.table("relationships"))
        if paper_id is not None:
            return found.where(F.col("paper_id") == paper_id)
        return found.where(F.col("doi") == doi) if doi else found.where(F.contains(F.lower("title"), F.lit((title or "").lower())))

    def get_paper_paths(self, paper_id: int) -> DataFrame:
        return self.table("paper_paths").where(F.col("paper_id") == paper_id).orderBy(F.desc("is_primary"), "added_at")

    def relocate_papers(self, asked: DataFrame) -> DataFrame:
        """Moves files (old, new, content_hash): their paths, chunks and hashes change place together, their folders are summarised anew.

        Only folders of tables that name a moved file are written. Returns (old, new, status) of ``papers.moves``.
        """
        found = written(papers.moves(asked, self.table("paper_paths")), "moves")
        done = written(found.where("status = 'moved'"), "moved")
        with self.store.changes():
            for name, column in (("paper_paths", "path"), ("chunks", "source_uri"), ("sources", "source_uri")):
                rows = written(papers.moved(self.table(name), column, done), "moved")
                if not rows.isEmpty():
                    self.store.delete(name, done.select(F.col("old").alias(column)), column)
                    self.append(name, rows)
            places = done.select(F.explode(F.array("old", "new")).alias("source_uri"))
            self.update_folder_summaries(places.select(retrieval.parent_folder().alias("folder_path")))
        return found

    def relocate_paper(self, old: str, new: str, file_hash: str) -> None:
        status = self.relocate_papers(self.spark.createDataFrame([(old, new, file_hash)], "old string, new string, content_hash string")).first().status
        if status != "moved":
            raise ValueError({"unknown": "no such file is registered", "other": "the file at the new place is another one"}.get(status, "a file is registered there"))

    def register_papers(self, asked: DataFrame) -> DataFrame:
        """Registers many papers: (n, title, doi, path) and what else a paper has; n unique. Returns (n, paper_id, status, path_owner).

        Abstracts are the first chunks of the paths, and similar papers are looked for by a job, as with ``register_paper``.
        """
        first = self.table("chunks").groupBy(F.col("source_uri").alias("path")).agg(F.min_by("chunk_id", "chunk_index").alias("abstract_chunk_id"))
        known = self.file_hashes().withColumnRenamed("source_uri", "path")
        found = papers.registrations(asked, self.table("papers"), self.table("paper_paths")).join(first, "path", "left").join(known, "path", "left")
        found = written(found, "asked")
        added = written(ingest.numbered(found.where("status = 'added'"), ["n"], self.next_id("papers", "paper_id"), "paper_id"), "added")
        now = F.current_timestamp()
        with self.store.changes():
            self.append("papers", added.withColumn("added_at", now))
            self.append("paper_paths", added.where("path_free").withColumns({"content_hash": F.coalesce("content_hash", F.lit("")), "is_primary": F.lit(True), "added_at": now}))
            jobs = ingest.numbered(added.select("paper_id"), ["paper_id"], self.next_id("jobs"), "id")
            self.append("jobs", jobs.withColumns({"job_type": F.lit("auto_relate"), "params": F.lit("{}"), "status": F.lit("pending"), "created_at": now}))
        return found.select("n", "status", "path_owner").join(added.select("n", "paper_id"), "n", "left").select("n", "paper_id", "status", "path_owner")

    def paper_chunks(self) -> DataFrame:
        return papers.paper_chunks(self.table("papers"), self.table("paper_paths"), self.table("chunks"))

    def add_relationship(self, source: int, target: int, relation_type: str, confidence: float = 1.0, evidence_chunk_id: int | None = None) -> None:
        if relation_type not in graph.RELATIONS:
            raise ValueError(f"a relationship is one of {graph.RELATIONS}")
        if not 0 <= confidence <= 1:
            raise ValueError("confidence must lie between 0 and 1")
        row = self.spark.createDataFrame([(source, target, relation_type, confidence, evidence_chunk_id)], ", ".join(schemas.TABLES["relationships"].split(", ")[:-1]))
        self._put("relationships", row.withColumn("created_at", F.current_timestamp()), ["source_paper_id", "target_paper_id", "relation_type"])

    def get_relationships(self, paper_id: int, relation_type: str | None = None, direction: str = "both") -> DataFrame:
        found = graph.both_directions(self.table("relationships")).where(F.col("paper_id") == paper_id)
        found = found.where(F.col("relation_type") == relation_type) if relation_type else found
        return found if direction == "both" else found.where(F.col("direction") == direction)

    def _paper_vectors(self) -> DataFrame:
        return self.paper_chunks().join(self.vectors(), "chunk_id").select("paper_id", "chunk_id", "embedding")

    def scan_relationships(self) -> DataFrame:
        """Similar edges between all papers, found anew."""
        least, vectors = self.settings.auto_relate_propose_threshold, self._paper_vectors()
        pairs = written(graph.similar_pairs(vectors, least)[0], "pairs")
        self.save("relationships", graph.rescanned_edges(self.table("relationships"), pairs, vectors, least))
        return graph.similar_edges(pairs, least)

    def relate(self, papers: DataFrame) -> DataFrame:
        """Similar edges between these papers (paper_id) and all others, found anew."""
        pairs = written(graph.pair_similarity(self._paper_vectors(), of=papers), "pairs")
        self.save("relationships", graph.refreshed_edges(self.table("relationships"), pairs, self.settings.auto_relate_propose_threshold))
        return graph.similar_edges(pairs, self.settings.auto_relate_propose_threshold)

    def auto_relate(self, paper_id: int) -> DataFrame:
        return self.relate(self.spark.createDataFrame([(paper_id,)], "paper_id long"))

    def suggest_relationships(self, paper_id: int | None = None) -> DataFrame:
        texts = self.paper_chunks()
        texts = texts if paper_id is None else texts.where(F.col("paper_id") == paper_id)
        return graph.suggest(texts, self.table("papers"), self.table("relationships"))

    def unmatched_dois(self) -> DataFrame:
        return graph.doi_matches(self.paper_chunks(), self.table("papers")).where("target_paper_id is null").drop("target_paper_id")

    def _chosen(self, ids: list[int] | None, title: str | None) -> DataFrame:
        papers = self.table("papers")
        if ids:
            return papers.where(F.col("paper_id").isin(ids))
        return papers.where(F.contains(F.lower("title"), F.lit(title.lower()))) if title else papers

    def export_bibtex(self, folder: str, ids: list[int] | None = None, title: str | None = None) -> None:
        bibtex.export(bibtex.entries(self._chosen(ids, title)), folder)

    def sync_bibtex(self, path: str, ids: list[int] | None = None, title: str | None = None) -> int:
        """Appends entries that a bibliography lacks; returns how many."""
        target = bibtex.checked_path(path)
        entries = bibtex.entries(self._chosen(ids, title))
        if target.exists():
            entries = bibtex.missing_entries(entries, self.spark.read.text(target.as_uri()))
        rows = entries.orderBy("paper_id").collect()  # as large as the file
        with target.open("a") as out:
            out.writelines(f"{r.entry}\n\n" for r in rows)
        return len(rows)

    # --- conclusions ---

    def record_conclusion(self, claim: str, confidence: float = 1.0, chunk_ids: list[int] | None = None, context: str | None = None) -> int:
        ids = set(chunk_ids or [])
        if ids and self.table("chunks").where(F.col("chunk_id").isin(sorted(ids))).count() < len(ids):
            raise ValueError("some chunks are not there")
        return self.add("conclusions", claim=claim, confidence=confidence, source_chunk_ids=chunk_ids or [], session_context=context, superseded_by=None)

    def supersede_conclusion(self, old: int, claim: str, confidence: float = 1.0, chunk_ids: list[int] | None = None) -> int:
        if self.table("conclusions").where((F.col("id") == old) & F.col("superseded_by").isNull()).isEmpty():
            raise ValueError("the conclusion is missing or superseded")
        new = self.record_conclusion(claim, confidence, chunk_ids)
        self.save("conclusions", mutate.superseded(self.table("conclusions"), old, new))
        return new

    def get_conclusions(self, word: str | None = None, least: float = 0.0, superseded: bool = False) -> DataFrame:
        return mutate.hydrated(mutate.get_conclusions(self.table("conclusions"), word, least, not superseded), self.table("chunks"))

    def get_conclusion_chain(self, id_: int) -> DataFrame:
        table = self.table("conclusions")
        return graph.chain_of(table.select("id", "superseded_by"), id_).join(table, "id").orderBy("depth")

    # --- facts ---

    def _record(self, name: str, title: str, paper_id: int, description: str | None, source: str = "user") -> None:
        row = self.spark.createDataFrame([(self.next_id(name), title, paper_id, description, source)], "id long, name string, paper_id long, description string, source string")
        self._put(name, row, ["name", "paper_id"])

    def record_method(self, name: str, paper_id: int, description: str | None = None) -> None:
        self._record("methods", name, paper_id, description)

    def record_dataset(self, name: str, paper_id: int, description: str | None = None) -> None:
        self._record("datasets", name, paper_id, description)

    def record_metric(self, name: str, value: float, paper_id: int, method_id: int | None = None, dataset_id: int | None = None, unit: str | None = None) -> int:
        return self.add("metrics", name=name, value=value, unit=unit, dataset_id=dataset_id, method_id=method_id, paper_id=paper_id, source="user")

    def compare_papers(self, ids: list[int]) -> DataFrame:
        return facts.compare_papers(self.table("metrics"), self.table("datasets"), self.table("methods"), self.table("papers"), ids)

    def extract_structure(self, paper_id: int) -> DataFrame:
        """Methods, datasets, metrics and entities of a paper by the model; earlier extracted ones go, a user's stay."""
        if self.model is None:
            raise ValueError("no model is set")
        chunks = facts.whole_papers(self.paper_chunks().where(F.col("paper_id") == paper_id))
        found = written(facts.extract(chunks, self.model), "facts")
        several = found.select("chunk_id").distinct().count() > 1  # a text read at once names each thing once
        groups = facts.resolved_groups(found, self.model) if several else self.spark.createDataFrame([], "kind string, surface string, canonical_name string")
        resolved = written(facts.canonical(found, groups), "facts")
        for name, kind in (("methods", "method"), ("datasets", "dataset")):
            old = facts.cleared(self.table(name), paper_id)
            new = resolved.where(F.col("kind") == kind).select(F.col("canonical_name").alias("name"), "paper_id", "description", "chunk_id", F.lit("extracted").alias("source"))
            fresh = new.join(old.select("name", "paper_id"), ["name", "paper_id"], "left_anti")
            self.save(name, old.unionByName(ingest.numbered(fresh, ["name"], self.next_id(name), "id"), allowMissingColumns=True))
        link = lambda name, column: self.table(name).where(F.col("paper_id") == paper_id).select(F.col("name").alias(column), F.col("id").alias(f"{column}_id"))
        values = found.where("kind = 'metric'").join(link("methods", "method"), "method", "left").join(link("datasets", "dataset"), "dataset", "left")
        values = values.select("name", "value", "unit", "dataset_id", "method_id", "paper_id", "chunk_id", F.lit("extracted").alias("source"))
        self.save("metrics", facts.cleared(self.table("metrics"), paper_id).unionByName(ingest.numbered(values, ["name", "value"], self.next_id("metrics"), "id"), allowMissingColumns=True))
        entities = facts.cleared(self.table("entities"), paper_id)
        named = resolved.select("canonical_name", F.col("kind").alias("entity_type"), "paper_id", "description", F.lit("extracted").alias("source"), "surface_forms")
        named = ingest.numbered(named, ["entity_type", "canonical_name"], self.next_id("entities"), "id")
        self.save("entities", entities.unionByName(named.drop("surface_forms"), allowMissingColumns=True))
        of = named.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("kind"), "canonical_name", "paper_id")
        seen = facts.entity_mentions(found, resolved).join(of, ["paper_id", "kind", "canonical_name"]).select("entity_id", "surface_form", "chunk_id", F.lit(1.0).alias("confidence"))
        live = self.table("entity_mentions").join(self.table("entities").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        self.save("entity_mentions", mutate.inserted(live, seen, ["entity_id", "surface_form", "chunk_id"]))
        return resolved

    def get_methods(self, paper_id: int) -> DataFrame:
        return self.table("methods").where(F.col("paper_id") == paper_id).orderBy("id")

    def get_datasets(self, paper_id: int) -> DataFrame:
        return self.table("datasets").where(F.col("paper_id") == paper_id).orderBy("id")

    def get_metrics(self, paper_id: int) -> DataFrame:
        """Metrics of a paper with the names of their method and dataset."""
        rows = self.table("metrics").where(F.col("paper_id") == paper_id)
        return facts.metrics_view(rows, self.table("methods"), self.table("datasets")).select("id", "name", "value", "unit", "method", "dataset", "chunk_id", "source").orderBy("id")

    def extraction_estimate(self, paper_id: int) -> DataFrame:
        return facts.extraction_estimate(self.paper_chunks().where(F.col("paper_id") == paper_id))

    def get_entities(self, paper_id: int) -> DataFrame:
        seen = self.table("entity_mentions").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("surface_form", "chunk_id"))).alias("mentions"))
        return self.table("entities").where(F.col("paper_id") == paper_id).join(seen, "id", "left")

    # --- figures ---

    def extract_figures(self, paper_id: int, folder: str, pages: list[int] | None = None) -> DataFrame:
        """Figures of a paper's images below a folder, described and read, as chunks of their own.

        Earlier figures of the paper, or of the given pages, go. An image's page is the
        earliest that its document's chunks name; captions stand near its reference.
        """
        if self.describer is None:
            raise ValueError("no describer is set")
        source = self.get_paper_paths(paper_id).first()
        if source is None:
            raise ValueError(f"paper {paper_id} has no file")
        chunks = self.table("chunks").where((F.col("source_uri") == source.path) & (F.col("source_type") != "figure"))
        meta = F.from_json("metadata", "pages array<int>, images array<string>")
        named = written(chunks.select("chunk_id", "source_uri", "content", F.coalesce(meta["images"], F.array().cast("array<string>")).alias("images"), F.coalesce(meta["pages"], F.array().cast("array<int>")).alias("pages")), "named")
        at = figures.image_pages(named).select("image", "page")
        at = at.where(F.col("page").isin(pages)) if pages else at
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", "/", -1).alias("name"), F.col("content").alias("image"))
        images = written(raw.join(at.select(F.col("image").alias("name")), "name", "left_semi"), "images")
        told = described(images, self.describer).withColumnRenamed("name", "image")
        ocr = figures.ocr_text(recognised(images, self.recogniser), "name").withColumnRenamed("name", "image")
        found = figures.figure_texts(at, figures.image_captions(named), told, ocr)
        new = found.withColumns({"p": F.array("page"), "i": F.array("image")}).select(
            F.lit(source.path).alias("source_uri"), F.lit("figure").alias("source_type"), ingest.figure_index("page", "figure").alias("chunk_index"), F.col("text").alias("content"), content_hash("text").alias("content_hash"),
            F.lit("mechanical").alias("chunk_strategy"), ingest.chunk_metadata("p", "i").alias("metadata"), F.current_timestamp().alias("created_at"),
        )
        new = written(new, "figures")
        old = self.table("chunks").where((F.col("source_uri") == source.path) & (F.col("source_type") == "figure"))
        with self.store.changes():
            self.drop_chunks(written(old.where(figures.in_pages("chunk_index", pages)) if pages else old, "old"))
            added = self._add_chunks(new, ["chunk_index"])
            self.update_folder_summaries(self.spark.createDataFrame([(source.path,)], "source_uri string").select(retrieval.parent_folder().alias("folder_path")))
            return added

    # --- embedding spaces ---

    def space(self, name: str):
        row = self.table("embed_spaces").where(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no space {name}")
        return row

    def active_space(self):
        return mutate.active_space(self.table("embed_spaces")).first()

    def list_embed_spaces(self) -> DataFrame:
        spaces = self.table("embed_spaces")
        return spaces.join(mutate.space_progress(spaces, self.table("chunks"), self.table("chunk_vec")).drop("status"), "name")

    def create_embed_space(self, name: str, dim: int | None = None, strategy: str = "mechanical", element_type: str = "float32", base_dim: int | None = None) -> None:
        self.save("embed_spaces", mutate.space_created(self.table("embed_spaces"), name, self.settings.embed_model, self.settings.embed_provider, dim or self.embedder.dim, strategy, element_type, base_dim))

    def backfill_embed_space(self, name: str, chunks: DataFrame | None = None) -> None:
        """Vectors for the chunks of the space's strategy that have none; truncated or quantised as the space asks."""
        space = self.space(name)
        if self.embedder.dim != (space.matryoshka_base_dim or space.dim):
            raise ValueError(f"space {name} has {space.matryoshka_base_dim or space.dim} dimensions, the embedder {self.embedder.dim}; re-embed or use the space's embedder")
        todo = (self.table("chunks") if chunks is None else chunks).where(F.col("chunk_strategy") == space.chunk_strategy)
        made = embedded(ingest.missing_vectors(todo, self.table("chunk_vec"), name).select("chunk_id", "content"), "content", self.embedder)
        shaped = truncated("embedding", space.dim) if space.matryoshka_base_dim else normalised("embedding")
        vector = (int8(shaped) if space.element_type == "int8" else shaped).cast("array<float>")
        made = made.select(F.lit(name).alias("space"), "chunk_id", vector.alias("embedding")).where("embedding is not null")
        self.append("chunk_vec", made)

    def promote_embed_space(self, name: str) -> None:
        """A complete space becomes active; similar edges and folder vectors are made anew."""
        spaces = self.table("embed_spaces")
        self.save("embed_spaces", mutate.space_promoted(spaces, mutate.space_progress(spaces, self.table("chunks"), self.table("chunk_vec")), name))
        self.save("relationships", self.table("relationships").where("relation_type <> 'similar'"))
        self.save("folder_summaries", self.table("folder_summaries").limit(0))
        self.update_folder_summaries()

    def deprecate_embed_space(self, name: str) -> None:
        self.save("embed_spaces", mutate.space_deprecated(self.table("embed_spaces"), name))

    def cleanup_embed_space(self, name: str) -> None:
        spaces, vectors = mutate.spaces_cleaned(self.table("embed_spaces"), self.table("chunk_vec"), name)
        self.save("embed_spaces", spaces)
        self.save("chunk_vec", vectors)

    def re_embed(self, name: str, embedder: Embedder) -> None:
        """All chunks by another embedder: a new space, filled and promoted."""
        self.embedder = embedder
        self.create_embed_space(name)
        self.backfill_embed_space(name)
        self.promote_embed_space(name)

    def compare_spaces(self, queries: list[str], a: str, b: str, top_k: int = 10) -> DataFrame:
        """Overlap, Jaccard and rho of two spaces' results for each query."""
        found = []
        for space in (self.space(a), self.space(b)):
            rows = [(i, self._query_vector(q, space)) for i, q in enumerate(queries)]
            qvecs = self.spark.createDataFrame(rows, "query_id int, qvec array<double>")
            found.append(retrieval.nearest(qvecs, self.vectors(space.name), "chunk_id", top_k))
        return stats.compare_spaces(*found, "chunk_id", top_k)

    def batch_compare_spaces(self, queries: list[str], a: str, b: str, top_k: int = 10) -> DataFrame:
        return stats.batch_stats(self.compare_spaces(queries, a, b, top_k))

    def benchmark_spaces(self, baseline: str | None = None, sample_queries: int = 50, top_k: int = 10, seed: int = 0) -> DataFrame:
        """Every other space that is not deprecated against a baseline, the active one if none is named, with chunks as queries.

        (space, element_type, dim, status, chunk_count, storage_ratio, overlap, jaccard, rho, error).
        """
        base = self.space(baseline) if baseline else self.active_space()
        queries = [r.content for r in stats.sampled(self.table("chunks"), sample_queries, seed, "chunk_id").collect()]  # sample_queries rows
        sizes = {r.name: r for r in stats.storage_ratio(self.table("embed_spaces")).collect()}  # a row for each space
        counts = {r.name: r.chunk_count for r in self.list_embed_spaces().collect()}
        rows = []
        for space in self.table("embed_spaces").where((F.col("name") != base.name) & (F.col("status") != "deprecated")).orderBy("name").collect():
            row = (space.name, space.element_type, space.dim, space.status, counts[space.name], round(sizes[space.name].bytes / sizes[base.name].bytes, 4))
            try:
                found = {r.measure: r["mean"] for r in self.batch_compare_spaces(queries, base.name, space.name, top_k).collect()}
                rows.append((*row, found.get("overlap"), found.get("jaccard"), found.get("rho"), None))
            except (PySparkException, ValueError, RuntimeError) as e:
                rows.append((*row, None, None, None, str(e)))
        return self.spark.createDataFrame(rows, "space string, element_type string, dim int, status string, chunk_count long, storage_ratio double, overlap double, jaccard double, rho double, error string")

    # --- jobs ---

    def submit_job(self, paper_id: int, job_type: str, params: str = "{}") -> None:
        if job_type not in schemas.JOB_TYPES:
            raise ValueError(f"a job is one of {schemas.JOB_TYPES}")
        row = self.spark.createDataFrame([(self.next_id("jobs"), paper_id, job_type, params, "pending")], "id long, paper_id long, job_type string, params string, status string")
        self.save("jobs", mutate.job_submitted(self.table("jobs"), row.withColumn("created_at", F.current_timestamp())))

    def recover_jobs(self) -> None:
        """Jobs that ran when a session ended wait again."""
        self.save("jobs", mutate.jobs_recovered(self.table("jobs")))

    def get_job_status(self, id_: int):
        """A job's row."""
        job = self.table("jobs").where(F.col("id") == id_).first()
        if job is None:
            raise ValueError(f"no job {id_}")
        return job

    def run_jobs(self, limit: int | None = None) -> int:
        """Runs waiting jobs, oldest first, up to ``limit``; returns how many."""
        run = {
            "auto_relate": lambda job: self.auto_relate(job.paper_id).count(),
            "extract_structure": lambda job: self.extract_structure(job.paper_id).count(),
            "extract_figures": lambda job: self.extract_figures(job.paper_id, **json.loads(job.params)).count(),
        }
        done = 0
        while limit is None or done < limit:
            jobs = mutate.job_claimed(self.table("jobs"))
            job = jobs.where("status = 'running'").first()
            if job is None:
                return done
            self.save("jobs", jobs)
            try:
                status, result, error = "completed", str(run[job.job_type](job)), None
            except (KeyError, TypeError, ValueError, RuntimeError, PySparkException) as e:
                status, result, error = "failed", None, str(e)
            mine = F.col("id") == job.id
            table = self.table("jobs")
            for column, value in (("status", status), ("result", result), ("error", error)):
                table = table.withColumn(column, F.when(mine, F.lit(value)).otherwise(F.col(column)))
            self.save("jobs", table.withColumn("completed_at", F.when(mine, F.current_timestamp()).otherwise(F.col("completed_at"))))
            done += 1
        return done

    def list_jobs(self, status: str | None = None, paper_id: int | None = None) -> DataFrame:
        jobs = self.table("jobs")
        jobs = jobs.where(F.col("status") == status) if status else jobs
        jobs = jobs.where(F.col("paper_id") == paper_id) if paper_id is not None else jobs
        return jobs.orderBy(F.desc("created_at"), F.desc("id"))
