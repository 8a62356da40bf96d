"""Ordered steps from older stores to the present schema.

Each step may run again without harm, and its tables and the note that it is done become
visible together, so a chain that stops between steps goes on behind the last one that was
noted. A store without notes but with tables is one of before they were kept: the whole
chain runs over it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.operators import mutate
from docloom.sources.snapshots import Store

#: The table of notes: (version, step, target, applied_at); target is the version of the build that ran the step.
NOTES = "schema_steps"


class SchemaError(RuntimeError):
    """The store is of a newer schema, or of an older one that is to be migrated first."""


def _changed(store: Store, name: str, **values: Callable[[Column], Column]) -> None:
    """Gives columns of a table new values, made of the old ones; written only if a value differs. A missing column is null before."""
    if store.current(name) is None:
        return
    rows = store.read(name)
    old = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in values}
    new = {c: make(old[c]) for c, make in values.items()}
    differs = reduce(lambda a, b: a | b, [~old[c].eqNullSafe(new[c]) for c in values])
    if not rows.where(differs).isEmpty():
        store.write(name, rows.withColumns(new))


def _or(value: Column) -> Callable[[Column], Column]:
    return lambda old: F.coalesce(old, value)


def _slashes(old: Column) -> Column:
    return F.translate(old, "\\", "/")


def _chunk_defaults(store: Store) -> None:
    _changed(store, "chunks", content_hash=_or(content_hash("content")), chunk_strategy=_or(F.lit("mechanical")), metadata=_or(F.lit("{}")))


def _sessions_of_chunks(store: Store) -> None:
    """Links from a column that named one session for each chunk."""
    if store.current("chunks") is None or "session_id" not in store.read("chunks").columns:
        return
    links = store.read("chunks").where("session_id IS NOT NULL").select("chunk_id", "session_id").distinct()
    if store.current("chunk_sessions") is not None:
        links = links.join(store.read("chunk_sessions"), ["chunk_id", "session_id"], "left_anti")
    if not links.isEmpty():
        store.append("chunk_sessions", links)


def _paths_of_papers(store: Store) -> None:
    """The document of its abstract for each paper without a path."""
    if store.current("papers") is None or store.current("chunks") is None:
        return
    papers, chunks = store.read("papers"), store.read("chunks")
    paths = store.read("paper_paths") if store.current("paper_paths") is not None else papers.select("paper_id").limit(0)
    found = mutate.backfilled_paths(papers, chunks, paths).withColumns({"is_primary": F.lit(True), "added_at": F.current_timestamp()})
    if not found.isEmpty():
        store.append("paper_paths", found)


def _spaces(store: Store) -> None:
    _changed(store, "embed_spaces", element_type=_or(F.lit("float32")), chunk_strategy=_or(F.lit("mechanical")))


def _addresses(store: Store) -> None:
    for name, column in (("chunks", "source_uri"), ("sources", "source_uri"), ("paper_paths", "path")):
        _changed(store, name, **{column: _slashes})


def _facts(store: Store) -> None:
    """Facts of before their origin was kept are a user's, so no extraction clears them."""
    for name in ("methods", "datasets", "metrics", "entities"):
        _changed(store, name, source=_or(F.lit("user")))


#: The chain; the version of a store is the number of its steps. New steps are put behind.
STEPS: tuple[Callable[[Store], None], ...] = (_chunk_defaults, _sessions_of_chunks, _paths_of_papers, _spaces, _addresses, _facts)


def noted(store: Store) -> tuple[int, int]:
    """(version of a store, version that its last chain was for); zeros without notes."""
    if store.current(NOTES) is None:
        return 0, 0
    return tuple(store.read(NOTES).agg(F.max("version"), F.max("target")).first())


def _note(store: Store, first: int, last: int) -> None:
    rows = [(v, STEPS[v - 1].__name__.lstrip("_"), len(STEPS)) for v in range(first, last + 1)]
    store.append(NOTES, store.spark.createDataFrame(rows, "version int, step string, target int").withColumn("applied_at", F.current_timestamp()))


def migrated(store: Store, version: int = 0) -> list[str]:
    """Runs the steps behind ``version``; returns their names."""
    done = []
    for at, step in enumerate(STEPS[version:], version + 1):
        with store.changes():
            step(store)
            _note(store, at, at)  # its pointer moves last
        done.append(step.__name__.lstrip("_"))
    return done


def opened(store: Store, legacy: bool, migrate: bool = False) -> list[str]:
    """Brings a store to the present schema, or refuses it; returns the steps that ran.

    A new store is noted as present. One without notes (``legacy``: it has tables) runs the
    chain, and one whose chain was stopped goes on. A complete one of an older build is refused
    unless ``migrate``, a newer one always.
    """
    version, target = noted(store)
    if not version and not legacy:
        _note(store, 1, len(STEPS))
        return []
    if max(version, target) > len(STEPS):
        raise SchemaError(f"the store's schema {max(version, target)} is newer than this build's {len(STEPS)}; use a newer build")
    if version and version == target < len(STEPS) and not migrate:
        raise SchemaError(f"the store's schema {version} is behind {len(STEPS)}; migrate it")
    return migrated(store, version)
