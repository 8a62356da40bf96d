"""Extracted facts: methods, datasets, metrics, entities; their validation, resolution and comparison."""

from __future__ import annotations

import json
import logging
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import CONTROL

# Bounds of an extraction.
NAME_LENGTH, DESCRIPTION_LENGTH, MOST_ENTITIES, MOST_METRICS, MOST_FORMS = 200, 2000, 50, 200, 20
SINGLE_PASS_CHARS, SECONDS_PER_CHUNK = 8000, 4
_CONTROL = re.compile(CONTROL)
_THOUGHT = re.compile(r"<(think|thinking|thought)>.*?</\1>", re.S | re.I)

RESOLVE = "Group the names that mean the same thing. Answer {\"groups\": [{\"canonical\": name, \"type\": method or dataset, \"members\": [names]}]}.\n"

EXTRACTED = "paper_id long, chunk_id long, kind string, name string, description string, surface_forms array<string>, value double, unit string, method string, dataset string"


def _clean(text: object, most: int) -> str | None:
    return _CONTROL.sub("", text)[:most] if isinstance(text, str) else None


def model_json(answer: str) -> object:
    """The JSON value of a model's answer, without reasoning tags and fences before or after it."""
    decoder = json.JSONDecoder()
    # a model may put its whole answer among its thoughts
    for text in (_THOUGHT.sub("", answer), answer):
        for mark in "{[":
            at = text.find(mark)
            while at >= 0:
                try:
                    return decoder.raw_decode(text, at)[0]
                except ValueError:
                    at = text.find(mark, at + 1)
    raise ValueError("no JSON in the answer")


def validated(data: object) -> dict[str, list[dict]]:
    """Methods, datasets and metrics of an extraction; items of wrong types go, long strings are cut."""
    if not isinstance(data, dict):
        raise ValueError("an extraction is an object")
    out: dict[str, list[dict]] = {}
    for kind, most in (("methods", MOST_ENTITIES), ("datasets", MOST_ENTITIES), ("metrics", MOST_METRICS)):
        items = data.get(kind) or []
        if not isinstance(items, list):
            raise ValueError(f"{kind} is a list")
        out[kind] = [c for c in map(_metric if kind == "metrics" else _entity, items[:most]) if c]
    return out


def _entity(item: object) -> dict | None:
    if not isinstance(item, dict) or not isinstance(item.get("name"), str) or not item["name"].strip():
        return None
    forms = item.get("surface_forms")
    forms = [_clean(f, NAME_LENGTH) for f in forms[:MOST_FORMS] if isinstance(f, str)] if isinstance(forms, list) else None
    return {"name": _clean(item["name"].strip(), NAME_LENGTH), "description": _clean(item.get("description"), DESCRIPTION_LENGTH), "surface_forms": forms, "chunk_id": item.get("chunk_id")}


def _metric(item: object) -> dict | None:
    if not isinstance(item, dict) or not isinstance(item.get("metric"), str) or not item["metric"].strip():
        return None
    try:
        value = float(item.get("value"))
    except (TypeError, ValueError):
        return None
    if not math.isfinite(value):
        return None
    return {"name": _clean(item["metric"].strip(), NAME_LENGTH), "value": value, "chunk_id": item.get("chunk_id")} | {k: _clean(item.get(k), NAME_LENGTH) for k in ("unit", "method", "dataset")}


def resolution(answer: str) -> list[tuple[str, str, str]]:
    """(kind, surface, canonical_name) of a model's answer {"groups": [{"canonical", "type", "members"}]}; odd groups go."""
    data = model_json(answer)
    groups = data.get("groups") if isinstance(data, dict) else None
    out = {}
    for g in groups if isinstance(groups, list) else []:
        name = _clean(g.get("canonical"), NAME_LENGTH) if isinstance(g, dict) else None
        members = g.get("members") if name else None
        for m in members if isinstance(members, list) else []:
            if isinstance(m, str) and m.strip():
                out[g.get("type") if g.get("type") in ("method", "dataset") else "method", m.strip().lower()] = name
    return [(kind, surface, name) for (kind, surface), name in out.items()]


def resolved_groups(found: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """(kind, surface, canonical_name): one call of the model about all mentions of a paper; without an answer that can be read, none.

    A paper has at most MOST_ENTITIES names of a kind for each chunk.
    """
    spark = found.sparkSession
    schema = "kind string, surface string, canonical_name string"
    names = [{"name": r.name, "type": r.kind, "surface_forms": r.surface_forms} for r in mentions(found).orderBy("kind", "key").collect()]
    try:
        rows = resolution(model(RESOLVE + json.dumps(names))) if names else []
    except Exception as e:  # the model is the user's; what was extracted stays as it is
        logging.getLogger(__name__).warning("no resolution: %s", e)
        rows = []
    return spark.createDataFrame(rows, schema)


def whole_papers(chunks: DataFrame) -> DataFrame:
    """Papers of up to SINGLE_PASS_CHARS as one text, under their first chunk; the others by chunk."""
    sized = chunks.groupBy("paper_id").agg(F.sum(F.length("content")).alias("n"), F.array_sort(F.collect_list(F.when(F.length("content") <= SINGLE_PASS_CHARS, F.struct("chunk_index", "chunk_id", "content")))).alias("c"))
    short = sized.where(F.col("n") <= SINGLE_PASS_CHARS)
    whole = short.select("paper_id", F.col("c")[0]["chunk_id"].alias("chunk_id"), F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"))
    return whole.unionByName(chunks.join(short.select("paper_id"), "paper_id", "left_anti").select("paper_id", "chunk_id", "content"))


def extract(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Facts of (paper_id, chunk_id, content) by a model that answers JSON; a chunk whose answer can't be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in EXTRACTED.split(", ")]
        for batch in batches:
            rows = []
            for paper, chunk, content in zip(batch["paper_id"], batch["chunk_id"], batch["content"]):
                try:
                    found = validated(model_json(model(content or "")))
                except ValueError:
                    continue
                for kind, items in found.items():
                    rows += [{"paper_id": paper, "kind": kind.rstrip("s"), **item, "chunk_id": chunk} for item in items]
            frame = pd.DataFrame(rows, columns=columns).astype(object)
            yield frame.where(frame.notna(), None)

    return chunks.select("paper_id", "chunk_id", "content").mapInPandas(run, EXTRACTED)


def mentions(facts: DataFrame) -> DataFrame:
    """(paper_id, kind, key, name, surface_forms): mentions of one name, letter case aside, with all forms seen.

    The name is that of the first chunk.
    """
    named = facts.where("kind <> 'metric' AND trim(name) <> ''").withColumn("key", F.lower(F.trim("name")))
    forms = F.coalesce("surface_forms", F.array("name"))
    return named.groupBy("paper_id", "kind", "key").agg(F.min_by("name", F.struct("chunk_id", "name")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(forms)))).alias("surface_forms"))


def canonical(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """(paper_id, kind, canonical_name, description, chunk_id, surface_forms): entities after resolution.

    ``groups`` has (kind, surface, canonical_name). The description is the last non-empty one
    by chunk, and the chunk is where it stands.
    """
    named = facts.where("kind <> 'metric' AND trim(name) <> ''").withColumn("surface", F.lower(F.trim("name")))
    found = named.join(groups.select("kind", F.lower("surface").alias("surface"), "canonical_name"), ["kind", "surface"], "left")
    found = found.withColumn("canonical_name", F.coalesce("canonical_name", F.trim("name")))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.struct("chunk_id", "description"))
    forms = F.coalesce("surface_forms", F.array("name"))
    grouped = found.groupBy("paper_id", "kind", "canonical_name").agg(F.max(told).alias("told"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(forms)))).alias("surface_forms"))
    return grouped.select("paper_id", "kind", "canonical_name", F.col("told.description").alias("description"), F.col("told.chunk_id").alias("chunk_id"), "surface_forms")


def entity_mentions(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, kind, canonical_name, surface_form, chunk_id): each form once for a chunk."""
    forms = facts.where("kind <> 'metric'").select("paper_id", "kind", "chunk_id", F.explode(F.coalesce("surface_forms", F.array("name"))).alias("surface_form"))
    of = resolved.select("paper_id", "kind", "canonical_name", F.explode("surface_forms").alias("surface_form"))
    return forms.join(of, ["paper_id", "kind", "surface_form"]).select("paper_id", "kind", "canonical_name", "surface_form", "chunk_id").distinct()


def metrics_view(metrics: DataFrame, methods: DataFrame, datasets: DataFrame) -> DataFrame:
    """Metrics with the names of their method and dataset, where they have one."""
    m = methods.select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    return metrics.join(m, "method_id", "left").join(d, "dataset_id", "left")


def shared_datasets(datasets: DataFrame, papers: list[int] | None = None, least: int = 2) -> DataFrame:
    """(name, n_papers): datasets of at least ``least`` papers."""
    if papers is not None:
        datasets = datasets.where(F.col("paper_id").isin(papers))
    return datasets.groupBy("name").agg(F.count_distinct("paper_id").alias("n_papers")).where(F.col("n_papers") >= least)


def compare_papers(metrics: DataFrame, datasets: DataFrame, methods: DataFrame, papers: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Metric rows of papers on the datasets they share, by metric name, highest value first."""
    shared = shared_datasets(datasets, ids).select("name")
    d = datasets.join(shared, "name", "left_semi").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    m = methods.select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    p = papers.select("paper_id", "title")
    rows = metrics if ids is None else metrics.where(F.col("paper_id").isin(ids))
    out = rows.join(d, "dataset_id").join(m, "method_id", "left").join(p, "paper_id")
    place = F.row_number().over(Window.partitionBy("dataset", "name").orderBy(F.desc("value"), "paper_id", "id"))
    return out.select("dataset", F.col("name").alias("metric"), "value", "unit", "method", "paper_id", "title", place.alias("place"))


def cleared(facts: DataFrame, paper_id: int) -> DataFrame:
    """Facts without the extracted ones of a paper; those a user recorded stay."""
    return facts.where((F.col("paper_id") != paper_id) | (F.col("source") == "user"))


def extraction_estimate(chunks: DataFrame) -> DataFrame:
    """(paper_id, n_chunks, n_chars, single_pass, seconds)."""
    sized = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
    return sized.select("*", (F.col("n_chars") <= SINGLE_PASS_CHARS).alias("single_pass"), (F.col("n_chunks") * SECONDS_PER_CHUNK).alias("seconds"))
