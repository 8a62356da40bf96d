"""License scans by an exact set-similarity join of text blocks with license templates.

A template of L words is compared with the blocks of 2 L consecutive words of a text. A block
meets a template if it holds ``THRESHOLD`` of the template's distinct words (containment).
Blocks begin at every place that holds a word of the template; any other block holds no more
of it than the next such one. Words are ordered by their frequency in the whole collection,
rarest first. Of a template with k words of which o must be found, every meeting block holds
one of the first k - o + 1 (prefix filter); a block with fewer than o places of template words
can't meet it (length filter); and a block whose first common word has place i in the order
can add only k - i - 1 further words, and no more than it has places of words after i
(positional filter). What passes is counted exactly. Meeting blocks that overlap are merged.

Besides, base phrases are found where their words stand consecutively. They give the base
labels; templates add theirs.

Templates are a table (label, text) of notices or whole license texts; a fixed list stands in
for it. They go to the tasks in blocks of about ``BLOCK_WORDS`` words, one block at a time,
and what is found with a block is written before the next one. Frequencies are counted over
all documents, for the templates' words.

Cases: null texts are empty; empty texts have no place and no label; templates without a
label or a word are left out; overlapping phrases all count; ties of frequency are ordered by
word, which changes the filters' work only; rows and ids repeat as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.llm.common import scan_words, sliced, sql_words, utf8, written
from docloom.session import table

# Phrase and label.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label and wording of license notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is distributed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("proprietary", "all rights reserved"),
)
THRESHOLD = 0.9
BLOCK_WORDS = 500_000


class Template:
    """A notice with its distinct words numbered from the rarest."""

    def __init__(self, label: str, words: list[bytes], number: dict[bytes, int], threshold: float):
        self.label, self.length = label, len(words)
        self.tokens = np.array(sorted({number[w] for w in words}))
        self.k = len(self.tokens)
        self.need = math.ceil(threshold * self.k - 1e-9)
        self.rank = dict(zip(self.tokens.tolist(), range(self.k)))
        self.prefix = self.tokens[: self.k - self.need + 1]


class Catalogue:
    """Templates with words numbered from the rarest, and base phrases."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, phrases=BASE_PHRASES, threshold: float = THRESHOLD):
        split = [(label, scan_words(text.encode())) for label, text in templates]
        known = {w for _, words in split for w in words} | {w for p, _ in phrases for w in p.encode().split()}
        order = sorted(known, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(order)}
        self.templates = [Template(label, words, self.number, threshold) for label, words in split if words]
        self.coded = [([self.number[w] for w in p.encode().split()], label) for p, label in phrases]
        # templates by the prefix words that call for them
        self.called: dict[int, list[int]] = {}
        for at, t in enumerate(self.templates):
            for word in t.prefix.tolist():
                self.called.setdefault(word, []).append(at)

    def asked(self, ids: np.ndarray) -> list[Template]:
        """Templates of which the words hold a prefix word."""
        return [self.templates[at] for at in sorted({at for word in set(ids.tolist()) & self.called.keys() for at in self.called[word]})]


def phrase_starts(ids: np.ndarray, coded: list[int]) -> np.ndarray:
    """Starts of a phrase in numbered words."""
    last = len(ids) - len(coded) + 1
    if last < 1:
        return np.empty(0, np.int64)
    hit = np.ones(last, bool)
    for i, c in enumerate(coded):
        hit &= ids[i : i + last] == c
    return np.flatnonzero(hit)


def may_meet(places: np.ndarray, ranks: np.ndarray, ends: np.ndarray, template: Template) -> tuple[np.ndarray, int]:
    """Blocks, by the index of their first place, that pass the filters, and how many the positional one turned away.

    Block i holds the places i to ends[i], whose words have these ranks in the template.
    """
    here, k, need = np.arange(len(places)), template.k, template.need
    long = ends - here >= need
    passed, open_ = np.zeros(len(places), bool), long.copy()
    for r in range(k - need + 1):
        if not open_.any():
            break
        among = np.concatenate([[0], np.cumsum(ranks == r)])
        first = open_ & (among[ends] > among[here])
        after = np.concatenate([[0], np.cumsum(ranks > r)])
        passed |= first & (1 + np.minimum(k - r - 1, after[ends] - after[here]) >= need)
        open_ &= ~first
    return np.flatnonzero(passed), int(np.count_nonzero(long & ~open_ & ~passed))


def distinct_ranks(ranks: list[int], blocks: np.ndarray, ends: np.ndarray, k: int) -> Iterator[int]:
    """Distinct words of each block, by sliding over the places once."""
    held, distinct, low, high = [0] * k, 0, 0, 0
    for start, end in zip(blocks.tolist(), ends[blocks].tolist()):
        if start >= high:  # nothing in common with the last block
            held, distinct, low, high = [0] * k, 0, start, start
        for r in ranks[high:end]:
            distinct += held[r] == 0
            held[r] += 1
        for r in ranks[low:start]:
            held[r] -= 1
            distinct -= held[r] == 0
        low, high = start, max(high, end)
        yield distinct


def template_blocks(ids: np.ndarray, known: np.ndarray, template: Template) -> list[tuple[int, int, float]]:
    """(start, end, containment) of the merged blocks that meet a template; ``known`` holds the places of numbered words."""
    places = known[np.isin(ids[known], template.tokens)]
    if len(places) < template.need:
        return []
    ranks = np.searchsorted(template.tokens, ids[places])
    ends = np.searchsorted(places, places + 2 * template.length)
    blocks, _ = may_meet(places, ranks, ends, template)
    merged: list[list] = []
    for i, n in zip(blocks.tolist(), distinct_ranks(ranks.tolist(), blocks, ends, template.k)):
        if n < template.need:
            continue
        start, end = int(places[i]), int(places[ends[i] - 1]) + 1
        if merged and start <= merged[-1][1]:
            merged[-1][1], merged[-1][2] = end, max(merged[-1][2], n / template.k)
        else:
            merged.append([start, end, n / template.k])
    return [tuple(m) for m in merged]


def scan_text(text: bytes, catalogue: Catalogue) -> dict:
    """Places, labels and score of a UTF-8 text."""
    words = scan_words(text)
    ids = np.fromiter(map(catalogue.number.get, words, repeat(-1)), np.int64, len(words))
    known = np.flatnonzero(ids >= 0)
    starts, base = [], set()
    more: dict[str, float] = {}
    blocks = []
    if len(known):
        for coded, label in catalogue.coded:
            at = phrase_starts(ids, coded)
            if len(at):
                starts.append(at)
                base.add(label)
        for template in catalogue.asked(ids[known]):
            for start, end, part in template_blocks(ids, known, template):
                blocks.append((start, end, template.label, part))
                more[template.label] = max(part, more.get(template.label, 0.0))
    places = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": int(places.min()) if len(places) else None, "last_word": int(places.max()) if len(places) else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | set(more))), "score": max([1.0 * bool(base), *more.values()]),
        "blocks": [{"start": a, "end": b, "label": label, "containment": p} for a, b, label, p in sorted(set(blocks))],
    }


def frequencies(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each wanted word stands in all documents; bounded by the templates' words."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in sliced(batches, 0):
            for text in utf8(batch.column(0)):
                total.update(filter(sent.value.__contains__, scan_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def blocks_of(templates: DataFrame | None, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Templates in blocks of about ``block_words`` words of text, by hash."""
    if templates is None:
        yield list(TEMPLATES)
        return
    templates = templates.select("label", "text").where("label is not null and text is not null")
    letters = templates.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = int(letters // (2 * block_words)) + 1  # words have two bytes at least, with their gap
    for i in range(blocks):
        yield [tuple(r) for r in templates.where(F.pmod(F.xxhash64("label", "text"), F.lit(blocks)) == i).distinct().collect()]


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:long,end:long,label:string,containment:double>>"


def _with_block(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, text, found) of documents, for one block of templates."""
    wanted = {w for _, text in [*templates, *((p, p) for p, _ in BASE_PHRASES)] for w in scan_words(text.encode())}
    sent = docs.sparkSession.sparkContext.broadcast(Catalogue(frequencies(docs, wanted), templates))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("found", T.StructType.fromDDL(FOUND))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            rows = [scan_text(x, sent.value) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), pa.array(rows, arrow.field(2).type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def scan(docs: DataFrame, templates: DataFrame | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of documents."""
    out = None
    for block in blocks_of(templates, block_words):
        if out is None:
            out = _with_block(docs, block)
            continue
        before = written(out.withColumnRenamed("found", "had"), "licenses")
        packed = before.select(F.struct("doc_id", "had").alias("doc_id"), "text")
        now = _with_block(packed, block).select("doc_id.doc_id", "text", "doc_id.had", "found")
        labels = F.array_sort(F.array_distinct(F.filter(F.concat(F.split("had.labels", ","), F.split("found.labels", ",")), lambda x: x != "")))
        both = F.col("found").withField("labels", F.array_join(labels, ",")).withField("score", F.greatest("had.score", "found.score"))
        out = now.select("doc_id", "text", both.withField("blocks", F.array_sort(F.array_distinct(F.concat("had.blocks", "found.blocks")))).alias("found"))
    return out.select("doc_id", "found.*")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def brute_labels(text: str | None, templates=TEMPLATES) -> dict[str, float]:
    """Template labels, with the greatest containment, by counting every template in every block; for tests."""
    words, out = scan_words((text or "").encode()), {}
    for label, wording in templates:
        w = scan_words(wording.encode())
        for start in range(len(words)):
            part = len(set(words[start : start + 2 * len(w)]) & set(w)) / len(set(w))
            if part >= THRESHOLD - 1e-9:
                out[label] = max(part, out.get(label, 0.0))
    return out


def _sql() -> str:
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in BASE_PHRASES)
    templates = ", ".join(f"('{label}', {text.split()})" for label, text in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
ph(label, p) AS (VALUES {phrases}),
te(label, t) AS (VALUES {templates}),
hit AS (SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM d, ph WHERE len(w) >= len(p)),
base AS (SELECT r, count(*) AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word FROM hit GROUP BY r),
block AS (SELECT r, label, t, unnest(list_transform(list_filter(range(0, len(w)), lambda i: list_contains(t, w[i + 1])), lambda i: w[i + 1:i + 2 * len(t)])) AS b FROM d, te WHERE len(list_intersect(w, t)) >= {THRESHOLD} * len(list_distinct(t)) - 1e-9),
met AS (SELECT r, label, len(list_intersect(list_distinct(b), list_distinct(t)))::DOUBLE / len(list_distinct(t)) AS c, len(list_distinct(t)) AS n, len(list_intersect(list_distinct(b), list_distinct(t))) AS k FROM block),
l AS (SELECT r, label, 1 AS base, 1.0::DOUBLE AS c FROM hit UNION ALL SELECT r, label, 0, c FROM met WHERE k >= {THRESHOLD} * n - 1e-9),
g AS (SELECT r, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM l GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN g USING (r)
"""


OP3_SQL = _sql()
