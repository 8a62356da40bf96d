"""Secret scans with a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that any match must contain:
literals give trigrams joined by AND, branches are joined by OR, and what can't be pinned
down asks for nothing. For each batch of documents an inverted index of the asked trigrams
is built in one pass over its bytes; the postings are intersected and united as the query
says, and only the candidates are verified with the regex. A rule without a mandatory
trigram scans every document.

Spans are code points, end exclusive. Base kinds are assign, access and hex; the rules
after them add spans of their own kinds.

Cases: null texts are empty; matches that fail a rule's length are dropped without a retry;
overlapping spans of different kinds all stay; repeated rows stay; null ids stay null; very
long texts are read in time that grows with their length; an empty table gives no rows; columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import sliced, utf8
from docloom.session import table

# Fixed values: (kind, regex, letters in either case, group whose length counts, least length).
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    ("hex", r"[0-9a-f]{24,}", False, 0, 24),  # runs are maximal, so this is as dropping shorter ones
)
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 1),
    # a run that begins no token is matched once and dropped, as group 1 is empty there; no later place in it could begin one
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)|eyJ[A-Za-z0-9_-]+", False, 1, 40),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
    ("map_key", r"AIza[0-9A-Za-z_-]+", False, 0, 39),
    ("pay", r"[rs]k_live_[0-9A-Za-z]+", False, 0, 24),
    ("url_login", r"://[^/\s:@]+:[^/\s:@]+@", False, 0, 1),
    ("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", True, 0, 27),
)
RULES = BASE_RULES + MORE_RULES
MOST_STRINGS = 64


def _cross(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST_STRINGS else None


def _exact(items, fold: bool) -> set[str] | None:
    """All strings a sequence can match, or None if they are too many."""
    out = {""}
    for op, value in items:
        if op is C.LITERAL:
            here = {chr(value)}
        elif op is C.IN and all(o is C.LITERAL for o, _ in value) and len(value) <= 8:
            here = {chr(v) for _, v in value}
        elif op is C.SUBPATTERN:
            here = _exact(value[3], fold)
        elif op is C.BRANCH:
            parts = [_exact(b, fold) for b in value[1]]
            here = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
            part = _exact(value[2], fold)
            here = None if part is None else part | {""}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == value[1] and value[0] <= 8:
            part, here = _exact(value[2], fold), {""}
            for _ in range(value[0]):
                here = None if here is None or part is None else _cross(here, part)
        else:
            here = None
        out = None if here is None else _cross(out, here)
        if out is None:
            return None
    return {x.lower() for x in out} if fold else out


def _trigrams(string: str) -> tuple:
    """AND of the trigrams of a string; None if it has none."""
    raw = string.encode()
    found = {raw[i : i + 3] for i in range(len(raw) - 2)}
    return ("and", *sorted(("tri", t) for t in found)) if found else None


def _either(strings: set[str]) -> tuple | None:
    parts = [_trigrams(s) for s in sorted(strings)]
    return None if None in parts or not parts else ("or", *parts)


def _query(items, fold: bool) -> tuple | None:
    """Boolean trigram query of a parsed sequence; None asks for nothing."""
    needs, run = [], []

    def close() -> None:
        """The longest stretches of the run with few strings become needs."""
        start = 0
        while start < len(run):
            stop = len(run)
            while stop > start and (strings := _exact(run[start:stop], fold)) is None:
                stop -= 1
            if stop > start:
                if (need := _either(strings)) is not None:
                    needs.append(need)
                start = stop
            else:
                start += 1
        run.clear()

    for op, value in items:
        if _exact([(op, value)], fold) is not None:
            run.append((op, value))
            continue
        close()
        inner = None
        if op is C.SUBPATTERN:
            inner = _query(value[3], fold)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            inner = _query(value[2], fold)
        elif op is C.BRANCH:
            parts = [_query(b, fold) for b in value[1]]
            inner = None if None in parts else ("or", *parts)
        if inner is not None:
            needs.append(inner)
    close()
    return ("and", *needs) if needs else None


def trigram_query(pattern: str, fold: bool) -> tuple | None:
    """The Boolean trigram query of a regex, in lower case if ``fold``; None means every document."""
    return _query(list(_parser.parse(pattern)), fold)


def trigrams_of(query: tuple | None) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1:]))


class TrigramIndex:
    """Postings of the asked trigrams over a batch of documents."""

    def __init__(self, asked: set[bytes]):
        self.codes = np.array(sorted(int.from_bytes(t, "big") for t in asked), np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def build(self, texts: list[bytes]) -> None:
        """Sorted unique (trigram, document) pairs of the batch."""
        self.n = len(texts)
        joined = np.frombuffer(b"\n\n\n".join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) + 3 for t in texts[:-1]])
        pairs = []
        for at in range(0, max(0, len(joined) - 2), 1 << 20):
            part = joined[at : at + (1 << 20) + 2].astype(np.int32)
            code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            hit = np.flatnonzero(self.wanted[code])
            doc = np.searchsorted(starts, hit + at, side="right") - 1
            pairs.append(np.unique(code[hit].astype(np.int64) * self.n + doc))
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.gram, self.doc = found // max(1, self.n), found % max(1, self.n)

    def candidates(self, query: tuple | None) -> np.ndarray:
        """Documents that satisfy a query, rising."""
        if query is None:
            return np.arange(self.n)
        if query[0] == "tri":
            code = int.from_bytes(query[1], "big")
            return self.doc[np.searchsorted(self.gram, code) : np.searchsorted(self.gram, code + 1)]
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    """Compiled rules with their queries."""

    def __init__(self, rules=RULES):
        self.rules = []
        for kind, pattern, fold, group, least in rules:
            compiled = re.compile(pattern, re.ASCII | (re.IGNORECASE if fold else 0))
            self.rules.append((kind, compiled, fold, group, least, trigram_query(pattern, fold)))
        self.plain = TrigramIndex(set().union(*(trigrams_of(r[5]) for r in self.rules if not r[2])))
        self.folded = TrigramIndex(set().union(*(trigrams_of(r[5]) for r in self.rules if r[2])))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each document's spans, sorted."""
        self.plain.build(texts)
        self.folded.build([t.lower() for t in texts])
        decoded: dict[int, str] = {}
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for at, (_, regex, fold, group, least, query) in enumerate(self.rules):
            for d in (self.folded if fold else self.plain).candidates(query).tolist():
                if d not in decoded:
                    decoded[d] = texts[d].decode("utf-8", "replace")
                text = decoded[d]
                for m in regex.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        out[d].append((m.start(), at, m.end()))
        return [sorted(x) for x in out]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of documents; a span has kind, start and end."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in sliced(batches, 1):
            rows = [[{"kind": RULES[k][0], "start": a, "end": b} for a, k, b in spans] for spans in scanner.scan(list(utf8(part.column(1))))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, span)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts, digest and list of spans: the columns of the query."""
    kinds = ", ".join(f"'{k[0]}'" for k in BASE_RULES)
    text = "concat(s.kind, ':', s.start, ':', s.end)"
    base = f"array_join(transform(filter(spans, s -> s.kind IN ({kinds})), s -> {text}), ',')"
    return spans.selectExpr(
        "doc_id",
        *[f"cast(size(filter(spans, s -> s.kind = '{k[0]}')) as bigint) AS n_{k[0]}" for k in BASE_RULES],
        f"sha2({base}, 256) AS base_sha256",
        f"array_join(transform(spans, s -> {text}), ',') AS spans",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return digest(scan(table(spark, sf_dir, "documents")))


def brute_spans(text: str | None, rules=RULES) -> list[tuple[int, int, int]]:
    """Spans by running every rule over the text; for tests."""
    out = []
    for at, (_, pattern, fold, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text or "", re.ASCII | (re.IGNORECASE if fold else 0)):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), at, m.end()))
    return sorted(out)


def brute_digest(text: str | None) -> str:
    spans = [f"{RULES[k][0]}:{a}:{b}" for a, k, b in brute_spans(text) if k < len(BASE_RULES)]
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def _sql() -> str:
    """The rules one by one, with letters in either case written out, as RE2's own folding goes beyond ASCII."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    rules = [
        ("assign", f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
        ("code_host", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
        ("map_key", "AIza[0-9A-Za-z_-]+", 0, 39),
        ("pay", "[rs]k_live_[0-9A-Za-z]+", 0, 24),
        ("url_login", "://[^/\\x09-\\x0D\\x20:@]+:[^/\\x09-\\x0D\\x20:@]+@", 0, 1),
        ("bearer", f"{either('bearer')}\\x20+[A-Za-z0-9._~+/=-]+", 0, 27),
    ]
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {group}) AS v, string_split_regex(t, '{regex}') AS g FROM d" for i, (kind, regex, group, least) in enumerate(rules)
    )
    listed = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({parts}),
e AS (SELECT r, k, kind, least, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, unnest(range(0, len(m))) AS i FROM f WHERE len(m) > 0),
p AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS stop FROM e),
s AS (SELECT r, k, kind, stop - length(m) AS start, stop FROM p WHERE length(v) >= least),
a AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({listed}, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base, string_agg({listed}, ',' ORDER BY start, k, stop) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


OP10_SQL = _sql()
