"""Full-text search: postings, BM25, and a boolean query language over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import query_tokens, terms
from docloom.session import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
_MATCHED = T.StructType().add("holds", T.BooleanType()).add("tf", T.ArrayType(T.IntegerType()))
#: Query words that a filter holds as a set.
MOST_TERMS = 5000
#: Keys of several rows that a filter holds as a set.
MOST_KEYS = 5000
#: Rows of a batch that are Python objects at once.
ROWS_AT_ONCE = 256


def occurrences(chunks: DataFrame, key: str, text: str, stem: bool = False, fold: bool = False) -> DataFrame:
    """(key, pos, term): every word of every chunk."""
    return chunks.select(key, F.posexplode(terms(F.col(text), stem, fold)).alias("pos", "term"))


def come_again(rows: DataFrame, key: str, most: int = MOST_KEYS) -> Column | None:
    """Whether a row's key is null or that of another row, too; None if more than ``most`` keys come again."""
    several = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    again = [r[key] for r in several.select(key).limit(most + 1).collect()]
    if len(again) > most:
        return None
    return F.col(key).isNull() | F.col(key).isin(again) if again else F.col(key).isNull()


def postings(chunks: DataFrame, key: str, text: str, stem: bool = False, fold: bool = False, most: int = MOST_KEYS) -> DataFrame:
    """(term, key, tf) of chunks.

    A chunk's words are in one row, so they are counted there: sorted, equal words are a run.
    Only chunks whose keys come again are counted by term and key; if more than ``most`` keys
    do, all are.
    """
    counted = lambda some: occurrences(some, key, text, stem, fold).groupBy("term", key).agg(F.count("*").alias("tf"))
    again = come_again(chunks, key, most)
    if again is None:
        return counted(chunks)
    words = chunks.where(~again).select(key, F.sort_array(terms(F.col(text), stem, fold)).alias("words"))
    places = F.slice(F.sequence(F.lit(0), F.size("words")), 1, F.size("words"))
    begins = F.filter(places, lambda i: ~F.equal_null(F.get("words", i), F.get("words", i - 1)))
    # inline takes an expression: of a column Spark would derive a filter and compute the words once more below it
    end = lambda run: F.coalesce(F.get("begins", run + 1), F.size("words"))
    runs = F.transform("begins", lambda at, run: F.struct(F.get("words", at).alias("term"), (end(run) - at).alias("tf")))
    return words.select(key, "words", begins.alias("begins")).select(key, F.inline(runs)).select("term", key, F.col("tf").cast("long").alias("tf")).unionByName(counted(chunks.where(again)))


def bm25(queries: DataFrame, chunks: DataFrame, key: str, text: str = "content", stem: bool = False, fold: bool = False, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, key, score): BM25 of chunks for the distinct words of each query, higher is better.

    ``queries`` has (query_id, term); their words are stemmed and folded as the texts' are.
    Frequencies and lengths come from all chunks, also where a filter follows. The text is
    read once: of each chunk its length and those words remain that the queries ask for; up to
    ``most`` words are a set in that filter, more are joined.
    """
    wanted = queries.select("query_id", F.explode(terms("term", stem, fold)).alias("term")).distinct()
    asked = [r.term for r in wanted.select("term").distinct().limit(most + 1).collect()]
    narrow = chunks.select(F.col(key), terms(F.col(text), stem, fold).alias("all"))
    if len(asked) <= most:
        kept = F.filter("all", lambda w: w.isin(asked) if asked else F.lit(False))
        narrow = written(narrow.select(key, F.size("all").alias("len"), kept.alias("found")), "bm25")
        each = narrow.select(key, "len", F.explode("found").alias("term"))
    else:
        each = occurrences(chunks, key, text, stem, fold).join(wanted.select("term").distinct(), "term", "left_semi")
        narrow = written(narrow.select(key, F.size("all").alias("len")), "bm25")
        each = each.join(narrow, key)
    hits = each.groupBy("term", key, "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    whole = F.broadcast(narrow.agg(F.count("*").alias("n"), F.sum("len").alias("words")))  # one row
    scored = hits.join(df, "term").crossJoin(whole).withColumn("weight", impact())
    return wanted.join(scored, "term").groupBy("query_id", key).agg(F.sum("weight").alias("score"))


def impact(**given: Column) -> Column:
    """BM25 of one word in one chunk, from tf, df, len, n (chunks) and words (of all chunks): columns, or those given."""
    tf, df, size, n, words = (given.get(c, F.col(c)) for c in ("tf", "df", "len", "n", "words"))
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (words / n)))


def top(scored: DataFrame, key: str, k: int, digits: int = 9, by: str = "score", descending: bool = True) -> DataFrame:
    """The k best rows of each query with their rank; scores are rounded first, ties go by key."""
    scored = scored.withColumn(by, F.round(by, digits))
    order = F.desc(by) if descending else F.asc(by)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


# --- boolean queries -------------------------------------------------------------------

_LEXER = re.compile(r'"((?:[^"]|"")*)"(\*?)|([()+])|(NEAR)\s*\(|([\w]+)(\*?)|,|(\S)')


class QueryError(ValueError):
    """A query that can't be parsed; a search leg then is empty."""


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False


@dataclass
class Node:
    op: str  # and, or, not, near
    parts: list
    distance: int = 10


def parse(query: str) -> Phrase | Node:
    """Implicit AND, AND, OR, NOT, parentheses, "phrases", prefix*, + and NEAR(a b, n); NOT binds tightest, then AND, OR."""
    items: list[tuple[str, object]] = []
    for m in _LEXER.finditer(query):
        quoted, star, mark, near, word, word_star, other = m.groups()
        if near:
            items.append(("near", None))
        elif quoted is not None:
            items.append(("phrase", Phrase(re.findall(r"\w+", quoted.replace('""', '"').lower()), star == "*")))
        elif word:
            items.append((word, None) if word in ("AND", "OR", "NOT") else ("phrase", Phrase([word.lower()], word_star == "*")))
        elif mark:
            items.append((mark, None))
        elif m[0] == ",":
            items.append((",", None))
        else:
            raise QueryError(f"unexpected {other!r}")
    at = 0

    def peek() -> str | None:
        return items[at][0] if at < len(items) else None

    def take(kind: str):
        nonlocal at
        if peek() != kind:
            raise QueryError(f"expected {kind}")
        at += 1
        return items[at - 1][1]

    def primary():
        if peek() == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        if peek() == "near":
            take("near")
            parts, distance = [], 10
            while peek() == "phrase":
                parts.append(take("phrase"))
            if peek() == ",":
                take(",")
                distance = int(take("phrase").words[0])
            take(")")
            return Node("near", parts, distance)
        found = take("phrase")
        while peek() == "+":
            take("+")
            more = take("phrase")
            found = Phrase(found.words + more.words, more.prefix)
        return found

    def without():
        left = primary()
        while peek() == "NOT":
            take("NOT")
            left = Node("not", [left, primary()])
        return left

    def every():
        parts = [without()]
        while peek() in ("AND", "phrase", "(", "near"):
            if peek() == "AND":
                take("AND")
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def either():
        parts = [every()]
        while peek() == "OR":
            take("OR")
            parts.append(every())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    tree = either()
    if at < len(items):
        raise QueryError("words after the end")
    return tree


def _phrase_spans(words: DataFrame, key: str, phrase: Phrase) -> DataFrame:
    """(key, first, last): where a phrase stands."""
    out = None
    for i, word in enumerate(phrase.words):
        here = words.where(F.col("term").startswith(word) if phrase.prefix and i + 1 == len(phrase.words) else F.col("term") == word)
        here = here.select(key, (F.col("pos") - i).alias("first")).distinct()
        out = here if out is None else out.join(here, [key, "first"], "left_semi")
    return out.withColumn("last", F.col("first") + len(phrase.words) - 1)


def matching(words: DataFrame, key: str, query: str | Phrase | Node) -> DataFrame:
    """Keys of the chunks that a boolean query matches."""
    tree = parse(query) if isinstance(query, str) else query
    if isinstance(tree, Phrase):
        if not tree.words:
            return words.select(key).where(F.lit(False))
        return _phrase_spans(words, key, tree).select(key).distinct()
    if tree.op == "near":
        spans = [_phrase_spans(words, key, p) for p in tree.parts]
        if not spans:
            raise QueryError("NEAR of nothing")
        out = spans[0].select(key, "first", "last", F.col("last").alias("reach"))
        for s in spans[1:]:
            s = s.select(key, F.col("first").alias("f2"), F.col("last").alias("l2"))
            gap = F.greatest("first", "f2") - F.least("reach", "l2") - 1
            out = out.join(s, key).where(gap <= tree.distance).select(key, F.least("first", "f2").alias("first"), F.greatest("last", "l2").alias("last"), F.greatest("reach", "l2").alias("reach")).distinct()
        return out.select(key).distinct()
    parts = [matching(words, key, p) for p in tree.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p).distinct() if tree.op == "or" else out.join(p, key, "left_anti" if tree.op == "not" else "left_semi")
    return out


def normal(tree: Phrase | Node, stem: bool, fold: bool) -> Phrase | Node:
    """A query with its words as the index has them."""
    if isinstance(tree, Phrase):
        return Phrase([t for w in tree.words for t in query_tokens(w, stem, fold)], tree.prefix)
    return Node(tree.op, [normal(p, stem, fold) for p in tree.parts], tree.distance)


def phrases(tree: Phrase | Node, scoring: bool = False) -> list[Phrase]:
    """The phrases of a query, repeats included; those after NOT don't score."""
    if isinstance(tree, Phrase):
        return [tree]
    parts = tree.parts[:1] if scoring and tree.op == "not" else tree.parts
    return [p for part in parts for p in phrases(part, scoring)]


def plain_words(tree: Phrase | Node) -> tuple[list[str], bool] | None:
    """(words, whether all are asked for) of a query of distinct words joined by OR or by AND; None for any other."""
    parts = [tree] if isinstance(tree, Phrase) else tree.parts if tree.op in ("or", "and") else []
    words = [p.words[0] for p in parts if isinstance(p, Phrase) and len(p.words) == 1 and not p.prefix]
    if not words or len(words) < len(parts) or len(set(words)) < len(words):
        return None
    return words, isinstance(tree, Node) and tree.op == "and"


def _spans(words: dict[str, list[int]], phrase: Phrase) -> list[tuple[int, int]]:
    """(first, last) of the places of a phrase in a chunk's words."""
    if not phrase.words:
        return []
    last = phrase.words[-1]
    ends = {p for w, places in words.items() if (w.startswith(last) if phrase.prefix else w == last) for p in places}
    n = len(phrase.words) - 1
    for i, w in enumerate(phrase.words[:-1]):
        ends &= {p + n - i for p in words.get(w, ())}
    return [(e - n, e) for e in sorted(ends)]


def _holds(words: dict[str, list[int]], tree: Phrase | Node) -> bool:
    """Whether a chunk with these words meets a query."""
    if isinstance(tree, Phrase):
        return bool(_spans(words, tree))
    if tree.op == "near":
        met = [(a, b, b) for a, b in _spans(words, tree.parts[0])] if tree.parts else []
        for part in tree.parts[1:]:
            spans = _spans(words, part)
            met = [(min(a, c), max(b, d), max(reach, d)) for a, b, reach in met for c, d in spans if max(a, c) - min(reach, d) - 1 <= tree.distance]
        return bool(met)
    found = (_holds(words, p) for p in tree.parts)
    return next(found) and not any(found) if tree.op == "not" else all(found) if tree.op == "and" else any(found)


def scored_matches(postings_: DataFrame, lengths: DataFrame, key: str, tree: Phrase | Node) -> DataFrame:
    """(query_id, key, score) of the chunks that a query matches, from the postings (term, key, positions) of its words.

    The words of a chunk come together once; the query is held against them, and its phrases
    are counted. BM25 is over phrases: one is as frequent in a chunk as it stands there.
    ``lengths`` has (key, len) of all chunks; others are gone.
    """
    asked: dict[tuple, int] = {}
    for p in phrases(tree, True):
        if p.words:
            asked[tuple(p.words), p.prefix] = asked.get((tuple(p.words), p.prefix), 0) + 1
    each = [Phrase(list(ws), prefix) for ws, prefix in asked]

    @F.arrow_udf(_MATCHED)
    def held(lists: pa.Array) -> pa.Array:
        holds, tf = [], []
        for at in range(0, len(lists), ROWS_AT_ONCE):
            for items in lists.slice(at, ROWS_AT_ONCE).to_pylist():
                words = {x["term"]: x["positions"] for x in items}
                holds.append(_holds(words, tree))
                tf.append([len(_spans(words, p)) for p in each])
        return pa.StructArray.from_arrays([pa.array(holds, pa.bool_()), pa.array(tf, pa.list_(pa.int32()))], ["holds", "tf"])

    grouped = postings_.groupBy(key).agg(F.collect_list(F.struct("term", "positions")).alias("words")).join(lengths, key)
    found = written(grouped.select(key, "len", held("words").alias("m")).select(key, "len", "m.*"), "matches")
    totals = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(each))]
    df = found.agg(*totals).first() if each else []
    whole = lengths.agg(F.count("*").alias("n"), F.sum("len").alias("words")).first()
    score = F.lit(0.0)
    for i, times in enumerate(asked.values()):
        one = {"tf": F.col("tf")[i], "df": F.lit(df[i]), "n": F.lit(whole.n), "words": F.lit(whole.words)}
        score = score + F.lit(times) * impact(**one)
    return found.where("holds").select(F.lit(0).alias("query_id"), key, score.alias("score"))
