"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base kinds are found by pattern: email, ip, card (Luhn) and phone. They are the seeds.
Identifiers that no base kind matches are sought among the white-space tokens with
``LEAST_DIGITS`` digits or a leading @ that touch no base span. Each occurrence of a seed or a
token has three lexical patterns: the word before it, the words before and after it, and the
word before it with its shape (runs of digits and letters shortened). Patterns and instances
(the values) form a graph, scored in turns: a pattern's confidence is the score of its distinct
instances over their number and a smoothing constant, an instance that is no seed gets the
greatest confidence of its patterns. So a pattern can also be learnt from instances that other
patterns discovered. After ``ROUNDS`` turns the patterns with enough score and confidence
discover the tokens that stand in them; these are added as kind context.

Matches are exploded and placed by running sums, as Spark's regex functions give no positions;
a text with many numbers costs no more than sorting them. The regexes take each run of
characters once, so long runs cost no more than their length.

Cases: null texts are empty; matches that fail a check are dropped without a retry; contexts
without a letter are no pattern; repeated rows and null ids stay, as rows are told apart by
a number of their own; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, split_join, written
from docloom.session import table

# Base kinds in order, as Java regexes that take runs whole (see _PLAIN for their plain form).
KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: White-space tokens with a digit or a leading @.
_TOKEN = r"(?<![^\x09-\x0D\x20])(?:@[^\x09-\x0D\x20]++|[^\x09-\x0D\x200-9]*+[0-9][^\x09-\x0D\x20]*+)"
CONTEXT = "context"
CONTEXT_CHARS = 48
LEAST_DIGITS = 6
ROUNDS = 3
SMOOTHING = 2.0
LEAST_SCORE = 3.0
CONFIDENCE = 0.5

_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    """The Luhn check of up to 19 digits, from the right."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _word(text: Column, side: int) -> Column:
    """The first (1) or last (-1) word of a text, its letters alone, A-Z lowered."""
    trim, cut = (F.ltrim, F.left) if side > 0 else (F.rtrim, F.right)
    near = trim(F.translate(cut(text, F.lit(CONTEXT_CHARS)), "\t\n\r", "   "))
    return ascii_lower(F.regexp_replace(F.substring_index(near, " ", side), r"[^\p{L}]", ""))


def extract(docs: DataFrame) -> DataFrame:
    """(row, doc_id, m_kind, g_kind, ...): matches of each kind, and the length, last and first word of the gaps around them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    has = {"email": F.col("t").contains("@"), "ip": F.col("t").rlike(r"[0-9]\.[0-9]"), "card": F.col("t").rlike("[0-9]"), "phone": F.col("t").contains("+"), "token": F.col("t").rlike("[0-9@]")}
    columns = []
    for name, pattern in [*_PATTERNS.items(), ("token", _TOKEN)]:
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        columns.append(F.when(has[name], found).otherwise(F.array().cast("array<string>")).alias(f"m_{name}"))
        gaps = F.transform(F.split("t", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), _word(g, -1).alias("last"), _word(g, 1).alias("first")))
        columns.append(F.when(has[name], gaps).otherwise(F.array().cast("array<struct<n:int,last:string,first:string>>")).alias(f"g_{name}"))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns), "pii")


def hits(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, before, after): checked base spans, and tokens (kind 4) that touch none of them."""
    zipped = "array<struct<value:string,gap:struct<n:int,last:string,first:string>>>"
    kinds = [F.struct(F.lit(i).alias("kind"), F.when(F.size(f"m_{k}") > 0, F.arrays_zip(f"m_{k}", f"g_{k}").cast(zipped)).alias("z")) for i, k in enumerate((*KINDS, "token"))]
    each = found.select("row", F.explode(F.array(*kinds)).alias("k")).select("row", "k.kind", F.posexplode("k.z").alias("i", "x"))
    along = Window.partitionBy("row", "kind").orderBy("i")
    size = F.coalesce(F.length("x.value"), F.lit(0))
    placed = each.repartition("row").select(
        "row", "kind", "x.value", F.col("x.gap.last").alias("before"), F.lead("x.gap.first").over(along).alias("after"), F.sum(F.col("x.gap.n") + size).over(along).cast("int").alias("end")
    )  # the last gap has no match
    placed = placed.where("value is not null").withColumn("start", F.col("end") - F.length("value"))
    good = F.coalesce(*[F.when(F.col("kind") == i, _valid(k, F.col("value"))) for i, k in enumerate(KINDS)])
    base = F.col("kind") < len(KINDS)
    token = ~base & (F.col("value").startswith("@") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= LEAST_DIGITS))
    kept = placed.where(F.when(base, good).otherwise(token))
    # a token touches a base span that begins no later and ends behind its start, or that begins inside it
    up = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumns({"reach": F.max(F.when(base, F.col("end"))).over(up), "next": F.min(F.when(base, F.col("start"))).over(down)})
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return written(kept.where(base | free).select("row", "kind", "start", "end", "value", "before", "after"), "pii")


def contexts() -> Column:
    """The patterns of an occurrence: its word before, both words, and the word before with the value's shape."""
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), r"\p{L}+", "a")
    both = F.when(F.col("after") != "", F.concat(F.lit("b "), F.col("before"), F.lit(" "), F.col("after")))
    named = F.array(F.concat(F.lit("l "), F.col("before")), both, F.concat(F.lit("s "), F.col("before"), F.lit(" "), shape))
    return F.when(F.col("before") != "", F.array_compact(named)).otherwise(F.array().cast("array<string>"))


def patterns(found: DataFrame) -> DataFrame:
    """(pattern, confidence, score, n) of the patterns that discover, after ROUNDS turns over the graph."""
    seed = F.max((F.col("kind") < len(KINDS)).cast("int")).alias("seed")
    edges = found.select("kind", "value", F.explode(contexts()).alias("pattern")).groupBy("pattern", F.xxhash64("value").alias("instance")).agg(seed)
    edges = written(edges, "pii")
    rows = edges.count()
    # an instance that is a seed anywhere is one everywhere
    known = F.max("seed").alias("known")
    scores = edges.groupBy("instance").agg(known).withColumn("score", F.col("known").cast("double"))
    scored = None
    for _ in range(ROUNDS):
        total = F.sum(F.round(F.col("score"), 9).cast("decimal(20,9)")).cast("double")
        scored = edges.select("pattern", "instance").join(scores, "instance").groupBy("pattern").agg(total.alias("score"), F.count("*").alias("n"))
        scored = written(scored.withColumn("confidence", F.col("score") / (F.col("n") + SMOOTHING)), "pii")
        best = split_join(edges, scored.select("pattern", "confidence", "n"), "pattern", "n", rows).groupBy("instance").agg(known, F.max("confidence").alias("best"))
        scores = written(best.select("instance", "known", F.when(F.col("known") == 1, F.lit(1.0)).otherwise(F.col("best")).alias("score")), "pii")
    return scored.where((F.col("score") >= LEAST_SCORE) & (F.col("confidence") >= CONFIDENCE))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): base spans and discovered ones of each document, as (start, kind, end) in order."""
    all_rows = extract(docs)
    found = hits(all_rows)
    good = written(patterns(found).select("pattern", "n"), "pii")
    tokens = found.where(F.col("kind") == len(KINDS)).select("row", "start", "kind", "end", F.explode(contexts()).alias("pattern"))
    more = split_join(tokens, good, "pattern", "n", tokens.count()).select("row", "start", "kind", "end").distinct()
    every = found.where(F.col("kind") < len(KINDS)).select("row", "start", "kind", "end").unionByName(more)
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = all_rows.select("row", "doc_id").join(spans, "row", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return out.select("doc_id", F.filter("spans", lambda x: x["kind"] < len(KINDS)).alias("base"), F.filter("spans", lambda x: x["kind"] == len(KINDS)).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and list of spans: the columns of the query."""
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, CONTEXT)) + ")"
    text = f"concat({names}[s.kind], ':', s.start, ':', s.end)"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(base, s -> s.kind = {i})) as bigint) AS n_{k}" for i, k in enumerate(KINDS)],
        f"sha2(array_join(transform(base, s -> {text}), ','), 256) AS base_sha256",
        f"array_join(transform(array_sort(concat(base, more)), s -> {text}), ',') AS spans",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return digest(detect(table(spark, sf_dir, "documents")))


def brute_base(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans by the plain patterns; for tests."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(_PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                good = 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
            elif kind == "phone":
                good = 10 <= len(digits) <= 15
            else:
                good = True
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def brute_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute_base(text)).encode()).hexdigest()


def _sql() -> str:
    """Matches by string_split_regex and regexp_extract_all, placed by running sums; the turns over the graph one by one."""
    plain = {k: v.replace("(", "(?:").replace("(?:?:", "(?:").replace("().", "().") for k, v in _PLAIN.items()}
    plain["phone"] = _PLAIN["phone"]  # its parentheses are characters
    parts = [
        f"SELECT r, {i} AS kind, regexp_extract_all(t, '{plain[k]}') AS m, string_split_regex(t, '{plain[k]}') AS g FROM d" for i, k in enumerate(KINDS)
    ]
    token = "[^\\x09-\\x0D\\x20]+"
    last = f"translate(regexp_replace(regexp_extract(rtrim(translate(right(gap, {CONTEXT_CHARS}), chr(9) || chr(10) || chr(13), '   '), ' '), '[^ ]*$'), '[^\\p{{L}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    first = f"translate(regexp_replace(regexp_extract(ltrim(translate(left(after, {CONTEXT_CHARS}), chr(9) || chr(10) || chr(13), '   '), ' '), '^[^ ]*'), '[^\\p{{L}}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    padded = f"lpad({digits}, 20, '0')"
    luhn = f"list_sum(list_transform(range(0, 20), lambda i: CASE WHEN i % 2 = 1 THEN {padded}[i + 1]::INT WHEN {padded}[i + 1]::INT > 4 THEN 2 * {padded}[i + 1]::INT - 9 ELSE 2 * {padded}[i + 1]::INT END)) % 10 = 0"
    turns = []
    for t in range(ROUNDS):
        turns.append(f"p{t} AS (SELECT pattern, sum(round(score, 9)::DECIMAL(20, 9))::DOUBLE AS score, count(*) AS n FROM edges JOIN s{t} USING (value) GROUP BY pattern)")
        turns.append(f"c{t} AS (SELECT *, score / (n + {SMOOTHING}) AS confidence FROM p{t})")
        turns.append(f"s{t + 1} AS (SELECT value, CASE WHEN max(seed) = 1 THEN 1.0::DOUBLE ELSE max(confidence) END AS score FROM edges JOIN c{t} USING (pattern) GROUP BY value)")
    names = [*KINDS, CONTEXT]
    listed = f"({names})[kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({' UNION ALL '.join(parts)}),
e AS (SELECT r, kind, unnest(m) AS value, unnest(g[1:len(m)]) AS gap, unnest(g[2:len(m) + 1]) AS after, unnest(range(0, len(m))) AS i FROM k WHERE len(m) > 0),
a AS (SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM e),
t0 AS (SELECT r, t, regexp_extract_all(t, '{token}') AS m, string_split_regex(t, '{token}') AS g FROM d),
t1 AS (SELECT r, t, unnest(m) AS value, unnest(g[1:len(m)]) AS gap, unnest(range(0, len(m))) AS i FROM t0 WHERE len(m) > 0),
t2 AS (SELECT *, (sum(length(gap) + length(value)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS stop FROM t1),
t3 AS (SELECT r, t, value, stop, stop - length(value) AS start FROM t2 WHERE starts_with(value, '@') AND length(value) > 1 OR length({digits}) > 0),
t4 AS (SELECT r, 4 AS kind, value, substr(t, coalesce(lag(stop) OVER o, 0) + 1, start - coalesce(lag(stop) OVER o, 0)) AS gap, substr(t, stop + 1, coalesce(lead(start) OVER o, length(t)) - stop) AS after, stop FROM t3 WINDOW o AS (PARTITION BY r ORDER BY start)),
w AS (SELECT r, kind, value, {last} AS before, {first} AS behind, stop::BIGINT AS stop, (stop - length(value))::BIGINT AS start FROM (SELECT r, kind, value, gap, after, stop FROM a UNION ALL SELECT * FROM t4)),
b AS (SELECT * FROM w WHERE kind = 0 OR kind = 1 AND len(list_filter(string_split(value, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT) > 255, true))) = 0
  OR kind = 2 AND length({digits}) BETWEEN 14 AND 19 AND {luhn} OR kind = 3 AND length({digits}) BETWEEN 10 AND 15),
q AS (SELECT * FROM w WHERE kind = 4 AND (starts_with(value, '@') OR length({digits}) >= {LEAST_DIGITS}) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND b.start < w.stop AND w.start < b.stop)),
x AS (SELECT * FROM b UNION ALL SELECT * FROM q),
y AS (SELECT *, unnest(['l ' || before, CASE WHEN behind <> '' THEN 'b ' || before || ' ' || behind END, 's ' || before || ' ' || regexp_replace(regexp_replace(value, '[0-9]+', '9', 'g'), '\\p{{L}}+', 'a', 'g')]) AS pattern FROM x WHERE before <> ''),
edges AS (SELECT pattern, value, max((kind < 4)::INT) AS seed FROM y WHERE pattern IS NOT NULL GROUP BY pattern, value),
s0 AS (SELECT value, max(seed)::DOUBLE AS score FROM edges GROUP BY value),
{', '.join(turns)},
good AS (SELECT pattern FROM c{ROUNDS - 1} WHERE score >= {LEAST_SCORE} AND confidence >= {CONFIDENCE}),
z AS (SELECT r, kind, start, stop FROM b UNION ALL SELECT DISTINCT r, kind, start, stop FROM y JOIN good USING (pattern) WHERE kind = 4),
f AS (SELECT r, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{n}" for i, n in enumerate(KINDS))}, string_agg({listed}, ',' ORDER BY start, kind, stop) FILTER (kind < 4) AS base, string_agg({listed}, ',' ORDER BY start, kind, stop) AS spans FROM z GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{n}, 0) AS n_{n}" for n in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)
"""


OP6_SQL = _sql()
