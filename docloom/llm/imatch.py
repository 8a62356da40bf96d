"""I-Match document fingerprints with randomised lexicons, in DataFrame operations alone.

The lexicon holds the terms whose share of documents lies in a chosen band: neither so
frequent that they say nothing nor so rare that a slip makes them. Of a text the distinct
terms in the lexicon are kept and sorted, and a hash is taken of them and of those in each
of several random subsets of the lexicon. Small subsets survive edits, the whole tells texts
apart; the likeness of two fingerprints is the share of equal hashes among the subsets that
either text has terms of.

A lexicon has at most (mean distinct terms of a document) / ``BAND[0]`` terms, whatever the
size of the collection. Up to ``MOST_LITERAL`` terms it is a set inside the expression that
filters a text's terms, so texts are shuffled once, to stand beside the next one, and terms
never; a larger one is joined by shuffle.

Cases: null texts are empty; texts without a lexicon term are hashed whole, so equal texts
(letter case A-Z aside) have equal fingerprints; documents are ordered by id (null first),
repeated ids by a hash of the text; a single document is its own next one; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import BUCKET_ROWS, WORD_BREAKS, ascii_lower, bucketed, small, written
from docloom.session import table

#: Least and greatest share of documents of a lexicon term.
BAND = (0.005, 0.2)
#: (one term in so many, first bit of the term's hash that says so) of each subset; the first holds the whole lexicon.
SUBSETS = [(1, 0), *((rate, 10 * i) for rate, n in ((4, 3), (16, 4), (64, 6), (256, 6), (1024, 6)) for i in range(n))]
DIGITS = 8
#: The hash of no terms.
NONE = "d41d8cd9"
MOST_LITERAL = 100_000


def terms(text: Column) -> Column:
    return F.split(ascii_lower(text), WORD_BREAKS)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(term) of the terms in the band."""
    n = docs.count()
    low, high = max(2, -int(-band[0] * n // 1)), int(band[1] * n)
    each = docs.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).where("term <> ''")
    return written(each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("term"), "lexicon")


def known_terms(texts: DataFrame, column: str, words: DataFrame, out: str, most: int = MOST_LITERAL) -> DataFrame:
    """``texts`` with the sorted distinct lexicon terms of a column."""
    known = [r.term for r in words.limit(most + 1).collect()]
    if len(known) <= most:
        kept = F.filter(F.array_distinct(terms(F.col(column))), lambda w: w.isin(known) if known else F.lit(False))
        return texts.withColumn(out, F.array_sort(kept))
    each = texts.select("bucket", "pos", F.explode(F.array_distinct(terms(F.col(column)))).alias("term")).join(words, "term")
    grouped = each.groupBy("bucket", "pos").agg(F.array_sort(F.collect_list("term")).alias(out))
    joined = texts.join(grouped, ["bucket", "pos"], "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def hashed(text: Column) -> Column:
    """60 bits of a text's MD5, by which documents of one id are ordered."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_bits(found: str) -> Column:
    """Terms with the 60 bits of their hash that choose their subsets."""
    return F.transform(found, lambda t: F.struct(t.alias("term"), hashed(t).alias("bits")))


def in_subset(s: int) -> Callable[[Column], Column]:
    """Whether a term is in subset s: some bits of its hash, other ones for each subset of a rate, are zero."""
    rate, shift = SUBSETS[s]
    return lambda x: F.shiftright(x["bits"], shift) % rate == 0


def fingerprint(found: str, whole: str) -> Column:
    """Joined subset hashes of sorted (term, bits); ``whole`` stands in for a text without any."""
    parts = [F.substring(F.md5(F.array_join(F.transform(F.filter(found, in_subset(s)), lambda x: x["term"]), " ")), 1, DIGITS) for s in range(len(SUBSETS))]
    return F.when(F.size(found) == 0, F.repeat(whole, F.lit(len(SUBSETS)))).otherwise(F.concat(*parts))


def likeness(left: str, right: str) -> Column:
    """Share of equal hashes among the subsets that either has terms of."""
    at = ", ".join(str(1 + DIGITS * i) for i in range(len(SUBSETS)))
    pair = f"transform(array({at}), i -> struct(substring({left}, i, {DIGITS}) AS l, substring({right}, i, {DIGITS}) AS r))"
    live = f"filter({pair}, x -> x.l <> '{NONE}' OR x.r <> '{NONE}')"
    return F.expr(f"aggregate({live}, struct(0 AS same, 0 AS n), (a, x) -> struct(a.same + if(x.l = x.r, 1, 0), a.n + 1), a -> CAST(a.same AS double) / greatest(a.n, 1))")


def chained(docs: DataFrame, rows_of_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Rows of documents in buckets of the id's order, each with the next document's text.

    A bucket also gets the first row of the following one (the last bucket that of the
    first), marked by ``flag`` 1, so no row needs another bucket.
    """
    t, first = F.coalesce("text", F.lit("")), F.lit(-(1 << 63))
    rows = docs.select("doc_id", t.alias("t"), F.coalesce(F.col("doc_id").cast("long"), first).alias("k"), hashed(t).alias("h"))
    rows, _, buckets, _ = bucketed(rows, "k", "h", "bucket", rows_of_bucket)
    order = Window.orderBy("bucket")
    heads = rows.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("m")).select("bucket", "m.*")
    back = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    marked = rows.join(small(heads.select("bucket", "k", "h", back.alias("back")), buckets), ["bucket", "k", "h"], "left")
    place = lambda b, flag: F.struct(F.col(b).alias("bucket"), F.lit(flag).alias("flag"))
    both = F.when(F.col("back").isNotNull(), F.array(place("bucket", 0), place("back", 1))).otherwise(F.array(place("bucket", 0)))
    rows = marked.select("doc_id", "k", "h", "t", F.explode(both).alias("p")).select("doc_id", "k", "h", "t", "p.*")
    within = Window.partitionBy("bucket").orderBy("flag", "k", "h", "t")
    return rows.select("doc_id", "bucket", "flag", "t", F.row_number().over(within).alias("pos"), F.coalesce(F.lead("t").over(within), F.lit("")).alias("next"))


def prints(docs: DataFrame, band: tuple[float, float] = BAND, most: int = MOST_LITERAL, rows_of_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and their likenesses."""
    words = lexicon(docs, band)
    rows = chained(docs, rows_of_bucket).withColumn("n_chars", F.length("t").cast("long"))
    half = F.expr("cast(shiftright(n_chars, 1) as int)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("t"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.withColumn("edited", F.when(F.col("flag") == 0, F.col("edited")).otherwise(""))
    found = known_terms(known_terms(rows, "t", words, "own", most), "edited", words, "other", most)
    whole = lambda c: F.substring(F.md5(ascii_lower(c)), 1, DIGITS)
    bare = found.select("bucket", "pos", "flag", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), whole("t").alias("w0"), whole("edited").alias("w1"), with_bits("own").alias("own"), with_bits("other").alias("other"))
    printed = bare.select("bucket", "pos", "flag", "doc_id", "n_chars", "edited_sha256", fingerprint("own", "w0").alias("fingerprint"), fingerprint("other", "w1").alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("pos"))
    out = printed.withColumn("next_fingerprint", following).where("flag = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return prints(table(spark, sf_dir, "documents"))


def _sql() -> str:
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_distinct(string_split_regex({low.format('{}')}, '{breaks}'))"
    tests = [f"(y.bits >> {shift}) % {rate} = 0" for rate, shift in SUBSETS]
    parts = " || ".join(
        f"substr(md5(coalesce(array_to_string(list_transform(list_filter(found, lambda y: {t}), lambda y: y.term), ' '), '')), 1, {DIGITS})" for t in tests
    )
    like = (
        "(SELECT count(*) FILTER (l = r)::DOUBLE / greatest(count(*), 1) FROM (SELECT substr({a}, i, 8) AS l, substr({b}, i, 8) AS r "
        f"FROM unnest(range(1, {8 * len(SUBSETS)}, 8)) u(i)) WHERE l <> '{NONE}' OR r <> '{NONE}')"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
df AS (SELECT term, count(*) AS n FROM (SELECT unnest({words.format('t')}) AS term FROM d) WHERE term <> '' GROUP BY term),
lex AS (SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS bits FROM df, (SELECT count(*) AS c FROM d)
  WHERE n BETWEEN greatest(2, ceil({BAND[0]}::DOUBLE * c)) AND floor({BAND[1]}::DOUBLE * c)),
o AS (SELECT *, length(t) AS n_chars, lead(t) OVER (ORDER BY doc_id NULLS FIRST, md5(t), t) AS nx,
    first_value(t) OVER (ORDER BY doc_id NULLS FIRST, md5(t), t) AS f, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(t), t) AS pos FROM d),
e AS (SELECT *, left(t, (n_chars - n_chars // 2)::BIGINT) || left(coalesce(nx, f), (n_chars // 2)::BIGINT) AS edited FROM o),
v AS (SELECT pos, 0 AS kind, t AS x FROM e UNION ALL SELECT pos, 1, edited FROM e),
m AS (SELECT pos, kind, list(struct_pack(term := term, bits := bits) ORDER BY term) AS found
  FROM (SELECT pos, kind, unnest({words.format('x')}) AS term FROM v) JOIN lex USING (term) GROUP BY pos, kind),
p AS (SELECT v.pos, v.kind, CASE WHEN found IS NULL THEN repeat(substr(md5({low.format('x')}), 1, {DIGITS}), {len(SUBSETS)}) ELSE {parts} END AS fp
  FROM v LEFT JOIN m USING (pos, kind)),
q AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
    coalesce(lead(a.fp) OVER (ORDER BY e.pos), first_value(a.fp) OVER (ORDER BY e.pos)) AS nf
  FROM e JOIN p a ON a.pos = e.pos AND a.kind = 0 JOIN p b ON b.pos = e.pos AND b.kind = 1)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {like.format(a='fingerprint', b='edited_fingerprint')} AS near_edited, {like.format(a='fingerprint', b='nf')} AS near_next FROM q
"""


OP5_SQL = _sql()
