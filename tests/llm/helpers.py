"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

LONG = "lorem ipsum dolor " * 20000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (3, None, None, None, None),
    (None, "no id here", "en", "b", 1),
    (None, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b ", "en", "b", 5),
    (6, LONG, "la", "c", len(LONG)),
    (7, "é ü ß 漢字 \U0001f600 naïve", "fr", "é", 3),
    (8, "one", "en", "a", 3),
    (9, "one two", "en", "b", 7),
    (-3, "x y   z\x1cw", "en", "\U0001f600", 3),
]


def odd(spark, extra: bool = False):
    """The awkward documents; ``extra`` adds columns with the operators' own names."""
    df = spark.createDataFrame(ODD, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "key", "cell", "score", "spans", "items", "n_words", "shard", "slot", "fp", "root", "node", "copies", "target", "term", "row", "bucket"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def none(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)


def save(df, folder, name: str):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same_rows(left, right) -> bool:
    key = lambda r: repr(tuple(r))
    return sorted(left, key=key) == sorted(right, key=key)
