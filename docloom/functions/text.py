"""Text expressions: tokens, hashes, keywords, names, stems."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no search intent.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "could", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during",
    "each", "few", "for", "from", "further", "get", "got", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "let", "me", "more", "most", "my", "myself", "no", "nor", "not", "of",
    "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than",
    "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your", "yours",
    "yourself", "yourselves", "also", "use", "used", "using", "can't", "won't", "shall", "may", "might", "must", "need", "vs", "best", "better", "good",
    "well", "many", "much", "several", "won", "don", "doesn", "didn", "shouldn", "couldn", "wouldn", "isn", "aren", "hasn", "weren", "via", "based",
)
# Function words that do not count when titles are compared.
TITLE_STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "be", "by", "with", "from", "as", "its", "this",
    "that", "not", "but", "no", "via", "using", "based",
)

WORD = r"[\p{L}\p{N}]+"
#: Control characters that are removed from extracted strings.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_EDGE_MARKS = ".,;:!?()[]{}\"'"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one accent, and the letters without it."""
    blocks = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in blocks if chr(c).islower()]
    pairs = [(c, parts[0]) for c, parts in pairs if len(parts) == 2 and parts[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


ACCENTED, PLAIN = _folds()
_FOLD = str.maketrans(ACCENTED, PLAIN)
#: Combining accents, which folding drops.
_ACCENTS = "[\u0300-\u0331]"


def tokens(text: Column | str, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits; ``fold`` removes accents of Latin letters."""
    text = F.lower(text)
    if fold:
        text = F.translate(F.regexp_replace(text, _ACCENTS, ""), ACCENTED, PLAIN)
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def query_tokens(text: str, stem_words: bool, fold: bool) -> list[str]:
    """The tokens of a query's string, as those of a text."""
    text = text.lower()
    if fold:
        text = re.sub(_ACCENTS, "", text).translate(_FOLD)
    words = re.findall(r"[^\W_]+", text)
    return [stem(w) for w in words] if stem_words else words


def content_hash(text: Column | str) -> Column:
    """First 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def normal_query(query: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(query, r"^\s+", ""), r"\s+$", ""))


def query_hash(query: Column | str) -> Column:
    return F.sha2(normal_query(query), 256)


def clean_string(text: Column | str, most: int) -> Column:
    """``text`` without control characters, cut to ``most``."""
    return F.substring(F.regexp_replace(text, CONTROL, ""), 1, most)


def contains_fold(text: Column | str, part: Column | str) -> Column:
    """Substring test that ignores the case of letters; wildcards in ``part`` mean themselves."""
    return F.contains(F.lower(text), F.lower(part))


def surname(author: Column) -> Column:
    """Lower-cased surname of 'Last, First' or 'First Last'."""
    return F.lower(F.when(author.contains(","), F.trim(F.substring_index(author, ",", 1))).otherwise(F.substring_index(F.trim(author), " ", -1)))


def keywords(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, query) -> (query_id, keyword, rank): intent words of each query.

    Stopwords go, and so do single characters unless they stand alone in upper case. Words
    score their count, joined words half a point more; ties go to the earlier word.
    """
    marks = re.escape(_EDGE_MARKS)
    alone = F.transform(
        F.filter(F.split(F.regexp_replace("query", r"\s+", " "), " "), lambda w: F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "").rlike(r"^\p{Lu}$")),
        lambda w: F.lower(F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")),
    )
    found = F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_\-.]*[\p{L}\p{N}_]|[\p{L}\p{N}_]"), F.lit(0))
    each = queries.select("query_id", alone.alias("alone"), F.posexplode(found).alias("pos", "keyword"))
    kept = each.where(~F.col("keyword").isin(list(STOPWORDS)) & ((F.length("keyword") > 1) | F.array_contains("alone", F.col("keyword"))))
    scored = kept.groupBy("query_id", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    scored = scored.withColumn("score", F.col("n") + F.when(F.col("keyword").rlike(r"[-.]"), 0.5).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "keyword", "rank")


def match_query(ranked: DataFrame) -> DataFrame:
    """(query_id, keyword, rank) -> (query_id, match): quoted keywords joined by OR."""
    quoted = F.concat(F.lit('"'), F.replace("keyword", F.lit('"'), F.lit('""')), F.lit('"'))
    listed = F.array_sort(F.collect_list(F.struct("rank", quoted.alias("q"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["q"]), " OR ").alias("match"))


# --- Porter stemming -------------------------------------------------------------------

_SHORT = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_NEXT = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _form(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _ends_cvc(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _by_table(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """Porter stem of a lower-case English word; the bytes of other letters count as consonants."""
    if not word.isascii():
        return _stem(word.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "replace")
    return _stem(word)


def _stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith("sses") and len(word) > 4 or word.endswith("ies") and len(word) > 3:
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _form(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _by_table(_by_table(word, _SHORT), _NEXT)
    for end in sorted((*_LAST, "sion", "tion"), key=len, reverse=True):
        if word.endswith(end):
            rest = word[:-3] if end in ("sion", "tion") else word[: -len(end)]
            if _measure(rest) > 1:
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _ends_cvc(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


class _Stems(dict):
    """Stems of the words met so far; beyond KEPT_STEMS it starts anew."""

    def __missing__(self, word: str) -> str:
        if len(self) >= KEPT_STEMS:
            self.clear()
        self[word] = out = stem(word)
        return out


KEPT_STEMS = 200_000


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Porter stems of the words of arrays; of a batch only its distinct words become strings."""
    each = words.flatten().dictionary_encode()
    known = _Stems()
    stemmed = pa.array([None if w is None else known[w] for w in each.dictionary.to_pylist()], pa.string())
    ends = np.append(0, np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stemmed.take(each.indices), mask=words.is_null())


def terms(text: Column | str, stem_words: bool = False, fold: bool = False) -> Column:
    """The search terms of a text, in order."""
    found = tokens(text, fold)
    return stems(found) if stem_words else found
