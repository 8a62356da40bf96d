import hashlib
import re

from docloom.llm import imatch
from tests.llm.helpers import ODD, none, odd, save


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows: list[tuple], band=imatch.BAND) -> dict:
    """Fingerprints by the plain rule: (doc_id, text) -> by position in order."""
    docs = sorted(((i, t or "") for i, t, *_ in rows), key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).hexdigest()))
    cut = lambda t: {w for w in re.split(imatch.WORD_BREAKS, lower(t)) if w}
    df: dict[str, int] = {}
    for _, t in docs:
        for w in cut(t):
            df[w] = df.get(w, 0) + 1
    n = len(docs)
    known = {w for w, c in df.items() if max(2, -(-band[0] * n // 1)) <= c <= band[1] * n}

    def fp(t):
        words = sorted(cut(t) & known, key=lambda w: w.encode())
        if not words:
            return hashlib.md5(lower(t).encode()).hexdigest()[:8] * len(imatch.SUBSETS)
        bits = {w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words}
        return "".join(hashlib.md5(" ".join(w for w in words if (bits[w] >> s) % r == 0).encode()).hexdigest()[:8] for r, s in imatch.SUBSETS)

    def like(a, b):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
        live = [(x, y) for x, y in pairs if (x, y) != (imatch.NONE, imatch.NONE)]
        return sum(x == y for x, y in live) / max(1, len(live))

    out = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp(t), fp(edited), round(like(fp(t), fp(edited)), 9), round(like(fp(t), fp(after)), 9)))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


def test_odd_table_against_brute_force(spark, tmp_path):
    folder = save(odd(spark, True), tmp_path, "documents")
    assert got(imatch.op5_imatch(spark, folder)) == sorted(brute(ODD), key=repr)


def test_many_documents_both_ways(spark):
    texts = [f"word{i % 7} word{i % 11} Word{i % 13} é{i % 5} common tail{i}" for i in range(150)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows), key=repr)
    assert got(imatch.prints(df)) == want
    assert got(imatch.prints(df, most=0)) == want  # terms joined by shuffle
    assert got(imatch.prints(df, rows_of_bucket=3)) == want  # ranges cut into buckets


def test_equal_texts_have_equal_fingerprints(spark):
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = imatch.op5_imatch(spark, SF).collect()
    by = {}
    for r in rows:
        assert by.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows)


def test_empty_and_single(spark, tmp_path):
    assert imatch.op5_imatch(spark, save(none(spark), tmp_path, "documents")).count() == 0
    one = imatch.prints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_one_id_holds_many_rows(spark):
    rows = [(None if i % 3 else i, f"text {i % 40} of {i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rows_of_bucket in (5, 20_000):
        assert got(imatch.prints(df, rows_of_bucket=rows_of_bucket)) == sorted(brute(rows), key=repr)
