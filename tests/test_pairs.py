"""Pairs of query and passage within a budget of tokens."""

import itertools
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.sources import providers

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.json")


def one_by_one(query, passage, most):
    """Takes a token at a time from the longer text; of two of one length the query gives first."""
    while query + passage > most:
        if query >= passage:
            query -= 1
        else:
            passage -= 1
    return query, passage


def test_lengths_equal_taking_tokens_one_by_one():
    for q, p, most in itertools.product(range(14), range(14), range(12)):
        got = providers.pair_lengths(q, p, most)
        assert sum(got) == min(q + p, most) and got[0] <= q and got[1] <= p
        # of two halves the odd token is the longer text's
        assert got == one_by_one(q, p, most) or q > p > most // 2 and got == one_by_one(q, p, most)[::-1]


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file")
def test_equal_to_the_tokenizers_own_truncation():
    from tokenizers import Tokenizer

    mine, theirs = providers.FileTokeniser(str(VOCABULARY)), Tokenizer.from_file(str(VOCABULARY))
    base = "The rate of gróws falls with depth, as tables 3 and 4 show; überraschend ist das nicht."
    texts = ["", "one", base[:30], base, base * 3]
    for q, p in itertools.product(texts, texts):
        for most in (2, 7, 16, 41, 509):
            theirs.enable_truncation(most)
            want = theirs.encode(q, p, add_special_tokens=False)
            ends = [[e for (_, e), s in zip(want.offsets, want.sequence_ids) if s == i] for i in (0, 1)]
            cut = providers.cut_pair(q, p, mine, most)
            for text, whole, kept in zip(cut, (q, p), ends):
                assert text == whole[: kept[-1] if kept else 0]


class Seen:
    """Gives logits by the lengths of what it is shown."""

    def score(self, query, texts):
        return [len(query.split()) * 100 + len(t.split()) for t in texts]


def test_reranker_sees_cut_pairs(spark):
    pool = spark.createDataFrame([(1, "w " * 600), (2, "w " * 3), (3, None), (4, "w " * 600)], "chunk_id long, content string")
    scored = providers.reranked("q " * 300, providers.OverlapReranker(), providers.WordTokeniser(), 20)(pool)
    assert {r.chunk_id for r in scored.collect()} == {1, 2, 3, 4}
    texts, query = ["w " * 600, "w " * 3, "", "w " * 600], "q " * 300
    cut = [providers.cut_pair(query, t, providers.WordTokeniser(), 20) for t in texts]
    assert [(len(q.split()), len(p.split())) for q, p in cut] == [(10, 10), (17, 3), (20, 0), (10, 10)]
    far = {r.chunk_id: r.rerank_score for r in providers.reranked("q " * 300, Seen(), providers.WordTokeniser(), 20)(pool).collect()}
    assert far == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}  # logits beyond a thousand
    near = {r.chunk_id: r.rerank_score for r in providers.reranked("", Seen(), providers.WordTokeniser(), 2)(pool).collect()}
    assert near == pytest.approx({1: 1 / (1 + math.exp(-2)), 2: 1 / (1 + math.exp(-2)), 3: 0.5, 4: 1 / (1 + math.exp(-2))})


def test_nulls_and_other_columns(spark):
    pairs = spark.createDataFrame([(1, None, "a b c"), (2, "x  y z", None), (3, " a ", "b ")], "id int, query string, passage string").withColumn("q", F.lit("own"))
    got = [tuple(r) for r in providers.cut_pairs(pairs, providers.WordTokeniser(), most=2).orderBy("id").collect()]
    assert got == [(1, "", "a b", "own"), (2, "x  y", "", "own"), (3, " a ", "b ", "own")]
