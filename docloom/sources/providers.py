"""Model providers behind three protocols, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Texts to vectors of one dimension."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Relevance of texts to a query, as logits."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Describer(Protocol):
    """Figures of an image, as dictionaries with a description."""

    def describe(self, image: bytes, prompt: str) -> list[dict]: ...


class Recogniser(Protocol):
    """Texts and icons in an image, as dictionaries with type, content and box."""

    def recognise(self, image: bytes) -> list[dict]: ...


class PdfReader(Protocol):
    """The pages of a PDF as markdown."""

    def pages(self, content: bytes) -> list[str]: ...


class Renderer(Protocol):
    """Gives a page's HTML after its scripts have run, null where it can't."""

    def render(self, url: str) -> str | None: ...


class Tokeniser(Protocol):
    """Where the tokens of a text end, in code points, ascending."""

    def ends(self, text: str) -> list[int]: ...


class WordTokeniser:
    """Runs without white space as tokens."""

    WORD = re.compile(r"[^\x20\x09-\x0D]+")

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.WORD.finditer(text)]


class FileTokeniser:
    """Tokens of a vocabulary file of the tokenizers library; it travels to the tasks with its vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def ends(self, text: str) -> list[int]:
        return [end for _, end in self.model.encode(text, add_special_tokens=False).offsets]


class HashEmbedder:
    """Sums of words' random signs, unit length; equal texts have equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                signs = np.frombuffer(hashlib.shake_128(word.encode()).digest(-(-self.dim // 8)), np.uint8)
                row += np.unpackbits(signs)[: self.dim] * 2.0 - 1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


class OverlapReranker:
    """Logits from the share of the query's words a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [8 * len(words & set(t.lower().split())) / max(1, len(words)) - 4 for t in texts]


def embedded(df: DataFrame, text: str, provider: Embedder, batch: int = 32, out: str = "embedding") -> DataFrame:
    """``df`` with vectors; texts go to the provider in batches, and a vector of another dimension is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, vectors = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                vectors += provider.embed(texts[at : at + batch])
            if any(len(v) != provider.dim for v in vectors):
                raise ValueError(f"the provider's vectors do not have {provider.dim} components")
            yield pd.Series(vectors)

    return df.withColumn(out, run(text))


#: Fixed value: tokens of a query and a passage together, and those of them that mark begin, border and end.
PAIR_TOKENS, PAIR_MARKS = 512, 3
#: Pairs of a batch that are Python strings at once.
PAIRS_AT_ONCE = 64


def pair_lengths(query: int, passage: int, most: int) -> tuple[int, int]:
    """Tokens that stay of a pair: the longer text gives until both fit, or both are halves; the odd token is the longer one's, or the passage's."""
    if query + passage <= most:
        return query, passage
    short = min(query, passage, most // 2)
    return (most - short, short) if query > passage else (short, most - short)


def cut_pair(query: str, passage: str, tokeniser: Tokeniser, most: int = PAIR_TOKENS - PAIR_MARKS, query_ends: list[int] | None = None) -> tuple[str, str]:
    """Both texts up to the end of their last token that stays; whole texts if all stay."""
    ends = (tokeniser.ends(query) if query_ends is None else query_ends, tokeniser.ends(passage))
    kept = pair_lengths(len(ends[0]), len(ends[1]), most)
    return tuple(text if n == len(e) else text[: e[n - 1]] if n else "" for text, e, n in zip((query, passage), ends, kept))


def cut_pairs(pairs: DataFrame, tokeniser: Tokeniser, query: str = "query", passage: str = "passage", most: int = PAIR_TOKENS - PAIR_MARKS) -> DataFrame:
    """``pairs`` with both texts cut to ``most`` tokens together; a null text counts as empty."""

    @F.arrow_udf("q string, p string")
    def run(queries: pa.Array, passages: pa.Array) -> pa.Array:
        out = [pa.StructArray.from_arrays([pa.array([], pa.string())] * 2, ["q", "p"])]
        for at in range(0, len(queries), PAIRS_AT_ONCE):
            both = (x.slice(at, PAIRS_AT_ONCE).to_pylist() for x in (queries, passages))
            cut = [cut_pair(q or "", p or "", tokeniser, most) for q, p in zip(*both, strict=True)]
            out.append(pa.StructArray.from_arrays([pa.array(side, pa.string()) for side in zip(*cut, strict=True)], ["q", "p"]))
        return pa.concat_arrays(out)

    return pairs.withColumn("__cut", run(query, passage)).withColumn(query, F.col("__cut.q")).withColumn(passage, F.col("__cut.p")).drop("__cut")


def reranked(query: str, provider: Reranker, tokeniser: Tokeniser | None = None, most: int = PAIR_TOKENS - PAIR_MARKS):
    """(chunk_id, content) -> (chunk_id, rerank_score): sigmoid of the provider's logits.

    With a tokeniser every pair of query and text is cut to ``most`` tokens before it is scored;
    texts that leave the query alike are scored together.
    """

    def logits(texts: list[str]) -> list[float]:
        if tokeniser is None:
            return provider.score(query, texts)
        ends, groups = tokeniser.ends(query), {}
        for at, text in enumerate(texts):
            q, p = cut_pair(query, text, tokeniser, most, ends)
            groups.setdefault(q, []).append((at, p))
        out = [0.0] * len(texts)
        for q, members in groups.items():
            for (at, _), score in zip(members, provider.score(q, [p for _, p in members])):
                out[at] = score
        return out

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        x = np.asarray(logits(texts.fillna("").tolist()), dtype=float)
        e = np.exp(-np.abs(x))  # large logits of either sign have a sigmoid too
        return pd.Series(np.where(x >= 0, 1 / (1 + e), e / (1 + e)))

    return lambda pool: pool.select("chunk_id", run("content").alias("rerank_score"))


def described(images: DataFrame, provider: Describer, prompt: str = "Describe the figures.") -> DataFrame:
    """(key, image) -> (key, n, description): figures of images; those without a description are left out."""
    key = images.columns[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, f["description"].strip()) for k, image in zip(part[key], part["image"]) for i, f in enumerate(provider.describe(image, prompt)) if isinstance(f.get("description"), str) and f["description"].strip()]
            yield pd.DataFrame(rows, columns=[key, "n", "description"])

    return images.mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, n int, description string")


def recognised(images: DataFrame, provider: Recogniser | None) -> DataFrame:
    """(key, image) -> (key, pos, type, content): elements of images, in order; none without a provider."""
    key = images.columns[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, i, e.get("type") or "text", e["content"]) for k, image in zip(part[key], part["image"]) for i, e in enumerate(provider.recognise(image) if provider else []) if isinstance(e.get("content"), str)]
            yield pd.DataFrame(rows, columns=[key, "pos", "type", "content"])

    return images.mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, pos int, type string, content string")
