"""External models behind small interfaces, with deterministic stand-ins.

A model is a column function over batches: no network exists in tests, so the stand-ins hash and count. Results that
rest on them say nothing about quality of real models.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import tokens


class Embedder(Protocol):
    dims: int

    def __call__(self, texts: pd.Series) -> pd.Series: ...


class Completer(Protocol):
    def __call__(self, prompts: pd.Series) -> pd.Series: ...


class PairScorer(Protocol):
    """Entailment, relevance or the like of (premise, hypothesis), 0..1."""

    def __call__(self, left: pd.Series, right: pd.Series) -> pd.Series: ...


class HashEmbedder:
    """Counts of hashed words, signed, at unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(self.dims)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dims] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)


def embed(model: Embedder) -> Callable[[Column], Column]:
    """Vectors of texts, in Arrow batches."""
    return F.pandas_udf(lambda s: model(s), "array<float>")  # noqa: PLW0108


def complete(model: Completer) -> Callable[[Column], Column]:
    """Answers to prompts; an error of the model gives null, which callers treat as failed."""

    def run(s: pd.Series) -> pd.Series:
        try:
            return model(s)
        except Exception:  # noqa: BLE001  a failed call must not end the job
            return pd.Series([None] * len(s), dtype=object)

    return F.pandas_udf(run, "string")


def score(model: PairScorer) -> Callable[[Column, Column], Column]:
    return F.pandas_udf(lambda a, b: model(a, b), "double")


def lexical_score(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' distinct words that the premise has: the stand-in for entailment and relevance, as a plain expression."""
    words = F.array_distinct(tokens(hypothesis))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, tokens(premise))), F.size(words)), F.lit(0.0)).cast("double")


def windows(words: Column, width: int = 380, stride: int = 190) -> Column:
    """Overlapping word windows of a passage; one that is short is one window."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)) + stride - 1, F.lit(stride))
    return F.when(n <= width, F.array(words)).otherwise(F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(width))))
