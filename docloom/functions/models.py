"""Pluggable scorers, and deterministic ones for tests.

Real encoders, rerankers and language models are external: implement the protocol and pass it in. The stand-ins
here are hashes and overlaps, so that every stage around a model can be tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as X


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEncoder:
    """Signed hashes of words in a few dimensions."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out


class OverlapScorer:
    """Share of the query's words that the text has."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray:
        pairs = [(set((q or "").lower().split()), set((t or "").lower().split())) for q, t in zip(queries, texts, strict=True)]
        return np.array([len(q & t) / max(1, len(q)) for q, t in pairs])


class EchoGenerator:
    def generate(self, prompts: list[str]) -> list[str]:
        return [p.rsplit("\n", 1)[-1] for p in prompts]


def encode(texts: Column, encoder: Encoder, batch: int = 32) -> Column:
    """Vectors of unit length, encoded in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            parts = [encoder.encode(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            v = np.concatenate(parts) if parts else np.empty((0, 1))
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return run(texts)


def unit(vector: Column) -> Column:
    """A vector of unit length; zero stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def score(query: Column, text: Column, scorer: Scorer) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(q.fillna("").tolist(), t.fillna("").tolist()))

    return run(query, text)


def generate(df: DataFrame, prompt: str, out: str, model: Generator, batch: int = 4) -> DataFrame:
    """Adds the model's replies; a batch that runs out of memory is halved until it fits."""

    def replies(prompts: list[str]) -> list[str]:
        try:
            return model.generate(prompts)
        except MemoryError:
            if len(prompts) == 1:
                raise
            half = len(prompts) // 2
            return replies(prompts[:half]) + replies(prompts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [r for i in range(0, len(f), batch) for r in replies(f[prompt].iloc[i : i + batch].fillna("").tolist())]
            yield f.assign(**{out: made})

    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.StringType())])
    return df.mapInPandas(run, schema)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has: a scorer that needs no model."""
    q = F.array_distinct(X.terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.terms(text))) / F.size(q)).otherwise(F.lit(0.0))
