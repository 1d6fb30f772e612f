"""Models behind small protocols: what embeds a text, what scores a question against a passage, what writes an answer.

A model is any object with the methods below; it is shipped to the tasks and called on whole batches. The stand-ins need no
model files: hashed words as a vector, shared words as a score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.functions.text import STOPWORDS
from cordonlake.session import give_back, giving_back

MODEL_ROWS = 1_000  # rows that a model gets at once


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row per text; rows of zeros are left out of every search."""


class Scorer(Protocol):
    def score(self, questions: list[str], passages: list[str]) -> np.ndarray:
        """One relevance per pair, the higher the better."""


class Writer(Protocol):
    def write(self, prompts: list[str]) -> list[str]:
        """One response per prompt, JSON of the answer contract."""


_STOP = frozenset(STOPWORDS)


def terms(text: str | None) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 2 and w not in _STOP]


@lru_cache(maxsize=1 << 18)
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dim


class HashedWords:
    """Counts of the words of a text by ``dim`` buckets of their MD5."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in terms(t):
                out[i, _bucket(w, self.dim)] += 1
        return out


class SharedWords:
    """Share of a question's distinct words that the passage has."""

    def score(self, questions: list[str], passages: list[str]) -> np.ndarray:
        out, last, held = np.zeros(len(questions)), None, set()
        for i, (q, p) in enumerate(zip(questions, passages)):
            if p != last:  # pairs come by passage, each is read once
                last, held = p, set(terms(p))
            asked = set(terms(q))
            out[i] = len(asked & held) / len(asked) if asked else 0.0
        return out


def embed(df: DataFrame, id_col: str, text_col: str, model: Embedder, keep: str | None = None) -> DataFrame:
    """``id, tenant, v`` of the texts, as dense search takes them; texts whose vector is all zero are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), MODEL_ROWS):
                pdf = batch.iloc[a : a + MODEL_ROWS]
                v = model.embed(pdf["text"].tolist())
                used = np.abs(v).max(1) > 0
                yield pd.DataFrame({"id": pdf["id"][used], "tenant": pdf["tenant"][used], "v": list(v[used].astype(np.float32))})

    rows = df.select(F.col(id_col).cast("string").alias("id"), (F.col(keep) if keep else F.lit(None)).cast("string").alias("tenant"), F.col(text_col).alias("text"))
    return rows.where("id is not null and text is not null").mapInPandas(giving_back(run), "id string, tenant string, v array<float>")


def scores(pairs: DataFrame, model: Scorer) -> DataFrame:
    """``pairs`` (with ``question, passage``) and their ``score``; null texts count as empty."""

    @F.arrow_udf("double")
    def run(q: pa.Array, p: pa.Array) -> pa.Array:
        text = lambda x, a: [t or "" for t in x[a : a + MODEL_ROWS].to_pylist()]
        out = [np.asarray(model.score(text(q, a), text(p, a)), np.float64) for a in range(0, len(q), MODEL_ROWS)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return pairs.withColumn("score", run("question", "passage"))
