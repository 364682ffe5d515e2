"""Embedding tables from a pluggable text encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Texts to a float matrix, one row each; must be picklable.

    One with ``prepare`` and ``encode_prepared`` shares what it prepares with others of its class.
    """

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Signed feature hashing of words, normalised to length 1; needs no model files."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    @staticmethod
    def prepare(texts: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of texts, row and code of every word, and the hash of every code."""
        split = [t.split() for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        if not len(rows):
            return len(texts), rows, rows, np.zeros(0, dtype=np.int64)
        code, vocabulary = pd.factorize(np.concatenate([np.array(w, dtype=object) for w in split if w]))
        h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in vocabulary])
        return len(texts), rows, code, h

    def encode_prepared(self, prepared) -> np.ndarray:
        n, rows, code, h = prepared
        out = np.zeros((n, self.dim))
        sign = 1 - 2 * ((h // self.dim) % 2)
        np.add.at(out, (rows, (h % self.dim)[code]), sign[code])
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).astype(np.float32)

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.encode_prepared(self.prepare(texts))


ENCODERS: dict[str, Callable[..., Encoder]] = {"hash": HashEncoder}


def register_encoder(kind: str, build: Callable[..., Encoder]) -> None:
    ENCODERS[kind] = build


def make_encoder(model_type: str = "hash", **options) -> Encoder:
    if model_type not in ENCODERS:
        raise ValueError(f"unknown encoder type {model_type!r}; registered: {sorted(ENCODERS)}")
    return ENCODERS[model_type](**options)


BATCH_TOKENS = 1 << 16   # words of one call of an encoder, about


def batches_by_length(sizes: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Row numbers of each call, shortest texts first: as many texts as ``budget`` tokens hold
    when all are padded to the longest of them, one at least."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for end in range(1, len(order) + 1):
        # The next text is the longest so far; does it still fit?
        if end == len(order) or (end + 1 - start) * sizes[order[end]] > budget:
            yield order[start:end]
            start = end


def _encoded(texts: list[str], encoders: list[Encoder], budget: int) -> list[np.ndarray]:
    """One matrix per encoder, in the order of the texts; every text is prepared once a class."""
    sizes = np.array([t.count(" ") + 1 for t in texts], dtype=np.int64)
    out: list[np.ndarray | None] = [None] * len(encoders)
    for at in batches_by_length(sizes, budget):
        part, prepared = [texts[i] for i in at], {}
        for e, encoder in enumerate(encoders):
            kind = type(encoder)
            if hasattr(kind, "prepare"):
                if kind not in prepared:
                    prepared[kind] = encoder.prepare(part)
                rows = encoder.encode_prepared(prepared[kind])
            else:
                rows = encoder.encode(part)
            rows = np.asarray(rows, dtype=np.float32)
            if out[e] is None:
                out[e] = np.zeros((len(texts), rows.shape[1]), dtype=np.float32)
            out[e][at] = rows
    return out


def _texts(df: DataFrame, text: str, keys) -> tuple[DataFrame, str]:
    kept = df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return kept, ", ".join(f"{n} {t}" for n, t in kept.dtypes if n != "_text")


def embed_table(
    df: DataFrame, encoder: Encoder | None = None, text: str = "text",
    keys: tuple[str, ...] = ("item", "idx", "score"), batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(keys, embedding) for every record, encoded where the rows are.

    Whole texts go to the encoder sorted by length, about ``batch_tokens`` padded words at a time; the
    vectors return to their rows.
    """
    model = encoder or HashEncoder()
    kept, schema = _texts(df, text, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                (matrix,) = _encoded(pdf["_text"].tolist(), [model], batch_tokens)
                yield pdf.drop(columns="_text").assign(embedding=list(matrix))

    return kept.mapInPandas(run, schema + ", embedding array<float>")


def embed_many(
    df: DataFrame, encoders: dict[int, Encoder], text: str = "text",
    keys: tuple[str, ...] = ("item", "idx", "score"), batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(keys, vectors): one vector per numbered encoder, from one pass over the texts."""
    kept, schema = _texts(df, text, keys)
    numbers = sorted(encoders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = _encoded(pdf["_text"].tolist(), [encoders[n] for n in numbers], batch_tokens)
                vectors = [dict(zip(numbers, row)) for row in zip(*found)]
                yield pdf.drop(columns="_text").assign(vectors=vectors)

    return kept.mapInPandas(run, schema + ", vectors map<int, array<float>>")
