"""Language identification with error-correcting output codes.

Every language has a codeword of ``BITS`` bits. One binary classifier per bit looks at the hashed
1- to 3-grams of letters in a text and predicts the bit; the text gets the language whose codeword
is nearest under a loss that weighs each bit by its margin (loss-weighted decoding). Because codewords
differ in many bits, single bits may be wrong.

Fitting needs only the gram counts of each language, summed over all training rows by Spark;
the classifiers are log-likelihood ratios of the languages with bit 1 against those with bit 0.
Texts go through as UTF-32 arrays; a task holds one batch of texts and one table of weights.

A text is ambiguous when the probability of its language, or the distance in loss to the second,
falls below a limit.

Defined cases: a text that is null or has no letter gets ``und``, score 0, and is ambiguous; so is
every text if the training rows hold no language. With a single language all other texts get it.
Ties between languages go to the first by name. Rows are judged one by one, so repeated rows and
ids do no harm. Columns pass through, except that those named like a result are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .wordhash import by_bytes

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
BITS = 15
PIECE = 1 << 20          # code points of a text handled at once
MARGIN_SCALE = 10.0      # of a bit's mean log-likelihood ratio per gram
MIN_SCORE = 0.5
MIN_GAP = 0.05
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "ambiguous")
OUT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
])


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """n rows of +1/-1, chosen greedily so that rows are far apart and no bit is constant.

    The first rows are those of a Hadamard matrix without its constant column, which are all
    (bits + 1) / 2 apart; more languages than that take longer words.
    """
    order = 1 << max(2, int(np.ceil(np.log2(max(n, bits + 1)))))
    h = np.array([[1]])
    while len(h) < order:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:].copy()


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _letters(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one blank, blanks at the ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _alphabet()[codes]
    clean = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], clean[keep], [32]]).astype(np.uint32) if letter.any() else np.zeros(0, np.uint32)


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed grams of a text, or None if it has no letter."""
    total = None
    for at in range(0, len(text), PIECE):
        c = _letters(text[at: at + PIECE])
        if not len(c):
            continue
        if total is None:
            total = np.zeros(BUCKETS, dtype=np.int64)
        key = np.zeros(len(c), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            key = key[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1:] * np.uint32(0x9E3779B1)
            if n in ORDERS:
                mixed = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                total += np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray      # languages x bits
    weights: np.ndarray    # buckets x bits, log-likelihood ratios

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Mean logistic loss of each codeword given the bit margins of a text."""
        margins = counts @ self.weights * (MARGIN_SCALE / max(counts.sum(), 1))
        weight = np.abs(np.tanh(margins))
        loss = np.log1p(np.exp(-np.clip(self.codes * margins, -30, 30))) * weight
        return loss.sum(axis=1) / max(weight.sum(), 1e-12)

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        loss = self.losses(counts)
        best = int(np.argmin(loss))
        p = np.exp(-(loss - loss[best]) * 2)
        score = float(1 / p.sum())
        gap = float(np.partition(loss, 1)[1] - loss[best]) if len(loss) > 1 else 1.0
        return self.languages[best], score, score < MIN_SCORE or gap < MIN_GAP


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts per language of a whole partition: one row per language."""
    sums: dict[str, np.ndarray] = {}
    for batch in (part for whole in batches for part in by_bytes(whole, whole.schema.names[1])):
        for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
            counts = gram_counts(text)
            if counts is not None:
                # A text weighs by the root of its length, so long ones do not drown short ones.
                part = counts / np.sqrt(counts.sum())
                sums[lang] = sums[lang] + part if lang in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()])],
            names=["lang", "counts"])


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all labelled rows; only one count table per language reaches the driver."""
    parts = (
        train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
        .mapInArrow(_count_partition, "lang string, counts array<double>")
    )
    rows = (
        parts.select("lang", F.posexplode("counts").alias("bucket", "n"))
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where("n > 0")
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).collect()
    )
    rows.sort(key=lambda r: r["lang"])
    languages = tuple(r["lang"] for r in rows)
    counts = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        for c in r["counts"]:
            counts[i, c["bucket"]] = round(c["n"], 3)   # sums in any order agree
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-12)
    codes = codewords(len(rows))
    floor = 1e-6
    weights = np.zeros((BUCKETS, codes.shape[1]))
    for b in range(codes.shape[1]):
        one, zero = share[codes[:, b] > 0], share[codes[:, b] < 0]
        if len(one) and len(zero):
            weights[:, b] = np.log(one.mean(axis=0) + floor) - np.log(zero.mean(axis=0) + floor)
    used = np.abs(weights).sum(axis=0) > 0 if len(rows) > 1 else np.ones(codes.shape[1], dtype=bool)
    return Model(languages, codes[:, used], weights[:, used])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and ambiguous, from the text alone."""
    docs = docs.drop(*[c for c in RESULTS if c != text])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(OUT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [m.predict(None if t is None else gram_counts(t)) for t in texts]
        return pd.DataFrame(rows, columns=list(RESULTS))

    (p,) = fresh(docs, "_language")
    return docs.withColumn(p, predict(F.col(text))).select(*docs.columns, f"{p}.*")
