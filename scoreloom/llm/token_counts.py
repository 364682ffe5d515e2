"""Token counts of sections by offset-mapped attribution.

Each text is encoded once as a whole. A byte-level tokenizer's tokens tile the UTF-8 bytes of the
text, so their offsets are the running sum of token lengths. Sections are code point spans, mapped
to bytes, and joined to the tokens as intervals: both sides are sorted, so each section finds its
first and last token by binary search, inside the task that holds the text.

Rule for a token that crosses boundaries: it belongs to the section that holds most of its bytes;
on ties to the section that starts first. A token that touches no section counts as outside. So
the counts of the sections and the outside count always add up to the tokens of the text.

Sections may come in any order and keep their place in the array. They are clipped to the text;
where two overlap, the one that starts later begins where the earlier ends. Empty ones count
nothing. Without given sections, the lines of the text are its sections, without their breaks.

Defined cases: a very long text is encoded whole, in one task. A null or empty text has no tokens; null sections are no sections, a null section
or bound is an empty section. Rows are counted one by one, so repeated rows and ids do no harm.
Columns pass through, except that those named like a result are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

RESULTS = ("n_tokens", "outside_tokens", "section_tokens", "crossing_tokens")
COUNTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("outside_tokens", T.LongType()),
    T.StructField("crossing_tokens", T.LongType()),
    T.StructField("section_tokens", T.ArrayType(T.LongType())),
])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Tokens of each section, outside tokens and crossing tokens.

    ``ends`` are the token ends in bytes; ``sections`` is an (n, 2) array of byte spans.
    """
    n = len(ends)
    counts = np.zeros(len(sections), dtype=np.int64)
    order = np.argsort(sections[:, 0], kind="stable")
    a, b = sections[order, 0].copy(), sections[order, 1]
    if len(order):
        a[1:] = np.maximum(a[1:], np.maximum.accumulate(b)[:-1])
    order, a, b = order[b > a], a[b > a], b[b > a]
    if n == 0 or len(order) == 0:
        return counts, n, 0
    starts = np.concatenate([[0], ends[:-1]])
    # Only the token that holds a boundary can belong to more than one section, or to none in part.
    first = np.searchsorted(ends, a, side="right")     # first token that ends after the start
    last = np.searchsorted(starts, b, side="left") - 1  # last token that starts before the end
    shares: dict[int, list[tuple[int, int]]] = {}
    inner_from, inner_to = first.copy(), last.copy()
    cut_left = (first < n) & (starts[np.minimum(first, n - 1)] < a)
    cut_right = (last >= 0) & (ends[np.maximum(last, 0)] > b)
    for k in np.nonzero(cut_left | cut_right)[0]:
        for t in {first[k]} if cut_left[k] and not cut_right[k] else (
                {last[k]} if not cut_left[k] else {first[k], last[k]}):
            held = min(ends[t], b[k]) - max(starts[t], a[k])
            if held > 0:
                shares.setdefault(int(t), []).append((int(held), -int(k)))
        inner_from[k] += cut_left[k]
        inner_to[k] -= cut_right[k]
    counts[order] = np.maximum(inner_to - inner_from + 1, 0)
    for held in shares.values():
        counts[order[-max(held)[1]]] += 1
    return counts, n - int(counts.sum()), len(shares)


def line_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    return spans


def _byte_spans(text: str, data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    sections = np.array(spans, dtype=np.int64).reshape(-1, 2)
    if len(data) == len(text):
        return np.clip(sections, 0, len(data))
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.append(np.nonzero((raw & 0xC0) != 0x80)[0], len(data))   # byte of each code point
    return at[np.clip(sections, 0, len(text))]


def counter(path: str, pattern: str, lines: bool):
    """A pandas UDF of text and sections that gives the four counts."""
    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoding, sizes = _encoding(path, pattern)
        for texts, given in batches:
            rows = []
            for text, spans in zip(texts, given):
                if lines:
                    spans = [] if text is None else line_spans(text)
                else:
                    spans = [] if spans is None else [
                        (0, 0) if s is None or s["start"] is None or s["end"] is None
                        else (s["start"], s["end"]) for s in spans]
                text = text or ""
                data = text.encode("utf-8")
                ends = np.cumsum(sizes[encoding.encode_to_numpy(text, disallowed_special=())]
                                 ) if data else np.zeros(0, dtype=np.int64)
                found, outside, crossing = attribute(ends, _byte_spans(text, data, spans))
                rows.append((len(ends), outside, crossing, found))
            yield pd.DataFrame(rows, columns=["n_tokens", "outside_tokens", "crossing_tokens", "section_tokens"])
    return count


def count_tokens(
    docs: DataFrame, sections: str | None = None, text: str = "text",
    vocabulary: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """Add n_tokens, outside_tokens, crossing_tokens and section_tokens (in section order).

    ``sections`` is a column of array<struct<start,end>> in code points, or None for the lines;
    ``vocabulary`` is a file of byte ranks.
    """
    docs = docs.drop(*[c for c in RESULTS if c not in (text, sections)])
    (c,) = fresh(docs, "_counts")
    udf = counter(vocabulary or default_vocabulary(), pattern or split_pattern(), sections is None)
    return docs.withColumn(c, udf(F.col(text), F.col(sections) if sections else F.lit(0))).select(*docs.columns, f"{c}.*")
