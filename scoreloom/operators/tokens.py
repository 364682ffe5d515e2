"""Token sequences: encoding, padding, label masks, lengths."""

from __future__ import annotations

import math
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import shared_dir, stored
from .scaling import numbered

PAD_ID = 0
UNKNOWN = 1
FIRST_ID = 16                # ids below are for padding and special tokens
FREQUENT_BYTES = 16 << 20    # words and ids that are broadcast, about
WORD_BYTES = 32              # what a word takes besides its characters
PACKED_ROWS = 256            # lists whose ids are packed or unpacked at once
WORD_BATCHES = {             # words that a task hands over at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
IGNORED = -100


class Tokenizer(Protocol):
    """Anything that turns texts into token ids, without special tokens."""

    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


def build_vocabulary(df: DataFrame, *texts: str) -> DataFrame:
    """``word, n, id`` of every word of the texts: ids are dense from ``FIRST_ID``, the most frequent first, equals by word.

    Words are counted with partial sums and numbered by ranges of the count, so the dictionary stays
    distributed whatever its size.
    """
    found = [df.select(F.explode(words(t)).alias("word")) for t in texts or ("text",)]
    counts = reduce(DataFrame.unionByName, found).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(counts, [F.desc("n"), F.asc("word")], "_rank")
    return ranked.select("word", "n", (F.col("_rank") + FIRST_ID).cast("int").alias("id"))


def frequent_below(vocabulary: DataFrame, limit: int = FREQUENT_BYTES) -> int:
    """The largest power of two below which all ids' words together take at most ``limit`` bytes."""
    band = F.floor(F.log2("id")).cast("int")     # at most 31 bands
    sizes = vocabulary.groupBy(band.alias("band")).agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("bytes")).collect()
    total, below = 0, 1
    for r in sorted(sizes):
        total += r["bytes"]
        if total > limit:
            break
        below = 2 << r["band"]
    return below


def vocabulary_ids(
    df: DataFrame, vocabulary: DataFrame, text: str, out: str, max_length: int | None = None, limit: int = FREQUENT_BYTES
) -> DataFrame:
    """Add the ids of a text's words; words that the vocabulary lacks get ``UNKNOWN``, a null text null.

    Frequent words are looked up in the task, in a dictionary of bounded bytes; only the places of the others, of
    which none is frequent, are joined by a shuffle and travel back to the text. With no other words nothing moves.
    """
    return coded_texts(df, vocabulary, {out: text}, max_length, limit)


def coded_texts(
    df: DataFrame, vocabulary: DataFrame, texts: dict[str, str], max_length: int | None = None,
    limit: int = FREQUENT_BYTES, gone: tuple[str, ...] = (),
) -> DataFrame:
    """``vocabulary_ids`` for several texts at once, ``texts`` from new column to text, without the columns ``gone``.

    Where rows must wait for words that are joined, they are stored with packed ids and without the columns
    that go, and what was shuffled before is deleted: neither texts nor plain ids lie on disk twice.
    """
    spark = df.sparkSession
    shared_dir(spark)
    below = frequent_below(vocabulary, limit)
    slim = vocabulary.select("word", "id")
    frequent = slim.where(F.col("id") < below).toArrow()
    known = spark.sparkContext.broadcast((frequent["word"].combine_chunks(), frequent["id"].combine_chunks()))
    rare = slim.where(F.col("id") >= below)

    def found(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
        names, ids = known.value
        flat = lists.flatten()
        return flat, ids.take(pc.index_in(flat, value_set=names.cast(flat.type)))

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        return _listed(lists, found(lists)[1].fill_null(UNKNOWN))

    @F.arrow_udf("struct<ids: binary, words: array<string>>")
    def look_up_packed(lists: pa.Array) -> pa.Array:
        """Packed ids, and the words that have none, in order."""
        flat, ids = found(lists)
        missing = ids.is_null()
        counts = np.diff(np.concatenate([[0], np.cumsum(missing.to_numpy(zero_copy_only=False))])[_ends(lists)])
        words_left = pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), flat.filter(missing).cast(pa.string()))
        return pa.StructArray.from_arrays([packed(lists, ids), words_left], ["ids", "words"])

    @F.arrow_udf("array<int>")
    def fill(ids: pa.Array, others: pa.Array) -> pa.Array:
        """The n-th id that is missing is the n-th of the others."""
        parts = [pa.array([], pa.list_(pa.int32()))]
        for lists, more in ((ids.slice(a, PACKED_ROWS), others.slice(a, PACKED_ROWS)) for a in range(0, len(ids), PACKED_ROWS)):
            lists = unpacked(lists)
            flat = lists.flatten()
            parts.append(_listed(lists, pc.replace_with_mask(flat, flat.is_null(), more.flatten().cast(flat.type))))
        return pa.concat_arrays(parts)

    def kept(text: str) -> Column:
        return F.slice(words(text), 1, max_length) if max_length else words(text)

    def ids_of(k: int) -> Column:
        """The lower halves of the numbers of a text, in order."""
        own = F.filter("_all", lambda t: F.shiftright(t, 32) % len(texts) == k)
        return F.transform(own, lambda t: F.shiftright(F.shiftleft(t, 32), 32).cast("int"))

    if rare.isEmpty():
        return df.withColumns({out: look_up(kept(text)) for out, text in texts.items()}).drop(*gone)
    places = list(enumerate(texts))
    rows = stored(df.withColumns({"_row": F.monotonically_increasing_id()} | {
        f"_ids_{k}": look_up_packed(kept(texts[out])) for k, out in places}).drop(*gone), "coded", WORD_BATCHES)
    missed = reduce(DataFrame.unionByName, [
        rows.select("_row", F.posexplode(f"_ids_{k}.words").alias("_place", "word")).select(
            "_row", (F.col("_place").cast("bigint") * len(places) + k).alias("_at"), "word") for k, _ in places])
    # Place, text and id travel in one number, the id in its lower half.
    low = F.coalesce("id", F.lit(UNKNOWN)).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))
    found_ids = missed.join(rare, "word", "left").select("_row", F.shiftleft("_at", 32).bitwiseOR(low).alias("_at"))
    in_order = found_ids.repartition("_row").groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("_all"))
    others = stored(in_order.select("_row", *[ids_of(k).alias(f"_others_{k}") for k, _ in places]), "rare")
    slim_rows = rows.withColumns({f"_ids_{k}": F.col(f"_ids_{k}.ids") for k, _ in places})
    filled = {out: fill(f"_ids_{k}", f"_others_{k}") for k, out in places}
    return slim_rows.join(others, "_row", "left").withColumns(filled).drop(
        "_row", *[f"_{name}_{k}" for k, _ in places for name in ("ids", "others")])


def _ends(lists: pa.Array) -> np.ndarray:
    """Where the lists begin and end among all their values."""
    return _starts(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _listed(like: pa.Array, values: pa.Array) -> pa.Array:
    """Values dealt to lists of the lengths of others."""
    ends = pa.array(_ends(like), pa.int32())
    return pa.ListArray.from_arrays(ends, values.cast(pa.int32()), mask=like.is_null() if like.null_count else None)


def packed(lists: pa.Array, ids: pa.Array) -> pa.Array:
    """Ids dealt to lists, as bytes of seven bits, low ones first, the last of an id below 128; a null id is 0, others one more."""
    ends = _ends(lists)
    borders, pieces = np.zeros(len(ends), np.int64), []
    for a in range(0, len(lists), PACKED_ROWS):
        own = ends[a:a + PACKED_ROWS + 1]
        part = ids.slice(own[0], own[-1] - own[0])
        values = part.fill_null(0).cast(pa.int32()).to_numpy().astype(np.uint32).astype(np.uint64) + 1
        values[part.is_null().to_numpy(zero_copy_only=False)] = 0
        sizes = np.ones(len(values), np.int64)
        for k in range(1, 5):
            sizes += values >= 1 << (7 * k)
        starts = _starts(sizes)
        data = np.empty(starts[-1], np.uint8)
        for k in range(5):
            longer = sizes > k
            more = np.where(sizes[longer] > k + 1, 128, 0).astype(np.uint8)
            data[starts[:-1][longer] + k] = (values[longer] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
        borders[a + 1:a + len(own)] = borders[a] + starts[own[1:] - own[0]]
        pieces.append(data.tobytes())
    valid = np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(lists), [
        pa.py_buffer(valid), pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(b"".join(pieces))])


def unpacked(lists: pa.Array) -> pa.Array:
    """The lists of ids that ``packed`` has made, null ids included."""
    sizes = pc.binary_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(lists.drop_null().to_pylist()), np.uint8)
    last = data < 128
    firsts = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(firsts, np.diff(np.append(firsts, len(data))))
    parts = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    values = np.bitwise_or.reduceat(parts, firsts) if len(data) else parts
    ids = pa.array((values - (values > 0)).astype(np.uint32).astype(np.int32), mask=values == 0)
    ends = _starts(last)[_starts(sizes)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids, mask=lists.is_null() if lists.null_count else None)


def token_ids(text: Column, tokenizer: Tokenizer, max_length: int | None = None) -> Column:
    """Ids of a text by a tokenizer, at most ``max_length``."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.encode_batch(texts.fillna("").tolist()))

    ids = encode(text)
    return F.slice(ids, 1, max_length) if max_length else ids


def tokenize_text(
    df: DataFrame, text: str = "text", tokenizer: Tokenizer | None = None,
    max_length: int | None = None, suffix: str = "", vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Add input_ids and attention_mask; a table that has them is returned as it is.

    Without a tokenizer, words get the ids of the vocabulary, by default the table's own.
    """
    ids, mask = f"input_ids{suffix}", f"attention_mask{suffix}"
    if ids in df.columns and mask in df.columns:
        return df
    if tokenizer is not None:
        coded = df.withColumn(ids, token_ids(F.col(text), tokenizer, max_length))
    else:
        coded = vocabulary_ids(df, build_vocabulary(df, text) if vocabulary is None else vocabulary, text, ids, max_length)
    return coded.withColumn(mask, F.transform(ids, lambda t: F.lit(1)))


def tokenize_pairs(
    df: DataFrame, texts: tuple[str, str] = ("txt1", "txt2"), tokenizer: Tokenizer | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Both texts of a pair, with the label columns and nothing else; one vocabulary serves both."""
    labels = [c for c in ("diff_abs", "diff", "diff_norm") if c in df.columns]
    out = df
    if tokenizer is None:
        known = build_vocabulary(df, *texts) if vocabulary is None else vocabulary
        have = [f"{c}_{i}" for i in (1, 2) for c in ("input_ids", "attention_mask") if f"{c}_{i}" in df.columns]
        todo = {f"input_ids_{i}": text for i, text in enumerate(texts, 1)
                if not {f"input_ids_{i}", f"attention_mask_{i}"} <= {*df.columns}}
        gone = tuple(c for c in df.columns if c not in have and c not in labels)
        out = coded_texts(df, known, todo, gone=gone) if todo else df
        out = out.withColumns({f"attention_mask_{ids[-1]}": F.transform(ids, lambda t: F.lit(1)) for ids in todo})
    for i, text in enumerate(texts, 1):
        out = tokenize_text(out, text, tokenizer, suffix=f"_{i}")
    names = [f"{c}_{i}" for i in (1, 2) for c in ("input_ids", "attention_mask")]
    if "diff_abs" not in labels and "diff" in labels:
        out = out.withColumn("diff_abs", F.col("diff"))
        labels = ["diff_abs", *[c for c in labels if c != "diff"]]
    return out.select(*names, *[c for c in labels if c != "diff"])


def pad_batch(
    df: DataFrame, batch: str = "batch", suffixes=("_1", "_2"), multiple_of: int = 4,
    side: str = "left", pad_id: int = PAD_ID,
) -> DataFrame:
    """Pad to the longest sequence of the batch, rounded up; each side of the pair for itself.

    The sizes are reduced per batch before they meet the rows, so no task sorts sequences.
    """
    if side not in ("left", "right"):
        raise ValueError(f"padding side {side!r} not recognised")
    goals = {f"_goal{s}": F.ceil(F.max(F.size(f"input_ids{s}")) / multiple_of) * multiple_of for s in suffixes}
    most = df.groupBy(batch).agg(*[goal.cast("int").alias(name) for name, goal in goals.items()])
    df = df.join(most, batch)
    padded = {}
    for s in suffixes:
        missing = F.col(f"_goal{s}") - F.size(f"input_ids{s}")
        for c, fill in ((f"input_ids{s}", pad_id), (f"attention_mask{s}", 0)):
            pads = F.array_repeat(F.lit(fill), missing)
            parts = (pads, F.col(c)) if side == "left" else (F.col(c), pads)
            padded[c] = F.concat(*parts)
    return df.withColumns(padded).drop(*goals)


def mask_labels(ids, mask) -> Column:
    """Token ids where the mask is 1, the ignored label elsewhere."""
    return F.zip_with(ids, mask, lambda t, m: F.when(m == 0, F.lit(IGNORED)).otherwise(t))


def length_histogram(
    df: DataFrame, columns=("input_ids_1", "input_ids_2"), bins: int = 20, tallest: int = 100
) -> DataFrame:
    """Rows (bin, low, high, n) of the pooled sequence lengths up to the last visible bin.

    ``columns`` are sequences or their lengths.

    A bin is visible from 1/tallest of the highest on. If fewer than 80 % of the bins are, the
    lengths are binned once more, finer. Only the extremes and the few bin counts reach the
    driver.
    """
    types = dict(df.dtypes)
    sizes = [F.size(c) if types[c].startswith("array") else F.col(c).cast("int") for c in columns]
    lengths = df.select(F.explode(F.array(*sizes)).alias("len"))
    lengths = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n")).persist()
    ends = lengths.agg(F.min("len").alias("lo"), F.max("len").alias("hi")).head()
    spark = df.sparkSession
    schema = "bin int, low double, high double, n bigint"
    if ends["lo"] is None:
        return spark.createDataFrame([], schema)
    low, width = ends["lo"], ends["hi"] - ends["lo"]
    if width == 0:
        total = lengths.agg(F.sum("n")).head()[0]
        return spark.createDataFrame([(0, float(low), float(low), total)], schema)

    def counts(nb: int) -> tuple[list[int], float]:
        w = width / nb
        last = math.ceil(nb + 1 / w) - 2
        place = F.least(F.floor((F.col("len") - low) / F.lit(w)), F.lit(last))
        got = lengths.groupBy(place.alias("b")).agg(F.sum("n").alias("n")).collect()
        filled = [0] * (last + 1)
        for r in got:
            filled[r["b"]] = r["n"]
        return filled, w

    def last_visible(filled: list[int]) -> int:
        return max(i for i, n in enumerate(filled) if int(tallest / max(filled) * n) > 0)

    filled, w = counts(bins)
    end = last_visible(filled)
    if end < 0.8 * bins:
        filled, w = counts(int(bins * bins / (end + 1)))
        end = last_visible(filled)
    rows = [(i, low + i * w, low + (i + 1) * w, n) for i, n in enumerate(filled[: end + 1])]
    return spark.createDataFrame(rows, schema)


def start_token_check(df: DataFrame, keys: list[str], ids: str = "input_ids") -> DataFrame:
    """Per group: the token every sequence starts with and never repeats, else NULL."""
    first = F.get(ids, 0)
    again = F.array_position(F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), first) > 0
    return df.groupBy(*keys).agg(
        F.min(first).alias("_lo"), F.max(first).alias("_hi"),
        F.max(again).alias("_again"), F.count_if(F.size(ids) == 0).alias("_empty"),
    ).select(
        *keys,
        F.when(
            (F.col("_lo") == F.col("_hi")) & ~F.col("_again") & (F.col("_empty") == 0), F.col("_lo")
        ).alias("start_token"),
    )
