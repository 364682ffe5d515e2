"""Removal of repeated passages by hashing of lines, cut further at the ends of sentences.

Units are the lines of a text, cut after ``.``, ``!`` or ``?`` and white space, since passages are
pasted into the middle of lines as often as between them. Units are normalised (lower case, white
space collapsed) and digested; the digests are grouped over all texts and the earliest unit in
the order of id, text mark and offset stays. A later unit is removed when it is part of a stretch of
neighbouring repeated units of ``min_words`` words or more (one long unit is a stretch), so that
short sentences which merely recur stay where they are.

``dedup_passages`` also removes passages that are glued to other words at either end. Rule: a word goes
if it lies in ``WINDOW`` consecutive words that also occur at an earlier place, in the order of id, text
mark and offset; so does a later stretch of units as above, where units without a letter or digit
do not end a stretch. It never compares all windows:

0. Texts are cut once; digests, prints and offsets are kept as lists per text in the shared folder.
1. The smallest hash of the ``GRAM`` word runs inside a window is its print. Equal windows have equal
   prints at the same place, so none is missed. Digests of units and prints are counted by hash
   alone; those seen more than once make up a Bloom filter of bounded size, and only what passes it
   is compared (above the bound more passes, with the same result).
2. Neighbouring windows with one print are a block. A block with an equal one at an earlier place goes.
3. The first places of different blocks with one print are compared window by window, hashes first; only
   windows whose hash is seen twice become rows.

Words of windows are parted by blanks, tabs, line and page breaks and compared in lower case. A removed
part reaches to the first character of the next word.

Removed parts are offsets of the original text, in code points, each from the first character of
a unit to the first of the next; the text without them is the result.

Defined cases: a null text stays null with no removals; an empty text has no units. A very long text is
cut whole, in a batch of its own; its lists are one row. Units without
a letter or digit are never removed and end a stretch. Null ids come first. Rows that share id and text
are one place and get the same result. Columns pass through, except that those named like a
result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stored, text_mark
from .wordhash import Words, _powers, by_bytes, mix

MIN_WORDS = 15
WINDOW, GRAM = 50, 15
MAX_SLOTS = 1 << 22      # 64-bit words of the filter at most, 32 MB
UNITS, BLOCKS = 0, 1
HALVES = "<qq"
UNIT = re.compile(r"(?:[^\n.!?]++|[.!?](?![ \t]))*+(?:\n|[.!?][ \t]+|$)")
RESULTS = ("n_units", "removed")
SPANS = "array<struct<start:int,end:int>>"


def cut_units(text: str) -> Iterator[tuple[int, int, str, int]]:
    """start, end, normalised form and words of each unit; the units cover the text."""
    for m in UNIT.finditer(text):
        if m.end() > m.start():
            words = m.group().lower().split()
            yield m.start(), m.end(), " ".join(words), len(words)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in by_bytes(whole, "text", 1 << 20)):
        ids, marks, texts = batch.columns
        rows, cols = [], [[], [], [], [], [], []]
        number, start, end, d1, d2, count = cols
        for row, text in enumerate(texts.to_pylist()):
            for n, (a, b, norm, words) in enumerate(cut_units(text)):
                if any(map(str.isalnum, norm)):
                    digest = hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append(row)
                    number.append(n)
                    start.append(a)
                    end.append(b)
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
                    count.append(words)
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), marks.take(take), pa.array(number, pa.int32()), pa.array(start, pa.int32()),
             pa.array(end, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             pa.array(count, pa.int32())],
            names=["id", "mark", "n", "start", "end", "d1", "d2", "words"])


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per unit with a letter or digit: place, offsets, digest in two halves, words."""
    slim = docs.where(F.col(text) != "").select(
        F.col(id_col).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["id"]
    return slim.mapInArrow(
        _units, f"id {kind}, mark long, n int, start int, end int, d1 long, d2 long, words int")


def later_units(units: DataFrame) -> DataFrame:
    """Units of which an equal one stands at an earlier place."""
    place = F.struct("id", "mark", "start")
    first = (
        units.groupBy("d1", "d2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last").drop("last")
    )
    return units.join(first, ["d1", "d2"]).where(place > F.col("first"))


def stretches(later: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, mark, removed``: merged spans of neighbouring later units that are long enough."""
    @F.pandas_udf(SPANS)
    def merge(units: pd.Series) -> pd.Series:
        def one(rows):
            out, run = [], []
            for r in [*sorted({(r["n"], r["start"], r["end"], r["words"]) for r in rows}), None]:
                if run and (r is None or r[0] != run[-1][0] + 1):
                    if sum(x[3] for x in run) >= min_words:
                        out.append({"start": run[0][1], "end": run[-1][2]})
                    run = []
                if r is not None:
                    run.append(r)
            return out
        return units.map(one)

    rows = later.groupBy("id", "mark").agg(F.collect_list(F.struct("n", "start", "end", "words")).alias("u"))
    return rows.select("id", "mark", merge("u").alias("removed")).where(F.size("removed") > 0)


@F.pandas_udf(T.StringType())
def without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without their removed spans."""
    def one(text, spans):
        keep, at = [], 0
        for s in spans:
            keep.append(text[at:s["start"]])
            at = s["end"]
        return "".join([*keep, text[at:]])
    return pd.Series([one(t, s) for t, s in zip(texts, removed)], dtype=object)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """Docs with later passages cut out of ``text``, and ``removed``: their original spans."""
    docs = docs.drop(*[c for c in RESULTS if c not in (id_col, text)])
    return cut_out(docs, stretches(later_units(unit_rows(docs, id_col, text)), min_words), id_col, text)


def cut_out(docs: DataFrame, spans: DataFrame, id_col: str, text: str) -> DataFrame:
    """Docs without the spans of their texts, and ``removed``."""
    i, m, k = fresh(docs, "_id", "_mark", "_key")
    out = docs.withColumn(k, text_mark(F.col(text))).join(
        spans.select(F.col("id").alias(i), F.col("mark").alias(m), "removed"),
        F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(m)), "left")
    out = out.withColumn("removed", F.coalesce(F.col("removed"), F.array().cast(SPANS)))
    # Only texts that lose something go to Python; of the others an empty value does.
    some = F.size("removed") > 0
    short = without(F.when(some, F.col(text)).otherwise(""), F.col("removed"))
    return out.withColumn(text, F.when(some, short).otherwise(F.col(text))).drop(i, m, k)


class Windows:
    """Windows of ``WINDOW`` words in the rows of a batch, in order, each with its print."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.first, n = words.first, len(words.hash)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words.hash * up[:n], out=self.sums[1:])
        points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
        row_points = points[words.rows]
        row = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.begin = points[words.start] - row_points[row]
        self.length = np.diff(row_points)
        at = np.arange(max(n - WINDOW + 1, 0))
        self.at = at[row[at] == row[at + WINDOW - 1]]        # number of the first word in the batch
        self.row = row[self.at]
        grams = self.span(np.arange(max(n - GRAM + 1, 0)), GRAM)
        # Place of the smallest gram of each window, the first one on ties, by doubling.
        place, reach, want = np.arange(len(grams)), 1, WINDOW - GRAM + 1
        while reach < want and len(place):
            step = min(reach, want - reach)
            a, b = place[: max(len(place) - step, 0)], place[step:]
            place = np.where(grams[b] < grams[a], b, a)
            reach += step
        self.place = place[self.at] if len(self.at) else self.at
        self.print = grams[self.place].view(np.int64)

    def span(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of ``size`` words each from word ``at`` on."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at] + mix(np.atleast_1d(size).astype(np.uint64)))

    def offsets(self, row: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points from the first character of word ``at`` (of the text, if it is its first word) to that
        of word ``end``, or to the end of the text."""
        start = np.where(at == self.first[row], 0, self.begin[at])
        inside = end < self.first[row + 1]
        return start, np.where(inside, self.begin[np.where(inside, end, 0)], self.length[row])

    def blocks(self) -> tuple[np.ndarray, ...]:
        """row, print, hash, word number, start and end of each block."""
        new = np.ones(len(self.at), dtype=bool)
        new[1:] = self.place[1:] != self.place[:-1]
        low = np.nonzero(new)[0]
        high = np.append(low[1:], len(self.at))[: len(low)] - 1
        at, row = self.at[low], self.row[low]
        end = self.at[high] + WINDOW
        digest = mix(self.span(at, end - at) + (self.place[low] - at).astype(np.uint64)).view(np.int64)
        return row, self.print[low], digest, at - self.first[row], *self.offsets(row, at, end)


def passes(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    k = keys.view(np.uint64)
    one = np.uint64(1)
    bits = (one << ((k >> np.uint64(22)) & np.uint64(63))) | (one << ((k >> np.uint64(28)) & np.uint64(63)))
    return slots[(k & np.uint64(len(slots) - 1)).astype(np.int64)] & bits == bits


def bloom(keys: DataFrame, most: int = MAX_SLOTS):
    """Broadcast filter of the column ``key``: at most ``most`` 64-bit words, about 16 bits a key."""
    n = max(1, min(most, 1 << (keys.count() // 4).bit_length()))

    def bit(shift):
        at = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    filled = keys.select(
        F.col("key").bitwiseAND(F.lit(n - 1).cast("long")).alias("slot"), bit(22).bitwiseOR(bit(28)).alias("bits")
    ).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(n, dtype=np.uint64)
    slots[filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(slots)


def _unit_list(texts: pa.Array) -> tuple[list, ...]:
    """row, two halves of the digest, number, start, end and words of the units that are not blank."""
    row, d1, d2, number, start, end, count = cols = [], [], [], [], [], [], []
    for r, text in enumerate(texts.to_pylist()):
        n = 0
        for a, b, norm, words in cut_units(text):
            if not (norm[:1].isalnum() or any(map(str.isalnum, norm))):
                continue
            low, high = struct.unpack(HALVES, hashlib.blake2b(norm.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            for c, v in zip(cols, (r, low, high, n, a, b, words)):
                c.append(v)
            n += 1
    return cols


def _slim(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.where(F.col(text) != "").select(
        F.col(id_col).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))


def _lists(row: np.ndarray, n: int, cols) -> list[pa.Array]:
    """Columns of ``n`` lists each from values in the order of their rows."""
    bounds = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(bounds, pa.array(c, kind)) for c, kind in cols]


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the row and value of the entries of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), column.flatten().to_numpy(zero_copy_only=False)


LONGS, INTS = pa.int64(), pa.int32()
UNIT_COLS, BLOCK_COLS = ("u1", "u2", "us", "ue", "uw"), ("b1", "b2", "bs", "be")


def cut_texts(slim: DataFrame) -> DataFrame:
    """Per text the lists of its units (digest halves, offsets, words) and blocks (print, digest, offsets).

    The one pass that reads all texts in Python; what follows counts and filters these lists.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, "text", 1 << 20)):
            ids, marks, texts = batch.columns
            row, low, high, _, start, end, words = [np.array(c, dtype=np.int64) for c in _unit_list(texts)]
            units = _lists(row, len(texts), [(low, LONGS), (high, LONGS), (start, INTS), (end, INTS), (words, INTS)])
            row, prints, digest, _, start, end = Windows(texts).blocks()
            blocks = _lists(row, len(texts), [(prints, LONGS), (digest, LONGS), (start, INTS), (end, INTS)])
            yield pa.RecordBatch.from_arrays([ids, marks, *units, *blocks], names=["id", "mark", *UNIT_COLS, *BLOCK_COLS])

    kinds = ["long", "long", "int", "int", "int", "long", "long", "int", "int"]
    lists = ", ".join(f"{c} array<{k}>" for c, k in zip(UNIT_COLS + BLOCK_COLS, kinds))
    return slim.mapInArrow(rows, f"id {dict(slim.dtypes)['id']}, mark long, {lists}")


def seen_twice(keys: DataFrame) -> DataFrame:
    """``key`` of the rows that have an equal one."""
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")


def candidates(cut: DataFrame, shared) -> DataFrame:
    """Units and blocks that pass the filter: kind, two keys, place, number, offsets, words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            ids, marks = batch.columns[:2]
            for kind, names in ((UNITS, UNIT_COLS), (BLOCKS, BLOCK_COLS)):
                row, number, k1 = _values(batch.column(names[0]))
                keep = passes(k1, slots)
                rest = [pa.array(_values(batch.column(c))[2][keep]) for c in names[1:]]
                if kind == BLOCKS:
                    rest.append(pa.array(np.zeros(int(keep.sum())), INTS))
                take = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(take), kind), INTS), pa.array(k1[keep]), rest[0], ids.take(take), marks.take(take),
                     pa.array(number[keep], INTS), *rest[1:]],
                    names=["kind", "k1", "k2", "id", "mark", "n", "start", "end", "words"])
            pa.default_memory_pool().release_unused()

    kind = dict(cut.dtypes)["id"]
    return cut.mapInArrow(
        rows, f"kind int, k1 long, k2 long, id {kind}, mark long, n int, start int, end int, words int")


def contested_windows(slim: DataFrame, shared) -> DataFrame:
    """Per text the lists of every window of the blocks whose print and text pass the filter, if there are any."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in (part for whole in batches for part in by_bytes(whole, "text", 1 << 20)):
            batch = batch.filter(pa.array(passes(batch.column(1).to_numpy(), slots)))
            ids, marks, texts = batch.columns
            w = Windows(texts)
            keep = passes(w.print ^ marks.to_numpy()[w.row], slots)
            row, at = w.row[keep], w.at[keep]
            start, end = w.offsets(row, at, at + WINDOW)
            lists = _lists(row, len(texts), [
                (w.print[keep], LONGS), (w.span(at, WINDOW).view(np.int64), LONGS), (start, INTS), (end, INTS)])
            yield pa.RecordBatch.from_arrays([ids, marks, *lists], names=["id", "mark", *BLOCK_COLS])

    lists = "b1 array<long>, b2 array<long>, bs array<int>, be array<int>"
    return slim.mapInArrow(rows, f"id {dict(slim.dtypes)['id']}, mark long, {lists}").where(F.size("b1") > 0)


def repeated_windows(contested: DataFrame, shared) -> DataFrame:
    """Windows whose hash passes the filter, a row each."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            ids, marks = batch.columns[:2]
            row, _, k2 = _values(batch.column("b2"))
            keep = passes(k2, slots)
            k1, start, end = [pa.array(_values(batch.column(c))[2][keep]) for c in ("b1", "bs", "be")]
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [k1, pa.array(k2[keep]), ids.take(take), marks.take(take), start, end],
                names=["k1", "k2", "id", "mark", "start", "end"])
            pa.default_memory_pool().release_unused()

    return contested.mapInArrow(
        rows, f"k1 long, k2 long, id {dict(contested.dtypes)['id']}, mark long, start int, end int")


def found_lists(cut: DataFrame, shared) -> DataFrame:
    """Per text the units and blocks that pass the filter, as lists."""
    names = ["un", "us", "ue", "uw", "bs", "be"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            row, number, k1 = _values(batch.column("u1"))
            keep = passes(k1, slots)
            units = [number[keep], *[_values(batch.column(c))[2][keep] for c in ("us", "ue", "uw")]]
            lists = _lists(row[keep], batch.num_rows, [(c, INTS) for c in units])
            row, _, k1 = _values(batch.column("b1"))
            keep = passes(k1, slots)
            blocks = [_values(batch.column(c))[2][keep] for c in ("bs", "be")]
            lists += _lists(row[keep], batch.num_rows, [(c, INTS) for c in blocks])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["id", "mark", *names])
            pa.default_memory_pool().release_unused()

    lists = ", ".join(f"{c} array<int>" for c in names)
    return cut.mapInArrow(rows, f"id {dict(cut.dtypes)['id']}, mark long, {lists}").where((F.size("us") > 0) | (F.size("bs") > 0))


def span_merger(min_words: int):
    """Spans of a text from its candidates, the places among them that are the first of their kind, and late windows."""
    @F.pandas_udf(SPANS)
    def merge(un: pd.Series, us: pd.Series, ue: pd.Series, uw: pd.Series, bs: pd.Series, be: pd.Series,
              firsts: pd.Series, late_start: pd.Series, late_end: pd.Series) -> pd.Series:
        def one(un, us, ue, uw, bs, be, firsts, late_start, late_end):
            firsts = np.asarray([] if firsts is None else firsts, dtype=np.int64)
            later = ~np.isin(us.astype(np.int64) * 2 + UNITS, firsts)
            n, start, end, words = un[later], us[later], ue[later], uw[later]
            head = np.nonzero(np.diff(n, prepend=-2) != 1)[0]      # first units of the stretches
            tail = np.append(head[1:], len(n))[: len(head)] - 1
            total = np.concatenate([[0], np.cumsum(words.astype(np.int64))])
            long = total[tail + 1] - total[head] >= min_words
            blocks = ~np.isin(bs.astype(np.int64) * 2 + BLOCKS, firsts)
            none = np.zeros(0, dtype=np.int32)
            low = np.concatenate([start[head[long]], bs[blocks], none if late_start is None else late_start])
            high = np.concatenate([end[tail[long]], be[blocks], none if late_end is None else late_end])
            order = np.argsort(low, kind="stable")
            low, reach = low[order], np.maximum.accumulate(high[order]) if len(high) else high
            new = np.ones(len(low), dtype=bool)
            new[1:] = low[1:] > reach[:-1]
            at = np.nonzero(new)[0]
            last = np.append(at[1:], len(low))[: len(at)] - 1
            return [{"start": int(x), "end": int(y)} for x, y in zip(low[at], reach[last])]
        return pd.Series([one(*r) for r in zip(un, us, ue, uw, bs, be, firsts, late_start, late_end)], dtype=object)

    return merge


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id, mark, removed``: the spans that ``dedup_passages`` removes."""
    slim = _slim(docs, id_col, text)
    place = F.struct("id", "mark", "start")
    cut = stored(cut_texts(slim), "units")
    shared = bloom(stored(seen_twice(cut.select(F.explode(F.concat("u1", "b1")).alias("key"))), "keys"))
    firsts = stored(
        candidates(cut, shared).groupBy("kind", "k1", "k2").agg(F.min(place).alias("first"))
        .select("kind", "k1", "first.*"), "firsts")

    blocks = firsts.where(F.col("kind") == BLOCKS)
    several = blocks.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1")
    marks = blocks.join(several, "k1", "left_semi").select("k1", "mark")
    contested = stored(marks.select(F.explode(F.array("mark", F.col("k1").bitwiseXOR(F.col("mark")))).alias("key")).distinct(), "contested")
    lists = stored(contested_windows(slim, bloom(contested)), "windows")
    windows = repeated_windows(lists, bloom(stored(seen_twice(lists.select(F.explode("b2").alias("key"))), "keys")))
    first = (
        windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last").drop("last")
    )
    late = windows.join(first, ["k1", "k2"]).where(place > F.col("first"))

    # A candidate that is not the first of its kind is a later one: only the firsts go back to their texts.
    none = F.lit(None)
    known = firsts.select(
        F.col("id").alias("i"), F.col("mark").alias("m"), (F.col("start").cast("long") * 2 + F.col("kind")).alias("code"),
        none.cast("int").alias("start"), none.cast("int").alias("end")
    ).unionByName(late.select(F.col("id").alias("i"), F.col("mark").alias("m"), none.cast("long").alias("code"), "start", "end"))
    known = known.groupBy("i", "m").agg(
        F.collect_list("code").alias("firsts"), F.collect_list("start").alias("late_start"), F.collect_list("end").alias("late_end"))
    rows = found_lists(cut, shared).join(known, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left")
    spans = rows.select("id", "mark", span_merger(min_words)(
        "un", "us", "ue", "uw", "bs", "be", "firsts", "late_start", "late_end").alias("removed"))
    # Rows that share id and text have equal spans; one of them serves all.
    return spans.where(F.size("removed") > 0).groupBy("id", "mark").agg(F.any_value("removed").alias("removed"))


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """As ``dedup_substrings``, and no repeat of ``WINDOW`` words stays, wherever it begins or ends."""
    docs = docs.drop(*[c for c in RESULTS if c not in (id_col, text)])
    return cut_out(docs, passages(docs, id_col, text, min_words), id_col, text)
