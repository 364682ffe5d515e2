"""Packing of token pieces into few sequences by a configuration linear program.

1. Texts are encoded in tasks; each becomes pieces of at most ``capacity`` tokens. Pieces are slim
   rows, kept once in the shared folder.
2. Spark counts pieces by length: at most ``capacity`` numbers, whatever the size of the corpus.
   From this histogram the configuration LP (fewest sequences so that every length is covered) is
   solved by multiplicative weights: lengths well covered lose weight, a knapsack dynamic
   program over all lengths prices the best configuration, and the later half of the rounds is averaged.
3. The fractional counts are rounded down; what is left is packed by taking the
   configurations once more while they fit, then best fit by decreasing length. Best fit of the whole
   histogram is a check: it stays if it takes fewer sequences. All this is on counts, not on pieces.
4. The plan is a table of slots per length (bounded by the configurations, not by rows). Pieces
   are ranked within their length, in salted groups shifted by the counts before them, so that a
   length that a third of all pieces share is spread over many tasks; the rank gives sequence and
   offset by arithmetic.

Defined cases: a null or empty text is one piece, the end token alone. Every row is packed,
repeated rows and ids included; rows with equal id, piece and tokens are interchangeable. An
empty table gives an empty result. Only the id of the input is returned, so other columns cannot
clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .wordhash import by_bytes

CAPACITY = 4096
END = 1
SALTS = 64
ROUNDS = 4 * CAPACITY    # configurations priced at most
FIRST = 64               # rounds before the first rounding; then after each doubling
WORK = 400_000           # lengths offered to all pricings together, at most
RATE = 0.01              # smallest rate at which weights fall with the cover; it begins at 0.5
GAP = 0.001              # relative distance from the dual bound that is near enough
CACHE_BYTES = 96 << 20   # chunks and parts of text a worker remembers, about
ENTRY_BYTES = 240        # what one of them takes besides its characters
PIECES = "piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of words; a missing one is made, and remembered while there is room, in bytes."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.room = make, size

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if self.room > 0 and len(word) <= 40:
            self.room -= ENTRY_BYTES + len(word) + len(found)
            self[word] = found
        return found


class WordEncoder:
    """The ids of a text as little-endian 32-bit bytes.

    The tokenizer lowers case and never joins characters across white space. So a text of plain
    Latin letters and ASCII is lowered and its blank-separated chunks are looked up one by one; a
    new chunk is cut the way the pre-tokenizer does and its parts go to the tokenizer's model.
    Whatever else a text or chunk holds goes to the tokenizer as it is.
    """

    PLAIN_TEXT = re.compile("[\x00-\x7eÀ-ÖØ-öø-įı-ɏ]*")
    PLAIN = re.compile("[!-~ß-öø-įı-ɏ]{1,40}")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^a-z0-9ß-öø-ɏ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # The printable stand-ins of byte-level tokenizers for single bytes.
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        for k, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + k)
        self.shown = shown
        self.parts = _Words(self._part, CACHE_BYTES // 3)
        self.chunks = _Words(self._chunk, CACHE_BYTES // 3 * 2)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.shown.__getitem__, part.encode()))
        ids = [t.id for t in self.tokenize(part)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        parts = self.PARTS.findall(chunk)
        return self.parts[chunk] if len(parts) == 1 else b"".join([self.parts[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if "<|" in text or not self.PLAIN_TEXT.fullmatch(text):
            return b"".join([self._whole(c) for c in text.split(" ") if c])
        return b"".join(map(self.chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every text."""
    path = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        step, tail = 4 * capacity, np.array([end], dtype="<u4").tobytes()
        for batch in (part for whole in batches for part in by_bytes(whole, "text")):
            rows, cols = [], ([], [], [], [])
            for row, value in enumerate(batch.column(1).to_pylist()):
                data = (encoder.encode(value) if value else b"") + tail
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at: at + step]
                    rows.append(row)
                    for c, v in zip(cols, (k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(pieces, f"doc_id {dict(slim.dtypes)['doc_id']}, {PIECES}")


def price(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack: the configuration of largest worth from the given lengths, at most ``most`` of each.

    Copies are offered as bundles of 1, 2, 4 ..., each a 0/1 item of the dynamic program.
    """
    best = np.zeros(capacity + 1)
    taken = []
    for size, w, n in zip(lengths.tolist(), worth.tolist(), np.minimum(most, capacity // lengths).tolist()):
        k = 1
        while n > 0:
            k = min(k, n)
            n -= k
            bulk = size * k
            other = best[: capacity + 1 - bulk] + w * k
            better = other > best[bulk:]
            best[bulk:][better] = other[better]
            taken.append((size, k, bulk, better))
            k *= 2
    config: dict[int, int] = {}
    at = int(best.argmax())
    for size, k, bulk, better in reversed(taken):
        if at >= bulk and better[at - bulk]:
            config[size] = config.get(size, 0) + k
            at -= bulk
    return config


def solve_lp(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations with fractional counts that together cover the histogram.

    Multiplicative weights for covering: a length is worth its tokens, and exponentially less the more of
    its demand is covered. A round prices the best configuration from all lengths and uses it as often as covers
    its scarcest length once; the sum of rounds, divided by the smallest cover, covers everything. The sum begins
    anew whenever the rounds have doubled, so early rounds leave it. The worths of a round are a
    dual solution, so it ends when the gap is below ``GAP`` or no better whole number of
    sequences is possible, for the fractions or for what they round to. With very many lengths ``WORK`` ends it
    earlier, with the better of the smallest cover and the rounded plan.
    """
    sizes = np.nonzero(counts)[0]
    if not len(sizes):
        return []
    most = counts[sizes].astype(np.int64)
    need = most.astype(np.float64)
    spot = {int(a): k for k, a in enumerate(sizes)}
    used: dict[tuple, float] = {}
    total, part, cover = 0.0, np.zeros(len(sizes)), np.zeros(len(sizes))
    best, found = np.inf, {}
    bound = float(need @ sizes) / capacity
    restart = FIRST
    for t in range(max(min(rounds, WORK // len(sizes)), 1)):
        if t == restart:
            plan = round_up(counts, list(used.items()), capacity)
            if sum(times for _, times in plan) < best:
                best, found = sum(times for _, times in plan), _merged(plan)
            used, total, part, restart = {}, 0.0, np.zeros(len(sizes)), 2 * restart
        if np.ceil(best - 1e-6) <= np.ceil(bound - 1e-6) or best <= bound * (1 + GAP):
            break
        worth = sizes * np.exp((cover.min() - cover) * max(RATE, 1 / np.sqrt(t + 4)))
        config = price(sizes, worth, most, capacity)
        at = np.array([spot[a] for a in config])
        copies = np.array(list(config.values()), dtype=np.float64)
        bound = max(bound, (worth @ need) / (worth[at] @ copies))
        step = (need[at] / copies).min()
        key = tuple(sorted(config.items(), reverse=True))
        used[key] = used.get(key, 0.0) + step
        total += step
        cover[at] += copies * step / need[at]
        part[at] += copies * step / need[at]
        low = part.min()
        if low > 0 and total / low < best:
            best, found = total / low, {k: v / low for k, v in used.items()}
    if not found:
        found = _merged(round_up(counts, list(used.items()), capacity))
    return [(dict(key), x) for key, x in found.items()]


def _merged(plan: list[tuple[dict[int, int], int]]) -> dict[tuple, float]:
    out: dict[tuple, float] = {}
    for config, times in plan:
        key = tuple(sorted(config.items(), reverse=True))
        out[key] = out.get(key, 0.0) + times
    return out


def round_up(counts: np.ndarray, mass: list[tuple[tuple, float]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the configurations, as far as pieces are left; best fit for the rest."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []

    def use(key: tuple, times: int) -> None:
        times = min([times, *[int(left[a]) // b for a, b in key]])
        if times > 0:
            for a, b in key:
                left[a] -= b * times
            plan.append((dict(key), times))

    for key, x in sorted(mass, key=lambda kx: -kx[1]):
        use(key, int(x + 1e-6))
    for key, x in sorted(mass, key=lambda kx: -(kx[1] % 1)):
        use(key, 1)
    return plan + best_fit(left, capacity)


def round_plan(
    counts: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations that hold every piece exactly once: the LP rounded, or best fit
    if that takes fewer sequences."""
    mass = [(tuple(config.items()), x) for config, x in solve_lp(counts, capacity, rounds)]
    plan, plain = round_up(counts, mass, capacity), best_fit(counts.astype(np.int64), capacity)
    return plain if sum(t for _, t in plain) < sum(t for _, t in plan) else plan


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by decreasing length on a histogram.

    Open sequences are held as counts by room and content class: the longest piece left opens a
    sequence, which is then filled with the longest pieces that still fit; equal fillings are
    made many at a time.
    """
    left = left.copy()
    present = [int(x) for x in np.nonzero(left)[0]]
    out = []
    while present:
        room, config = capacity, {}
        k = len(present) - 1
        while k >= 0 and room > 0:
            size = present[k]
            fit = min(int(left[size]), room // size)
            if fit:
                config[size] = fit
                room -= fit * size
            k = min(k - 1, int(np.searchsorted(present, room, side="right")) - 1)
        times = min(int(left[a]) // b for a, b in config.items())
        for a, b in config.items():
            left[a] -= b * times
        present = [x for x in present if left[x] > 0] if any(left[a] == 0 for a in config) else present
        out.append((config, times))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, first, last, per, sequence, offset``: ranks first..last-1 of a length fill
    ``per`` places of each sequence from ``sequence`` on, from ``offset`` on."""
    rows, used, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for size in sorted(config, reverse=True):
            per = config[size]
            first = used.get(size, 0)
            used[size] = first + per * times
            rows.append((size, first, used[size], per, sequence, offset))
            offset += size * per
        sequence += times
    return rows


def rank_by_length(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``rank``, from 0, among the pieces of the same length."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    ranked = salted.withColumn("local", local)
    # At most capacity x salts rows, whatever the number of pieces.
    return ranked.join(F.broadcast(shifts), ["length", "salt"]).withColumn(
        "rank", F.col("local") - 1 + F.col("shift")).drop("salt", "local", "shift")


def place(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give each piece ``sequence_id`` and ``offset``; pieces must be a stored table."""
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():     # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    rows = slots(round_plan(counts, capacity, rounds))
    table: dict[int, list] = {}
    for size, first, last, per, sequence, offset in rows:
        table.setdefault(size, []).append((first, last, per, sequence, offset))
    plan = spark.createDataFrame(
        [(size, v) for size, v in table.items()],
        "length long, slots array<struct<first:long,last:long,per:long,sequence:long,offset:long>>")
    ranked = rank_by_length(pieces).join(F.broadcast(plan), "length")
    slot = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])), 1)
    at = F.col("rank") - F.col("slot.first")
    return ranked.withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(at / F.col("slot.per"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + (at % F.col("slot.per")) * F.col("length")).cast("long").alias("offset"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None,
    capacity: int = CAPACITY, end: int = END, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    return place(settle(token_pieces(docs, id_col, text, vocabulary, capacity, end)), capacity, rounds)
