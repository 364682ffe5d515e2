"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts and items are sequences of words (lower case, cut at white space); an item of n words is found
where some stretch of a text is within ``limit = floor(max_share * n)`` word edits of it.

1. Windows. At every word of a text a window may begin for every size class of items (sizes within a
   factor ``CLASS``). A stretch within the limit keeps all but limit of the item's words; so it holds at least
   c - limit of any c of them, and of the c rarest in particular. Windows that cannot hold that many for any
   item of their class are left out; this loses nothing, whatever the texts.
2. CGK embedding. A window is walked with random bits that depend on step and word: each
   step emits the word at the pointer, then the pointer stays or moves on. The same bits are used for items, so
   a small edit distance becomes a small Hamming distance of the walks.
3. Bit sampling. Each of ``WALKS`` walks feeds ``TABLES`` hash tables whose keys are
   ``SAMPLED`` emitted words at random steps. Equal keys of item and window make a candidate.
4. Verification. Candidates of one item are merged to stretches, widened by the limit, and the exact least
   edit distance of the item to any part of the stretch is computed. Only that decides.

An exact copy meets its item in every table; the recall at other distances is measured in the tests. The
benchmark reaches tasks in blocks of at most ``BLOCK_WORDS`` words, so a task never holds more than a
block's tables; every text is read once per block. Texts are not shuffled.

Defined cases: null or empty texts match nothing, nor do items without words. Of equal items each is
reported. Rows are judged one by one, so repeated rows give repeated results. A long text is
handled ``PIECE`` windows at a time. Only the id and text of the input are read, so other columns cannot
clash. An empty table, or an empty benchmark, gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_mark
from .wordhash import Words, by_bytes, mix

MAX_SHARE = 0.15
CLASS = 1.25
WALKS, TABLES, SAMPLED = 8, 6, 2
PIECE = 1 << 17
BLOCK_WORDS = 1 << 20
EXTRA_SEEDS = 4      # rarest words of an item that are looked for, beyond twice its limit
PAD = np.uint64(0x5851F42D4C957F2D)


def _draw(*parts: int) -> int:
    h = np.zeros(1, dtype=np.uint64)
    for p in parts:
        h = mix(h + np.uint64(p + 1))
    return int(h[0])


def walk(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """What the walks from ``begin`` emit at the (sorted) ``steps``: (walks, steps) of word hashes.

    A walk whose pointer has reached ``stop`` emits padding.
    """
    out = np.empty((len(begin), len(steps)), dtype=np.uint64)
    padded = np.append(words, PAD)
    at = begin.copy()
    wanted = {int(s): k for k, s in enumerate(steps)}
    for step in range(int(steps[-1]) + 1):
        here = padded[np.minimum(at, len(words))]
        ended = at >= stop
        if ended.any():
            here = np.where(ended, PAD, here)
        if step in wanted:
            out[:, wanted[step]] = here
        bits = (here * np.uint64(_draw(seed, step) | 1)) >> np.uint64(63)
        at += bits.astype(np.int64)
    return out


@dataclass(frozen=True)
class Tables:
    """The hash tables of one size class."""
    length: int                 # words of a window
    steps: tuple                # of each walk: (sorted steps, columns of each table)
    keys: tuple                 # of each table: sorted keys
    items: tuple                # of each table: item numbers in the order of the keys


@dataclass(frozen=True)
class Index:
    words: tuple                # word hashes of each item
    ids: tuple
    limits: tuple
    seeds: np.ndarray           # sorted hashes of the items' rarest words
    seed_from: np.ndarray       # bounds of each seed's items in ``seed_items``
    seed_items: np.ndarray
    needed: np.ndarray          # of each item: how many of its seeds a stretch holds at least
    span: np.ndarray            # of each item: the longest stretch within its limit
    group: np.ndarray           # of each item: its size class
    tables: tuple


def _keys(emitted: np.ndarray, columns: np.ndarray, table: int) -> np.ndarray:
    key = np.full(len(emitted), _draw(77, table), dtype=np.uint64)
    for c in columns:
        key = mix(key ^ emitted[:, c])
    return key


def build_index(ids: list, texts: list, max_share: float = MAX_SHARE) -> Index:
    cut = Words(pa.array(texts, pa.string()))
    words = [cut.hash[a:b] for a, b in zip(cut.first[:-1], cut.first[1:])]
    some = [k for k, w in enumerate(words) if len(w)]
    words, ids = [words[k] for k in some], [ids[k] for k in some]
    limits = [int(max_share * len(w)) for w in words]
    classes: list[list[int]] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if not classes or len(words[k]) > CLASS * len(words[classes[-1][0]]):
            classes.append([])
        classes[-1].append(k)
    tables = []
    for number, members in enumerate(classes):
        low, high = len(words[members[0]]), len(words[members[-1]])
        flat = np.concatenate([words[k] for k in members])
        ends = np.cumsum([len(words[k]) for k in members])
        begins = ends - np.array([len(words[k]) for k in members])
        steps, keys, items = [], [], []
        for w in range(WALKS):
            # Steps within the shortest item's usual walk; a walk makes about two steps a word.
            reach = max(1, 2 * low - 2)
            rng = np.random.default_rng([number, w, low])
            drawn = rng.integers(0, reach, size=(TABLES, SAMPLED))
            used = np.unique(drawn)
            steps.append((used, np.searchsorted(used, drawn)))
            emitted = walk(flat, begins, ends, used, w)
            for t in range(TABLES):
                key = _keys(emitted, steps[-1][1][t], w * TABLES + t)
                order = np.argsort(key, kind="stable")
                keys.append(key[order])
                items.append(np.array(members)[order])
        tables.append(Tables(high, tuple(steps), tuple(keys), tuple(items)))
    group = np.zeros(len(words), np.int64)
    for number, members in enumerate(classes):
        group[members] = number
    holders = Counter(w for own in words for w in set(own.tolist()))
    seeds: dict[int, list[int]] = {}
    needed = np.zeros(len(words), np.int64)
    for k, own in enumerate(words):
        rarest = sorted(own.tolist(), key=holders.__getitem__)[: 2 * limits[k] + EXTRA_SEEDS]
        needed[k] = len(rarest) - limits[k]
        for w in set(rarest):
            seeds.setdefault(w, []).append(k)
    order = sorted(seeds)
    return Index(
        tuple(words), tuple(ids), tuple(limits), np.array(order, dtype=np.uint64),
        np.cumsum([0, *[len(seeds[w]) for w in order]]), np.array([k for w in order for k in seeds[w]], dtype=np.int64),
        needed, np.array([len(w) + n for w, n in zip(words, limits)], dtype=np.int64), group, tuple(tables))


def edit_distance(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Least edits from the item to any stretch of ``part``; where that stretch begins and ends."""
    n = len(part)
    place = np.arange(n + 1)
    cost = np.zeros(n + 1, dtype=np.int64)
    begin = place.copy()
    for k, word in enumerate(item):
        up = cost + 1
        across = np.concatenate([[k + 1], cost[:-1] + (part != word)])
        from_across = np.concatenate([[0], begin[:-1]])
        best = np.minimum(up, across)
        start = np.where(across <= up, from_across, begin)
        # A run of insertions: the least of best[j'] + (j - j') over j' <= j.
        shifted = best - place
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, place, 0))
        cost, begin = low + place, start[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Finder:
    def __init__(self, index: Index):
        self.index = index
        # A bit table answers most lookups of words that no item has.
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(index.seeds >> np.uint64(42)).astype(np.int64)] = True

    def begins(self, words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each size class, where windows begin that can hold enough of some item's seeds."""
        ix = self.index
        at = np.nonzero(self.bits[(words >> np.uint64(42)).astype(np.int64)])[0]
        slot = np.minimum(np.searchsorted(ix.seeds, words[at]), len(ix.seeds) - 1)
        real = ix.seeds[slot] == words[at]
        at, slot = at[real], slot[real]
        n = ix.seed_from[slot + 1] - ix.seed_from[slot]
        item = ix.seed_items[np.repeat(ix.seed_from[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(n) else n
        at = np.repeat(at, n)
        order = np.lexsort((at, item))
        at, item = at[order], item[order]
        # The hit that completes the needed number, if it is of the same item and text and near enough.
        end = np.arange(len(at)) + ix.needed[item] - 1
        ok = end < len(at)
        end = np.minimum(end, max(len(at) - 1, 0))
        text = np.searchsorted(first, at, side="right")
        ok &= (item[end] == item) & (text[end] == text) & (at[end] - at < ix.span[item])
        low = np.maximum(at[end] - ix.span[item] + 1, first[text - 1])[ok]
        high, group = at[ok], ix.group[item[ok]]
        out = []
        for number in range(len(ix.tables)):
            mine = group == number
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(marks, low[mine], 1)
            np.add.at(marks, high[mine] + 1, -1)
            out.append(np.nonzero(np.cumsum(marks)[:-1])[0])
        return out

    def candidates(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts and item numbers whose keys meet; ``first`` bounds the texts in ``words``."""
        starts, items = [], []
        for table, at in zip(self.index.tables, self.begins(words, first)):
            for piece in range(0, len(at), PIECE):
                begin = at[piece: piece + PIECE]
                stop = np.minimum(begin + table.length, first[np.searchsorted(first, begin, side="right")])
                for w, (steps, columns) in enumerate(table.steps):
                    emitted = walk(words, begin, stop, steps, w)
                    for t in range(TABLES):
                        keys = table.keys[w * TABLES + t]
                        key = _keys(emitted, columns[t], w * TABLES + t)
                        left = np.searchsorted(keys, key, side="left")
                        hit = np.nonzero(keys[np.minimum(left, len(keys) - 1)] == key)[0]
                        if len(hit):
                            right = np.searchsorted(keys, key[hit], side="right")
                            n = right - left[hit]
                            spread = np.repeat(left[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                            starts.append(np.repeat(begin[hit], n))
                            items.append(table.items[w * TABLES + t][spread])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)], axis=1), axis=0)
        return pairs[:, 1], pairs[:, 0]

    def find(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, begin, end) in words of the text: the best match of each pair."""
        starts, items = self.candidates(words, first)
        texts = np.searchsorted(first, starts, side="right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        k = 0
        while k < len(starts):
            text, item = int(texts[k]), int(items[k])
            own, limit = self.index.words[item], self.index.limits[item]
            k2 = k + 1
            while k2 < len(starts) and items[k2] == item and texts[k2] == text and starts[k2] - starts[k2 - 1] <= len(own):
                k2 += 1
            a = max(int(first[text]), int(starts[k]) - limit)
            b = min(int(first[text + 1]), int(starts[k2 - 1]) + len(own) + 2 * limit)
            d, x, y = edit_distance(own, words[a:b])
            if d <= limit and (d, a + x) < best.get((text, item), (limit + 1, 0, 0))[:2]:
                best[text, item] = (d, a + x, a + y)
            k = k2
        return [(t, i, *v) for (t, i), v in best.items()]


def _matches(index: Index):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                cut = Words(batch.column("text"))
                rows = sorted(finder.find(cut.hash, cut.first)) if len(cut.hash) else []
                if not rows:
                    continue
                take = pa.array([r[0] for r in rows])
                low = cut.first
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("mark").take(take),
                     pa.array([index.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                     pa.array([int(r[3] - low[r[0]]) for r in rows], pa.int32()), pa.array([int(r[4] - low[r[0]]) for r in rows], pa.int32())],
                    names=["id", "mark", "item_id", "distance", "first_word", "end_word"])
    return matches


def benchmark_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """The benchmark in blocks of about ``block_words`` words, one at a time on the driver."""
    slim = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    words = slim.agg(F.sum(F.size(F.split("t", r"\s+")))).head()[0] or 0
    blocks = -(-words // block_words)
    for k in range(blocks):
        part = slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = sorted((r["i"] is None, r["i"] or 0, r["t"]) for r in part.collect())
        yield [(None if null else i, t) for null, i, t in rows]


def find_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_share: float = MAX_SHARE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``id, mark, item_id, distance, first_word, end_word``: the nearest stretch of each text for
    each item that it holds within the limit."""
    slim = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, mark long, item_id long, distance int, first_word int, end_word int"
    out = None
    for block in benchmark_blocks(items, item_id, item_text, block_words):
        index = build_index([i for i, _ in block], [t for _, t in block], max_share)
        if index.words:
            found = slim.where(F.col("text").isNotNull()).mapInArrow(_matches(index), schema)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Texts without a match of any item."""
    i, m, k = fresh(docs, "_id", "_mark", "_key")
    hit = find_matches(docs, items, id_col, text, **options).select(F.col("id").alias(i), F.col("mark").alias(m)).distinct()
    return docs.withColumn(k, text_mark(F.col(text))).join(
        hit, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(m)), "left_anti").drop(k)
