"""Hashes of the words of many texts at once, from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20                       # bytes hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers have inverses modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n or len(_POWERS["up"]) > 4 * max(n, PIECE):
        size = max(n, PIECE)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """The words of a column of texts: ``hash``, byte ``start`` and ``end``, and ``first[row]``, the
    number of the first word of each row (with one entry more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.utf8_lower(texts)
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        low = int(ends[0]) if len(texts) else 0
        self.rows = ends - low
        self.raw = np.frombuffer(data, dtype=np.uint8)[low: int(ends[-1])] if data is not None and len(texts) else np.zeros(0, np.uint8)
        self._cut()

    def _cut(self) -> None:
        raw, n = self.raw, len(self.raw)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = self.rows[(self.rows > 0) & (self.rows < n)]     # a row's end also ends a word
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.start = np.nonzero(begins)[0]
        self.end = np.nonzero(stops)[0] + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + PIECE, side="right")))
            part = raw[base: self.end[to - 1]]
            up, down = _powers(len(part))
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
            a, b = self.start[at:to] - base, self.end[at:to] - base
            self.hash[at:to] = mix((sums[b] - sums[a]) * down[a])
            at = to


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; one row at least.

    After a batch, what Arrow has freed goes back to the system: workers stay alive between tasks.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``width`` words, and the row bounds in them.

    A row with fewer words than that has one shingle of all its words; one without words has none.
    """
    h, count = words.hash, np.diff(words.first)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        full += h[k: len(h) - width + 1 + k] * odd[k] if len(full) else np.uint64(0)
    full = mix(full)
    sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    long_rows = count >= width
    # Positions of the long rows' shingles among all windows, in one gather.
    take = np.repeat(words.first[:-1][long_rows] - bounds[:-1][long_rows], sizes[long_rows])
    slot = np.repeat(long_rows, sizes)
    out[slot] = full[np.nonzero(slot)[0] + take]
    for row in np.nonzero(~long_rows & (count > 0))[0]:
        part = h[words.first[row]: words.first[row + 1]]
        out[bounds[row]] = mix(np.array([(part * odd[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))]))[0]
    return out, bounds
