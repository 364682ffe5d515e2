"""Self-join of texts on the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Texts with equal shingle sets are one class, found by a 128-bit digest; only one signature
   per class goes on, so copies cost one row each and are never paired.
2. Bands of the MinHash signature that two classes share make them candidates. Candidates are linked
   to the least class of the band, and the components of these links hold all candidate pairs.
3. Each component is compared in tasks. Signatures are read ``STEP`` values at a time; after each
   step pairs whose posterior probability of a similarity of at least ``threshold`` (uniform prior, given
   the values that agree) is below ``tolerance`` are dropped. The rest is verified exactly on the
   shingle sets. Components of more than ``CHUNK`` classes are cut into chunks by hash, and every two
   chunks meet in a task of their own, so a hot group is spread over many tasks.
4. Tasks return the number of links per class, and each class with the least one it is linked to over any
   number of links, never the pairs. The components of these are the groups.

Two texts that reach the threshold are missed only if no band agrees (probability (1 - t^4)^24, or
3e-6, at t = 0.8) or by the tolerance.

Defined cases: a very long text is one row with the set of all its shingles. Texts of fewer than ``WIDTH`` words have one shingle of all their words; texts that are
null or without a word are alone. Words are compared in lower case. Rows with equal id and text get equal
results. Input columns other than id and text are not read, so they cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, text_mark
from .components import components
from .wordhash import Words, by_bytes, mix, shingles

WIDTH = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, BAND = 24, 4      # 96 MinHash values
STEP = 16
CHUNK = 512              # classes of a component that are compared in one task with those of another chunk
MASK = np.uint64(0xFFFFFFFF)


def _hash_families() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, 2 * BANDS * BAND + 1, dtype=np.uint64)
    draws = mix(k)
    return draws[: BANDS * BAND] | np.uint64(1), draws[BANDS * BAND:]


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of each row, (rows, hashes) of 32 bits; rows must not be empty."""
    odd, plus = _hash_families()
    out = np.zeros((len(bounds) - 1, len(odd)), dtype=np.uint32)
    at = 0
    while at < len(bounds) - 1:
        # As many rows at a time as fit the processor's cache, one at least.
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 16), side="right")) - 1)
        part = values[bounds[at]: bounds[to]]
        starts = bounds[at:to] - bounds[at]
        for k in range(len(odd)):
            out[at:to, k] = np.minimum.reduceat(part * odd[k] + plus[k] >> np.uint64(32), starts)
        at = to
    return out


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, one after the other, and the row bounds."""
    values, bounds = shingles(Words(texts), WIDTH)
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            values, bounds = _sets(batch.column("text"))
            sizes = np.diff(bounds)
            rows = np.nonzero(sizes)[0]
            if not len(rows):
                continue
            sigs = signatures(values, np.concatenate([bounds[:-1][rows], [bounds[-1]]]))
            keys = [hashlib.blake2b(values[bounds[r]: bounds[r + 1]].tobytes(), digest_size=16).digest() for r in rows]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("mark").take(take), pa.array(keys, pa.binary()),
                 pa.array([s.tobytes() for s in sigs], pa.binary())], names=["id", "mark", "key", "sig"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            values, bounds = _sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("comp"), batch.column("chunk"), batch.column("chunks"), batch.column("sig"),
                 pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["key", "comp", "chunk", "chunks", "sig", "items"])


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches that keep a pair alive.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1); that it reaches
    t has the probability that a Binomial(n + 1, t) is at most m.
    """
    out = {}
    for n in range(STEP, BANDS * BAND + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature arrays that outlive the incremental comparison."""
    if same:
        i, j = np.triu_indices(len(a), 1)
    else:
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    matches = np.zeros(len(i), dtype=np.int64)
    for n, fewest in least.items():
        matches += (a[i, n - STEP: n] == b[j, n - STEP: n]).sum(axis=1)
        alive = matches >= fewest
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def verified(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted arrays reach the threshold, exactly.

    Few pairs are intersected one by one. Many pairs among the same rows are counted with
    products of 0/1 matrices over blocks of the shingles that occur in both sides.
    """
    size_a = np.array([len(x) for x in sets_a], dtype=np.int64)
    size_b = np.array([len(x) for x in sets_b], dtype=np.int64)
    if len(i) <= 4 * (len(sets_a) + len(sets_b)):
        common = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j)], dtype=np.int64)
    else:
        flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
        rows_a, rows_b = np.repeat(np.arange(len(sets_a)), size_a), np.repeat(np.arange(len(sets_b)), size_b)
        both = np.intersect1d(flat_a, flat_b)
        keep_a, keep_b = np.isin(flat_a, both), np.isin(flat_b, both)
        col_a, col_b = np.searchsorted(both, flat_a[keep_a]), np.searchsorted(both, flat_b[keep_b])
        rows_a, rows_b = rows_a[keep_a], rows_b[keep_b]
        product = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
        block = 1 << 13
        order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
        col_a, rows_a, col_b, rows_b = col_a[order_a], rows_a[order_a], col_b[order_b], rows_b[order_b]
        for at in range(0, len(both), block):
            m = []
            for col, rows, n in ((col_a, rows_a, len(sets_a)), (col_b, rows_b, len(sets_b))):
                x, y = np.searchsorted(col, [at, at + block])
                part = np.zeros((n, min(block, len(both) - at)), dtype=np.float32)
                part[rows[x:y], col[x:y] - at] = 1
                m.append(part)
            product += m[0] @ m[1].T      # sums below 2**24 are exact
        common = product[i, j].astype(np.int64)
    union = size_a[i] + size_b[j] - common
    return common >= threshold * union - 1e-9


def stars(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node of the links with the least node that they connect it to, but for that node itself."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _compare(threshold: float, tolerance: float):
    """A grouped function over the classes of one chunk, or of two chunks that meet."""
    def compare(table: pa.Table) -> pa.Table:
        least = least_matches(threshold, tolerance)
        table = table.sort_by("key")      # so the least number is the least key
        keys, chunk = table["key"].to_pylist(), np.array(table["chunk"].to_pylist())
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(len(keys), -1)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["items"].to_pylist()]
        one = table["c1"][0].as_py() == table["c2"][0].as_py()
        side_a = np.arange(len(keys)) if one else np.nonzero(chunk == table["c1"][0].as_py())[0]
        side_b = side_a if one else np.nonzero(chunk == table["c2"][0].as_py())[0]
        links = np.zeros(len(keys), dtype=np.int64)
        found = []
        rows = max(1, (1 << 18) // max(1, len(side_b)))
        for at in range(0, len(side_a), rows):      # bounds the pairs held at once
            part = side_a[at: at + rows]
            i, j = surviving(sigs[part], sigs[side_b], False, least)
            i, j = part[i], side_b[j]
            if one:
                i, j = i[i < j], j[i < j]
            if len(i):
                local = {x: k for k, x in enumerate(np.unique(np.concatenate([i, j])).tolist())}
                used = list(local)
                near = verified([sets[x] for x in used], [sets[x] for x in used],
                                np.array([local[x] for x in i.tolist()]), np.array([local[x] for x in j.tolist()]), threshold)
                i, j = i[near], j[near]
                links += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
                found = stars([*found, *zip(i.tolist(), j.tolist())])
        rows_a = [k for k in range(len(keys)) if links[k]]
        return pa.table({
            "a": pa.array([keys[k] for k in rows_a] + [keys[x] for x, _ in found], pa.binary()),
            "b": pa.array([None] * len(rows_a) + [keys[y] for _, y in found], pa.binary()),
            "links": pa.array([int(links[k]) for k in rows_a] + [0] * len(found), pa.int64()),
        })
    return compare


def band_links(reps: DataFrame) -> DataFrame:
    """Each class linked to the least class that shares a band with it."""
    width = 4 * BAND
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width))))
    rows = reps.select("key", F.explode(bands).alias("band"))
    least = rows.groupBy("band").agg(F.min("key").alias("least"), F.max("key").alias("most")).where(
        "least < most").select("band", "least")
    return rows.join(least, "band").where("key != least").select("key", "least").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per text: ``id, mark, group_id, n_links, n_copies, first``.

    ``group_id`` is the least id of the texts joined to it by links, ``n_links`` the number of different
    shingle sets that reach the threshold with its own, ``n_copies`` the texts with the same set,
    itself included, and ``first`` whether it is the first of its group by id and mark.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["id"]
    signed = settle(slim.where(F.col("text").isNotNull()).mapInArrow(
        _sign, f"id {kind}, mark long, key binary, sig binary"))
    reps = signed.groupBy("key").agg(F.min(F.struct("id", "mark", "sig")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = reps.select("key", "r.*", "copies")
    comps = components(band_links(reps))
    sizes = comps.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = (
        comps.join(sizes, "root").select(
            F.col("node").alias("key"), F.col("root").alias("comp"), chunks.alias("chunks"),
            F.pmod(F.xxhash64("node"), chunks.cast("long")).cast("int").alias("chunk"))
        .join(reps.drop("copies"), "key")
    )
    texts = slim.join(members, slim["id"].eqNullSafe(members["id"]) & (slim["mark"] == members["mark"])).select(
        "key", "comp", "chunk", "chunks", "sig", "text")
    sets = texts.mapInArrow(_with_sets, "key binary, comp binary, chunk int, chunks int, sig binary, items binary")
    # A repeated row brings its class twice; one is enough.
    met = sets.dropDuplicates(["key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "comp", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "key", "sig", "items")
    found = settle(met.groupBy("comp", "c1", "c2").applyInArrow(
        _compare(threshold, tolerance), "a binary, b binary, links long"))
    links = found.where("links > 0").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    known = (
        reps.select("key", "id", "mark", "copies")
        .join(links, "key", "left")
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("root", "key").alias("root"), F.struct("id", "mark").alias("place"))
    )
    heads = known.groupBy("root").agg(F.min("place").alias("head"))
    known = known.join(heads, "root").select("key", "copies", "n_links", "head")
    rows = slim.select("id", "mark").join(
        signed.select(F.col("id").alias("i"), F.col("mark").alias("m"), "key").distinct(),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").drop("i", "m")
    out = rows.join(known, "key", "left")
    return out.select(
        "id", "mark",
        F.when(F.col("head").isNotNull(), F.col("head.id")).otherwise(F.col("id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("head").isNull() | (F.col("head.id").eqNullSafe(F.col("id")) & (F.col("head.mark") == F.col("mark")))).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first text of every group; texts without a word stay, repeated rows become one."""
    found = settle(near_duplicates(docs, id_col, text, **options))
    i, m, k = fresh(docs, "_id", "_mark", "_key")
    lost = found.where(~F.col("first")).select(F.col("id").alias(i), F.col("mark").alias(m)).distinct()
    out = docs.withColumn(k, text_mark(F.col(text))).join(
        lost, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(m)), "left_anti")
    if not found.where("first").groupBy("id", "mark").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, k])
    return out.drop(k)
