"""Exact largest inner products of a query set against all rows, by best-first search in metric trees.

Vectors become integers, floor(scale * x). With one more component, sqrt(M - |x|^2) for the largest squared
length M of all (0 for a query), every row lies on one sphere, and the distance from a query grows as the
inner product falls. Distances obey the triangle inequality, so an M-tree can be searched exactly.

Building: a bounded sample of rows (``ROOTS``) gives routing objects; every row goes to its nearest one. A
cell with many rows is dealt over several trees by a hash of the row, so a tree has a bounded number of bytes
whatever the cell holds, copies included. A tree is filled by splitting its rows at two far pivots into halves
until they fit a page. Every page has a routing object out of its rows, a covering radius, and its distance from
the tree's routing object; every row keeps its distance from the page's. A tree is one row of a
table in the shared folder.

Searching: queries travel to the trees in blocks, a bounded number of bytes of them in one broadcast; more
queries take more passes over the trees. Where a task meets a tree, every query takes the page with the least bound
next, until no page can hold a better row. A page whose bound follows from stored distances alone is not
measured, a row whose distance from the page's routing object rules it out is not multiplied, and a
tree beyond its covering radius is left at once. What a task has found bounds what it looks for in the
next trees. Each task sends at most k rows a query; the k best of all are the result. A fixed number of
rows (``SEEDS``) is compared with all queries first, so that search begins with a bound.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate. Of vectors of several lengths, a missing component counts as 0; an empty vector scores 0
with all. A row is told from others by its place, not by its id: repeated rows are candidates of each
other and each a query of its own, ties go to the smaller id (null last), then to any. Rows with a null id are
candidates only. Fewer rows than k give them all; an empty table gives an empty result. Inner products are
exact as long as they fit a long. Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

ROOTS = 64                 # rows drawn as routing objects of the cells
SEEDS = 512                # rows that every query meets before the search
TREE_BYTES = 8 << 20       # integer vectors of one tree, about
PAGE = 256                 # rows of a page
QUERY_BYTES = 32 << 20     # query vectors of one broadcast, about
BLOCK_ROWS = 1024          # queries that search a tree together
EXACT = float(1 << 53)     # products of doubles are exact below
VECTOR = "row long, id long, x array<long>"


def usable(vector) -> F.Column:
    """Neither null nor with a null or non-finite component."""
    ok = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vector.isNotNull() & ok


def integer_rows(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``row, id, x``: usable vectors as integers, with a number of their own; stored in the shared folder."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = df.where(usable(F.col(vector))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return settle(kept.select(F.monotonically_increasing_id().alias("row"), "id", "x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Distances between integer vectors on the sphere of squared radius ``top``."""

    def __init__(self, width: int, top: int):
        self.width, self.top = width, top
        self.kind = np.float64 if max(top, 1) < EXACT else np.int64   # a product is no more than ``top``

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))])

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (q.astype(self.kind) @ x.astype(self.kind).T).astype(np.int64)

    def reach(self, lengths: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from a query of that squared length a row of that score lies, at most; the slack
        covers rounding, so that equal scores are never lost."""
        far = lengths + self.top - 2 * score.astype(np.float64)
        return np.sqrt(np.maximum(far, 0)) + self.slack

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(float(self.top)))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a from all rows of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


# --- building ------------------------------------------------------------------------------------

def _pages(points: np.ndarray, page: int) -> list[np.ndarray]:
    """Row numbers of each page: halves at two far pivots, again and again."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= page:
            done.append(rows)
            continue
        part = points[rows]
        one = part[gaps(part[:1], part)[0].argmax()]
        two = part[gaps(one[None], part)[0].argmax()]
        order = np.argsort(part @ (two - one), kind="stable")   # distance from one less that from two
        half = max(page, len(rows) // 2 // page * page)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return done


TREE = ("rows binary, ids array<long>, x binary, starts array<int>, centres array<int>, radius array<double>,"
        " parent array<double>, own array<double>, root int, reach double")


def _tree(rows: np.ndarray, ids: list, x: np.ndarray, space: Space, page: int) -> dict:
    points = space.lift(x)
    parts = _pages(points, page)
    order = np.concatenate(parts)
    points, starts = points[order], np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    centres, own, radius = [], np.zeros(len(order)), []
    for a, b in zip(starts, starts[1:]):
        middle = points[a:b].mean(axis=0)
        centre = a + int(gaps(middle[None], points[a:b])[0].argmin())
        own[a:b] = gaps(points[centre][None], points[a:b])[0]
        centres.append(centre)
        radius.append(own[a:b].max())
    heads = points[centres]
    root = centres[int(gaps(heads.mean(axis=0)[None], heads)[0].argmin())]
    parent = gaps(points[root][None], heads)[0]
    return {
        "rows": rows[order].tobytes(), "ids": [ids[i] for i in order], "x": x[order].tobytes(), "starts": starts.tolist(),
        "centres": centres, "radius": radius, "parent": parent.tolist(), "own": own.tolist(), "root": int(root),
        "reach": float(gaps(points[root][None], points)[0].max()),
    }


def build(rows: DataFrame, space: Space, roots: int = ROOTS, tree_bytes: int = TREE_BYTES, page: int = PAGE) -> DataFrame:
    """A table of trees over ``row, id, x``, stored in the shared folder."""
    heads = _draw(rows, roots, space)
    most = max(page, tree_bytes // (8 * (space.width + 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted = space.lift(heads)
        for batch in batches:
            cell = gaps(space.lift(matrix(batch.column("x"), space.width)), lifted).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    celled = rows.mapInArrow(assign, f"{VECTOR}, cell int")
    # A row for each cell: at most ``roots`` of them.
    counts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(most))).alias("trees"))
    dealt = celled.join(F.broadcast(counts), "cell").withColumn("tree", F.pmod(F.xxhash64("row"), F.col("trees")))

    def grow(group: pa.Table) -> pa.Table:
        one = group.combine_chunks()
        x = one.column("x").chunk(0) if one.num_rows else pa.array([], pa.list_(pa.int64()))
        tree = _tree(one.column("row").to_numpy().astype("<i8"), one.column("id").to_pylist(), matrix(x, space.width), space, page)
        return pa.table({k: [v] for k, v in tree.items()}, schema=grown)

    grown = pa.schema([
        ("rows", pa.binary()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("starts", pa.list_(pa.int32())),
        ("centres", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("parent", pa.list_(pa.float64())),
        ("own", pa.list_(pa.float64())), ("root", pa.int32()), ("reach", pa.float64())])
    return settle(dealt.select("row", "id", "x", "cell", "tree").groupBy("cell", "tree").applyInArrow(grow, TREE))


def _draw(rows: DataFrame, n: int, space: Space) -> np.ndarray:
    """At most n rows, the first by a hash of their number."""
    drawn = rows.orderBy(F.xxhash64("row", F.lit(13)), "row").limit(n).select("x").collect()
    out = np.zeros((len(drawn), space.width), dtype=np.int64)
    for i, r in enumerate(drawn):
        out[i, : len(r["x"])] = r["x"]
    return out


# --- searching -----------------------------------------------------------------------------------

LAST = np.iinfo(np.int64).max    # stands for a null id, which comes after all others


class Best:
    """The k best rows of each query of a block so far."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, seen: np.ndarray, k: int, space: Space):
        self.rows, self.x, self.k, self.space = rows, x, k, space
        self.points = np.column_stack([x.astype(np.float64), np.zeros(len(x))])
        self.lengths = (self.points ** 2).sum(axis=1)
        self.floor = seen             # a score that k other rows are known to reach
        self.score = np.full((len(x), k), np.iinfo(np.int64).min)
        self.id = np.full((len(x), k), LAST)
        self.row = np.full((len(x), k), -1)

    def reach(self, at=slice(None)) -> np.ndarray:
        least = np.maximum(self.floor[at], self.score[at, -1])
        return np.where(least == np.iinfo(np.int64).min, np.inf, self.space.reach(self.lengths[at], least))

    def take(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = self.rows[at][:, None] == rows[None, :]
        least = np.maximum(self.floor[at], self.score[at, -1])
        good = (scores >= least[:, None]) & ~own
        some = good.any(axis=1)
        at, good, scores = at[some], good[some], scores[some]
        for i, q in enumerate(at):
            new = np.nonzero(good[i])[0]
            score = np.concatenate([self.score[q], scores[i, new]])
            id_, row = np.concatenate([self.id[q], ids[new]]), np.concatenate([self.row[q], rows[new]])
            order = np.lexsort((id_, row < 0, ~score))[: self.k]   # ~ falls as the score rises
            self.score[q], self.id[q], self.row[q] = score[order], id_[order], row[order]


class Tree:
    def __init__(self, r: dict, space: Space):
        self.space = space
        self.rows = np.frombuffer(r["rows"], dtype="<i8")
        self.null = np.array([i is None for i in r["ids"]])
        self.ids = np.array([LAST if i is None else i for i in r["ids"]], dtype=np.int64)
        self.x = np.frombuffer(r["x"], dtype=np.int64).reshape(len(self.rows), space.width)
        self.starts, self.centres = np.array(r["starts"]), np.array(r["centres"])
        self.radius, self.parent, self.own = (np.array(r[c]) for c in ("radius", "parent", "own"))
        self.reach = r["reach"]
        points = space.lift(self.x[[*self.centres, r["root"]]])
        self.heads, self.root = points[:-1], points[-1:]

    def search(self, best: Best) -> int:
        """Bring the tree's rows into the best of every query; returns the products computed."""
        slack, work = self.space.slack, 0
        to_root = gaps(best.points, self.root)[:, 0]
        near = np.nonzero(to_root - self.reach <= best.reach())[0]
        if not len(near):
            return 0
        # Bounds of the pages from stored distances; infinite once a page is done with.
        bound = np.abs(to_root[near][:, None] - self.parent) - self.radius - slack
        bound = np.maximum(bound, 0)
        measured = np.zeros(bound.shape, dtype=bool)
        distance = np.zeros(bound.shape)
        while len(near):
            page = bound.argmin(axis=1)
            here = np.arange(len(near))
            open_ = (bound[here, page] < np.inf) & (bound[here, page] <= best.reach(near))
            if not open_.all():
                near, bound, measured, distance = near[open_], bound[open_], measured[open_], distance[open_]
                page, here = page[open_], np.arange(open_.sum())
            order = np.argsort(page, kind="stable")
            cuts = np.nonzero(np.diff(page[order]))[0] + 1
            for group in np.split(order, cuts) if len(order) else ():
                p, q = page[group[0]], near[group]
                new = ~measured[group, p]
                if new.any():
                    # First the page's own distance; the page waits until its true bound is the least.
                    far = gaps(best.points[q[new]], self.heads[p][None])[:, 0]
                    work += len(far)
                    distance[group[new], p], measured[group[new], p] = far, True
                    bound[group[new], p] = np.maximum(far - self.radius[p] - slack, 0)
                    group, q = group[~new], q[~new]
                    if not len(group):
                        continue
                bound[group, p] = np.inf
                a, b = self.starts[p], self.starts[p + 1]
                # A row is out of reach if its stored distance differs too much from the query's.
                off = np.abs(distance[group, p][:, None] - self.own[a:b]) - slack <= best.reach(q)[:, None]
                entries = a + np.nonzero(off.any(axis=0))[0]
                if len(entries):
                    work += len(entries) * len(q)
                    best.take(q, self.space.products(best.x[q], self.x[entries]), self.ids[entries], self.rows[entries])
        return work


FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _packed(queries: DataFrame, space: Space, size: int) -> DataFrame:
    """Queries in rows of about ``size``: their numbers, ids and vectors as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                x = matrix(b.column("x"), space.width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (
                        b.column("row").to_numpy(), b.column("id").to_numpy(), x, b.column("seen").to_numpy())
                ], ["q_rows", "q_ids", "q_x", "q_seen"])

    return queries.select("row", "id", "x", "seen").mapInArrow(pack, "q_rows binary, q_ids binary, q_x binary, q_seen binary")


def _seeded(queries: DataFrame, seeds: np.ndarray, k: int, space: Space) -> DataFrame:
    """Queries with ``seen``: a score that k rows other than the query reach, or the least long."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = space.products(matrix(b.column("x"), space.width), seeds)
            # One of the seeds may be the query itself, so the next best counts.
            seen = np.sort(scores, axis=1)[:, -k - 1] if len(seeds) > k else np.full(len(scores), np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen, pa.int64())], [*b.schema.names, "seen"])

    return queries.mapInArrow(look, f"{VECTOR}, seen long")


def search(trees: DataFrame, queries: DataFrame, k: int, space: Space, block: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows of each query in each task's trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                key = columns["q_rows"][i].as_py()
                if key not in kept:
                    rows = np.frombuffer(key, dtype=np.int64)
                    x = np.frombuffer(columns["q_x"][i].as_py(), dtype=np.int64).reshape(len(rows), space.width)
                    seen = np.frombuffer(columns["q_seen"][i].as_py(), dtype=np.int64)
                    kept[key] = Best(rows, x, seen, k, space), np.frombuffer(columns["q_ids"][i].as_py(), dtype=np.int64)
                tree = Tree({n: columns[n][i].as_py() for n in names}, space)
                tree.search(kept[key][0])
        for best, ids in kept.values():
            q, place = np.nonzero(best.row >= 0)
            vec = best.id[q, place]
            yield pa.RecordBatch.from_arrays([
                pa.array(best.rows[q]), pa.array(ids[q]), pa.array(best.row[q, place]), pa.array(vec, mask=vec == LAST),
                pa.array(best.score[q, place])], ["query_row", "query_id", "row", "vec_id", "score"])

    names = trees.columns
    blocks = F.broadcast(_packed(queries, space, block))
    return trees.crossJoin(blocks).mapInArrow(run, FOUND)


def top_k(
    df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding",
    roots: int = ROOTS, seeds: int = SEEDS, tree_bytes: int = TREE_BYTES, page: int = PAGE, query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every row whose id is divisible by
    ``every`` with all other rows."""
    rows = integer_rows(df, id_col, vector, scale)
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)
    asked = F.col("id") % every == 0
    size = rows.agg(F.max(F.size("x")).alias("width"), F.max(square).alias("top"), F.count_if(asked).alias("asked")).head()
    space = Space(max(1, size["width"] or 0), size["top"] or 0)
    trees = build(rows, space, roots, tree_bytes, page)
    queries = settle(_seeded(rows.where(asked), _draw(rows, seeds, space), k, space))
    # Each pass broadcasts a bounded share of the queries, taken by a hash of their numbers.
    passes = max(1, -(-(size["asked"] or 0) * 8 * (space.width + 3) // query_bytes))
    parts = None
    for n in range(passes):
        some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == n)
        part = search(trees, some, k, space)
        parts = part if parts is None else parts.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
