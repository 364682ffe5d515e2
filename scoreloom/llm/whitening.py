"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become integers, floor(scale * c) + shift, so counts and sums are exact; a row is centred as
(n * x - S) / n, from whole numbers, before anything is multiplied.

Let X hold the centred rows over sqrt(n). From a unit vector v the method alternates distributed products:
u = Xv and w = X'u. Each new u is made orthogonal to all earlier ones and scaled (alpha), each new v to all
earlier v and scaled (beta); then X V = U B with B upper bidiagonal, and the singular values of the small B and its right
vectors give deviations and components. It goes on for as many steps as vectors have dimensions, so that
components of every spectrum, flat ones included, are exact to double precision; with ``tolerance`` it ends when the
wanted triplets have residuals below that share of the largest. Where beta vanishes, a fresh v orthogonal to all others goes on.

A left vector is as long as the table. It is never stored: u = X p with a short p, so a task makes its
part of all left vectors from its rows and one small matrix, and lost executors cost no state. A
step is two passes over the packed rows: one for U'u, one for X'u of the corrected u (with U'u again, so
that orthogonality is repaired twice). Tasks sum their share; grouped sums by position meet a few hundred numbers.

The rows are packed once into the shared folder in blocks of bounded bytes.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped. Of vectors of
several lengths, missing entries count as 0. Directions without variance cannot be scaled and are left out, so equal rows or
a single one give no components and no rows. Repeated rows count as often as they stand; rows with a null or repeated id are kept
as rows. Eigenvalues that tie share their plane, in any basis of it. An empty table gives an empty result. Only the id and the vector are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .metric_search import matrix, usable

SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 4 << 20     # integers of one packed block, about
SINGULAR = 1e-12          # eigenvalues below this share of the largest are no variance


def integer_rows(df: DataFrame, id_col: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    return df.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), x.alias("x"))


def _padded(column: pa.Array, width: int, shift: int) -> np.ndarray:
    """A missing entry is that of c = 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = matrix(column, width)
    if (sizes < width).any():
        out[np.arange(width)[None, :] >= sizes[:, None]] = shift
    return out


def pack(rows: DataFrame, width: int, shift: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``x`` as blocks of bytes, stored in the shared folder."""
    size = max(1, block_bytes // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = _padded(batch.column("x").slice(at, size), width, shift)
                held.append(part)
                n += len(part)
                if n >= size:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])

    return settle(rows.select("x").mapInArrow(run, "block binary"))


@dataclass(frozen=True)
class Centre:
    """Exact count and sums, and the centring that follows from them."""

    n: int
    sums: tuple[int, ...]

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs while they fit, else as whole numbers of any size."""
        high = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        kind = np.int64 if high < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        y = self.numerators(x)
        most = int(np.abs(y).max(initial=0))
        if most ** 2 * max(1, x.shape[1]) >= 1 << 63:
            y = y.astype(object)
        return [Decimal(int(v)) for v in (y * y).sum(axis=1)]


def totals(blocks: DataFrame, width: int, part, size: int) -> np.ndarray:
    """Sum of ``part(integer rows)``, ``size`` numbers, over all blocks.

    A task sums its blocks; sums meet by position, so no task holds more than one number a position.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column("block"):
                total += part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    sums = blocks.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
    out = np.zeros(size)
    for r in sums.groupBy("at").agg(F.sum("v").alias("v")).collect():    # ``size`` rows
        out[r["at"]] = r["v"]
    return out


@dataclass(frozen=True)
class Spectrum:
    components: np.ndarray     # columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def bidiagonalise(
    blocks: DataFrame, centre: Centre, wanted: int, seed: int = 11, tolerance: float | None = None
) -> Spectrum:
    """Leading eigenvectors of the covariance by Golub-Kahan-Lanczos steps on the driver's small vectors."""
    width, rng = len(centre.sums), np.random.default_rng(seed)
    spark = blocks.sparkSession

    def products(p: np.ndarray, right: bool) -> np.ndarray:
        """U'u, u'u, and X'u if asked for, of u = X p[:, -1] and U = X p[:, :-1]."""
        sent = spark.sparkContext.broadcast(p)

        def part(x):
            rows = centre.rows(x)
            left = rows @ sent.value
            u = left[:, -1]
            return np.concatenate([left.T @ u, rows.T @ u if right else ()])

        out = totals(blocks, width, part, p.shape[1] + (width if right else 0)) / centre.n
        sent.unpersist()
        return out

    trace = float(totals(blocks, width, lambda x: np.array([(centre.rows(x) ** 2).sum()]), 1)[0] / centre.n)
    if trace == 0:
        return Spectrum(np.zeros((width, 0)), np.zeros(0), 0.0)
    tiny = 1e-13 * np.sqrt(trace)
    v_all, p_all, z_all = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))
    alphas, betas = [], []
    v, beta = _fresh(v_all, rng), 0.0
    while v is not None:
        v_all = np.column_stack([v_all, v])
        p = v - beta * p_all[:, -1] if beta else v.copy()
        j = p_all.shape[1]
        found = products(np.column_stack([p_all, p]), right=False)
        p = p - p_all @ found[:j]
        found = products(np.column_stack([p_all, p]), right=True)
        overlap, square, z = found[:j], found[j], found[j + 1:]
        p, z, square = p - p_all @ overlap, z - z_all @ overlap, square - overlap @ overlap
        alpha = np.sqrt(max(square, 0.0))
        if alpha <= tiny:      # Xv lies among the earlier left vectors: this one is nothing
            alpha, p, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            p, z = p / alpha, z / alpha
        p_all, z_all = np.column_stack([p_all, p]), np.column_stack([z_all, z])
        alphas.append(alpha)
        w = z - alpha * v
        for _ in range(2):
            w = w - v_all @ (v_all.T @ w)
        beta = float(np.linalg.norm(w))
        if tolerance and beta > tiny and _settled(alphas, betas, beta, wanted, tolerance):
            break
        if beta <= tiny:
            v, beta = _fresh(v_all, rng), 0.0
        else:
            v = w / beta
        if v_all.shape[1] == width:
            break
        betas.append(beta)
    values, right = _small_svd(alphas, betas[: len(alphas) - 1])[1:]
    vectors = v_all @ right.T
    keep = values ** 2 > SINGULAR * values[0] ** 2
    vectors, values = vectors[:, keep][:, :wanted], values[keep][:wanted]
    return Spectrum(vectors / np.linalg.norm(vectors, axis=0), values ** 2, trace)


def _fresh(v_all: np.ndarray, rng) -> np.ndarray | None:
    """A random unit vector orthogonal to all right vectors, None where they fill the space."""
    if v_all.shape[1] >= len(v_all):
        return None
    w = rng.normal(size=len(v_all))
    for _ in range(3):
        w = w - v_all @ (v_all.T @ w)
        w = w / np.linalg.norm(w)
    return w


def _small_svd(alphas: list[float], betas: list[float]):
    return np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))


def _settled(alphas, betas, beta, wanted, tolerance) -> bool:
    """Are the residuals of the wanted triplets, beta times the last entries of their left vectors, small?"""
    if len(alphas) < wanted:
        return False
    left, values, _ = _small_svd(alphas, betas)
    return bool((beta * np.abs(left[-1, :wanted]) <= tolerance * values[0]).all())


def whiten(
    df: DataFrame, wanted: int = 32, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
    shift: int = SHIFT, seed: int = 11, tolerance: float | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, n, deviation, whitened, explained, identity_error`` of every usable row.

    ``whitened`` and ``explained`` are arrays over the components; deviation is an exact decimal.
    """
    spark = df.sparkSession
    rows = integer_rows(df, id_col, vector, scale, shift)
    id_type = dict(rows.dtypes)["id"]
    schema = (f"id {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>,"
              " identity_error double")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).head()
    n, width = size["n"], size["d"] or 0
    if width == 0:
        return spark.createDataFrame([], schema)
    blocks = pack(rows, width, shift, block_bytes)
    centre = Centre(n, _sums(blocks, width))
    found = bidiagonalise(blocks, centre, wanted, seed, tolerance)
    k = len(found.eigenvalues)
    if k == 0:
        return spark.createDataFrame([], schema)
    turn = found.components / np.sqrt(found.eigenvalues)

    def moments(x):
        w = centre.rows(x) @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    got = totals(blocks, width, moments, k * k + k) / n
    covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:])
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = (found.eigenvalues / found.trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _padded(b.column("x"), width, shift)
            m = len(x)
            white = (centre.rows(x) @ turn).ravel()
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(np.full(m, n)), pa.array(centre.deviations(x), pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), pa.array(white)),
                pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), pa.array(np.tile(explained, m))),
                pa.array(np.full(m, error))],
                ["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _sums(blocks: DataFrame, width: int) -> tuple[int, ...]:
    """Exact sums by dimension: longs in tasks, decimals where tasks meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], ["v"])

    sums = blocks.mapInArrow(run, "v array<long>").select(F.posexplode("v").alias("at", "v"))
    by = {r["at"]: int(r["v"]) for r in sums.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return tuple(by.get(i, 0) for i in range(width))
