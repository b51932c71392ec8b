"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c becomes the whole number x = floor(64 c) + 1000000. The components are fitted on the list of distinct x
vectors: A holds those vectors as rows, centred. Starting from a fixed random direction v1 the method alternates

    alpha_k u_k = A v_k - beta_(k-1) u_(k-1)          beta_k v_(k+1) = A'u_k - alpha_k v_k

with full reorthogonalisation on both sides, so A V = U B with B upper bidiagonal. A left vector has one entry per row of
the list, so it is never stored: u_k = A p_k, where p_k is as short as a row, and a pass over the rows returns the squared
length of A t and the product A'(A t) together, each task working its rows block by block. From the second product come
the inner products with all earlier left vectors. The driver holds dims x dims numbers. Without ``steps`` the method goes
on for as many steps as there are dimensions (a direction that ends early is followed by a random one orthogonal to all
before), so repeated eigenvalues are all found. The singular values of B, by falling size, are the square roots of n times
the eigenvalues of the covariance (divisor n); V times B's right vectors are the components.

Vectors that are null or empty, hold null or non-finite components, or have another length than most vectors have (ties: the
longer length) take no part and give no rows. Entries beyond 2^52 / 64 count as that. Null and repeated ids and repeated rows keep
their rows. A direction without spread (eigenvalue at most 1e-12 of the largest) can't be whitened: it is no component,
so a list of equal vectors gives no rows, as does an empty table. A deviation over 64 bits is null. Extra columns are ignored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import written

STEP, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
FEW_PARTS = 64
FLAT = 1e-12  # of the largest eigenvalue: no spread
SEED = 11


def finite(vector: Column) -> Column:
    x = F.transform(vector, lambda v: v.cast("double"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) of every entry. The shift by a constant changes no deviation, covariance or component, so it is left out."""
    edge = float(1 << 52)
    return F.transform(vector, lambda v: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), v.cast("double") * STEP))))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(distinct: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` vectors with their sums and sums of squares (exact, as decimal text)."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(s, BLOCK_ROWS))
                wide = x.astype(object) if len(x) and np.abs(x).max() > 1 << 24 else x
                sums, squares = wide.sum(0), (wide * wide).sum(0)
                text = lambda row: pa.array([[str(v) for v in row]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), text(sums), text(squares), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["n", "sums", "squares", "block"])

    return distinct.select("x").mapInArrow(run, "n long, sums array<string>, squares array<string>, block binary")


class Centred:
    """The fit list as a matrix whose products with short vectors are passes over the blocks."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        self.tasks = blocks.rdd.getNumPartitions()
        total = lambda name: [F.sum(F.get(name, i).cast("decimal(38,0)")) for i in range(dims)]
        row = blocks.agg(F.sum("n"), *total("sums"), *total("squares")).first()
        self.n = int(row[0] or 0)
        self.sums = [int(v or 0) for v in row[1 : dims + 1]]
        spread = sum(self.n * int(q or 0) - s * s for q, s in zip(row[dims + 1 :], self.sums))
        self.trace = spread / (self.n * self.n) if self.n else 0.0
        self.base = np.array([s // self.n if self.n else 0 for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n if self.n else 0.0 for s in self.sums])

    def _rows(self, make, width: int) -> np.ndarray:
        """The sum over all blocks of ``make(centred block)``: one line per task, added up in tasks while there are many."""
        base, rest, dims = self.base, self.rest, self.dims

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                for raw in batch.column(0):
                    total += make((np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims) - base) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["z"])

        def add(batches):
            total = np.zeros(width)
            for batch in batches:
                total += _matrix(batch.column(0)).sum(0) if batch.num_rows else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["z"])

        parts = self.blocks.select("block").mapInArrow(run, "z array<double>")
        if self.tasks > FEW_PARTS:  # the driver adds up at most the square root of the tasks
            parts = parts.repartition(math.isqrt(self.tasks)).mapInArrow(add, "z array<double>")
        return np.array([r["z"] for r in parts.collect()]).sum(0)

    def product(self, t: np.ndarray) -> tuple[float, np.ndarray]:
        """|A t|^2 and A'(A t)."""

        def make(a):
            u = a @ t
            return np.concatenate(([u @ u], u @ a))

        out = self._rows(make, self.dims + 1)
        return float(out[0]), out[1:]

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest absolute entry of the covariance of A times ``scaled``, minus the identity."""
        k = scaled.shape[1]
        at = np.triu_indices(k)

        def make(a):
            w = a @ scaled
            return np.concatenate((w.sum(0), (w.T @ w)[at]))

        out = self._rows(make, k + len(at[0]))
        mean = out[:k] / self.n
        return float(np.abs(out[k:] / self.n - mean[at[0]] * mean[at[1]] - (at[0] == at[1])).max()) if k else 0.0


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(product, dims: int, steps: int | None = None, seed: int = SEED):
    """V (dims x steps) and the upper bidiagonal B of A V = U B, from passes ``product(t)`` = (|A t|^2, A'A t)."""
    rng = np.random.default_rng(seed)
    fresh = lambda basis: (lambda w: w / np.linalg.norm(w))(_orthogonal(rng.standard_normal(dims), basis))
    vs, ps, ws, alphas, betas = [fresh([])], [], [], [], [0.0]
    scale = 0.0
    while True:
        t = vs[-1] - betas[-1] * ps[-1] if ps else vs[-1]
        size, z = product(t)
        for _ in range(3):  # left vectors: inner products with all earlier ones come from A'A t
            if not ps:
                break
            h = np.array(ps) @ z
            if h @ h <= 1e-28 * max(size, 0.0):
                break
            t = t - h @ np.array(ps)
            if h @ h <= 1e-8 * size:
                z, size = z - h @ np.array(ws), size - h @ h
                break
            size, z = product(t)
        alpha = float(np.sqrt(max(size, 0.0)))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale or alpha == 0.0:
            alpha, p, w = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            p, w = t / alpha, z / alpha
        alphas.append(alpha)
        ps.append(p)
        ws.append(w)
        if len(vs) == min(dims, steps or dims):
            return np.array(vs).T, np.diag(alphas) + np.diag(betas[1:], 1)
        rest = _orthogonal(w - alpha * vs[-1], vs)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * scale or beta == 0.0:
            beta, rest = 0.0, fresh(vs)
        betas.append(beta)
        vs.append(rest / np.linalg.norm(rest))


def components(list_: Centred, most: int = COMPONENTS, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(dims x k) unit components and their eigenvalues, falling."""
    if list_.n == 0 or list_.trace <= 0:
        return np.zeros((list_.dims, 0)), np.zeros(0)
    v, b = bidiagonalise(list_.product, list_.dims, steps)
    _, sizes, right = np.linalg.svd(b)
    values = sizes**2 / list_.n
    keep = np.flatnonzero(values > FLAT * values[0])[:most]
    axes = v @ right[keep].T
    return axes / np.linalg.norm(axes, axis=0), values[keep]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every vector that takes part."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x"))
    rows = written(rows, "whole-numbers")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = common["d"]
    rows = rows.where(F.size("x") == dims)
    fit = Centred(written(packed(rows.select("x").distinct()), "fit-blocks"), dims)
    axes, values = components(fit, most, steps)
    scaled = axes / np.sqrt(values)
    error = fit.identity_error(scaled)
    n, base, rest, sums = fit.n, fit.base, fit.rest, fit.sums
    explained = values / fit.trace if fit.trace else values
    k = len(values)

    def run(batches):
        whole = np.array(sums, object)
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                x = _matrix(part.column(1))
                far = max(int(np.abs(x).max()), 1) * n + max(abs(v) for v in sums)
                if far < 1 << 30 or far * far * dims < 1 << 63:
                    gap = n * x - np.array(sums, np.int64)
                    deviation = (gap * gap).sum(1).tolist()
                else:
                    gap = n * x.astype(object) - whole
                    deviation = [v if v < 1 << 63 else None for v in (gap * gap).sum(1)]
                w = ((x - base) - rest) @ scaled
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(numbers), pa.array(np.full(len(numbers), n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                     pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(numbers), error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
