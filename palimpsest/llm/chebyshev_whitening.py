"""Embedding whitening by Chebyshev-filtered subspace iteration.

A vector c becomes the integers floor(256 c). The fit list, each distinct integer vector once, is written to the shared
folder; a pass over it multiplies its covariance with a block of directions: every task centres its rows, multiplies them with the
block and back, and the tasks' sums are added by dimension. No task, and not the driver, ever holds more than a batch of rows
and the block (dimensions times block numbers; the covariance itself is never built).

A round applies a Chebyshev polynomial of the covariance to the block, one pass a degree: the recurrence stays within one on the
unwanted part of the spectrum, from 0 (a covariance has no negative eigenvalue) to the block's least Ritz value, and grows
beyond it. QR and Rayleigh-Ritz follow. A component is certified once the residual of its eigenvector is at the rounding error of the
sums; the rounds end when all wanted ones are. A block that spans all dimensions needs no round.

Defined results: vectors that are null or hold null or non-finite entries are dropped; a null id stays. Repeated vectors count
once in the fit, and each of their rows is returned. Vectors of unlike length are an error, as are integers whose sums do
not fit into a long. Components of eigenvalue zero, as of a single distinct vector, have no whitened value (null) and are left out of
identity_error. There are no more components than dimensions. An empty table, or one of empty vectors, gives no rows. Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rounds at most; a degree is lowered where the largest eigenvalue would outgrow the wanted ones by more than SPREAD.
ROUNDS, DEGREE, SPREAD = 60, 12, 1e7
#: Rounding error of the sums, as a share of the largest eigenvalue and for each root of the dimensions.
ROUNDING = 1e-14


@dataclass(frozen=True)
class Fit:
    """What is learned: n distinct vectors with the sums per dimension, eigenvectors as columns with falling eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of exact integers, rounded once

    @property
    def whitener(self) -> np.ndarray:
        """Columns that a centred vector is multiplied with; NaN for a component without extent."""
        flat = self.values <= ROUNDING * len(self.sums) * max(self.values, default=0.0)
        return self.vectors / np.where(flat, np.nan, np.sqrt(np.where(flat, 1.0, self.values)))


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the integer vectors of the rows that have one."""
    c = F.col(vector_col).cast("array<double>")
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # the filter is repeated inside, so that nothing else is cast even where Spark moves it
    x = F.when(whole, F.transform(c, lambda v: F.floor(v * 256).cast("long")))
    return embeddings.select(F.col(id_col).alias("vec_id"), x.alias("x")).where("x is not null")


def _matrix(column: pa.ListArray | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list, and exact sums per dimension."""
    lengths = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lengths[0] is None or lengths[1] == 0:
        return 0, []
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} dimensions")
    dims = lengths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dims)
            if float(np.abs(x.astype(np.float64)).max(initial=0.0)) * len(x) >= 2.0**62:
                raise OverflowError("the sums of these vectors do not fit into a long")
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "n": pa.array([len(x)] * dims, pa.int64()), "s": pa.array(x.sum(axis=0))})

    rows = fit.select("x").mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # one a dimension
    sums = {r.i: r.s for r in rows}
    return rows[0].n, [sums[i] for i in range(dims)]


def _summed(fit: DataFrame, dims: int, width: int, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of of_batch, a matrix of so many columns; its rows are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = of_batch(_matrix(b.column(0), dims).astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))})

    rows = fit.select("x").mapInArrow(run, "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v"))
    found = {r.i: r.v for r in rows.collect()}  # one row a dimension
    return np.array([found[i] for i in sorted(found)])


def _growth(value: float, high: float) -> float:
    """By how much a degree multiplies what lies at value, beyond the unwanted interval from 0 to high."""
    x = max(2 * value / high - 1, 1.0)
    return x + np.sqrt(x * x - 1)


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, degree: int, high: float, top: float) -> np.ndarray:
    """The block after a Chebyshev polynomial of the operator that damps 0 to high, scaled to be one at top."""
    half = high / 2
    s1 = half / (top - half)
    s, before = s1, block
    now = (apply(block) - half * block) * (s1 / half)
    for _ in range(degree - 1):
        after = 1 / (2 / s1 - s)
        before, now = now, (apply(now) - half * now) * (2 * after / half) - before * (s * after)
        s = after
    return now


def components(fit: DataFrame, count: int, *, block: int | None = None, seed: int = 7) -> Fit:
    """The first eigenvectors of the covariance of the vectors x in fit, a table that every pass reads again."""
    n, sums = _totals(fit)
    dims = len(sums)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    mean = np.array([s / n for s in sums])
    width = min(dims, block or 8 * count)
    wanted = min(count, dims)
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def centred(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ q)

        return _summed(fit, dims, q.shape[1], centred) / n

    trace = float(_summed(fit, dims, 1, lambda x: np.square(x - mean).sum(axis=0)[:, None]).sum()) / n
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    last = np.inf
    for _ in range(ROUNDS):
        image = apply(q)
        inner = q.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:wanted]
        worst, floor = residuals.max(), ROUNDING * np.sqrt(dims) * max(values[0], 0.0)
        # at rounding error, or within a hundred times of it and no longer falling
        if width == dims or worst <= floor or (worst <= 100 * floor and worst > last / 2):
            return Fit(n, sums, q[:, :wanted], np.maximum(values[:wanted], 0.0), trace, residuals, passes)
        last = worst
        high = max(values[-1], 1e-6 * values[0])
        ratio = _growth(values[0], high) / _growth(values[wanted - 1], high)
        degree = int(np.clip(np.log(SPREAD) / np.log(ratio), 2, DEGREE)) if ratio > 1 else DEGREE
        q = np.linalg.qr(chebyshev(apply, q, degree, high, values[0]))[0]
    raise RuntimeError(f"after {passes} passes residuals are {worst / values[0]:.1e} of the largest eigenvalue")


def identity_error(fit: DataFrame, learned: Fit) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors minus the identity."""
    mean, w = learned.mean, learned.whitener
    w = w[:, ~np.isnan(w).any(axis=0)]
    if not w.size:
        return 0.0
    means = _summed(fit, len(mean), 1, lambda x: ((x - mean) @ w).sum(axis=0)[:, None])[:, 0] / learned.n

    def squares(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ w - means
        return y.T @ y

    cov = _summed(fit, len(mean), w.shape[1], squares) / learned.n
    return float(np.abs(cov - np.eye(len(cov))).max())


OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, count: int = 4, block: int | None = None) -> DataFrame:
    """Per row and component: vec_id, component, n (vectors of the fit list), deviation (exact, of n x from the sums), whitened,
    explained (the component's share of the variance), identity_error."""
    rows = integers(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    fit = saved(rows.select("x").distinct(), "vectors")
    learned = components(fit, count, block=block)
    n, k, dims = learned.n, len(learned.values), len(learned.sums)
    if not k:
        return rows.sparkSession.createDataFrame([], OUT.format(id=kind))
    error, mean, w = identity_error(fit, learned), learned.mean, learned.whitener
    explained = np.where(learned.trace > 0, learned.values / (learned.trace or 1.0), 0.0)
    sums = F.array(*[F.lit(s).cast("long") for s in learned.sums])
    # in longs, whose overflow is an error in Spark
    apart = F.aggregate(F.zip_with("x", sums, lambda a, s: a * F.lit(n).cast("long") - s), F.lit(0).cast("long"), lambda t, v: t + v * v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            white = (_matrix(b.column(1), dims).astype(np.float64) - mean) @ w
            m = b.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": b.column(0).take(at),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": b.column(2).take(at),
                    "whitened": pa.array(white.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return rows.select("vec_id", "x", apart.alias("deviation")).mapInArrow(run, OUT.format(id=kind))
