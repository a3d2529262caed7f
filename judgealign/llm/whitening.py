"""Whitening of vectors on their principal components, by Golub-Kahan-Lanczos bidiagonalisation.

1. Entries become whole numbers, ``floor(scale * c)``. The fit list holds each distinct vector once; it is written, and
   its number of rows n and sums S are exact.
2. The centred fit list is X. A step of the bidiagonalisation is one scan: a task forms ``w = X v - beta u`` for its
   rows and adds ``Xᵀ w`` and the products of w with all left vectors so far up. Left vectors are as long as the
   table, so none is stored: ``u = X c`` with a coefficient vector c as wide as a row. Both sides are fully
   reorthogonalised, the left one by those products (``Xᵀ u`` of earlier steps is known), the right one on the
   driver, which holds vectors as wide as a row only.
3. The SVD of the small bidiagonal matrix gives components and deviations; steps go on until the residuals of the
   wanted ones are at the level of rounding. A run sees one vector of a repeated singular value, so further runs start
   orthogonal to what was found until one finds nothing larger.

Only sums as wide as a row, added up by Spark, reach the driver. Tasks hold slices of rows.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors count as
if filled with zeros; a null ``vec_id`` and repeated rows stay; components without variance are left out, so a table
of equal vectors (or an empty one) gives no rows; ``floor`` of huge entries ends at the range of a long; a
``deviation`` beyond that range is null; labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import table
from judgealign.llm.store import Scratch
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

SCALE, COMPONENTS = 256, 4
#: Residual, and singular value, below which a triplet is exact, and a component has no variance; relative to the largest.
EXACT, NOTHING = 1e-14, 1e-10
#: Accuracy at which a run that only looks for a larger component may stop.
LOOK = 1e-3
#: Entries of a slice of rows inside a task.
CELLS = 1 << 18


def whole_entries(scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry of ``embedding``; null where the vector is null or holds null or non-finite entries."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vec, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


@dataclass
class Shape:
    """What all passes know of the fit list: rows, width, and exact sums per dimension."""

    n: int
    width: int
    sums: list[int]

    def distance(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, in Python's whole numbers where 64 bits could overflow."""
        most = self.n * (int(np.abs(x.astype(float)).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.distance(x).astype(np.float64) / self.n


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, CELLS // max(width, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, matrix(part.column("x"), width)


def _halves(width: int):
    """Exact sums per dimension, in two halves of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for _, x in _rows(batch, width):
                high += (x >> 32).sum(0)
                low += (x & 0xFFFFFFFF).sum(0)
        schema = pa.schema([("pos", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
        yield table(schema, pos=np.arange(width, dtype=np.int32), high=high, low=low)

    return run


def shape_of(fit: DataFrame) -> Shape:
    """Rows, width and sums of a fit list (column ``x``)."""
    n, width = fit.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not width:
        return Shape(n, width, [0] * width)
    wide = F.lit(1 << 32).cast("decimal(11,0)")
    parts = fit.mapInArrow(_halves(width), "pos int, high long, low long").groupBy("pos")
    total = parts.agg(F.sum(F.col("high").cast("decimal(27,0)")).alias("high"), F.sum(F.col("low").cast("decimal(27,0)")).alias("low"))
    total = total.select("pos", (F.col("high").cast("decimal(26,0)") * wide + F.col("low")).cast("decimal(38,0)").alias("s"))
    sums = [0] * width
    for pos, s in total.collect():  # as many rows as a vector has entries
        sums[pos] = int(s)
    return Shape(n, width, sums)


def _summed(of: Callable[[np.ndarray], np.ndarray], shape: Shape, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, x in _rows(batch, shape.width):
                total += of(shape.centred(x))
        yield table(pa.schema([("pos", pa.int32()), ("value", pa.float64())]), pos=np.arange(size, dtype=np.int32), value=total)

    return run


def sum_over(fit: DataFrame, shape: Shape, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over slices of centred rows of a function that returns ``size`` numbers."""
    parts = fit.mapInArrow(_summed(of, shape, size), "pos int, value double")
    out = np.zeros(size)
    for pos, value in parts.groupBy("pos").agg(F.sum("value")).collect():  # ``size`` rows
        out[pos] = value
    return out


def _products(q: np.ndarray, coefficients: np.ndarray):
    """``Xᵀ w``, ``w·w`` and the products of w with the left vectors, for w = X q."""

    def of(rows: np.ndarray) -> np.ndarray:
        w = rows @ q
        return np.concatenate([w @ rows, [w @ w], w @ (rows @ coefficients)])

    return of


def _outside(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """What is left of v beside an orthonormal basis; twice, so that it is orthogonal to rounding."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - (b @ v) @ b
    return v


def bidiagonalise(
    scan: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]],
    width: int, want: int, found: list[np.ndarray], least: float, floor: float, number: int,
) -> list[tuple[float, np.ndarray]]:
    """Singular values and right vectors orthogonal to ``found``, the largest ``want`` or all that this start reaches.

    ``scan(q, C)`` returns ``Xᵀ w``, ``w·w`` and ``(X C)ᵀ w`` for w = X q. With ``least`` the run only asks whether a
    value above it exists and stops as soon as that is denied. Values up to ``floor`` count as zero.
    """
    start = np.random.Generator(np.random.PCG64([613, number])).standard_normal(width)
    v = _outside(start, found)
    norm = np.linalg.norm(v)
    if len(found) >= width or norm == 0:
        return []
    right, left, back = [v / norm], [], []  # v, coefficients of u, and Xᵀ u
    alphas, betas = [], []
    while True:
        beta = betas[-1] if betas else 0.0
        q = right[-1] - beta * left[-1] if left else right[-1]
        c = np.array(left).T if left else np.zeros((width, 0))
        turned, square, along = scan(q, c)
        for k, h in enumerate(along):
            q, turned, square = q - h * left[k], turned - h * back[k], square - h * h
        alpha = float(np.sqrt(max(square, 0.0)))
        alphas.append(alpha)
        rest = 0.0
        if alpha > floor:
            left.append(q / alpha)
            back.append(turned / alpha)
            z = _outside(back[-1] - alpha * right[-1], found + right)
            rest = float(np.linalg.norm(z))
        size = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(small)
        open_ = rest * np.abs(p[-1])
        over = rest <= floor or size + len(found) >= width
        done = over or (size >= want and (open_[:want] <= EXACT * max(s[0], least)).all())
        if least and not done:
            done = bool(open_[0] <= LOOK * s[0] and s[0] + open_[0] < least)
        if done:
            vectors = qt @ np.array(right)
            return [(float(s[k]), vectors[k] / np.linalg.norm(vectors[k])) for k in range(min(want, size)) if s[k] > floor]
        betas.append(rest)
        right.append(z / rest)


@dataclass
class Whitener:
    """Components as rows, eigenvalues, their shares of the variance, and the largest error of the whitened covariance."""

    shape: Shape
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Principal components of a written fit list (column ``x``, each vector once)."""
    shape = shape_of(fit)
    none = Whitener(shape, np.zeros((0, shape.width)), np.zeros(0), np.zeros(0), 0.0)
    if not shape.n or not shape.width:
        return none
    trace = float(sum_over(fit, shape, lambda rows: np.array([(rows * rows).sum()]), 1)[0])
    if trace <= 0:
        return none
    floor = NOTHING * float(np.sqrt(trace))

    def scan(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        out = sum_over(fit, shape, _products(q, c), shape.width + 1 + c.shape[1])
        return out[: shape.width], float(out[shape.width]), out[shape.width + 1 :]

    best: list[tuple[float, np.ndarray]] = []
    number = 0
    while True:
        full = len(best) >= components
        least = best[-1][0] if full else 0.0
        more = bidiagonalise(scan, shape.width, 1 if full else components - len(best), [v for _, v in best], least, floor, number)
        more = [m for m in more if m[0] > least * (1 + 1e-12)]
        if not more:
            break
        best = sorted(best + more, key=lambda m: -m[0])[:components]
        number += 1
    if not best:
        return none
    values = np.array([s for s, _ in best])
    vectors = np.array([v for _, v in best])
    turn = (vectors / values[:, None] * np.sqrt(shape.n)).T

    def crossed(rows: np.ndarray) -> np.ndarray:
        white = rows @ turn
        return (white.T @ white).reshape(-1)

    k = len(best)
    covariance = sum_over(fit, shape, crossed, k * k).reshape(k, k) / shape.n
    return Whitener(shape, vectors, values**2 / shape.n, values**2 / trace, float(np.abs(covariance - np.eye(k)).max()))


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_WHITE = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def _deviations(apart: np.ndarray) -> pa.Array:
    if apart.dtype != object and float(np.abs(apart).max(initial=0)) ** 2 * max(apart.shape[1], 1) < 2.0**62:
        return pa.array((apart * apart).sum(1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _whitened(model: Whitener):
    k, shape = len(model.components), model.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
        for batch in batches:
            for part, x in _rows(batch, shape.width):
                apart = shape.distance(x)
                white = (apart.astype(np.float64) / shape.n) @ turn
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield table(
                    _WHITE, vec_id=part.column("vec_id").take(each), component=np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    n=np.full(rows * k, shape.n), deviation=_deviations(apart).take(each), whitened=white.reshape(-1),
                    explained=np.tile(model.explained, rows), identity_error=np.full(rows * k, model.identity_error),
                )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, scratch: Scratch | None = None) -> DataFrame:
    """One row per remaining vector and component (``WHITE``), from columns ``vec_id`` and ``embedding``."""
    scratch = scratch or Scratch(vectors.sparkSession, "whitening")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_entries(scale).alias("x")).filter("x is not null")
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    short, wide = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if short != wide:  # vectors that differ in the zeros that fill them up only are one
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("x")))
        fit = scratch.keep(fit.select(filled.alias("x")).distinct(), "filled")
    model = fit_whitener(fit, components)
    scratch.drop("fit", "filled")
    if not len(model.components):
        return rows.filter(F.lit(False)).mapInArrow(_whitened(model), WHITE)
    return rows.mapInArrow(_whitened(model), WHITE)
