"""Embedding whitening by spectral divide-and-conquer.

Spark adds up the vectors' integer forms and then, around their mean, their products; what comes to the driver is a sum of
d numbers and d * d of products, whatever the number of rows. There the covariance is taken apart: the polar factor of the
covariance minus a shift (by the dynamically weighted Halley iteration with QR factors) has the eigenvalues 1 and -1, so
half of it plus one is the projector on all components above the shift. Bases of its range and of what is left split the
matrix in two, each is split again, and single dimensions are components. The components (d * COMPONENTS numbers) go to
the tasks, which project each row.

An entry c becomes floor(1024 * c) + 100000. Sums of entries are exact. Products are taken of entries minus the rounded
mean, whole numbers again, so their sums are exact in doubles up to 2 ** 53 and don't depend on how rows are dealt out.

Defined results: a vector that is null, empty, holds null, not finite or entries of SPAN or more, or isn't of the commonest length
(of equally common ones the longest) is dropped; equal rows count each; null vec_id stays null; a component without any
spread (a single row, copies alone, dimensions that depend on each other) has whitened null and isn't part of
identity_error, and without any spread at all explained is 0; a deviation beyond a long is null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import prepare

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more have no exact whole form.
SPAN = 2.0**42
#: Vectors that are worked on together in a task.
BLOCK = 1024
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


# ---------------------------------------------------------------- the driver's part: d x d matrices


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by the QR form of the dynamically weighted Halley iteration."""
    n, x = len(a), a / np.linalg.norm(a)
    least = max(np.linalg.norm(x, -2), np.finfo(float).eps)  # a lower bound of the singular values
    for _ in range(30):
        d = np.cbrt(4 * (1 - least**2) / least**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - least**2) / (least**2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        least = min(least * (wa + wb * least**2) / (1 + wc * least**2), 1.0)
        if moved < 1e-12 * np.sqrt(n) or (least == 1.0 and moved < 1e-8):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None where all eigenvalues are the same to rounding."""
    n, middle = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 4 * n * np.finfo(float).eps * np.linalg.norm(a):
        return None
    for step in (0, 0.11, -0.11, 0.031, -0.031, 0.0047, -0.0047):  # another shift where one meets an eigenvalue
        projector = (polar(a - (middle + step * spread / np.sqrt(n)) * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < n and np.linalg.norm(projector @ projector - projector) < 1e-8:
            order = np.argsort(-np.diag(projector), kind="stable")
            basis, _ = np.linalg.qr(np.hstack([projector[:, order[:rank]], (np.eye(n) - projector)[:, order[rank:]]]))
            for _ in range(2):  # the chosen columns may be nearly dependent: the projectors clean them
                basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]]))
            off = basis[:, :rank].T @ a @ basis[:, rank:]
            if np.linalg.norm(off) <= 1e-10 * np.linalg.norm(a):
                return basis[:, :rank], basis[:, rank:]
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down and unit eigenvectors as columns, the largest entry of each positive."""
    found: list[tuple[float, np.ndarray]] = []
    stack = [(a, np.eye(len(a)))]
    while stack:
        part, basis = stack.pop()
        halves = _split(part) if len(part) > 1 else None
        if halves is None:
            found += [(float(part[k, k]), basis[:, k]) for k in range(len(part))]
            continue
        for own in halves:
            inner = own.T @ part @ own
            stack.append(((inner + inner.T) / 2, basis @ own))
    vectors = np.array([v for _, v in found]).T
    vectors, values = _refined(a, vectors)
    order = np.argsort(-values, kind="stable")
    vectors, values = vectors[:, order], values[order]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(a))] < 0, -1.0, 1.0)


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step that squares the error left by the recursion: orthogonality and residuals are corrected to first order."""
    r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    small = np.abs(gap) <= 2 * (np.linalg.norm(s - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(r))
    e = np.where(small, r / 2, (s + values[None, :] * r) / np.where(small, 1.0, gap))
    x = x + x @ e
    for _ in range(2):  # back to unit length and right angles
        x = x @ (1.5 * np.eye(len(a)) - 0.5 * x.T @ x)
    return x, np.diag(x.T @ a @ x).copy()


# ---------------------------------------------------------------- the rows' part


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x: the kept rows with whole entries."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < SPAN)), F.lit(False))
    kept = embeddings.filter(fine)
    longest = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size("embedding") == (longest.d if longest else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, _matrix(part.column(place))


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and S: exact sums by dimension (whole numbers of any size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0
        for _, x in _blocks(batches, 0):
            high, low = x >> 24, x & ((1 << 24) - 1)
            total, n = total + (high.sum(axis=0).astype(object) << 24) + low.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(int(t)) for t in total]), pa.array([n] * len(total), pa.int64())], names=["place", "total", "n"])

    rows = vectors.select("x").mapInArrow(run, "place int, total string, n long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("place").collect()
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def _products(rows: DataFrame, width: int, centred) -> np.ndarray:
    """The sum over all rows of the outer products of what centred() makes of a block of vectors; width x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for _, x in _blocks(batches, 0):
            y = centred(x)
            total, n = total + y.T @ y, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), width)), pa.array(total.ravel())], names=["i", "j", "s"])

    out = np.zeros((width, width))
    for r in rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = r.s
    return out


@dataclass
class Whitening:
    n: int
    sums: list[int]
    middle: np.ndarray  # the mean, rounded to whole numbers
    rest: np.ndarray  # what rounding left of it
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def spread(self) -> np.ndarray:
        """Which components have a spread beyond rounding."""
        return self.values > 8 * len(self.rest) * np.finfo(float).eps * max(self.values[0], 0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Columns by component; a component without spread is not a number."""
        scale = np.where(self.spread, np.sqrt(np.where(self.spread, self.values, 1.0)), np.nan)
        return (x - self.middle - self.rest) @ (self.vectors / scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2: whole numbers, in Python's own where a long or a product of longs can't hold them."""
        near = x - self.middle.astype(np.int64)
        left = [self.n * int(m) - s for m, s in zip(self.middle, self.sums, strict=True)]
        largest = self.n * int(np.abs(near).max(initial=0)) + max((abs(v) for v in left), default=0)
        if largest**2 * len(left) < 1 << 63:
            far = near * self.n + np.array(left, np.int64)
            return (far * far).sum(axis=1).tolist()
        far = near.astype(object) * self.n + np.array(left, object)
        return [int(t) if t < 1 << 63 else None for t in (far * far).sum(axis=1)]


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """The first components of all rows' covariance; None without rows."""
    n, sums = _sums(vectors)
    if not n:
        return None
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])
    covariance = _products(vectors, len(sums), lambda x: (x - middle).astype(np.float64)) / n - np.outer(rest, rest)
    values, basis = components((covariance + covariance.T) / 2)
    return Whitening(n, sums, middle.astype(np.float64), rest, values[:count], basis[:, :count], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the covariance of the whitened rows minus the identity, over components with spread."""
    k, width = len(model.values), int(model.spread.sum())
    if not width:
        return 0.0
    # a one beside the whitened values adds their sums to the products
    total = _products(vectors, k + 1, lambda x: np.column_stack([np.nan_to_num(model.whiten(x)), np.ones(len(x))]))
    mean = total[-1, :width] / model.n
    return float(np.abs(total[:width, :width] / model.n - np.outer(mean, mean) - np.eye(width)).max())


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component."""
    prepare(embeddings.sparkSession)
    vectors = whole_vectors(embeddings)
    model = fit(vectors, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else model.values * 0
        for part, x in _blocks(batches, 1):
            rows, white = np.repeat(np.arange(len(x)), k), model.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, len(x))),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"{SCHEMA}, identity_error double")
    return vectors.mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(identity_error(vectors, model)))
