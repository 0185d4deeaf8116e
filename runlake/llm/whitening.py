"""Embedding whitening by an incremental eigendecomposition.

The fit list is each distinct quantised vector once.  Every partition reads its
vectors one after another and keeps the eigendecomposition of their scatter:
a new vector is a centred rank-one update, whose eigenvalues solve the secular
equation after deflation.  Partition spectra are combined in a tree of groups
of ``FAN_IN``, again by rank-one updates (one per eigenpair and one for the
difference of the means).  The eigenvectors found so span the space of a final
Rayleigh-Ritz step: the centred fit list is projected on them, its covariance
summed over all partitions, and the small matrix of d x d rotates the basis to
eigenvectors of double precision.

No task holds more than a few d x d matrices and one batch of vectors, and the
driver only gets one spectrum and matrices of d x d numbers; nothing there
grows with the rows.

Rows whose vector is null, or holds null or non-finite entries, are dropped;
so are vectors of another length than most rows have (ties: the longer one).
Copies of a vector count once in the fit and all get their result.  A
component without variance (eigenvalue at most 1e-12 of the largest) cannot be
whitened and is left out, so a table of equal vectors gives no rows, as does
an empty one.  Only vec_id and embedding are read; other columns do not matter,
whatever their names, and a null vec_id is kept as a value.  ``deviation`` is exact; one that
does not fit in 64 bits raises ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import stage

SCALE, SHIFT = 64, 1_000_000
FAN_IN = 32
BATCH = 4096
EPS = np.finfo(np.float64).eps
SPECTRUM = "part long, n long, sums binary, mean binary, values binary, vectors binary"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for ascending distinct ``d`` and positive ``z2``.

    Root i lies between d[i] and d[i + 1] (the last below d[-1] + sum(z2)).
    Returns, for each root, the index of its nearest pole and its exact-to-
    rounding distance from it, so that differences to poles lose no digits."""
    k = len(d)
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    f = 1.0 + (z2[None, :] / (d[None, :] - middle[:, None])).sum(1)
    near = np.arange(k)
    right = (f < 0) & (near < k - 1)                   # the root is in the upper half: measure from the pole above
    near = near + right
    shifted = d[None, :] - d[near][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where((f < 0) & ~right, gap, gap / 2))
    last = near[-1] == k - 1 and not right[-1]
    if last and f[-1] < 0:
        low[-1] = gap[-1] / 2
    weight, x, lowest = z2[near], (low + high) / 2, 4 * EPS * k
    for _ in range(100):
        with np.errstate(divide="ignore", invalid="ignore"):
            away = 1.0 / (shifted - x[:, None])
            part = away * z2
        f = 1.0 + part.sum(1)
        found = np.abs(f) <= lowest * (1.0 + np.abs(part).sum(1))
        if found.all():
            break
        above = f > 0
        low, high = np.where(above, low, x), np.where(above, x, high)
        # The nearest pole is kept exact and the rest linear: rest + tilt * (t - x) - weight / t = 0
        rest = f + weight / x
        tilt = (part * away).sum(1) - weight / (x * x)
        b = rest - tilt * x
        root = np.sqrt(np.maximum(b * b + 4 * tilt * weight, 0))
        t = np.where(b > 0, -b - root, root - b) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            first, second = t / tilt, -weight / t
        step = np.where((first > low) & (first < high), first, second)
        x = np.where(found, x, np.where((step > low) & (step < high), step, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of ``vectors diag(values) vectors' + v v'``; ascending values."""
    z = vectors.T @ v
    norm2 = float(z @ z)
    if norm2 == 0.0:
        return values, vectors
    scale = max(values[-1], norm2)
    small = 8 * EPS * scale
    live = z * z > small * EPS * 8
    # Deflation 1: a coordinate that v hardly touches keeps its eigenpair.
    live &= np.abs(z) * np.sqrt(norm2) > small
    z = np.where(live, z, 0.0)
    # Deflation 2: of eigenvalues that agree, a rotation leaves weight in one only.
    at = np.flatnonzero(live)
    close = np.flatnonzero(np.diff(values[at]) <= small)
    if len(close):
        vectors = vectors.copy()
        for j in close:
            a, b = at[j], at[j + 1]
            r = np.hypot(z[a], z[b])
            c, s = z[b] / r, z[a] / r
            left, right = vectors[:, a].copy(), vectors[:, b].copy()
            vectors[:, a], vectors[:, b] = c * left - s * right, s * left + c * right
            z[a], z[b] = 0.0, r
        at = np.flatnonzero(z != 0.0)
    if not len(at):
        return values, vectors
    d = values[at]
    near, x = secular_roots(d, z[at] ** 2)
    away = (d[None, :] - d[near][:, None]) - x[:, None]         # d[j] - root[i], without cancellation
    # The weights for which these roots are exact (Gu and Eisenstat) keep the vectors orthogonal.
    k = len(at)
    logs = np.log(np.abs(away)).sum(0)
    between = np.abs(d[None, :] - d[:, None])
    np.fill_diagonal(between, 1.0)
    weight = np.sqrt(np.exp(logs - np.log(between).sum(0))) * np.sign(z[at])
    turn = weight[None, :] / away
    turn /= np.sqrt((turn * turn).sum(1))[:, None]
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[at] = d[near] + x
    new_vectors[:, at] = vectors[:, at] @ turn.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and scatter eigenpairs of the vectors seen."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean = 0, np.zeros(dims, np.int64), np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def add(self, rows: np.ndarray) -> None:
        """Quantised vectors (long, one per row), as centred rank-one updates."""
        self.sums += rows.sum(0)
        for row in (rows - SHIFT).astype(np.float64):
            away = row - self.mean
            self.n += 1
            self.mean += away / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, away * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        n = self.n + other.n
        away = other.mean - self.mean
        ties = away * np.sqrt(self.n * (other.n / n))
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, ties)
        self.mean = self.mean + away * (other.n / n)
        self.sums, self.n = self.sums + other.sums, n

    def row(self, part: int) -> dict:
        return {"part": [part], "n": [self.n], "sums": [self.sums.tobytes()], "mean": [self.mean.tobytes()],
                "values": [self.values.tobytes()], "vectors": [np.ascontiguousarray(self.vectors).tobytes()]}

    @classmethod
    def read(cls, row) -> Spectrum:
        s = cls(len(row["mean"]) // 8)
        s.n, s.sums, s.mean = int(row["n"]), np.frombuffer(row["sums"], np.int64), np.frombuffer(row["mean"])
        s.values = np.frombuffer(row["values"])
        s.vectors = np.frombuffer(row["vectors"]).reshape(len(s.mean), -1)
        return s


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x (array of long): usable rows, all of the prevailing length."""
    c = F.col(embedding)
    usable = c.isNotNull() & (F.size(c) > 0) & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT)
    rows = vectors.where(usable).select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    prevailing = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (prevailing["size"] if prevailing else 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_spectrum(fit: DataFrame, dims: int) -> Spectrum:
    """Spectrum of all rows of ``fit`` (x), partitions merged in a tree."""
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = Spectrum(dims)
        for batch in batches:
            seen.add(_matrix(batch.column("x"), dims))
        if seen.n:
            yield pa.RecordBatch.from_pydict(seen.row(TaskContext.get().partitionId()))

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        found = [Spectrum.read(r) for r in rows.sort_values("part").to_dict("records")]
        for other in found[1:]:
            found[0].merge(other)
        return pd.DataFrame(found[0].row(int(rows["part"].min()) // FAN_IN))

    level = stage(fit.mapInArrow(update, SPECTRUM), "spectrum")
    while level.count() > 1:
        level = stage(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(combine, SPECTRUM), "spectrum")
    last = level.first()
    return Spectrum.read(last) if last else Spectrum(dims)


def _gram(fit: DataFrame, dims: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over the rows of (x - centre) basis, multiplied with itself; cells are added up in Spark."""
    k = basis.shape[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = ((_matrix(batch.column("x"), dims) - SHIFT) - centre) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k * k), "value": total.ravel()})

    out = np.zeros(k * k)
    for r in fit.mapInArrow(cells, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(k, k)


def whiten(vectors: DataFrame, components: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component."""
    rows = quantised(vectors, vec_id, embedding)
    fit = stage(rows.select("x").distinct(), "whiten-fit")
    some = fit.first()
    dims = len(some["x"]) if some else 1
    s = fit_spectrum(fit, dims)
    n, sums = s.n, s.sums
    centre = np.array([(int(t) - SHIFT * n) / n for t in sums]) if n else np.zeros(dims)
    # Rayleigh-Ritz in the space of the eigenvectors found.
    ritz = _gram(fit, dims, centre, s.vectors) / max(n, 1)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(values)[::-1]
    values, basis = values[order], (s.vectors @ turn)[:, order]
    keep = int((values[:components] > 1e-12 * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    trace, values = float(np.trace(ritz)), values[:keep]
    basis = basis[:, :keep] / np.sqrt(values)
    error = float(np.abs(_gram(fit, dims, centre, basis) / n - np.eye(keep)).max()) if keep else 0.0
    explained = values / trace if keep else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows if keep else 0, BATCH):
                batch = whole.slice(start, BATCH)
                x = _matrix(batch.column("x"), dims)
                offset = (x - SHIFT) * n - (sums - SHIFT * n)
                if float((offset.astype(np.float64) ** 2).sum(1).max()) >= 2.0 ** 63:
                    raise ArithmeticError("deviation does not fit in 64 bits")
                deviation = (offset * offset).sum(1)
                y = ((x - SHIFT) - centre) @ basis
                at = np.repeat(np.arange(len(x)), keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(at), n, np.int64)), pa.array(deviation[at]), pa.array(y.ravel()),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                    "explained double, identity_error double")
