"""Whitening of vectors by an incremental eigendecomposition.

A spectrum is the number of vectors, their exact sum, and eigenvalues and vectors of their centred
scatter. Partitions build theirs by rank-one updates; each solves a secular equation for all
eigenvalues at once, after deflation. The rows of a batch are turned by an orthogonal matrix first,
which leaves their scatter as it is and all but a few of them zero. Spectra are combined by the same
updates, one for each eigenvector and one for the distance of the means, in groups of few, round by
round. A Rayleigh-Ritz step over all vectors then gives the components to double precision.

No task holds more than a batch and a few spectra, and the driver gets one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.base import Scratch
from recollect.llm.vectors import matrix, sound
from recollect.llm.words import give_back

#: Vector entries become integers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Integers beyond this are not exact as doubles; vectors that have them are left out.
LARGEST = 1 << 52
#: Components that are returned, and the share of the variance that one must have to be told from none.
COMPONENTS, LEAST_SHARE = 8, 1e-12
#: Spectra or sums that a task combines.
FAN_IN = 16
_EPS = np.finfo(np.float64).eps


# -- rank-one updates ---------------------------------------------------------------


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - x)) = 0`` for rising ``d`` and positive ``z2``.

    A root lies between each two neighbours of ``d`` and one beyond the last. Each is given as
    (the number of the nearest pole, distance from it), so that differences to poles are exact.
    """
    n = len(d)
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    middle = (d + upper) / 2
    right = (1 + (z2[None] / (d[None] - middle[:, None])).sum(axis=1)) < 0
    right[-1] = False
    pole = np.arange(n) + right
    delta = d[None] - d[pole][:, None]
    low = np.where(right, (d - upper) / 2, 0.0)
    high = np.where(right, 0.0, (upper - d) / 2)
    high[-1] = total
    rows = np.arange(n)
    here, there = d - d[pole], upper - d[pole]  # the two poles around each root
    x = (low + high) / 2
    below = np.tri(n, dtype=bool)  # poles up to the root's left one
    for _ in range(60):
        gap = delta - x[:, None]
        terms = z2[None] / gap
        slopes = terms / gap
        f = 1 + terms.sum(axis=1)
        noise = _EPS * n * (1 + np.abs(terms).sum(axis=1))
        up = f < 0  # f rises between poles
        low, high = np.where(up, x, low), np.where(up, high, x)
        if (np.abs(f) <= noise).all():
            break
        left_slope = np.where(below, slopes, 0.0).sum(axis=1)
        right_slope = slopes.sum(axis=1) - left_slope
        p, q = here - x, there - x
        c = f - p * left_slope - q * right_slope
        a = (p + q) * f - p * q * (left_slope + right_slope)
        b = p * q * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        bad = ~np.isfinite(new) | (new <= low) | (new >= high)
        new = np.where(bad, (low + high) / 2, new)
        new = np.where(np.abs(f) <= noise, x, new)
        if (new == x).all():
            break
        x = new
    return pole[rows], x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and vectors of ``basis diag(values) basis' + vector vector'``."""
    z = basis.T @ vector
    size = z @ z
    if not size > 0:
        return values, basis
    tiny = 8 * _EPS * max(values[-1], size)
    # Equal eigenvalues: a reflection within their space leaves one of them a share in the update.
    runs = np.flatnonzero(np.diff(values) > tiny) + 1
    if len(runs) < len(values) - 1:
        basis, z = basis.copy(), z.copy()
        for a, b in zip(np.concatenate([[0], runs]), np.concatenate([runs, [len(values)]])):
            length = np.linalg.norm(z[a:b])
            if b - a > 1 and length > 0:
                mirror = z[a:b].copy()
                mirror[-1] += np.copysign(length, mirror[-1])
                mirror /= np.linalg.norm(mirror)
                basis[:, a:b] -= 2 * np.outer(basis[:, a:b] @ mirror, mirror)
                last = -np.copysign(length, z[b - 1])
                z[a:b] = 0.0
                z[b - 1] = last
    # Directions without a share stay as they are.
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    if not len(active):
        return values, basis
    d, w = values[active], z[active]
    pole, offset = secular_roots(d, w * w)
    # What the roots found are the exact eigenvalues of; vectors from these shares are orthogonal.
    apart = (d[pole] - d[:, None]) + offset  # [i, j]: root j less pole i
    poles = d[None] - d[:, None]
    np.fill_diagonal(poles, 1.0)
    exact = np.sqrt(np.abs(np.prod(apart / poles, axis=1)))
    vectors = np.copysign(exact, w)[:, None] / -apart
    vectors /= np.linalg.norm(vectors, axis=0)
    values, basis = values.copy(), basis.copy()
    values[active] = d[pole] + offset
    basis[:, active] = basis[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


# -- spectra ------------------------------------------------------------------------


@dataclass
class Spectrum:
    """Vectors seen so far: how many, their sum, and the spectrum of their centred scatter."""

    n: int
    total: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> "Spectrum":
        return cls(0, np.zeros(dim, dtype=np.int64), np.zeros(dim), np.eye(dim))

    def absorb(self, n: int, total: np.ndarray, rows: np.ndarray) -> None:
        """Take in ``n`` vectors whose centred scatter is that of ``rows``."""
        updates = list(rows)
        if self.n:
            shift = total / n - self.total / self.n
            updates.append(np.sqrt(self.n * (n / (self.n + n))) * shift)
        for row in updates:
            self.values, self.basis = rank_one(self.values, self.basis, row)
        self.n, self.total = self.n + n, self.total + total

    def add(self, x: np.ndarray) -> None:
        """Take in a batch of integer vectors."""
        total = x.sum(axis=0)
        self.absorb(len(x), total, np.linalg.qr(x - total / len(x), mode="r"))

    def merge(self, other: "Spectrum") -> None:
        self.absorb(other.n, other.total, np.sqrt(np.maximum(other.values, 0.0))[:, None] * other.basis.T)

    def dump(self) -> bytes:
        return b"".join(a.tobytes() for a in (np.array([self.n], dtype=np.int64), self.total, self.values, self.basis))

    @classmethod
    def load(cls, data: bytes, dim: int) -> "Spectrum":
        total, values, basis = 8, 8 + 8 * dim, 8 + 16 * dim
        return cls(
            int(np.frombuffer(data[:8], dtype=np.int64)[0]),
            np.frombuffer(data[total:values], dtype=np.int64),
            np.frombuffer(data[values:basis]),
            np.frombuffer(data[basis:]).reshape(dim, dim),
        )


def _summed(rows: DataFrame, parts: int, first: Callable[[Iterator[np.ndarray]], bytes | None], join: Callable, dim: int) -> bytes:
    """One value from all of ``rows``: ``first`` makes it of a partition, ``join`` of FAN_IN values."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = first(integers(b.column("vector"), dim) for b in batches if b.num_rows)
        if made is not None:
            slot = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([slot, pa.array([made], pa.binary())], ["slot", "data"])
        give_back()

    def combine(group: pa.Table) -> pa.Table:
        found = group.sort_by("slot")
        slot = found["slot"][0].as_py() // FAN_IN
        return pa.table({"slot": pa.array([slot], pa.int64()), "data": pa.array([join(found["data"].to_pylist())], pa.binary())})

    now = rows.select("vector").mapInArrow(start, "slot long, data binary")
    while parts > 1:
        now = now.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInArrow(combine, "slot long, data binary")
        parts = -(-parts // FAN_IN)
    return bytes(now.first()["data"])


def integers(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, dim)).astype(np.int64) + SHIFT


def fitted(rows: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all ``vector`` values, by incremental updates."""

    def first(batches: Iterator[np.ndarray]) -> bytes | None:
        own = Spectrum.empty(dim)
        for x in batches:
            own.add(x)
        return own.dump() if own.n else None

    def join(parts: list[bytes]) -> bytes:
        own = Spectrum.empty(dim)
        for part in parts:
            own.merge(Spectrum.load(part, dim))
        return own.dump()

    return Spectrum.load(_summed(rows, rows.rdd.getNumPartitions(), first, join, dim), dim)


def products(rows: DataFrame, dim: int, centre: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of all vectors' coordinates on ``axes`` about ``centre``."""
    k = axes.shape[1]

    def first(batches: Iterator[np.ndarray]) -> bytes | None:
        out = np.zeros((k + 1, k))
        for x in batches:
            y = (x - centre) @ axes
            out[0] += y.sum(axis=0)
            out[1:] += y.T @ y
        return out.tobytes()

    def join(parts: list[bytes]) -> bytes:
        return np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()

    out = np.frombuffer(_summed(rows, rows.rdd.getNumPartitions(), first, join, dim)).reshape(k + 1, k)
    return out[0], out[1:]


@dataclass
class Components:
    """What whitening needs: exact sums, axes by falling eigenvalue, and how good the result is."""

    n: int
    total: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    variance: float
    identity_error: float


def principal(rows: DataFrame, dim: int, wanted: int = COMPONENTS) -> Components:
    """Components of all ``vector`` values; those without variance are left out."""
    found = fitted(rows, dim)
    centre = found.total / found.n
    basis, _ = np.linalg.qr(found.basis[:, ::-1])
    scatter = products(rows, dim, centre, basis)[1] / found.n
    values, turned = np.linalg.eigh((scatter + scatter.T) / 2)
    values, axes = values[::-1], basis @ turned[:, ::-1]
    variance = float(np.trace(scatter))
    n = int((values[:wanted] > LEAST_SHARE * variance).sum())
    values, axes = values[:n], axes[:, :n]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(n)])
    error = 0.0
    if n:
        sums, squares = products(rows, dim, centre, axes / np.sqrt(values))
        error = float(np.abs(squares / found.n - np.outer(sums, sums) / found.n**2 - np.eye(n)).max())
    return Components(found.n, found.total, values, axes, variance, error)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """``sum((n x - total)^2)`` of each row, exact; none where it needs more than 64 bits."""
    most = n * float(np.abs(x).max(initial=0)) + float(np.abs(total).max(initial=0))
    apart = float(np.abs(x - total / n).max(initial=0)) * n * (1 + 1e-9) + 1
    if most < 2.0**62 and apart * apart * x.shape[1] < 2.0**62:
        apart = n * x - total
        return (apart * apart).sum(axis=1).tolist()
    sums = [sum((n * a - s) ** 2 for a, s in zip(row, total.tolist())) for row in x.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def whitened(
    rows: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of sound vectors.

    Vectors that are null or empty, hold null or non-finite entries or such whose integer is beyond
    2^52, or have another length than most (the smaller length, if two are equally frequent) are
    left out. Components without variance don't exist, so a single vector, or equal ones, give no
    row, and no more components come than vectors have entries. Repeated rows count and are
    returned as often as they occur; null ids stay null. ``deviation`` is null where it does not
    fit 64 bits. Signs: the largest entry of a component is positive. An empty table gives an empty result.
    """
    small = F.forall("vector", lambda x: F.abs(x) < LARGEST / SCALE)
    sane = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        sound("vector") & small
    )
    lengths = sane.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", -F.col("dim"))).alias("most")).first()["most"]
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return rows.sparkSession.createDataFrame([], out)
    dim = -most[1]
    fit = scratch.keep(sane.where(F.size("vector") == dim))
    found = principal(fit, dim, wanted)
    centre, scaled, k = found.total / found.n, found.axes / np.sqrt(found.values), len(found.values)
    explained = found.values / found.variance if k else found.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = integers(batch.column("vector"), dim)
            apart = pa.array(deviations(x, found.n, found.total), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n, dtype=np.int64)),
                    apart.take(each),
                    pa.array(((x - centre) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, found.identity_error)),
                ],
                [c.split()[0] for c in out.split(", ")],
            )
        give_back()

    return fit.mapInArrow(run, out)
