"""Whitening of vectors by an incremental eigendecomposition, refined once over all data.

Each task holds the spectrum of what it has read: mean, eigenvalues and eigenvectors of the scatter.  A further vector, centred
on the mean so far, is a rank-one update: the new eigenvalues are the roots of the secular equation, found between the old
ones after deflation (a vanishing weight leaves its pair as it is; of equal eigenvalues a rotation leaves one with weight), and
the new vectors come from weights recomputed for these roots, which keeps them orthogonal.  Spectra are combined in a tree by
the rank-one updates of one's pairs and of the means' difference on the other.  The basis found serves a Rayleigh-Ritz step
over all data: the centred projections' products are summed over partitions, and the small problem's solution, in double
precision, turns the basis.  Sums of the data are of whole numbers, so centring is exact before anything is rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlake.llm.common import cut

SCALE = 64
LARGEST = 1 << 40       # entries beyond it do not fit exact sums and count as not finite
FAN_IN = 16             # partial results combined by one task
EPS = np.finfo(float).eps


# --- spectra ------------------------------------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' (d rising and apart, z without zeros), each as a pole's number and its distance from that pole."""
    n = len(d)
    weight = z * z
    gap = np.r_[d[1:] - d[:-1], weight.sum()]
    rows = np.arange(n)
    # the pole closer to the root is the origin
    middle = d[:, None] - d[None, :] - gap[None, :] / 2
    at_middle = 1 + (weight[:, None] / middle).sum(0)
    right = (at_middle < 0) & (rows < n - 1)
    origin = rows + right
    lo = np.where(right, -gap / 2, np.where((at_middle < 0) & (rows == n - 1), gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where((at_middle < 0) & (rows == n - 1), gap, gap / 2))
    delta = d[:, None] - d[origin][None, :]
    left_of = (rows[:, None] <= rows[None, :]).astype(float)
    first = weight[:, None]
    below, above = delta[rows, rows], np.r_[delta[rows[1:], rows[:-1]], 0.0]
    mu = (lo + hi) / 2
    for _ in range(80):
        away = 1 / (delta - mu)
        terms = first * away
        psi = np.einsum("ij,ij->j", terms, left_of)
        phi = terms.sum(0) - psi
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
        if (done := (np.abs(f) <= 4 * n * EPS * (1 + np.abs(psi) + np.abs(phi))) | (hi - lo <= 4 * EPS * np.abs(mu))).all():
            break
        # two poles carry value and slope of either side; the model's root is the next guess, kept inside the bracket
        terms *= away
        dpsi = np.einsum("ij,ij->j", terms, left_of)
        dphi = terms.sum(0) - dpsi
        a, b = below - mu, above - mu
        c = np.where(rows < n - 1, f - a * dpsi - b * dphi, f - a * dpsi)
        s, t = a * a * dpsi, np.where(rows < n - 1, b * b * dphi, 0.0)
        with np.errstate(all="ignore"):
            p, q = np.where(rows < n - 1, c * (a + b) + s + t, c * a + s), np.where(rows < n - 1, c * a * b + s * b + t * a, 0.0)
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(rows < n - 1, np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c)), p / c)
            guess = mu + step
            fits = np.isfinite(guess) & (guess > lo) & (guess < hi)
        mu = np.where(done, mu, np.where(fits, guess, (lo + hi) / 2))
    return origin, mu


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (values rising, vectors as columns) of ``vectors diag(values) vectors' + x x'``."""
    z = x @ vectors
    rest = x - vectors @ z
    again = rest @ vectors  # once more, for what rounding left
    z, rest = z + again, rest - vectors @ again
    size = np.sqrt(x @ x)
    length = np.sqrt(rest @ rest)
    if vectors.shape[1] < len(x) and length > 1e-10 * size:
        vectors, values, z = np.c_[vectors, rest / length], np.r_[values, 0.0], np.r_[z, length]
    order = np.argsort(values, kind="stable")
    values, vectors, z = values[order], vectors[:, order], z[order]
    total = max(values[-1] if len(values) else 0.0, size * size)
    small = 8 * EPS * total
    # deflation: equal values share one weight, weights that change nothing are left out
    for i in np.flatnonzero(np.diff(values) <= small).tolist():
        r = np.hypot(z[i], z[i + 1])
        if r > 0:
            cos, sin = z[i + 1] / r, z[i] / r
            a, b = vectors[:, i].copy(), vectors[:, i + 1].copy()
            vectors[:, i], vectors[:, i + 1] = cos * a - sin * b, sin * a + cos * b
            z[i], z[i + 1] = 0.0, r
    live = np.flatnonzero(np.abs(z) * size > small)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    origin, mu = secular_roots(d, w)
    gaps = (d[:, None] - d[origin][None, :]) - mu  # pole minus root
    # the weights for which these roots are exact
    n = len(d)
    ratio = -gaps / np.where(np.eye(n, dtype=bool), 1.0, d[None, :] - d[:, None]).T
    ratio[np.arange(n), np.arange(n)] = -gaps[np.arange(n), np.arange(n)]
    exact = np.sqrt(np.maximum(np.abs(ratio.prod(1)), 0)) * np.sign(w)
    turn = exact[:, None] / gaps
    turn /= np.sqrt((turn * turn).sum(0))
    values, vectors = values.copy(), vectors.copy()
    vectors[:, live] = vectors[:, live] @ turn
    values[live] = d[origin] + mu
    return values, vectors


class Spectrum:
    """Count, mean and scatter's spectrum of vectors."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(0), np.zeros((size, 0))

    def _update(self, x):
        self.values, self.vectors = rank_one(self.values, self.vectors, x)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1 and away.any():
            self._update(away * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        if self.n and away.any():
            self._update(away * np.sqrt(self.n * other.n / n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(vector * np.sqrt(value))

    def packed(self) -> bytes:
        return np.concatenate([[self.n, len(self.values)], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, size: int) -> Spectrum:
        x = np.frombuffer(data)
        out, k = cls(size), int(x[1])
        out.n, out.mean, out.values = int(x[0]), x[2:2 + size].copy(), x[2 + size:2 + size + k].copy()
        out.vectors = x[2 + size + k:].reshape(size, k).copy()
        return out


# --- tasks --------------------------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _spectra(size: int):
    def run(batches):
        found = Spectrum(size)
        for batch in batches:
            for x in _matrix(batch.column(0), size).astype(float):
                found.add(x)
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([found.packed()], pa.binary())], names=["part"])
    return run


def _merge(size: int):
    def run(batches):
        found = Spectrum(size)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found.merge(Spectrum.unpacked(data, size))
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([found.packed()], pa.binary())], names=["part"])
    return run


def _add(batches):
    total = None
    for batch in batches:
        for data in batch.column(0).to_pylist():
            x = np.frombuffer(data)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def _products(n: int, sums: np.ndarray, turn: np.ndarray):
    """Sums over rows of the products of ``turn``ed centred vectors, one matrix per task."""
    def run(batches):
        total = np.zeros((turn.shape[1], turn.shape[1]))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), len(sums)), n, sums) @ turn
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once where the product fits whole numbers."""
    if n * (np.abs(x).max(initial=1) + 1.0) < 2.0**62:
        return (x * n - sums) / float(n)
    whole, part = sums // n, sums % n
    return (x - whole) - part / float(n)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - sums)^2 over the dimensions, exact; null where it does not fit 64 bits."""
    rough = ((x.astype(float) * n - sums.astype(float)) ** 2).sum(1)
    fits = n * (np.abs(x).max(initial=1) + 1.0) < 2.0**62
    exact = ((x * n - sums) ** 2).sum(1) if fits else np.zeros(len(x), np.int64)
    out = exact.tolist()
    for i in np.flatnonzero((rough > 2.0**61) | (not fits)).tolist():
        value = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))
        out[i] = value if value < 1 << 63 else None
    return out


def _whitened(n, sums, turn, explained, error):
    """Rows to one row per component."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), len(sums))
            y = _centred(x, n, sums) @ turn
            rows, k = y.shape
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                 pa.array(_deviation(x, n, sums), pa.int64()).take(again), pa.array(y.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def _tree(parts: DataFrame, combine) -> bytes | None:
    """One result of many: FAN_IN to a task, level by level, each level a written table."""
    while True:
        parts = cut(parts)
        count = parts.count()
        if count <= 1:
            row = parts.first()
            return bytes(row[0]) if row else None
        parts = parts.repartition(-(-count // FAN_IN)).mapInArrow(combine, "part binary")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and each component.

    Not usable are vectors that are null, empty, of another length than most (ties: the longest), or that hold null, non-finite
    or huge (above 2^40) entries.  Spectra are of the distinct vectors of whole numbers floor(64 c), plus any constant.  Components
    without variance (at most their rounding errors of the largest) have nothing to divide by and are left out, so a table whose
    vectors are all equal gives no rows.  Null and repeated ids keep a row each.
    """
    entries = F.col("_v")
    finite = F.forall(entries, lambda v: v.isNotNull() & (F.abs(v) <= LARGEST))  # false or null for NaN and infinity
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("_v")).where(
        entries.isNotNull() & (F.size(entries) > 0) & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = rows.sparkSession.createDataFrame([], shape)
    if sizes is None:
        return none
    size = sizes["size"]
    # the constant added to every entry cancels in all results
    whole = cut(rows.where(F.size("_v") == size).select("vec_id", F.transform("_v", lambda v: F.floor(v * SCALE).cast("long")).alias("x")))
    fit = cut(whole.select("x").distinct())
    totals = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, sums = totals[0]["n"], np.array([int(r["s"]) for r in sorted(totals, key=lambda r: r["at"])], np.int64)
    found = Spectrum.unpacked(_tree(fit.mapInArrow(_spectra(size), "part binary"), _merge(size)), size)
    basis = np.linalg.qr(np.c_[found.vectors[:, ::-1], np.eye(size)])[0][:, :size]
    scatter = np.frombuffer(_tree(fit.mapInArrow(_products(n, sums, basis), "part binary"), _add)).reshape(size, size) / n
    values, turn = np.linalg.eigh((scatter + scatter.T) / 2)
    values, turn = values[::-1], basis @ turn[:, ::-1]
    kept = min(components, int((values > size * 16 * EPS * max(values[0], 0)).sum())) if values[0] > 0 else 0
    if not kept:
        return none
    scaled = turn[:, :kept] / np.sqrt(values[:kept])
    own = np.frombuffer(_tree(fit.mapInArrow(_products(n, sums, scaled), "part binary"), _add)).reshape(kept, kept) / n
    error = float(np.abs(own - np.eye(kept)).max())
    explained = values[:kept] / np.trace(scatter)
    return whole.mapInArrow(_whitened(n, sums, scaled, explained, error), shape)
