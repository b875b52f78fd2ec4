"""Embedding whitening (operator 11): principal components by incremental eigendecomposition.

A *spectrum* is the count, mean, eigenvalues and eigenvectors of the scatter
(sum of squared deviations) of some vectors.  A partition keeps one spectrum and
adds to it by rank-one updates: with D the eigenvalues and z the update in the
eigenbasis, the new eigenvalues are the roots of the secular equation
1 + sum z_i^2 / (D_i - x) = 0, one between each two neighbours of D, and the new
eigenvectors follow from z / (D - x).  Entries of z that vanish and equal
eigenvalues are deflated first: they keep their eigenvector.  Spectra are
combined in the same way, by one update for each eigenvector of the other, and
one for the distance of the means.

A batch of more rows than dimensions is first turned into its triangular factor
R, whose rows have the same scatter: d updates stand for the batch, so the work
per vector does not hold d^3.

The updates find the basis; its small errors are removed by a final
Rayleigh-Ritz step over all vectors: the covariance is taken in that basis,
where it is almost diagonal, and the small problem that is left is solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.tables import written

#: Integers of a vector: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and above take no part: their integers leave the range in which doubles are exact.
MOST = 2.0**40
COMPONENTS = 32
#: Spectra (or sums) that meet in one task at each level of the combination.
FAN_IN = 32
#: Share of the greatest eigenvalue below which a component has no variance to scale.
RANK = 1e-12
EPS = np.finfo(float).eps


@dataclass
class Spectrum:
    """n vectors with this mean, and the eigenvalues (ascending) and eigenvectors (columns) of their scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def update(self, v: np.ndarray) -> None:
        """The scatter grows by v v'."""
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def add(self, x: np.ndarray) -> None:
        """The vectors (rows) of x join."""
        if not len(x):
            return
        mean = x.mean(axis=0)
        rows = x - mean
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.update(row)
        self._meet(len(x), mean)

    def _meet(self, n: int, mean: np.ndarray) -> None:
        """n vectors whose scatter about their own mean is already in join: their mean's distance is one more update."""
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * (n / (self.n + n))))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def combine(self, other: Spectrum) -> None:
        if other.n:
            for value, vector in zip(other.values, other.vectors.T, strict=True):
                self.update(np.sqrt(max(value, 0.0)) * vector)
            self._meet(other.n, other.mean)


def secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2 / (d - x) = 0 for ascending, different d: the nearest pole of each and its distance from that pole.

    Each root is bracketed between two poles and found by rational steps that
    are kept in the bracket; distances from the nearest pole keep all digits.
    """
    n = d.size
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    at = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    right = (at < 0) & (np.arange(n) < n - 1)
    pole = np.arange(n) + right
    shift = d[None, :] - d[pole][:, None]
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap)
    hi = np.where(~right & (np.arange(n) < n - 1), gap / 2, hi)
    x = np.where(right, -gap / 4, np.where(np.arange(n) < n - 1, gap / 4, gap / 2))
    own = np.arange(n)[None, :] <= np.arange(n)[:, None]
    todo = np.arange(n)
    for _ in range(200):
        s, t = shift[todo], x[todo]
        diff = s - t[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = z2 / diff
            slope = term / diff
            left = own[todo]
            f = 1 + term.sum(axis=1)
            # f rises from -inf at the lower pole to +inf at the upper one (or 1 beyond the last).
            lo[todo] = np.where(f < 0, t, lo[todo])
            hi[todo] = np.where(f > 0, t, hi[todo])
            bound = 1 + np.abs(term).sum(axis=1)
            # The two sides of the sum are fitted by one pole each: p / (a - y) and q / (b - y).
            a, b = s[np.arange(todo.size), todo], np.where(todo < n - 1, s[np.arange(todo.size), np.minimum(todo + 1, n - 1)], np.inf)
            p = np.where(left, slope, 0).sum(axis=1) * (a - t) ** 2
            q = np.where(left, 0, slope).sum(axis=1) * np.where(np.isfinite(b), (b - t) ** 2, 0)
            c = f - p / (a - t) - np.where(np.isfinite(b), q / (b - t), 0)
            # c + p / (a - y) + q / (b - y) = 0 in y.
            bb = np.where(np.isfinite(b), b, 0)
            qa = c
            qb = -(c * (a + bb) + p + q)
            qc = c * a * bb + p * bb + q * a
            root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))
            h = -0.5 * (qb + np.where(qb >= 0, root, -root))
            y1, y2 = h / qa, qc / h
            single = a + p / c
            y = np.where(np.isfinite(b), np.where((y1 > lo[todo]) & (y1 < hi[todo]), y1, y2), single)
        good = (y > lo[todo]) & (y < hi[todo])
        new = np.where(good, y, (lo[todo] + hi[todo]) / 2)
        done = (np.abs(f) <= 4 * EPS * n * bound) | (hi[todo] - lo[todo] <= 2 * EPS * np.maximum(np.abs(lo[todo]), np.abs(hi[todo]))) | (new == t)
        x[todo] = np.where(done, t, new)
        todo = todo[~done]
        if not todo.size:
            break
    return pole, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of V diag(values) V' + v v'."""
    z = vectors.T @ v
    weight = float(z @ z)
    if not weight > 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    small = 8 * EPS * max(float(np.abs(values).max()), weight)
    # Deflation: a vanishing entry leaves its eigenpair alone; of two equal eigenvalues one entry is turned to nothing.
    keep = np.abs(z) * np.sqrt(weight) > small
    last = -1
    for i in np.flatnonzero(keep):
        if last >= 0 and values[i] - values[last] <= small:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            z[i], z[last], keep[last] = r, 0.0, False
            turned = c * vectors[:, i] + s * vectors[:, last]
            vectors[:, last] = c * vectors[:, last] - s * vectors[:, i]
            vectors[:, i] = turned
        last = i
    d, z = values[keep], z[keep]
    pole, x = secular(d, z * z)
    # d_i - root_j with all digits, and the z for which these roots are exact (so that the eigenvectors are orthogonal).
    diff = (d[:, None] - d[pole][None, :]) - x[None, :]
    k = d.size
    if k > 1:
        gaps = d[:, None] - d[None, :]
        np.fill_diagonal(gaps, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = -diff.copy()  # root_j - d_i
            quotient = ratio / np.where(np.eye(k, dtype=bool), 1.0, -gaps)
        z = np.copysign(np.sqrt(np.abs(np.prod(quotient, axis=1))), z)
    diff = np.where(diff == 0, -EPS * small - np.finfo(float).tiny, diff)
    w = z[:, None] / diff
    w /= np.linalg.norm(w, axis=0)
    values[keep] = d[pole] + x
    vectors[:, keep] = vectors[:, keep] @ w
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and x, the vector as integers, of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), vector.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)))
    # Spark may look at the integers' number before the entries are checked, so the conversion itself takes no huge ones.
    rows = rows.where(F.size("v") > 0).select("_id", F.transform("v", lambda c: F.when(F.abs(c) < MOST, F.floor(SCALE * c) + SHIFT)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["dim"] if lengths else 0))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    column = batch.column(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


STATE = "n long, sums array<decimal(38,0)>, mean binary, vals binary, vecs binary"
SUMS = "total binary"


def partition_spectra(rows: DataFrame) -> DataFrame:
    """One row for each partition with vectors: exact sums, and the spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                if spectrum is None:
                    spectrum, sums = Spectrum.empty(x.shape[1]), np.zeros(x.shape[1], dtype=object)
                sums = sums + exact_sums(x)
                spectrum.add((x - SHIFT).astype(float))
        if spectrum:
            yield state_row(spectrum, sums)

    return rows.select("x").mapInArrow(run, STATE)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers: high and low halves are summed apart, so nothing overflows."""
    return (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & ((1 << 20) - 1)).sum(axis=0).astype(object)


def state_row(s: Spectrum, sums: np.ndarray) -> pa.RecordBatch:
    decimals = pa.array([pa.array([str(t) for t in sums]).cast(pa.decimal128(38, 0)).to_pylist()], pa.list_(pa.decimal128(38, 0)))
    parts = (pa.array([a.tobytes()], pa.binary()) for a in (s.mean, s.values, s.vectors))
    return pa.RecordBatch.from_arrays([pa.array([s.n], pa.int64()), decimals, *parts], names=["n", "sums", "mean", "vals", "vecs"])


def spectra_of(batch: pa.RecordBatch) -> Iterator[tuple[Spectrum, np.ndarray]]:
    for r in batch.select(["n", "sums", "mean", "vals", "vecs"]).to_pylist():
        mean, values = np.frombuffer(r["mean"]), np.frombuffer(r["vals"])
        yield Spectrum(r["n"], mean, values, np.frombuffer(r["vecs"]).reshape(mean.size, mean.size)), np.array([int(t) for t in r["sums"]], dtype=object)


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spectra of a task as one."""
    spectrum = sums = None
    for batch in batches:
        for other, more in spectra_of(batch):
            if spectrum is None:
                spectrum, sums = other, more
            else:
                spectrum.combine(other)
                sums = sums + more
    if spectrum:
        yield state_row(spectrum, sums)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of a task, summed."""
    total = None
    for batch in batches:
        for part in batch.column("total").to_pylist():
            part = np.frombuffer(part)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def fold(parts: DataFrame, join, schema: str, name: str) -> list:
    """The rows of ``parts`` (one a task, each as large as d x d numbers) joined to one, ``FAN_IN`` at a time; that row."""
    parts = written(parts, name)
    n = parts.count()
    while n > 1:
        n = -(-n // FAN_IN)
        numbers = F.pmod(F.xxhash64(*parts.columns), F.lit(n)).cast("int")
        # As many partitions as rows are left: some may get several rows and some none.
        parts = written(parts.repartition(n, numbers).mapInArrow(join, schema), name)
        n = min(n, parts.count()) if n > 1 else n
    return parts.take(1)


@dataclass
class Whitening:
    """n, exact sums of the integers, and components (columns) by falling eigenvalue of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([centre(t, self.n) for t in self.sums])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """sum (n x - S)^2 of each row, exact; null where it is no long."""
        low = np.array([abs(t) for t in self.sums], dtype=object).max() + self.n * int(np.abs(x).max())
        if low < 2**62:
            off = self.n * x - np.array([int(t) for t in self.sums], dtype=np.int64)
            if int(np.abs(off).max()) ** 2 * x.shape[1] < 2**63:
                return pa.array((off * off).sum(axis=1))
        exact = [sum((self.n * int(c) - t) ** 2 for c, t in zip(row, self.sums, strict=True)) for row in x]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))


def centre(total: int, n: int) -> float:
    return total / n  # of two whole numbers: correctly rounded


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off in whole numbers, so no digits are lost."""
    whole = np.array([t // n for t in sums], dtype=np.int64)
    rest = np.array([t % n / n for t in sums])
    return (x - whole).astype(float) - rest


def covariance_in(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """basis' V basis, V the covariance of the integers, from one pass over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centred(matrix(batch), n, sums) @ basis
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    found = fold(rows.select("x").mapInArrow(run, SUMS), added, SUMS, "covariance")
    return np.frombuffer(found[0]["total"]).reshape(basis.shape[1], -1) / n


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows (x); None where there are none, or none that differ."""
    state = fold(partition_spectra(rows), combined, STATE, "spectra")
    if not state:
        return None
    n, sums = state[0]["n"], [int(t) for t in state[0]["sums"]]
    dim = len(sums)
    basis = np.frombuffer(state[0]["vecs"]).reshape(dim, dim)[:, ::-1]
    basis = np.linalg.qr(basis)[0]
    small = covariance_in(rows, n, sums, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(np.trace(small))
    count = min(components, int((values > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    if not count:
        return None
    found = Whitening(n, sums, values[:count].copy(), np.ascontiguousarray(vectors[:, :count]), trace, 0.0)
    check = covariance_in(rows, n, sums, found.vectors / np.sqrt(found.values))
    found.identity_error = float(np.abs(check - np.eye(count)).max())
    return found


def whitening(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and each of the first components.

    Vectors are turned into integers x = floor(64 c) + 1000000; n vectors with
    sums S have covariance V (divisor n, about S / n).  A component is a unit
    eigenvector of V, numbered from 1 by falling eigenvalue e.  deviation: the
    exact sum of (n x - S)^2 (null where it is no long); whitened: x - S / n on
    the component over sqrt(e); explained: e / trace(V); identity_error: the
    greatest entry of the covariance of whitened, minus the identity, taken from
    the whitened vectors themselves.

    Null and empty vectors and those with null, non-finite or huge (2^40)
    entries take no part, nor do those of another length than the most (of equal
    numbers the longest).  Components without variance (below 1e-12 of the
    first) cannot be scaled and are left out; so an empty table, one vector or
    equal vectors give no rows.  Repeated rows count each time and all get their
    rows, a null id is passed on, other columns are not read.
    """
    rows = written(taking_part(df, id_col, vector_col), "vectors")
    model = fitted(rows, components)
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.values.size
        for batch in batches:
            if not batch.num_rows:
                continue
            x, times = matrix(batch), batch.num_rows * k
            row = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(times, model.n)),
                    model.deviations(x).take(row),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, batch.num_rows)),
                    pa.array(np.full(times, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
