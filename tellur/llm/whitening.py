"""Whitening of embeddings by an incremental eigendecomposition, refined by a distributed Rayleigh-Ritz step.

A spectrum is the state of some vectors: how many, their exact sums, and the eigenvalues and eigenvectors of their centred
scatter. A vector changes it by a centred rank-one update, whose eigenvalues are the roots of a secular equation and whose
eigenvectors follow from them; directions that an update doesn't move, and equal eigenvalues, are deflated. Vectors come in
lots: the triangular factor of a centred lot has the lot's scatter, so its rows, at most one for each dimension, are the
lot's updates, and the shift of its mean is one more. Spectra of partitions are combined, some at a time, by the rank-one
updates of one's eigenvectors to the other. The eigenvectors of all then span the space in which the covariance of all
vectors is added up once more, centred first, and its small eigenproblem turns them into the components (Rayleigh-Ritz).
A spectrum has dim x dim numbers, whatever the number of vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import durable, read

#: Vectors in a lot, and states that one task combines.
LOT, FAN = 1_024, 16
#: Eigenvalues under this share of all variance are none: their directions hold rounding only.
NONE = 1e-12
EPS = np.finfo(float).eps


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' and the matrix d_i - root_j; d rises strictly and no z is zero.

    Each root lies between two neighbours of d. It is sought as a distance from the nearer of both, by interpolating the
    poles on either side as 1/x each, and by halving where that leaves the interval.
    """
    k, zz = len(d), z * z
    nxt = np.append(d[1:], d[-1] + zz.sum())
    gap = nxt - d
    mid = d + gap / 2
    at_mid = 1 + (zz[:, None] / (d[:, None] - mid)).sum(axis=0)
    left = (at_mid >= 0) | (np.arange(k) == k - 1)
    origin = np.where(left, d, nxt)
    delta = d[:, None] - origin  # exact where it matters: zero at the root's own pole
    below = np.arange(k)[:, None] <= np.arange(k)
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    mu = (lo + hi) / 2
    live = np.arange(k)
    for _ in range(100):
        t = delta[:, live] - mu[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            q = zz[:, None] / t
            f = 1 + q.sum(axis=0)
            slope = q / t
        p1, p2 = np.where(below[:, live], slope, 0).sum(axis=0), np.where(below[:, live], 0, slope).sum(axis=0)
        up = f < 0  # f rises between two poles
        lo[live], hi[live] = np.where(up, mu[live], lo[live]), np.where(up, hi[live], mu[live])
        d1, d2 = d[live] - origin[live] - mu[live], nxt[live] - origin[live] - mu[live]
        a, b, c = (d1 + d2) * f - d1 * d2 * (p1 + p2), d1 * d2 * f, f - d1 * p1 - d2 * p2
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        to = mu[live] + step
        bad = ~np.isfinite(to) | (to <= lo[live]) | (to >= hi[live])
        to = np.where(bad, (lo[live] + hi[live]) / 2, to)
        done = (np.abs(f) <= 2 * EPS * k * (1 + np.abs(q).sum(axis=0))) | (hi[live] - lo[live] <= 2 * EPS * np.abs(mu[live]))
        mu[live] = np.where(done, mu[live], to)
        live = live[~done]
        if not len(live):
            break
    return origin + mu, delta - mu


def updated(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of u diag(d) u' + v v'."""
    z = v @ u
    size = float(z @ z)
    small = 8 * EPS * max(float(np.abs(d).max(initial=0)), size)
    moved = np.abs(z) * np.sqrt(size) > small  # the others' eigenpairs stay
    d, u = d.copy(), u.copy()
    at = np.flatnonzero(moved)
    last = -1
    for i in at:  # of equal eigenvalues a rotation leaves one to be moved
        if last >= 0 and d[i] - d[last] <= small:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            u[:, [last, i]] = np.stack([c * u[:, last] - s * u[:, i], s * u[:, last] + c * u[:, i]], axis=1)
            d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
            z[last], z[i], moved[last] = 0.0, r, False
        last = i
    at = np.flatnonzero(moved)
    if len(at):
        at = at[np.argsort(d[at], kind="stable")]
        own = d[at]
        roots, far = secular(own, z[at])
        # The z that has these roots exactly, by the products of their distances: its eigenvectors are orthogonal.
        apart = own[:, None] - own
        np.fill_diagonal(apart, 1.0)
        ratio = far / apart.T
        exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[at])
        w = exact[:, None] / far
        w /= np.linalg.norm(w, axis=0)
        d[at], u[:, at] = roots, u[:, at] @ w
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """How many vectors, their sums (exact integers), and the eigenvalues and eigenvectors of their centred scatter."""

    def __init__(self, dim: int):
        self.n, self.sums, self.d, self.u = 0, [0] * dim, np.zeros(dim), np.eye(dim)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def take(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        """Adds n vectors whose centred scatter is that of `rows`: an update for each row, and one for the means' distance."""
        if self.n and n:
            apart = np.array([s / n for s in sums]) - self.mean()
            self.d, self.u = updated(self.d, self.u, apart * np.sqrt(self.n * n / (self.n + n)))
        for v in rows:
            if v.any():
                self.d, self.u = updated(self.d, self.u, v)
        self.n, self.sums = self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def add(self, x: np.ndarray) -> None:
        """A lot of vectors (longs)."""
        sums = exact_sums(x)
        rows = x - np.array([s / len(x) for s in sums])
        self.take(len(x), sums, np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows)

    def combine(self, other: Spectrum) -> None:
        d = np.maximum(other.d, 0)
        self.take(other.n, other.sums, (other.u * np.sqrt(d)).T[d > 0])


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of longs as Python integers."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def sound(vectors: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is whole: not null, without null and non-finite entries."""
    return vectors.where(F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def longs(lists: pa.Array, dim: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of each entry as longs, held within 62 bits; shorter vectors are filled up by entries of 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return np.clip(np.floor(out * scale), -(2.0**62) + 2**40, 2.0**62 - 2**40).astype(np.int64) + shift


def gathered(rows: DataFrame, start: Callable[[], object], take: Callable[[object, pa.Array], None], combine: Callable[[object, object], None]) -> object | None:
    """A state of all rows' vectors: one from each partition, FAN of them combined at a time; None without rows."""

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state, any_rows = start(), False
        for b in batches:
            for i in range(0, len(b), LOT):
                any_rows = True
                take(state, b.column(0)[i : i + LOT])
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["at", "state"])

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        state = pickle.loads(group.state.iloc[0])
        for other in group.state.iloc[1:]:
            combine(state, pickle.loads(other))
        return pd.DataFrame({"at": [key[0]], "state": [pickle.dumps(state)]})

    states = durable(rows.mapInArrow(of_part, "at bigint, state binary"))
    while (n := states.count()) > 1:
        numbered = states.groupBy(F.floor(F.col("at") / F.lit(FAN)).cast("bigint").alias("to")) if n > FAN else states.groupBy(F.lit(0).cast("bigint").alias("to"))
        states = durable(numbered.applyInPandas(merged, "at bigint, state binary"))
    found = states.first()
    return pickle.loads(found.state) if found else None


class Turned:
    """The sum of outer products of centred vectors in a basis."""

    def __init__(self, dim: int):
        self.total = np.zeros((dim, dim))

    def combine(self, other: Turned) -> None:
        self.total += other.total


def whitening(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and each of the first components.

    Entries become x = floor(scale * c) + shift, as longs; entries beyond 62 bits are held there. Vectors that are null or
    hold null or non-finite entries are left out; shorter ones are filled up by entries of 0. A null id is kept. Rows that
    repeat an id or a vector are rows each. `deviation` is exact, and null beyond 64 bits. Of components whose eigenvalue
    is no more than NONE of all variance (of one vector, or of equal ones: all) `whitened` is null, `explained` their
    share, and identity_error, over the others, is null if there are none. Empty input gives no rows.
    Other columns, whatever their names, take no part.
    """
    kind = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = sound(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("x")), "x")
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], kind)
    dim = max(1, dim)
    read_x = lambda a: longs(a, dim, scale, shift)

    whole = gathered(rows.select("x"), lambda: Spectrum(dim), lambda s, a: s.add(read_x(a)), lambda s, t: s.combine(t))
    n, sums, mean = whole.n, whole.sums, whole.mean()

    def scatter(basis: np.ndarray, over: np.ndarray) -> np.ndarray:
        """The covariance of the centred vectors' coordinates in a basis, each divided by `over`."""
        sent = spark.sparkContext.broadcast((basis, over))

        def take(state: Turned, a: pa.Array) -> None:
            y = (read_x(a) - mean) @ sent.value[0] / sent.value[1]
            state.total += y.T @ y

        k = basis.shape[1]
        return gathered(rows.select("x"), lambda: Turned(k), take, lambda s, t: s.combine(t)).total / n

    basis = np.linalg.qr(whole.u[:, ::-1])[0]
    values, turn = np.linalg.eigh(scatter(basis, np.ones(dim)))
    values, axes = np.maximum(values[::-1], 0), (basis @ turn)[:, ::-1][:, :components]
    total = float(values.sum())
    values = values[:components]
    good = values > NONE * total
    over = np.sqrt(np.where(good, values, 1.0))
    error = float(np.abs(scatter(axes[:, good], over[good]) - np.eye(int(good.sum()))).max()) if good.any() else None
    explained = values / total if total > 0 else np.zeros(len(values))
    sent = spark.sparkContext.broadcast((axes, over, good, explained, mean, np.array(sums, object)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, over, good, explained, mean, sums = sent.value
        k = len(over)
        for b in batches:
            for i in range(0, len(b), LOT):
                part = b.slice(i, LOT)
                x = read_x(part.column(1))
                y = (x - mean) @ axes / over
                whitened = pa.array(y.ravel(), pa.float64(), mask=np.tile(~good, len(x)))
                rep = np.repeat(np.arange(len(x)), k)
                size = len(rep)
                cols = [
                    part.column(0).take(pa.array(rep)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rep)), whitened, pa.array(np.tile(explained, len(x))), pa.array([error] * size, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(work, kind)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sum)^2 of each row, None beyond 64 bits."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most < 2**62:
        y = n * x - sums.astype(np.int64)
        if x.shape[1] * float(np.abs(y).max(initial=0)) ** 2 < 2**62:
            return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - sums
    return [s if s < 2**63 else None for s in (y * y).sum(axis=1).tolist()]


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all sound `embeddings`: the first 8 components."""
    return whitening(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
