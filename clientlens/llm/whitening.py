"""Whitening of vectors by incremental eigendecomposition.

A spectrum is the number, mean and scatter eigenpairs of the vectors seen so
far. A task starts from none and applies one centred rank-one update a vector;
spectra are combined, a few at a time, by one update for each eigenpair of the
other and one for the distance of their means. An update solves the secular
equation of its eigenvalues after deflation (directions without a share in the
update, and equal eigenvalues, which are turned until one of them holds the
whole share), and takes the vectors from the roots that were found (Gu and
Eisenstat), so that they stay orthogonal. What rounding has left over is
removed by Rayleigh-Ritz steps over all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, prepare
from .vectors import finite, floors, gathered, packed, unpacked

#: Added to every whole number, and taken off inside: differences stay the same.
SHIFT = 1_000_000
#: Spectra that are combined in one group.
FAN_IN = 8
_EPS = float(np.finfo(np.float64).eps)
_STEPS = 80


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (d - x))`` for rising, distinct ``d``,
    ``z`` without zeros and ``rho`` > 0: root i lies between ``d[i]`` and the
    next one. Returned as (place of the nearer pole, distance from it), which
    keeps the digits that a root close to a pole would lose."""
    n = len(d)
    weight = rho * z * z
    upper = np.append(d[1:], d[-1] + 1.001 * weight.sum())
    half = (upper - d) / 2
    delta = d[None, :] - d[:, None]
    middle = 1 + (weight / (delta - half[:, None])).sum(axis=1)
    at_next = (middle < 0) & (np.arange(n) < n - 1)
    pole = np.arange(n) + at_next
    shifted = d[None, :] - d[pole][:, None]
    low = np.where(at_next, -half, np.where(middle < 0, half, 0.0))
    high = np.where(at_next, 0.0, np.where(middle < 0, upper - d, half))
    x = (low + high) / 2
    left = np.tril(np.ones((n, n)))
    near, far = shifted[np.arange(n), np.arange(n)], shifted[np.arange(n), np.minimum(np.arange(n) + 1, n - 1)]
    far = np.where(np.arange(n) < n - 1, far, np.inf)
    open_ = np.arange(n)
    for _ in range(_STEPS):
        every = len(open_) == n
        gap = (shifted if every else shifted[open_]) - x[open_, None]
        share = weight / gap
        slope = share / gap
        value = 1 + share.sum(axis=1)
        below = np.einsum("ij,ij->i", slope, left if every else left[open_])
        above = slope.sum(axis=1) - below
        low[open_] = np.where(value < 0, x[open_], low[open_])
        high[open_] = np.where(value < 0, high[open_], x[open_])
        # one term for the poles on either side, matched in value and slope
        a, b = near[open_] - x[open_], np.where(np.isinf(far[open_]), 0.0, far[open_] - x[open_])
        p, q = a * a * below, b * b * above
        c = value - a * below - b * above
        mid = c * (a + b) + p + q
        end = a * b * value
        root = np.sqrt(np.maximum(mid * mid - 4 * c * end, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(mid > 0, 2 * end / (mid + root), (mid - root) / (2 * c))
            step = np.where(np.isinf(far[open_]), a * value / c, step)
        new = x[open_] + step
        good = np.isfinite(new) & (new > low[open_]) & (new < high[open_])
        new = np.where(good, new, (low[open_] + high[open_]) / 2)
        done = (np.abs(new - x[open_]) <= 2 * _EPS * np.abs(new)) | (np.abs(value) <= 4 * _EPS * np.abs(share).sum(axis=1))
        x[open_] = np.where(done & ~good, x[open_], new)
        open_ = open_[~done]
        if not len(open_):
            break
    return pole, x


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis @ diag(values) @ basis.T + rho * vector vector^T``
    (columns of ``basis`` by rising value, ``rho`` >= 0)."""
    z = vector @ basis
    length = float(np.sqrt(z @ z))
    if not length or rho <= 0:
        return values, basis
    z, rho = z / length, rho * length * length
    scale = max(float(np.abs(values[-1])), rho)
    small = 8 * _EPS * scale
    basis, values = basis.copy(), values.copy()
    last, shares = -1, np.flatnonzero(rho * np.abs(z) > small)
    for i in shares.tolist() if (np.diff(values[shares]) <= small).any() else []:
        if last >= 0 and values[i] - values[last] <= small:
            # equal eigenvalues: turn their plane until the second holds both shares
            r = float(np.hypot(z[last], z[i]))
            c, s = z[i] / r, z[last] / r
            basis[:, [last, i]] = basis[:, [last, i]] @ np.array([[c, s], [-s, c]])
            z[last], z[i] = 0.0, r
        last = i
    live = np.flatnonzero(rho * np.abs(z) > small)
    if len(live):
        d, own = values[live], z[live]
        pole, x = secular_roots(d, own, rho)
        roots_less = (d[pole][:, None] - d[None, :]) + x[:, None]  # root j less pole i
        poles_less = d[:, None] - d[None, :]
        ratio = np.ones_like(poles_less)
        np.divide(roots_less, poles_less, out=ratio, where=poles_less != 0)
        exact = np.sign(own) * np.sqrt(np.abs(np.diagonal(roots_less) * ratio.prod(axis=0)))
        turn = exact[:, None] / -roots_less.T
        turn /= np.linalg.norm(turn, axis=0)
        values[live], basis[:, live] = d[pole] + x, basis[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number, mean and scatter eigenpairs of vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.basis = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, vector: np.ndarray) -> None:
        gap = vector - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, gap, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + gap / self.n

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values.tolist(), other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, value)
        total, gap = self.n + other.n, other.mean - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, gap, self.n * other.n / total)
        self.mean, self.n = self.mean + gap * (other.n / total), total

    def row(self) -> dict:
        return {"n": self.n, "mean": self.mean, "values": self.values, "basis": self.basis.ravel()}

    @staticmethod
    def of(row) -> Spectrum:
        own = Spectrum(len(row["mean"]))
        own.n, own.mean, own.values = int(row["n"]), np.array(row["mean"], np.float64), np.array(row["values"], np.float64)
        own.basis = np.array(row["basis"], np.float64).reshape(len(own.mean), len(own.mean))
        return own


_SPECTRUM = "part int, n long, mean array<double>, values array<double>, basis array<double>"


def _combined(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("part").to_dict("records")
    total = Spectrum.of(rows[0])
    for row in rows[1:]:
        total.join(Spectrum.of(row))
    return pd.DataFrame([{"part": int(rows[0]["part"]) // FAN_IN, **total.row()}])


def spectrum(fit: DataFrame, dim: int) -> Spectrum:
    """The spectrum of ``fit(x)``: one update a vector in every task, then
    groups of ``FAN_IN`` spectra until one is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = Spectrum(dim), 0
        for batch in batches:
            for row, number in zip(unpacked(batch.column(0), dim).astype(np.float64), batch.column(1).to_pylist(), strict=True):
                own.add(row)
                part = number
        if own.n:
            yield pa.RecordBatch.from_pylist([{"part": part, **own.row()}], pa.schema([("part", pa.int32()), ("n", pa.int64()), *((k, pa.list_(pa.float64())) for k in ("mean", "values", "basis"))]))

    found, left = fit.select("x", F.spark_partition_id().alias("part")).mapInArrow(run, _SPECTRUM), fit.rdd.getNumPartitions()
    while left > 1:
        found, left = found.groupBy((F.col("part") / FAN_IN).cast("int").alias("group")).applyInPandas(_combined, _SPECTRUM), -(-left // FAN_IN)
    rows = found.collect()
    return Spectrum.of(rows[0].asDict()) if rows else Spectrum(dim)


def _added(fit: DataFrame, run, size: int) -> np.ndarray:
    """The sum over all tasks of the array that ``run`` gives for each."""
    rows = fit.mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.pos] = r.v
    return out


def projected_covariance(fit: DataFrame, n: int, total: np.ndarray, basis: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the vectors of ``fit(x)`` along the columns of ``basis``,
    centred exactly before anything is multiplied; each column over ``scale``."""
    dim, k = basis.shape
    shared = fit.sparkSession.sparkContext.broadcast((n, total, basis if scale is None else basis / scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, turn = shared.value
        own = np.zeros((k, k))
        for batch in gathered(batches):
            y = centred(unpacked(batch.column(0), dim), count, sums) @ turn
            own += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([(own / count).ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    return _added(fit.select("x"), run, k * k).reshape(k, k)


def _times_n_less_sum(rows: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: Python's whole numbers where 64 bits do not do."""
    most = max(float(np.abs(rows).max(initial=0)), 1.0) * n + max(map(abs, total.tolist()), default=0)
    return rows * n - total.astype(np.int64) if most < 2.0 ** 62 else rows.astype(object) * n - total


def centred(rows: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return _times_n_less_sum(rows, n, total).astype(np.float64) / n


def deviations(rows: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """Sum over the components of ``(n * x - S)^2``, exact."""
    gap = _times_n_less_sum(rows, n, total)
    if gap.dtype != object and float(np.abs(gap).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 2.0 ** 62:
        return (gap * gap).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in gap.tolist()]


def _sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(number of vectors, exact sum of each component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in gathered(batches):
            rows = unpacked(batch.column(0), dim)
            n += len(rows)
            wide = float(np.abs(rows).max(initial=0)) * len(rows) >= 2.0 ** 62
            total = [a + b for a, b in zip(total, (rows.astype(object) if wide else rows).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "v"])

    found = durable(fit.select("x").mapInArrow(run, "n long, v array<string>"))
    n = found.agg(F.sum("n")).first()[0] or 0
    rows = found.select(F.posexplode("v")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("v")).collect()
    total = np.array([0] * dim, object)
    for r in rows:
        total[r.pos] = int(r.v)
    return n, total


def _is_whole(column: str) -> Column:
    return F.expr(f"{column} is not null and forall({column}, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")


def _whole_numbers(vectors: DataFrame, dim: int, *names: str) -> DataFrame:
    """The named columns and ``x``, the whole numbers less :data:`SHIFT`, of
    the rows whose vector is finite."""
    schema = ", ".join([*(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names), "x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            at, matrix = finite(batch.column(len(names)))
            if not len(at):
                continue
            if matrix.shape[1] != dim:
                raise ValueError("vectors of different lengths")
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns[:-1], packed(floors(matrix, 64))], [*names, "x"])

    return vectors.select(*names, "embedding").mapInArrow(run, schema)


def components(fit: DataFrame, n: int, total: np.ndarray, dim: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of the covariance of ``fit(x)``, falling; unit
    eigenvectors as columns)."""
    basis = spectrum(fit, dim).basis[:, ::-1]
    values = np.zeros(dim)
    for _ in range(steps):
        basis, _ = np.linalg.qr(basis)
        values, turn = np.linalg.eigh(projected_covariance(fit, n, total, basis))
        values, basis = values[::-1], basis @ turn[:, ::-1]
    return np.maximum(values, 0.0), basis


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``vec_id, component, n,
    deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are dropped;
    entries become ``floor(64 * c) + 1000000``. The covariance is that of the
    distinct vectors. One row comes for each remaining row, also where ids or
    vectors repeat, and component up to ``most`` (fewer in shorter vectors).
    Along a component without variance (all vectors equal, or fewer of them
    than components) ``whitened`` is null, and it does not count for
    ``identity_error``. No remaining row gives no rows. Other columns are not
    read. Vectors of different lengths and a ``deviation`` beyond 64 bits
    raise."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    one = vectors.where(_is_whole("embedding")).select(F.size("embedding")).first()
    if one is None:
        return spark.createDataFrame([], result)
    dim = one[0]
    fit = durable(_whole_numbers(vectors, dim).distinct())
    n, total = _sums(fit, dim)
    values, basis = components(fit, n, total, dim)
    k = min(most, dim)
    trace = float(values.sum())
    live = values[:k] > max(trace, 1e-300) * 1e-13
    scale = np.sqrt(np.where(live, values[:k], 1.0))
    own = projected_covariance(fit, n, total, basis[:, :k][:, live], scale[live])
    error = float(np.abs(own - np.eye(len(own))).max(initial=0.0))
    explained = [float(v / trace) if trace else 0.0 for v in values[:k]]
    shared = spark.sparkContext.broadcast((total, basis[:, :k] / scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, turn = shared.value
        for batch in gathered(batches):
            rows = unpacked(batch.column(1), dim)
            white = centred(rows, n, sums) @ turn
            count = len(rows)
            at = pa.array(np.repeat(np.arange(count), k))
            empty = np.tile(~live, count)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()), pa.array(np.full(count * k, n), pa.int64()),
                pa.array(deviations(rows, n, sums), pa.int64()).take(at), pa.array(white.ravel(), pa.float64(), mask=empty), pa.array(np.tile(explained, count), pa.float64()),
                pa.array(np.full(count * k, error), pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _whole_numbers(vectors, dim, "vec_id").mapInArrow(run, result)
