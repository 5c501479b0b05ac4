"""Embedding whitening: principal components of integer-scaled vectors, unit variance each.

Vectors are scaled to whole numbers, so that equal vectors, counts and sums are exact. The
covariance is added up where the rows lie: each task centres its rows before it multiplies
them and hands over one triangle of d x d numbers. The driver holds that triangle alone. It
brings it to tridiagonal form by Householder reflections, finds the leading eigenvalues by
bisection on Sturm counts and their vectors by inverse iteration, with the vectors of close
eigenvalues made orthogonal to each other. The components go to the tasks as a broadcast of
d x k numbers, and every row is projected where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm.common import ship
from leadtide.workspace import store

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries stop here: beyond it a double no longer tells whole numbers apart.
LIMIT = 1 << 53
EPS = np.finfo(np.float64).eps
WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Fit:
    """``n`` different vectors with per-dimension sums ``n * whole + rest``, and the leading
    ``components`` (a column each) with ``values``, their share of the trace, and how far the
    covariance of the whitened fit list is from the identity."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` minus the mean; the whole part of the mean is taken off exactly."""
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of ``(n x - S)^2``, exact; null beyond 38 digits."""
        off = x - self.whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return pa.array(((off * self.n - self.rest) ** 2).sum(1)).cast(WIDE)
        wide = off.astype(object) * self.n - self.rest.astype(object)
        sums = [int(s) for s in (wide * wide).sum(1)]
        return pa.array([s if s < 10**38 else None for s in sums], WIDE)


def scaled(vectors: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns) and ``x``, the scaled vector, of the usable vectors."""
    entries = F.col(vector)
    usable = entries.isNotNull() & F.forall(
        entries, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    )
    x = F.transform(
        entries,
        lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
        .cast("bigint")
        + SHIFT,
    )
    return vectors.filter(usable).select(F.struct(*[vectors[c] for c in keep]).alias("row"), x.alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _sums(dim: int):
    def run(batches):
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield _batch(["i", "high", "low"], np.arange(dim, dtype=np.int32), high, low)

    return run


def _products(dim: int, width: int, centre):
    """The upper triangle of the products of centred rows, and their sums at ``j = width``."""
    i, j = np.triu_indices(width)

    def run(batches):
        total, mean = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            z = centre(_matrix(batch.column(0), dim))
            total += z.T @ z
            mean += z.sum(0)
        yield _batch(
            ["i", "j", "v"],
            np.concatenate([i, np.arange(width)]).astype(np.int32),
            np.concatenate([j, np.full(width, width)]).astype(np.int32),
            np.concatenate([total[i, j], mean]),
        )

    return run


def _covariance(fit_list: DataFrame, dim: int, width: int, n: int, centre) -> tuple[np.ndarray, np.ndarray]:
    """Covariance with divisor ``n`` of the rows given by ``centre``, and their mean: at most
    ``width`` x ``width`` numbers reach the driver."""
    parts = fit_list.select("x").mapInArrow(_products(dim, width, centre), "i int, j int, v double")
    out, mean = np.zeros((width, width)), np.zeros(width)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        if j == width:
            mean[i] = v / n
        else:
            out[i, j] = out[j, i] = v / n
    return out, mean


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of ``H a H`` and the unit vectors of the reflections in ``H``.

    Reflection ``k`` acts on the entries after ``k`` and clears column ``k`` below the
    off-diagonal.
    """
    a = a.copy()
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        v[0] += np.copysign(size, v[0])
        length = np.linalg.norm(v)
        if length == 0:
            mirrors.append(np.zeros(d - k - 1))
            continue
        v /= length
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number of ``at``, how many eigenvalues lie below it."""
    tiny = max(np.finfo(np.float64).tiny, EPS * EPS * np.abs(diagonal).max(initial=0))
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[k] - at - off[k - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection."""
    d = len(diagonal)
    side = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - side).min()), np.full(k, (diagonal + side).max())
    slack = EPS * max(abs(low[0]), abs(high[0])) + np.finfo(np.float64).tiny
    low, high = low - slack, high + slack
    above = np.arange(k)  # so many eigenvalues are larger
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high) & (high - low > slack / 4)
        if not open_.any():
            return middle
        under = d - sturm_counts(diagonal, off, middle) <= above
        high = np.where(open_ & under, middle, high)
        low = np.where(open_ & ~under, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of the shifted tridiagonal system, rows exchanged for the larger pivot."""
    d = len(diagonal)
    main, up, up2, y = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d, right.tolist()
    for i in range(d - 1):
        below = float(off[i])
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], up[i], main[i + 1], above = below, main[i + 1], up[i] - factor * main[i + 1], up[i + 1]
            up2[i], up[i + 1] = above, -factor * above
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = below / main[i]
            main[i + 1] -= factor * up[i]
            y[i + 1] -= factor * y[i]
    for i in range(d - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = tiny
        value = y[i]
        if i + 1 < d:
            value -= up[i] * y[i + 1]
        if i + 2 < d:
            value -= up2[i] * y[i + 2]
        y[i] = value / main[i]
    y = np.array(y)
    return y / max(np.abs(y).max(), np.finfo(np.float64).tiny)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, a column each, by inverse iteration.

    Values closer than a thousandth of the matrix are one cluster, whose vectors are made
    orthogonal to each other in every step.
    """
    d = len(diagonal)
    side = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    norm = (np.abs(diagonal) + side).max(initial=0)
    tiny = max(EPS * norm, np.finfo(np.float64).tiny)
    rng = np.random.default_rng(12)
    found, start = np.zeros((d, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        v = rng.uniform(-1, 1, d)
        good = 0
        for _ in range(12):
            v = _solve(diagonal, off, value, v, tiny)
            for _ in range(2):
                v -= found[:, start:k] @ (found[:, start:k].T @ v)
            v /= np.linalg.norm(v)
            left = (diagonal - value) * v
            left[:-1] += off * v[1:]
            left[1:] += off * v[:-1]
            good += np.linalg.norm(left) <= 4 * d * tiny
            if good == 2:
                break
        found[:, k] = v
    return found


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are not zero within rounding, falling, with unit
    eigenvectors, a column each; the largest entry of a vector is positive."""
    k = min(k, len(covariance))
    if k == 0 or not np.trace(covariance) > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading_values(diagonal, off, k)
    values = values[values > len(covariance) * EPS * values[0]]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit on each different ``x`` of ``rows`` once; None without rows.

    Vectors of the most frequent length count (of equally frequent ones, the longest).
    """
    spark = rows.sparkSession
    ship(spark)
    lengths = rows.select("x").distinct().withColumn("dim", F.size("x"))
    fit_list = store(lengths, "whitening")
    most = fit_list.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None or most["dim"] == 0:
        return None
    dim, n = most["dim"], most["n"]
    fit_list = fit_list.filter(F.col("dim") == dim)
    parts = fit_list.select("x").mapInArrow(_sums(dim), "i int, high bigint, low bigint")
    sums = [0] * dim
    wide = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]
    for i, high, low in parts.groupBy("i").agg(*wide).collect():
        sums[i] = (int(high) << 32) + int(low)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    blank = Fit(n, whole, rest, np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    covariance, mean = _covariance(fit_list, dim, dim, n, blank.centred)
    covariance -= np.outer(mean, mean)
    values, vectors = leading_components(covariance, components)
    if not len(values):
        return blank
    found = Fit(n, whole, rest, values, vectors, values / np.trace(covariance))
    middle = mean @ (vectors / np.sqrt(values))
    check, mean = _covariance(fit_list, dim, len(values), n, lambda x: found.whitened(x) - middle)
    check -= np.outer(mean, mean)
    error = float(np.abs(check - np.eye(len(values))).max())
    return Fit(n, whole, rest, values, vectors, found.explained, error)


def _project(model, dim: int, row_type: pa.DataType | None = None):
    def run(batches):
        fitted = model.value
        k = len(fitted.values)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, fitted.n)),
                    fitted.deviation(x).take(pa.array(each)),
                    pa.array(fitted.whitened(x).ravel()),
                    pa.array(np.tile(fitted.explained, len(x))),
                    pa.array(np.full(len(x) * k, fitted.identity_error)),
                ],
                names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    vectors: DataFrame, keep: list[str], vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and component.

    Columns: ``row`` (a struct of the columns ``keep``, so that their names clash with
    nothing), ``component`` from 1 by falling eigenvalue, ``n``, ``deviation`` (whole number,
    see ``Fit.deviation``), ``whitened``, ``explained``, ``identity_error``.

    * Null vectors and vectors with a null or non-finite entry give no row. Nor do vectors of
      another length than the most frequent one: they lie in no common space.
    * Entries are scaled by 64, rounded down and shifted by a million; beyond 2^53 they stop.
    * Equal vectors are fitted once and projected each; a repeated row gives repeated rows.
    * Components without variance (an eigenvalue that is zero within rounding) are left out,
      so a table with a single different vector, or none, gives no row.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, vector, keep)
    fitted = fit(rows, components)
    row_type = rows.schema["row"].dataType.simpleString()
    schema = (
        f"row {row_type}, component int, n bigint, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    model, dim = spark.sparkContext.broadcast(fitted), len(fitted.whole)
    return rows.filter(F.size("x") == dim).mapInArrow(_project(model, dim), schema)
