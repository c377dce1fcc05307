"""Whitening of integer vectors by their leading principal components.

Every different vector counts once. Tasks sum up vectors, then products of centred
vectors; only the sums, one matrix of the number of dimensions squared, meet on the
driver. There Householder reflections turn the covariance into a tridiagonal matrix;
bisection on Sturm counts finds its leading eigenvalues, and inverse iteration their
vectors, with those of one cluster kept orthogonal to each other. The components, a few
rows of numbers, go to all tasks, which project every vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filltape.llm.common import stored

#: Vectors of more dimensions are refused: the driver holds their square in numbers.
MAX_DIMS = 4_096
#: Eigenvalues below this share of the largest are noise of its rounding.
NOISE = 1e-10
#: Entries from here on are taken as not finite: they would leave the range of a long.
_LIMIT = float(1 << 52)
_EPS = np.finfo(float).eps
_SEED = 7


class Model(NamedTuple):
    """What tasks need to project a vector."""

    n: int
    #: Whole numbers near the mean, and n times the mean's distance from them.
    centre: np.ndarray
    rest: list[int]
    #: One row per component, and its eigenvalue.
    components: np.ndarray
    values: np.ndarray
    trace: float


def quantised(vector: Column, scale: int, shift: int) -> Column:
    """``floor(scale * entry) + shift`` of every entry as long.

    Null for a vector that is null or has an entry that is null, not finite or too large.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.forall(
        scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_LIMIT))
    )
    whole = F.transform(scaled, lambda x: F.floor(x) + F.lit(shift))
    return F.when(vector.isNotNull() & sound, whole)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that lead there."""
    a, mirrors = matrix.astype(float).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        v[0] += length if v[0] >= 0 else -length
        size = np.sqrt(v @ v)
        if size:
            v /= size
            p = 2 * (a[k + 1 :, k + 1 :] @ v)
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
            column = a[k + 1 :, k]
            a[k + 1 :, k] = column - 2 * (v @ column) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative terms of a Sturm sequence."""
    tiny = np.finfo(float).tiny / _EPS
    count = np.zeros(len(points), int)
    q = np.ones(len(points))
    # A term near zero makes the next one very large, which is what it should be.
    with np.errstate(over="ignore"):
        for i, own in enumerate(diagonal):
            q = own - points - (off[i - 1] ** 2 / q if i else 0)
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each to the last digits."""
    radius = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    spread = 4 * _EPS * max(np.abs(diagonal).max() + radius.max(), np.finfo(float).tiny)
    low = np.full(k, (diagonal - radius).min() - spread)
    high = np.full(k, (diagonal + radius).max() + spread)
    wanted = len(diagonal) - np.arange(k)
    for _ in range(128):
        middle = (low + high) / 2
        # The j-th largest lies below a point that has more than d - j of them below it.
        under = below(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
        if (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))).all():
            break
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, norm: float):
    """Solves ``(T - value) x = b`` by elimination with row exchange."""
    size = len(diagonal)
    d, u, l = (diagonal - value).tolist(), [*off.tolist(), 0.0], [*off.tolist(), 0.0]
    second, factors, swapped = [0.0] * size, [0.0] * size, [False] * size
    for i in range(size - 1):
        if abs(d[i]) < abs(l[i]):
            swapped[i] = True
            d[i], l[i] = l[i], d[i]
            u[i], d[i + 1] = d[i + 1], u[i]
            second[i], u[i + 1] = u[i + 1], 0.0
        factors[i] = l[i] / d[i] if d[i] else 0.0
        d[i + 1] -= factors[i] * u[i]
        u[i + 1] -= factors[i] * second[i]
    small = _EPS * norm or np.finfo(float).tiny
    d = [x if abs(x) > small else small for x in d]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in reversed(range(size)):
            if i + 1 < size:
                x[i] -= u[i] * x[i + 1]
            if i + 2 < size:
                x[i] -= second[i] * x[i + 2]
            x[i] /= d[i]
        x = np.array(x)
        return x / np.abs(x).max()

    return solve


def vectors_of(
    diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, mirrors: list[np.ndarray]
) -> np.ndarray:
    """Unit eigenvectors of the full matrix, one row for each of its falling ``values``."""
    size, rng = len(diagonal), np.random.default_rng(_SEED)
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if len(off) else 0))
    found, cluster, last = [], 0, np.inf
    for number, value in enumerate(values):
        if last - value > 1e-3 * norm:
            cluster = number
        # Values that agree to the last digits would give the same vector again.
        own = min(value, last - 10 * _EPS * norm) if number > cluster else value
        last, solve = own, _solver(diagonal, off, own, norm)
        x = rng.uniform(-1, 1, size)
        for _ in range(5):
            x = solve(x)
            for _ in range(2):
                for other in found[cluster:]:
                    x = x - (other @ x) * other
            x /= np.sqrt(x @ x)
        found.append(x)
    turned = np.array(found).reshape(len(values), size)
    for k in reversed(range(len(mirrors))):
        v = mirrors[k]
        turned[:, k + 1 :] -= 2 * np.outer(turned[:, k + 1 :] @ v, v)
    # Either sign is right; this one does not depend on rounding of small entries.
    largest = np.abs(turned).argmax(1)
    return turned * np.sign(turned[np.arange(len(turned)), largest])[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _total(
    rows: DataFrame, dims: int, width: int, part: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum over all vectors of ``part``, a matrix of ``width`` columns per batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), dims))
                total = own if total is None else total + own
        if total is not None:
            place = np.arange(len(total))
            values = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width)
            values = values.cast(pa.list_(pa.from_numpy_dtype(total.dtype)))
            yield pa.RecordBatch.from_arrays([pa.array(place), values], names=["i", "values"])

    kind = "bigint" if part is _halves else "double"
    parts = rows.select("x").mapInArrow(sums, f"i long, values array<{kind}>")
    cells = parts.select("i", F.posexplode("values").alias("j", "value"))
    cells = cells.groupBy("i", "j").agg(F.sum("value").alias("value"))
    lines = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("line"))
    found = lines.select("i", F.col("line.value").alias("line")).collect()
    found.sort(key=lambda row: row["i"])
    return np.array([row["line"] for row in found])


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and lower halves of whole numbers, which cannot overflow."""
    low = (x & 0xFFFFFFFF).sum(0)
    return np.stack([(x >> 32).sum(0), low, np.full(x.shape[1], len(x))])


def fit(rows: DataFrame, dims: int, k: int) -> Model:
    """The model of the different vectors ``x`` (longs, ``dims`` each), one row or more."""
    high, low, count = (line.tolist() for line in _total(rows, dims, dims, _halves))
    n = count[0]
    sums = [(h << 32) + l for h, l in zip(high, low, strict=True)]
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    whole, offset = np.array(centre), np.array(rest) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = (x - whole) - offset
        return z.T @ z

    covariance = _total(rows, dims, dims, products) / n
    covariance = (covariance + covariance.T) / 2
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading(diagonal, off, min(k, dims))
    values = values[values > max(NOISE * values[0], 0)]
    components = vectors_of(diagonal, off, values, mirrors)
    return Model(n, whole, rest, components, values, float(np.trace(covariance)))


def _projected(model: Model, x: np.ndarray) -> np.ndarray:
    z = (x - model.centre) - np.array(model.rest) / model.n
    return (z @ model.components.T) / np.sqrt(model.values)


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S) ** 2 of each row, exact; null where a long cannot hold it."""
    away, rest = x - model.centre, np.array(model.rest, object)
    largest = float(np.abs(away).max(initial=0)) * model.n + float(max(model.rest, default=0))
    if largest**2 * x.shape[1] < 2.0**62:
        away = model.n * away - np.array(model.rest, np.int64)
        return (away * away).sum(1).tolist()
    exact = [sum(t * t for t in line) for line in (away.astype(object) * model.n - rest).tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(
    rows: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "x"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    One row for every vector of longs and each of the ``k`` leading components, counted
    from 1. ``n`` is the number of different vectors, ``deviation`` a vector's exact sum of
    squares of n times its distance to their mean, ``whitened`` its distance to the mean
    along the component in units of the root of its eigenvalue, ``explained`` the
    eigenvalue's share of the total variance, and ``identity_error`` the largest absolute
    difference of the whitened different vectors' covariance to the identity.

    Defined results: null and empty vectors and those of another length than the commonest
    (of equally common ones the shorter) take no part; rows with equal ids or vectors are
    judged one by one; a null id stays; components without variance are left out, so there
    are fewer than ``k`` for few dimensions or dependent ones, and no rows if all vectors
    are equal or there are none; a deviation beyond a long is null; other columns are
    ignored, whatever they are called.
    """
    spark = rows.sparkSession
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    given = given.filter(F.size("x") > 0)
    sizes = given.groupBy(F.size("x").alias("dims")).count()
    common = sizes.orderBy(F.desc("count"), "dims").limit(1).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of more than {MAX_DIMS} dimensions")
    given = given.filter(F.size("x") == dims)
    different = stored(given.select("x").distinct(), "different")
    model = fit(different, dims, k)
    found = len(model.values)
    if not found:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)

    def squares(x: np.ndarray) -> np.ndarray:
        w = _projected(sent.value, x)
        return w.T @ w

    covariance = _total(different, dims, found, squares) / model.n
    error = float(np.abs(covariance - np.eye(found)).max())
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, count = _matrix(batch.column("x"), dims), batch.num_rows
            whitened = _projected(sent.value, x)
            deviation = pa.array(_deviations(sent.value, x), pa.int64())
            every = np.repeat(np.arange(count), found)
            columns = [
                batch.column("vec_id").take(pa.array(every)),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), count)),
                pa.array(np.full(count * found, sent.value.n)),
                deviation.take(pa.array(every)),
                pa.array(whitened.ravel()),
                pa.array(np.tile(explained, count)),
                pa.array(np.full(count * found, error)),
            ]
            names = "vec_id component n deviation whitened explained identity_error".split()
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(project, schema)
