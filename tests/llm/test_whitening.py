"""Whitening against exact sums and a library's eigenvectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from filltape.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def matrices() -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    known = [
        np.diag(np.arange(1.0, 9)),
        np.eye(7),
        np.diag([5.0, 5, 5, 1, 1, 0]),
        turn @ np.diag([9, 9, 9, 9 - 1e-13, 9 - 1e-9, *[3] * 10, *np.linspace(2, 1, 15)]) @ turn.T,
        np.array([[4.0]]),
        np.array([[2.0, 1], [1, 2]]),
        np.ones((6, 6)),
    ]
    random = [rng.normal(size=(d, 2 * d)) for d in (3, 16, 64, 120)]
    return known + [m @ m.T for m in random] + [1e-12 * turn @ turn.T, 1e12 * np.diag([1.0, 1e-8])]


@pytest.mark.parametrize("matrix", matrices())
def test_leading_eigenvectors(matrix):
    matrix = (matrix + matrix.T) / 2
    diagonal, off, mirrors = whitening.tridiagonal(matrix)
    k = min(16, len(matrix))
    values = whitening.leading(diagonal, off, k)
    want = np.linalg.eigvalsh(matrix)[::-1][:k]
    scale = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-13 * scale * len(matrix)
    rows = whitening.vectors_of(diagonal, off, values, mirrors)
    assert np.abs(rows @ rows.T - np.eye(k)).max() <= 1e-12
    assert np.abs(rows @ matrix - values[:, None] * rows).max() <= 1e-12 * scale * len(matrix)


def brute(x: np.ndarray, k: int = 16):
    """Of distinct rows: n, exact deviations of all rows, projections, shares."""
    different = np.unique(x, axis=0)
    n, sums = len(different), [int(s) for s in different.sum(0)]
    z = different - different.sum(0) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    kept = values > whitening.NOISE * values[0]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    whitened = ((x - different.sum(0) / n) @ vectors / np.sqrt(np.where(kept, values, 1)))[:, kept]
    return n, deviation, whitened, values[kept] / np.trace(z.T @ z / n)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([np.floor(64 * np.array(r["embedding"], float)) + 1_000_000 for r in rows])
    n, deviation, whitened, explained = brute(x.astype(np.int64))
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    mine = np.zeros_like(whitened)
    for r in got:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert r["identity_error"] < 1e-9
        mine[i, c] = r["whitened"]
    signs = np.sign((mine * whitened).sum(0))
    assert np.abs(mine - signs * whitened).max() < 1e-8


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    # Two dimensions are copies of others, so three components have variance.
    base = rng.integers(-500, 500, (40, 3))
    x = np.concatenate([base, base[:, :2]], 1) / 64
    inf, nan = float("inf"), float("nan")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5, x[5].tolist()), (6, x[9].tolist()), (None, x[0].tolist())]
    bad = [None, [], [None] * 5, [nan] * 5, [1.0, inf, 1.0, 1.0, 1.0], [1e300] * 5, [1.0, 2.0]]
    rows += [(100 + i, v) for i, v in enumerate(bad)]
    schema = "vec_id long, embedding array<double>, n string, component string, x int"
    frame = spark.createDataFrame([(*r, "n", "c", 1) for r in rows], schema)
    vectors = frame.withColumn("x", whitening.quantised(F.col("embedding"), 64, 10))
    got = whitening.whiten(vectors).collect()
    given = np.array([v for _, v in rows[:43]])
    n, deviation, whitened, explained = brute(np.floor(64 * given).astype(np.int64) + 10)
    assert n == 40 and whitened.shape[1] == 3 and len(got) == 3 * 43
    mine = sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 3)
    assert mine == sorted((str(rows[i][0]), deviation[i]) for i in range(43))
    assert {r["component"] for r in got} == {1, 2, 3}
    shares = {r["component"]: r["explained"] for r in got}
    assert [shares[c] for c in (1, 2, 3)] == pytest.approx(list(explained))
    assert max(r["identity_error"] for r in got) < 1e-9
    first = {r["vec_id"]: r["whitened"] for r in got if r["component"] == 1}
    assert first[None] == first[0]

    same = vectors.filter("vec_id = 0")
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(vectors.filter("false")).collect() == []
    assert whitening.whiten(vectors.filter("vec_id >= 100 and size(embedding) <> 2")).collect() == []


def test_deviations_beyond_a_long(spark):
    rows = [(0, [0, 5]), (1, [1 << 50, 5]), (2, [1, 6])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, x array<bigint>")).collect()
    n, deviation, _, _ = brute(np.array([r[1] for r in rows], object).astype(np.int64))
    assert {r["vec_id"]: r["deviation"] for r in got} == {
        i: d if d < 1 << 63 else None for i, d in enumerate(deviation)
    }
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1] * 5000)], "vec_id long, x array<bigint>"))
