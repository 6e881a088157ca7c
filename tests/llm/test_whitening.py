"""Whitening against a brute-force version in whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lexspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """n, S, exact covariance (Fractions) and exact deviations of the rows that take part."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, wide = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(wide)]
    v = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(wide)] for i in range(wide)]
    return n, x, s, v, [sum((n * r[i] - s[i]) ** 2 for i in range(wide)) for r in x]


@pytest.mark.parametrize("spread", [0.05, 3.0, 1e9])
def test_whitening(spark, spread):
    r = np.random.default_rng(5)
    x = (r.normal(size=(400, 10)) @ r.normal(size=(10, 10)) * spread + 0.3).tolist()
    rows = [(2**60 + i, v) for i, v in enumerate(x)] + [(None, x[0]), (7, x[1])]
    odd = [(1, None), (2, []), (3, [1.0, None] + [0.0] * 8), (4, [float("nan")] * 10), (5, [float("-inf")] * 10), (6, [1e300] * 10), (8, [1.0] * 9)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS x", "2 AS z", "3 AS deviation").repartition(3)
    got = whitening.whiten(docs).collect()
    n, ints, s, v, deviations = brute(rows)
    trace = sum(v[i][i] for i in range(10))
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    assert len(got) == 8 * len(rows) and {g["n"] for g in got} == {n}
    by = {(g["vec_id"], g["component"]): g for g in got}
    z = np.array([[by[i, c]["whitened"] for c in range(1, 9)] for i, _ in rows])
    for k in range(8):
        e, u = values[-1 - k], vectors[:, -1 - k]
        want = np.array([float(sum(Fraction(n * c - t, n) * Fraction(float(w)) for c, t, w in zip(row, s, u))) for row in ints]) / np.sqrt(e)
        assert min(abs(z[:, k] - want).max(), abs(z[:, k] + want).max()) < 1e-6 * abs(want).max()
        assert abs(by[rows[0][0], k + 1]["explained"] - e / float(trace)) < 1e-9
    assert [int(by[i, 1]["deviation"]) for i, _ in rows] == deviations
    error = abs(np.cov(z.T, bias=True) - np.eye(8)).max()
    assert got[0]["identity_error"] < 1e-6 and error < 1e-6 and len({g["identity_error"] for g in got}) == 1


def test_totals_are_exact():
    """Integers of any size, in blocks and limbs, against Python's own."""
    r = np.random.default_rng(6)
    for most in (5, 1 << 20, 1 << 21, 1 << 45, 1 << 62):
        y = r.integers(-most, most + 1, (5000, 3))
        y[0] = (-most, most, 0)
        one, two = whitening.Scatter(3), whitening.Scatter(3)
        one.add(y[:4500])
        two.add(y[4500:])
        n, total, products = whitening.add_up([*one.rows(), *two.rows()], 3)
        big = y.astype(object)
        assert n == 5000 and (total == big.sum(0)).all() and (products == big.T @ big).all()


def test_whitening_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], SCHEMA)).collect()
    assert {g["component"] for g in flat} == {1} and abs(sum(g["whitened"] ** 2 for g in flat) / 9 - 1) < 1e-9 and flat[0]["explained"] == pytest.approx(1)
