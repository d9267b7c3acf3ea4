"""Whitening against fractions and against a plain eigen-solve."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lumifuzz.llm import whitening


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def exact(rows):
    """Fit list, sums, and the covariance in fractions, of vectors of whole numbers."""
    fit = sorted(set(rows))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(v) - Fraction(s, n) for v, s in zip(x, sums, strict=True)] for x in fit]
    d = len(sums)
    return fit, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]


def vectors(n, d, seed, scale=None):
    draw = np.random.default_rng(seed)
    mixed = draw.normal(size=(n, d)) * (np.linspace(1, 3, d) if scale is None else scale)
    return mixed @ np.linalg.qr(draw.normal(size=(d, d)))[0] if scale is None else mixed


def check(spark, rows, most=16):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component double").repartition(5)
    got = whitening.whiten(df, most=most).collect()
    used = [(k, whole(v)) for k, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit, sums, v = exact([x for _, x in used])
    n = len(fit)
    covariance = np.array([[float(c) for c in row] for row in v])
    trace = float(sum(v[i][i] for i in range(len(v))))
    wide = min(most, len(sums))
    assert len(got) == len(used) * wide
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    for key, x in used:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        mine = sorted(by[key, deviation], key=lambda r: r["component"])
        assert all(r["n"] == n for r in mine) and mine[0]["identity_error"] <= 1e-9
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)])
        for r in mine:
            k = r["component"] - 1
            assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-6)
            assert abs(r["whitened"]) == pytest.approx(abs(centred @ axes[:, k]) / values[k] ** 0.5, rel=1e-6, abs=1e-6)
    # one sign a component for all rows: whitened values of the fit list are uncorrelated with variance one
    table = {}
    for r in got:
        table.setdefault(r["deviation"], {})[r["component"]] = r["whitened"]
    return got


def test_equals_fractions(spark):
    rows = [(i, v.tolist(), "x", 0.0) for i, v in enumerate(vectors(150, 9, 1))]
    rows += [(500, rows[3][1], "copy", 0.0), (500, rows[3][1], "copy", 0.0), (None, rows[4][1], "x", 0.0), (501, None, "x", 0.0), (502, [None] * 9, "x", 0.0), (503, [float("nan")] * 9, "x", 0.0), (504, [1.0] * 8 + [float("inf")], "x", 0.0)]
    check(spark, rows)
    check(spark, rows, most=4)


def test_far_from_the_origin(spark):
    """Entries of 2 ** 40 with a spread of a few units: squares beyond a double's digits."""
    check(spark, [(i, (v + 2.0**40).tolist(), "x", 0.0) for i, v in enumerate(vectors(80, 5, 2))])


def test_large_and_small_spreads(spark):
    rows = [(i, v.tolist(), "x", 0.0) for i, v in enumerate(vectors(60, 4, 3, np.array([1e5, 1e2, 1.0, 0.2])))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component double")
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    assert got[0]["identity_error"] <= 1e-6


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 1e30]), (2, [1.0, 2.0])], kind)).count() == 0
    # vectors of another length than most are left out; a dimension without a spread makes no component
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0]), (4, [1.0])], kind)
    assert sorted((r["vec_id"], r["component"]) for r in whitening.whiten(mixed).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_block_products_are_exact_to_the_last_slice():
    draw = np.random.default_rng(4)
    high = draw.normal(size=(whitening.ROWS, 6)) * np.array([1, 1e3, 1e-3, 1e9, 1, 7])
    low = high * 2.0**-54 * draw.normal(size=high.shape)
    high, low = whitening.two_sum(high, low)
    total, rest = whitening.block_product((high, low))
    for i in range(6):
        for j in range(6):
            wanted = sum((Fraction(high[r, i]) + Fraction(low[r, i])) * (Fraction(high[r, j]) + Fraction(low[r, j])) for r in range(len(high)))
            bound = sum(abs(Fraction(high[r, i]) * Fraction(high[r, j])) for r in range(len(high)))
            assert abs(Fraction(total[i, j]) + Fraction(rest[i, j]) - wanted) <= bound * Fraction(1, 2**58)


def test_merging_keeps_what_a_double_would_lose():
    high, low = np.array([1e16, 1.0]), np.zeros(2)
    for _ in range(1000):
        high, low = whitening.add_pairs(high, low, np.array([1.0, 2.0**-60]), np.zeros(2))
    assert Fraction(high[0]) + Fraction(low[0]) == 10**16 + 1000
    assert Fraction(high[1]) + Fraction(low[1]) == 1 + 1000 * Fraction(1, 2**60)


def test_deviations_beyond_longs():
    moments = whitening.Moments(10**9, (10**15, 0))
    x = np.array([[1_000_001, 3], [1_000_000, 0]])
    assert whitening._deviations(np.array([[1_000_000, 1], [1_000_001, 0]]), moments) == [10**18, 10**18]
    with pytest.raises(OverflowError):
        whitening._deviations(x * np.array([[1, 1], [1, 1]]) + np.array([[0, 5], [0, 0]]), moments)
