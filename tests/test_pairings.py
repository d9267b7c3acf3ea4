"""The permutation test over all rows, against permutations of all memberships."""

import numpy as np
import pytest
from pyspark.sql import DataFrame

from lumifuzz.functions.membership import Trapezoid, Variable
from lumifuzz.operators import pairings
from lumifuzz.operators.partitions import permutation_p, validate_partitions


def counted(spark, a, b):
    rows = [(0, float(x), float(y), 1) for x, y in zip(a, b, strict=True)]
    return spark.createDataFrame(rows, "i int, m0 double, m1 double, n long").groupBy("i", "m0", "m1").sum("n").toDF("i", "m0", "m1", "n")


def test_deals_are_those_of_permutations():
    draw, deals = np.random.default_rng(1), 20_000
    buckets = [([0.0], [2]), ([0.1, 0.2, 0.3], [1, 1, 2]), ([0.5, 0.9], [1, 1]), ([1.0], [2])]
    pool = np.concatenate([np.repeat(v, n) for v, n in buckets])
    roles = pairings._roles([sum(n) for _, n in buckets], 5, deals, draw)
    got = sum(pairings._dealt(np.array(v), n, r, draw) for (v, n), r in zip(buckets, roles, strict=True))
    left, right = np.split(np.array([draw.permutation(pool) for _ in range(deals)]), 2, axis=1)
    want = np.stack([np.abs(left - right).sum(1), left.sum(1), (left * left).sum(1)])
    assert np.allclose(got.mean(1), want.mean(1), atol=0.03) and np.allclose(np.cov(got), np.cov(want), atol=0.02)
    # the bounds hold
    least, most = got - 0.01, got + 0.01
    whole, squares = pool.sum(), (pool * pool).sum()
    low, high = pairings._bounds(5, least, most, whole, squares)
    at = pairings._statistic(5, *got, whole, squares)
    assert (low <= at).all() and (at <= high).all()


@pytest.mark.parametrize("kind", ["apart", "alike", "near", "few values"])
def test_p_values_are_those_of_permutations(spark, kind):
    draw = np.random.default_rng(3)
    a = draw.random(3000)
    b = {"apart": 1 - a, "alike": draw.random(3000), "near": np.where(draw.random(3000) < 0.03, a, draw.random(3000)), "few values": draw.integers(0, 4, 3000) / 3}[kind]
    a = np.round(3 * a) / 3 if kind == "few values" else a
    (p,) = pairings.p_values(counted(spark, a, b), [(0, 0)], 400)
    assert p == pytest.approx(permutation_p(a, b, 400), abs=0.15)
    assert (p < 0.05) == (kind == "apart") or kind == "near"


def test_all_rows_are_tested(spark, monkeypatch):
    """2000 rows of 20000 do not tell a small difference from chance; all of them do. No row is left out of the test by default."""
    rows = spark.range(20_000).selectExpr("id", "pmod(xxhash64(id), 1000003) / 1000003D as a", "pmod(xxhash64(id, 7), 1000003) / 1000003D as b")
    mixed = rows.selectExpr("a", "case when id % 50 = 0 then a else b end as b").toPandas()
    (p,) = pairings.p_values(counted(spark, mixed["a"], mixed["b"]), [(0, 0)], 400)
    assert p < 0.05 and permutation_p(mixed["a"].to_numpy()[:2000], mixed["b"].to_numpy()[:2000], 400) > 0.05
    monkeypatch.setattr(DataFrame, "limit", lambda *a: pytest.fail("rows are left out"))
    sets = (Trapezoid("low", (0.0, 0.0, 0.3, 0.6), domain=(0.0, 1.0)), Trapezoid("high", (0.3, 0.6, 1.0, 1.0), domain=(0.0, 1.0)))
    assert validate_partitions(rows, [Variable("a", sets)], permutations=200)["a"]["valid"]
