"""Exact ranks and exact stratified splits against sorting everything."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Trapezoid, Variable
from lumifuzz.operators import conformal, ranks
from lumifuzz.operators.rules import Rule, RuleBase


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check(spark, points, asked, inclusive):
    p = spark.createDataFrame(points, "group int, value double, n long").repartition(3)
    a = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(asked)], "row long, group int, value double").repartition(4)
    got, made = ranks.rank(p, a, F.col("group").isin(*inclusive) if inclusive else F.lit(False))
    held = {}
    for g, v, n in points:
        held.setdefault(g, []).extend([v] * n)
    held = {g: sorted(v) for g, v in held.items()}
    wanted = {(i, g): (bisect_right if g in inclusive else bisect_left)(held.get(g, []), v) for i, (g, v) in enumerate(asked)}
    rows = [((r["row"], r["group"]), r["n"]) for r in got.collect()]
    assert len(rows) == len(asked) and dict(rows) == wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_are_those_of_sorting(spark, small_batches, seed):
    draw = random.Random(seed)
    values = [draw.random() for _ in range(40)]
    points = [(draw.randrange(4), draw.choice(values) if draw.random() < 0.7 else draw.random(), draw.randint(1, 5)) for _ in range(400)]
    # one value is asked for by most rows, one group has no points, another no rows
    asked = [(draw.choice([0, 1, 2, 2, 2, 9]), draw.choice([values[0]] * 30 + values + [-1.0, 2.0, draw.random()])) for _ in range(900)]
    check(spark, points, asked, {0, 2})


def test_ranks_without_points_or_rows(spark):
    check(spark, [], [(0, 1.0), (1, 2.0)], set())
    check(spark, [(0, 1.0, 3)], [], {0})
    check(spark, [(0, 1.0, 3)], [(0, 1.0)] * 50, {0})


def test_splits_hold_exactly_the_share_of_each_class(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a"] * 60 + ["b"] * 9 + ["c", None])) for i in range(3000)] + [(None, "a")]
    df = spark.createDataFrame(rows, "k long, y string").repartition(3)
    train, held = conformal.split(df, "k", 0.25, label="y")
    counts = Counter(y for _, y in rows)
    got = Counter(r["y"] for r in held.collect())
    assert got == {c: round(0.25 * n) for c, n in counts.items() if c is not None}
    assert train.count() + held.count() == len(rows)
    again = conformal.split(df.repartition(5), "k", 0.25, label="y")[1]
    assert {r["k"] for r in again.collect()} == {r["k"] for r in held.collect()}
    plain = conformal.split(df, "k", 0.25)[1].count()
    assert 600 < plain < 900
    assert conformal.split(df.where("k < 0"), "k", 0.25, label="y")[1].count() == 0


def test_rows_of_the_same_scores_are_asked_for_once(spark, monkeypatch):
    sets = (Trapezoid("Low", (0, 0, 0.3, 0.6), domain=(0, 1)), Trapezoid("High", (0.3, 0.6, 1, 1), domain=(0, 1)))
    base = RuleBase((Variable("a", sets),), (Rule((0,), 0), Rule((1,), 1)), ("x", "y"), 1)
    rows = [(i, (i % 25) / 24, "xy"[i % 3 == 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, a double, y string").repartition(3)
    cal = conformal.calibrate(df.where("k < 200"), base, "y")
    asked, rank = [], ranks.rank
    monkeypatch.setattr(ranks, "rank", lambda points, rows, inclusive: (asked.append(rows.count()), rank(points, rows, inclusive))[1])
    one = conformal.predict_set_with_rules(df.where("k >= 200"), cal, 0.1)
    assert asked[0] <= 25 * 4
    got = {r["k"]: r for r in one.collect()}
    assert sorted(got) == list(range(200, 600)) and one.columns[:3] == df.columns
    low, high = (s.at(np.array([x for _, x, _ in rows])) for s in sets)
    for i in range(200, 600):
        for c, m in enumerate((low, high)):
            own = [1 - m[j] for j in range(200) if (rows[j][2] == "y") == c]
            assert got[i]["p_values"][c] == pytest.approx((sum(s >= 1 - m[i] for s in own) + 1) / (len(own) + 1))
        told = {x["rule"]: x for x in got[i]["contributions"]}
        for c, m in enumerate((low, high)):
            assert (c in told) == (m[i] > 0)
            if c in told:
                own = [m[j] for j in range(200) if (rows[j][2] == "y") == c]
                assert told[c]["confidence"] == pytest.approx(sum(s <= m[i] for s in own) / len(own)) and told[c]["strength"] == pytest.approx(m[i])
