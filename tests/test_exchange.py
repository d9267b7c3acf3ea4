"""Exchanges of columns within classes."""

from collections import Counter

import numpy as np
import pytest

from lumifuzz.functions.membership import Trapezoid, Variable
from lumifuzz.operators import rule_quality, validation
from lumifuzz.operators.rules import Rule, RuleBase

CLASSES = ("x", "y")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 70_001])
def test_permuted_is_a_bijection(n):
    out = validation.permuted(np.arange(n), n, 7)
    assert sorted(out.tolist()) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef(out, np.arange(n))[0, 1]) < 4 / n**0.5
        assert (validation.permuted(np.arange(n), n, 8) == out).mean() < 0.02


def table(spark, n=900):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a = float(draw.random())
        # the columns go together: b follows a in class x, and is its opposite in class y
        rows.append((i, a, a if i % 3 else 1 - a, f"c{i % 5}", "x" if i % 3 else "y"))
    return spark.createDataFrame([*rows, (n, None, 0.5, None, "x"), (n + 1, 0.1, 0.1, "c0", None)], "k long, a double, b double, c string, label string").repartition(4)


def test_columns_keep_their_values_and_lose_their_partners(spark):
    df = table(spark)
    moved = validation.exchanged(df, ["a", "b", "c"], rule_quality.class_place("label", CLASSES), 3).collect()
    before = df.where("label is not null").collect()
    for i in range(3):
        for y, name in enumerate(CLASSES):
            own, was = [r for r in moved if r["replicate"] == i and r["_y"] == y], [r for r in before if r["label"] == name]
            for f in "abc":
                assert Counter(r[f] for r in own) == Counter(r[f] for r in was)
            pairs = np.array([(r["a"], r["b"]) for r in own if r["a"] is not None])
            assert abs(np.corrcoef(pairs.T)[0, 1]) < 0.25
    assert {(r["a"], r["b"]) for r in moved if r["replicate"] == 0} != {(r["a"], r["b"]) for r in moved if r["replicate"] == 1}
    assert validation.exchanged(df.where("k < 0"), ["a"], rule_quality.class_place("label", CLASSES), 2).count() == 0


def test_p_values_tell_whether_columns_go_together(spark):
    sets = (Trapezoid("Low", (0, 0, 0.2, 0.8), domain=(0, 1)), Trapezoid("High", (0.2, 0.8, 1, 1), domain=(0, 1)))
    variables = (Variable("a", sets), Variable("b", sets))
    base = RuleBase(variables, (Rule((0, 0), 0), Rule((1, 1), 0), Rule((0, 1), 1), Rule((1, 0), 1)), CLASSES, 1)
    df = table(spark).select("a", "b", "label")
    assert validation.column_permutation_test(df, base, "label", k=19) == 1 / 20
    assert all(p == 1 / 20 for p in validation.rulewise_column_permutation_test(df, base, "label", k=19, whole_rows=False))
    # one column alone: no exchange changes anything
    one = RuleBase(variables[:1], (Rule((0,), 0), Rule((1,), 1)), CLASSES, 1)
    assert validation.column_permutation_test(df.select("a", "label"), one, "label", k=9) == 1 / 10
    assert validation._error(base, {}) == 1.0


def test_columns_of_few_values_need_no_shuffle(spark):
    """Their exchange is drawn from counts, whatever the pieces; other columns still meet their rows."""
    df = table(spark)
    place = rule_quality.class_place("label", CLASSES)
    plan = validation.exchanged(df, ["a", "b", "c"], place, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    pieces = validation._Pieces({(0, 0): np.array([50_000, 30_000, 20_000])}, {0: [(0, 70_001), (4, 1), (7, 29_998)]}, 4096, 5)
    every = [pieces.codes(1, 0, 0, p, i) for p, n in ((0, 70_001), (4, 1), (7, 29_998)) for i in range(-(-n // 4096))]
    assert np.bincount(np.concatenate(every)).tolist() == [50_000, 30_000, 20_000]
    assert [len(x) for x in every] == [4096] * 17 + [369] + [1] + [4096] * 7 + [1326]
    # in any order, and by another task
    other = validation._Pieces(pieces.counts, {0: [(0, 70_001), (4, 1), (7, 29_998)]}, 4096, 5)
    assert all((other.codes(1, 0, 0, 0, i) == every[i]).all() for i in (17, 3, 4, 0))
    shares = np.array([np.bincount(x, minlength=3) / len(x) for x in every if len(x) > 1000])
    assert 0 < np.abs(shares - [0.5, 0.3, 0.2]).max() < 0.05


@pytest.mark.parametrize("few, piece", [(1000, 1024), (10, 1024), (0, 1024)])
def test_both_ways_keep_the_values_of_every_class(spark, monkeypatch, few, piece):
    monkeypatch.setattr(validation, "FEW", few)
    monkeypatch.setattr(validation, "PIECE", piece)
    df = table(spark, 3000)
    moved = validation.exchanged(df, ["c", "a", "b"], rule_quality.class_place("label", CLASSES), 2).collect()
    before = df.where("label is not null").collect()
    for y, name in enumerate(CLASSES):
        was = [r for r in before if r["label"] == name]
        own = [r for r in moved if r["replicate"] == 1 and r["_y"] == y]
        for f in "abc":
            assert Counter(r[f] for r in own) == Counter(r[f] for r in was)
        assert abs(np.corrcoef(np.array([(r["a"], r["b"]) for r in own if r["a"] is not None]).T)[0, 1]) < 0.15


def test_both_tests_share_their_exchanges(spark):
    sets = (Trapezoid("Low", (0, 0, 0.2, 0.8), domain=(0, 1)), Trapezoid("High", (0.2, 0.8, 1, 1), domain=(0, 1)))
    base = RuleBase((Variable("a", sets), Variable("b", sets)), (Rule((0, 0), 0), Rule((1, 1), 0), Rule((0, 1), 1), Rule((1, 0), 1)), CLASSES, 1)
    df = table(spark).select("a", "b", "label")
    whole, each = validation.column_permutation_tests(df, base, "label", k=9)
    assert whole == validation.column_permutation_test(df, base, "label", k=9)
    assert each == validation.rulewise_column_permutation_test(df, base, "label", k=9, whole_rows=False)
