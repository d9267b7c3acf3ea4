import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Category, Gaussian, GeneralType2, IntervalCategory, IntervalGaussian, IntervalTrapezoid, Kind, TemporalSet, Trapezoid, Triangle, TriangularType2, Variable, cache, extended_kinds
from lumifuzz.operators import centroids
from lumifuzz.operators.rules import MamdaniRule


def column(spark, s, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r["m"] for r in df.select("i", s.membership("x").alias("m")).orderBy("i").collect()]


def test_closed_form(spark):
    s = Trapezoid("s", (0, 0.1, 0.25, 0.5))
    assert column(spark, s, [0.1, 1.0, 0.51, 0.05]) == pytest.approx([1, 0, 0, 0.5])
    assert s.at(np.array([0.1, 1.0, 0.51, 0.05])) == pytest.approx([1, 0, 0, 0.5])


def test_degenerate_corners(spark):
    crisp, left, right = Trapezoid("c", (2, 2, 2, 2)), Trapezoid("l", (0, 0, 1, 2)), Trapezoid("r", (0, 1, 2, 2))
    assert column(spark, crisp, [2.0, 2.1, None]) == [1.0, 0.0, None]
    assert column(spark, left, [0.0, -0.01]) == [1.0, 0.0] and column(spark, right, [2.0, 2.01]) == [1.0, 0.0]


def test_gaussian_and_triangle(spark):
    g = Gaussian("g", 0.5, 0.2)
    assert column(spark, g, [0.5, 0.3, 0.7]) == pytest.approx([1, np.exp(-1), np.exp(-1)])
    assert column(spark, Triangle("t", (0, 0.5, 0.5, 1)), [0.25, 0.5, 0.75]) == pytest.approx([0.5, 1, 0.5])


def test_interval_sets(spark):
    s = IntervalTrapezoid("s", (0.1, 0.15, 0.25, 0.4), (0, 0.1, 0.25, 0.5), 0.8)
    (m,) = column(spark, s, [0.2])
    assert m["lo"] == pytest.approx(0.8) and m["hi"] == 1 and m["lo"] <= m["hi"]
    with pytest.raises(ValueError):
        IntervalTrapezoid("s", (0, 0.1, 0.2, 0.9), (0.1, 0.1, 0.2, 0.3), strict=True)
    g = IntervalGaussian("g", (0.5, 0.1), (0.5, 0.2))
    (m,) = column(spark, g, [0.4])
    assert (m["lo"], m["hi"]) == pytest.approx((np.exp(-1), np.exp(-0.25)))


def test_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    got = df.select(Category("a", "a").membership("x").alias("m"), IntervalCategory("a", "a").membership("x").alias("i")).collect()
    assert [r["m"] for r in got] == [1.0, 0.0, None] and got[0]["i"]["lo"] == got[0]["i"]["hi"] == 1.0


def test_general_type_2(spark):
    grid = {round(0.1 * i, 1): Trapezoid("z", (0.25, 0.5, 0.5, 0.75)) for i in range(1, 11)}
    s = GeneralType2.over("s", grid, 1, resolution=0.001)
    (m,) = column(spark, s, [0.3])
    assert (m["lo"] + m["hi"]) / 2 == pytest.approx(0.5, abs=0.1)
    assert s.all_cuts(np.array([0.3])).shape == (1, 6, 2)
    x = np.array([0.1, 0.37, 0.99, 5.0])
    assert np.allclose([(r["lo"], r["hi"]) for r in column(spark, s, x.tolist())], s.at(x))


def test_variables_clip_to_their_domain(spark):
    v = Variable("x", (Trapezoid("Low", (0, 0, 1, 2), domain=(0, 3)), Trapezoid("High", (1, 2, 3, 3), domain=(0, 3))))
    df = spark.createDataFrame([(-5.0,), (9.0,), (float("nan"),), (None,)], "x double")
    got = [r["mu_x"] for r in df.select(*cache([v])).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [None, None], [None, None]]
    assert [r[0] for r in df.select(v.unclipped().memberships()).collect()][:2] == [[0.0, 0.0], [0.0, 0.0]]
    assert v.labels == ["Low", "High"] and len(v.sampled(10)) == 20 and v.kind is Kind.T1


def test_temporal_sets(spark):
    s = TemporalSet("s", Trapezoid("s", (0, 0, 1, 1)), (0.5, 1.0), "t")
    df = spark.createDataFrame([(0.5, 0), (0.5, 1)], "x double, t int")
    assert [r[0] for r in df.select(s.membership("x")).collect()] == [0.5, 1.0]
    assert [r[0] for r in df.select(s.fix(0).membership("x")).collect()] == [0.5, 0.5]
    assert "WEEKLY" in extended_kinds(["weekly"]).__members__


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=4, max_size=4).map(sorted), st.lists(st.floats(-150, 150), min_size=1, max_size=20))
def test_trapezoids_stay_between_0_and_1(corners, x):
    m = Trapezoid("s", tuple(corners)).at(np.array(x))
    assert ((m >= 0) & (m <= 1)).all()


def test_centroids():
    s = IntervalTrapezoid("s", (0.35, 0.4, 0.6, 0.65), (0.25, 0.4, 0.6, 0.75), 0.8, domain=(0, 1))
    lo, hi = centroids.interval_centroid(s)
    assert lo == pytest.approx(0.5, abs=0.05) and hi == pytest.approx(0.5, abs=0.05) and lo <= hi
    assert centroids.set_centroid(Trapezoid("t", (0, 0.4, 0.6, 1), domain=(0, 1))) == pytest.approx(0.5, abs=1e-3)
    assert np.isnan(centroids.center(np.array([1.0]), np.array([0.0])))
    assert centroids.consequent_centroid(np.zeros((2, 2)), np.ones((2, 2))) == (0.0, 0.0)
    ends = centroids.consequent_centroid(np.array([[0.2, 0.8], [0.4, 0.6]]), np.array([[0.1, 0.3], [0.7, 0.9]]))
    assert 0.1 <= ends[0] <= ends[1] <= 0.9


def test_mamdani_rule(spark):
    r = MamdaniRule((("x", Trapezoid("a", (0, 1, 1, 2))), ("y", Trapezoid("b", (0, 1, 1, 2)))), Trapezoid("c", (0, 0.4, 0.6, 1), domain=(0, 1)))
    df = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    assert df.select(r.membership()).first()[0] == pytest.approx(0.25)
    assert df.select(r.membership(F.least)).first()[0] == pytest.approx(0.5)
    assert r.consequent_centroid() == pytest.approx(0.5, abs=0.05)


def test_closed_general_type_2_is_the_table(spark):
    """Against a table of secondary triangles, one for each grid point, in numpy, as a column and in a rule."""
    from lumifuzz.operators.rules import Rule, RuleBase

    for of in (IntervalTrapezoid("s", (0.2, 0.4, 0.5, 0.7), (0.13, 0.4, 0.5, 0.9)), IntervalGaussian("s", (0.5, 0.1), (0.5, 0.25)), IntervalTrapezoid("s", (0.0, 0.0, 0.305, 0.6), (-0.01, 0.0, 0.305, 0.65))):
        grid = 0.03 + 0.01 * np.arange(98)
        table = GeneralType2.over("s", {float(x): Trapezoid("z", (lo, (lo + hi) / 2, (lo + hi) / 2, hi)) for x, (lo, hi) in zip(grid, of.at(grid), strict=True)}, 2)
        closed = TriangularType2("s", of, 0.03, 98, 2, domain=(0.03, 1.0))
        x = np.r_[grid + 1e-6, 0.0, 5.0, -3.0, np.random.default_rng(0).random(200)]
        assert np.allclose(closed.all_cuts(x), table.all_cuts(x))
        got = column(spark, closed, [*x.tolist(), None, float("nan")])
        assert np.allclose([(r["lo"], r["hi"]) for r in got[: len(x)]], table.at(x))
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        fired = [[r["firing"][0] for r in RuleBase((Variable("x", (one,), clipped=False),), (Rule((0,), 0), Rule((-1,), 0)), ("c",), 1).firing(rows, scaled=False).collect()] for one in (closed, table)]
        assert np.allclose(*fired) and fired[0][-1] == 0


def test_closed_general_type_2_has_no_limit_of_points(spark):
    of = IntervalTrapezoid("s", (0.0, 4e8, 5e8, 8e8), (0.0, 3e8, 6e8, 9e8))
    (m,) = column(spark, TriangularType2("s", of, 0.0, 10**11, 2), [2e8])
    assert m["lo"] < m["hi"]


def test_general_sets_are_worked_out_once_for_each_value(spark, sf):
    """Not once for each row: the rows of a value are counted first."""
    from lumifuzz.plans.queries import QUERIES

    plan = QUERIES["gt2_wide_memberships"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" +-:") for x in plan.splitlines()]
    generate = next(i for i, x in enumerate(lines) if "Generate" in x)
    assert any(x.startswith("Aggregate") for x in lines[generate:])


def test_partition_checks_draw_rows_before_their_memberships(spark, sf, monkeypatch):
    from lumifuzz.operators.partitions import fit_partitions, validate_partitions

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_tax")
    variables, seen = fit_partitions(df, df.columns), []
    sort = type(df).orderBy
    monkeypatch.setattr(type(df), "orderBy", lambda self, *a, **b: (seen.append(self.columns), sort(self, *a, **b))[1])
    assert validate_partitions(df, variables, 20, 200)["l_quantity"]["covered"]
    assert seen == [["l_quantity", "l_tax", "_draw"]]
