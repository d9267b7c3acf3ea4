from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Kind, Trapezoid, Variable
from lumifuzz.operators import rule_quality as rq
from lumifuzz.operators.partitions import crisp, even, fit_partitions, permutation_p, quantiles, validate_partitions
from lumifuzz.operators.rules import Rule, RuleBase, RuleError, forward, infer_interval, infer_type1, rule_base

SETS = (Trapezoid("Low", (0, 0, 0.3, 0.5), domain=(0, 1)), Trapezoid("Medium", (0.3, 0.5, 0.5, 0.7), domain=(0, 1)), Trapezoid("High", (0.5, 0.7, 1, 1), domain=(0, 1)))
VARIABLES = [Variable("a", SETS), Variable("b", SETS)]


def base(**options):
    return RuleBase(tuple(VARIABLES), (Rule((0, 1), 0), Rule((1, 2), 1), Rule((2, 0), 2)), ("x", "y", "z"), **({"ds_mode": 1} | options))


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(42)
    return spark.createDataFrame([(i, float(a), float(b), ["x", "y", "z"][int(c)]) for i, (a, b, c) in enumerate(zip(draw.random(120), draw.random(120), draw.integers(0, 3, 120), strict=True))], "k int, a double, b double, y string")


def brute(df, b):
    out = []
    for r in df.collect():
        m = {n: [float(s.at(np.array([r[n]]))[0]) for s in SETS] for n in ("a", "b")}
        out.append([m["a"][x.antecedents[0]] * m["b"][x.antecedents[1]] for x in b.rules])
    return np.array(out)


def test_quantiles_are_numpys(spark):
    v = np.random.default_rng(1).random(101)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double")
    assert quantiles(df, ["x"], even(6))["x"] == pytest.approx(list(np.quantile(v, even(6))))
    with pytest.raises(ValueError):
        quantiles(df.where("x is null"), ["x"], [0.5])


@pytest.mark.parametrize("shape", ["trapezoid", "gaussian", "triangular", "simple_trapezoid", "simple_gaussian", "three_trapezoid"])
def test_partition_shapes(rows, shape):
    (v,) = fit_partitions(rows, ["a"], shape=shape)
    assert len(v) == (4 if shape.startswith("simple") else 3)
    assert rows.select(F.max(F.expr(v.texts()[0])), F.max(F.expr(v.texts()[-1]))).first()[0] > 0.5


@pytest.mark.parametrize("kind", [Kind.T2, Kind.GT2])
def test_interval_partitions_are_ordered(rows, kind):
    (v,) = fit_partitions(rows, ["a"], kind=kind)
    assert rows.where(" or ".join(f"{lo} > {hi} + 1e-9" for lo, hi in v.bounds())).count() == 0


def test_crisp_and_validated_partitions(spark, rows):
    assert crisp(rows, "y").labels == ["x", "y", "z"]
    got = validate_partitions(rows, fit_partitions(rows, ["a"]), permutations=50)
    assert got["a"]["covered"] and got["a"]["one_full"] and got["a"]["ordered"]
    v = fit_partitions(rows, ["a", "y"], categorical=["y"])
    assert [x.name for x in v] == ["a", "y"]
    with pytest.raises(ValueError):
        fit_partitions(rows, ["a"], shape="round")


def test_firing_and_winner(rows):
    b = base()
    wanted = brute(rows, b)
    got = [r["firing"] for r in b.firing(rows).orderBy("k").collect()]
    assert np.allclose(got, wanted)
    winners = [r["winner"] for r in b.predict(rows).orderBy("k").collect()]
    assert winners == wanted.argmax(axis=1).tolist()
    unknown = [r["predicted"] for r in base(allow_unknown=True).predict(rows).orderBy("k").collect()]
    assert unknown == [int(w.argmax()) if w.max() > 0 else -1 for w in wanted]
    assert {r["predicted"] for r in b.predict(rows, names=True).collect()} <= {"x", "y", "z"}


def test_scaled_firing_sums_to_one_in_each_class(rows):
    """Every class is a rule base of its own, which scales its own rules."""
    b = RuleBase(tuple(VARIABLES), (Rule((0, -1), 0), Rule((1, 0), 0), Rule((-1, 2), 0), Rule((2, 1), 1), Rule((2, -1), 1)), ("x", "y"), 1)
    got = np.array([r["firing"] for r in b.firing(rows, scaled=True).collect()])
    for own in (got[:, :3], got[:, 3:]):
        assert all(s == pytest.approx(1) or s == 0 for s in own.sum(axis=1)) and (own.sum(axis=1) > 0).any()


def test_an_empty_rule_fires_0_and_modifiers_raise(rows):
    b = RuleBase(tuple(VARIABLES), (Rule((-1, -1), 0), Rule((0, -1), 1, (2.0, -1.0)), Rule((0, -1), 2)), ("x", "y", "z"), 1)
    got = np.array([r["firing"] for r in b.firing(rows).collect()])
    assert (got[:, 0] == 0).all() and np.allclose(got[:, 1], got[:, 2] ** 2)


def test_nulls_count_as_0(spark):
    df = spark.createDataFrame([(None, 0.5), (float("nan"), 0.5)], "a double, b double")
    assert [r["firing"] for r in base().firing(df).collect()] == [[0.0] * 3] * 2
    assert base().predict(df.limit(0)).count() == 0


def test_probabilities(rows):
    p = np.array([r["probabilities"] for r in base().probabilities(rows).collect()])
    assert np.allclose(p.sum(axis=1), 1)
    assert base().class_membership(rows).count() == 120


def test_collection():
    b = base()
    assert len(b.add(Rule((0, 1), 0))) == 3 and len(b.remove([0])) == 2 and len(b + b) == 3
    assert b.copy() == b and b.matrix() == [[0, 1], [1, 2], [2, 0]] and b.renamed("uvw").classes == ("u", "v", "w")
    assert rule_base([[0, 1]], [0], VARIABLES).rules[0] == Rule((0, 1), 0)
    assert "IF a IS Low AND b IS Medium" in b.text()
    for bad in ((Rule((0,), 0),), (Rule((9, 0), 0),), (Rule((0, 0), 7),)):
        with pytest.raises(RuleError):
            RuleBase(tuple(VARIABLES), bad, ("x",))


def test_no_rules(rows):
    none = RuleBase(tuple(VARIABLES), (), ("x",))
    assert {r["predicted"] for r in none.predict(rows).collect()} == {-1}
    with pytest.raises(RuleError):
        none.firing(rows)


def test_quality_against_numpy(rows):
    b = base()
    f = brute(rows, b)
    y = np.array([("x", "y", "z").index(r["y"]) for r in rows.orderBy("k").collect()])
    mine = [(f[:, i] * (y == i)) for i in range(3)]
    assert rq.antecedent_support(rows, b, "y") == pytest.approx(f.mean(axis=0))
    assert rq.rule_support(rows, b, "y") == pytest.approx([m.mean() for m in mine])
    assert rq.rule_confidence(rows, b, "y") == pytest.approx([m.sum() / f[:, i].sum() for i, m in enumerate(mine)])
    assert rq.dominance(rows, b, "y") == pytest.approx([m.mean() * m.sum() / f[:, i].sum() for i, m in enumerate(mine)])
    won = f.argmax(axis=1)
    assert [r.accuracy for r in rq.with_accuracy(rows, b, "y").rules] == pytest.approx([float((y[won == i] == i).mean()) if (won == i).any() else 0.0 for i in range(3)])
    counts = rq.collected(rq.confusion(rows, b, "y"))
    assert sum(counts.values()) == 120 and rq.accuracy_score(counts) == pytest.approx(float((won == y).mean()))
    onehot = lambda v: np.eye(3)[v]
    c = np.cov(onehot(y).T, onehot(won).T, bias=True)
    assert rq.matthews(counts) == pytest.approx(np.trace(c[:3, 3:]) / np.sqrt(np.trace(c[:3, :3]) * np.trace(c[3:, 3:])))


def test_reports(rows):
    b = rq.full_evaluation(rows, base(), "y")
    assert all(r.aux and r.score is not None for r in b.rules)
    assert 0 <= rq.size_antecedents(b, 0.0) <= 1 and 0 <= rq.effective_rules(b, 0.0) <= 1
    e = rq.Evaluator(b, "y")
    assert e.get_metric("f1_score", rows) <= 1 and "accuracy" in e.report(rows, rows)
    with pytest.raises(ValueError):
        e.get_metric("nothing", rows)
    assert rq.matthews({(0, 0): 5}) == 0 and len(b.purged(10)) == 0
    assert rq.mcc_loss(rows, b, "y") == pytest.approx(rq.classification(rows, b, "y")["mcc"])
    assert rq.association_degrees(rows, b, "y").count() == 120


def test_regression(rows):
    out = Variable("o", SETS)
    got = infer_type1(base(), out, rows).collect()
    assert all(r["inferred"] is None or 0 <= r["inferred"] <= 1 for r in got)
    assert 0 <= forward(base(), out, rows) <= 1
    both = infer_interval(base(), out, rows).collect()
    assert all(-1e-9 <= r["inferred"]["lo"] <= 1 for r in both)


def test_weights_and_modes(rows):
    b = replace(base(), rules=tuple(replace(r, weight=0.5, score=0.25) for r in base().rules))
    f = brute(rows, b)
    for mode, factor in ((0, 0.25), (1, 1.0), (2, 0.5)):
        got = np.array([r["association"] for r in replace(b, ds_mode=mode).association(rows).orderBy("k").collect()])
        assert np.allclose(got, f * factor)


def test_generated_code_is_small_enough_to_be_compiled(spark):
    """No method over 8000 bytes, which the JVM would interpret for ever, for 30 rules over 4 features."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    variables = fit_partitions(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    draw = np.random.default_rng(3)
    rules = {tuple(int(x) for x in draw.integers(-1, 3, 4)) for _ in range(60)} - {(-1, -1, -1, -1)}
    b = RuleBase(tuple(variables), tuple(Rule(a, i % 3) for i, a in enumerate(sorted(rules)[:30])), ("A", "N", "R"), 1)
    assert len(b) == 30
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (b.explain(df).groupBy("l_returnflag", "winner").agg(F.sum("strength")), b.predict(df).groupBy("predicted").count(), b.probabilities(df).agg(F.sum(F.col("probabilities")[0]))):
            seq = debug.codegenStringSeq(made._jdf.queryExecution().executedPlan())
            sizes = [seq.apply(i)._3().maxMethodCodeSize() for i in range(seq.size())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rank_selection_in_narrow_brackets(spark, monkeypatch):
    """Exact quantiles whatever the size of a bracket: continuous values, few values, and one value that many rows share."""
    from lumifuzz.operators import partitions

    draw = np.random.default_rng(5)
    columns = {"a": draw.random(5000), "b": draw.integers(0, 5, 5000).astype(float), "c": np.where(draw.random(5000) < 0.4, 7.0, draw.normal(size=5000))}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values(), strict=True)], "a double, b double, c double")
    asked = [0, 0.1, 0.2, 0.21345, 0.5, 0.999, 1]
    for most in (20_000, 50, 3):
        monkeypatch.setattr(partitions, "MOST_VALUES", most)
        got = quantiles(df, list(columns), asked)
        for c, v in columns.items():
            assert got[c] == pytest.approx(list(np.quantile(v, asked)), rel=0, abs=1e-12)


def test_type_reduction_of_many_rows_is_that_of_each():
    """Against the search as it is defined, one row at a time."""
    from lumifuzz.operators.centroids import SAME, consequent_centroids

    def one(firing, c, first):
        w = firing.mean(axis=1)
        if not w.sum():
            return 0.0
        now, seen = float(w @ c / w.sum()), []
        while not any(abs(now - s) <= SAME for s in seen):
            seen.append(now)
            below = np.flatnonzero(c <= now + SAME)
            k = below[-1] if len(below) else 0
            w = np.concatenate([firing[: k + 1, first], firing[k + 1 :, 1 - first]])
            now = float(w @ c / w.sum()) if w.sum() else 0.0
        return now

    draw = np.random.default_rng(0)
    low = draw.random((500, 6)) * (draw.random((500, 6)) < 0.6)
    firing = np.stack([low, low + draw.random((500, 6)) * (draw.random((500, 6)) < 0.7)], axis=2)
    c = np.array([0.2, 0.2, 0.5, 0.5, 0.8, 0.8])
    lo, hi = consequent_centroids(firing, np.stack([c, c], axis=1))
    assert np.allclose(lo, [one(f, c, 1) for f in firing]) and np.allclose(hi, [one(f, c, 0) for f in firing])


def test_few_values_are_sampled_row_by_row(spark):
    """A column of nine values: a sample by the value's own hash would be the rows of one or two of them."""
    rows = spark.range(6000).selectExpr("(id % 9) / 100.0 as tax", "id as key")
    variables = fit_partitions(rows, ["tax"])
    got = validate_partitions(rows, variables)["tax"]
    assert got["distinct"] and got["valid"]
    assert validate_partitions(rows, variables, key=["key"])["tax"] == got
    assert not validate_partitions(rows.where("key < 0"), variables)["tax"]["valid"]


def test_sets_of_equal_memberships_are_not_distinct(spark):
    rows = spark.range(500).selectExpr("id / 500.0 as a")
    flat = Trapezoid("x", (-1.0, 0.0, 1.0, 2.0), domain=(0.0, 1.0))
    got = validate_partitions(rows, [Variable("a", (flat, Trapezoid("y", (-1.0, 0.0, 1.0, 2.0), domain=(0.0, 1.0))))], permutations=200)["a"]
    assert not got["distinct"] and not got["one_full"] and got["covered"]


def test_permutation_p_of_the_definition():
    draw = np.random.default_rng(0)
    same = draw.random(400)
    assert permutation_p(same, draw.random(400), 300) > 0.05
    assert permutation_p(same, 1 - same, 300) < 0.05
