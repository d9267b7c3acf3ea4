import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Kind
from lumifuzz.operators import cognitive, conformal, evolve, mining, rule_graph, stability, temporal, tree, validation
from lumifuzz.operators import rule_quality as rq
from lumifuzz.operators.partitions import fit_partitions
from lumifuzz.operators.rules import Rule, RuleBase
from lumifuzz.sources import text_format
from lumifuzz.streaming import scoring

FEATURES = ["A", "B", "C"]
CLASSES = ("0", "1", "2")


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(42)
    x = draw.random((240, 3))
    y = np.repeat([0, 1, 2], 80)
    x[:, 0] = (x[:, 0] + y) / 3
    return spark.createDataFrame([(i, *map(float, v), str(c), i % 24) for i, (v, c) in enumerate(zip(x, y.tolist(), strict=True))], "k int, A double, B double, C double, y string, h int")


@pytest.fixture(scope="module")
def variables(rows):
    return fit_partitions(rows, FEATURES)


@pytest.fixture(scope="module")
def base(variables):
    return RuleBase(tuple(variables), (Rule((0, -1, -1), 0), Rule((1, -1, -1), 1), Rule((2, -1, -1), 2)), CLASSES, 1)


def test_mining_finds_what_trying_all_finds(rows, variables):
    from itertools import combinations, product

    m = rows.select(*(v.memberships().alias(v.name) for v in variables)).toPandas()
    mu = {(i, j): np.array([r[j] for r in m[f]]) for i, f in enumerate(FEATURES) for j in range(3)}
    wanted = {}
    for k in (1, 2, 3):
        for vs in combinations(range(3), k):
            for ss in product(range(3), repeat=k):
                s = np.minimum.reduce([mu[p] for p in zip(vs, ss, strict=True)]).mean()
                if s > 0.05:
                    wanted[tuple(zip(vs, ss, strict=True))] = s
    got = {x.items: x.support for x in mining.mine_itemsets(rows, variables, 0.05)}
    assert got == pytest.approx(wanted)


def test_mining_thresholds(rows, variables):
    n = [len(mining.mine_itemsets(rows, variables, t, d)) for t, d in ((0.05, 2), (0.2, 2), (0.05, 1))]
    assert n[0] >= n[1] and n[0] >= n[2]
    found = mining.mine_classes(rows, "y", CLASSES, variables, 0.1, 2, 0.0, 0.0)
    pruned = mining.prune(rows, found, "y", 1.0, 1.5)
    assert 0 < len(pruned) < len(found)
    assert len(mining.simple_mine(rows, FEATURES, Kind.T2, 0.1, 1)) > 0
    assert mining.mine_itemsets(rows.limit(0), variables) == []


def test_search_is_repeatable_and_learns(rows, variables):
    how = evolve.Search(n_gen=4, pop_size=10)
    made = [evolve.FuzzyRulesEstimator(FEATURES, 6, 2, variables=variables).fit(rows, "y", how) for _ in range(2)]
    assert made[0].base == made[1].base and made[0].history == sorted(made[0].history)
    assert made[0].fitness == pytest.approx(rq.classification(rows, made[0].base, "y")["mcc"], abs=1e-9)
    seen = []
    again = evolve.FuzzyRulesEstimator(FEATURES, 6, 2, variables=variables)
    again.custom_loss(rq.accuracy_score)
    again.fit(rows, "y", evolve.Search(n_gen=2, pop_size=6, patience=0), initial=made[0].base, checkpoints=1, checkpoint=lambda g, t: seen.append((g, t)))
    assert [g for g, _ in seen] == [1, 2] and again.fitness >= rq.classification(rows, made[0].base, "y")["accuracy"] - 1e-9
    genes = evolve.RuleGenes(tuple(variables), 3, 6, 2)
    assert genes.decode(genes.encode(made[0].base), CLASSES) == RuleBase(tuple(variables), tuple(Rule(r.antecedents, r.consequent) for r in made[0].base.rules), CLASSES)


def test_search_over_candidates_and_partitions(rows):
    how = evolve.Search(n_gen=1, pop_size=4)
    mined = evolve.RuleMineClassifier(FEATURES, 5, 2, threshold=0.05, confidence=0.0, lift=0.0).fit(rows, "y", how)
    assert 0 < len(mined.base) <= 5
    assert evolve.TwoStageClassifier(FEATURES, 4, 2).fit(rows, "y", how).base.rules
    assert evolve.RuleFineTuneClassifier(FEATURES, 4, 2, confidence=0.0, lift=0.0).fit(rows, "y", how).predict(rows).count() == 240
    shaped = evolve.FuzzyRulesEstimator(FEATURES, 4, 2, optimise_partitions=True).fit(rows, "y", how)
    assert shaped.predict(rows).count() == 240
    with pytest.raises(ValueError):
        evolve.backend("other")


def test_validation(rows, base):
    assert validation.label_permutation_test(rows, base, "y", 50) < 0.05
    assert all(p < 0.05 for p in validation.rulewise_label_permutation_test(rows, base, "y", 50))
    assert validation.column_permutation_test(rows, base, "y", "k", whole_rows=True) == 1 / 21
    assert 0 < validation.column_permutation_test(rows, base, "y", "k", k=2) <= 1
    got = validation.with_intervals(rows, base, "y", "k", 30)
    support = rq.rule_support(rows, base, "y")
    assert all(r.support_interval[0] <= s <= r.support_interval[1] for r, s in zip(got.rules, support, strict=True))
    assert all(0 <= r.p_values[0] <= 1 for r in validation.rule_p_values(rows, base, "y", 20, 2).rules)
    assert "support" in got.text()
    assert 150 < validation.bootstrap_sample(rows, "k", 1).count() < 330
    assert validation.p_permutation([0.1, 0.5], 0.3) == 2 / 3


def test_conformal(rows, base):
    c = conformal.ConformalClassifier(base).calibrate(rows.where("k % 2 = 0"), "y")
    rest = rows.where("k % 2 = 1")
    total, by = conformal.coverage(rest, c.calibrated, "y", 0.1)
    assert total["coverage"] >= 0.75 and set(by) == set(CLASSES)
    sizes = [c.predict_set(rest, a).agg(F.avg(F.size("prediction_set"))).first()[0] for a in (0.05, 0.3)]
    assert sizes[0] >= sizes[1]
    # p-values by the definition, to the last bit
    scored = base.class_membership(rows).collect()
    for p in c.predict_set(rest).select("k", "p_values").collect():
        own = next(r["memberships"] for r in scored if r["k"] == p["k"])
        for i, name in enumerate(CLASSES):
            seen = [1 - r["memberships"][i] for r in scored if r["k"] % 2 == 0 and r["y"] == name]
            assert p["p_values"][i] == (sum(s >= 1 - own[i] for s in seen) + 1) / (len(seen) + 1)
    said = c.predict_set_with_rules(rest).first()["contributions"]
    assert [x["strength"] for x in said] == sorted((x["strength"] for x in said), reverse=True)
    assert c.calibration_info()[0]["rows"] == 40
    for kind in conformal.SCORES:
        assert conformal.p_values(rest, conformal.calibrate(rows, base, "y", kind), kind).count() == 120
    with pytest.raises(ValueError):
        conformal.ConformalClassifier(base).predict_set(rows)


def test_trees(rows, variables):
    for split, metric in (("label", "cci"), ("label", "purity"), ("label", "validity"), ("feature", "purity"), ("feature", "cci"), ("feature", "validity")):
        t = tree.FuzzyTree(variables, CLASSES, max_rules=6, min_improvement=0.0, metric=metric, split=split).fit(rows, "y")
        assert t.score(rows, "y") > 0.5, (split, metric)
        p = np.array([r["probabilities"] for r in t.predict_proba(rows).collect()])
        assert np.allclose(p.sum(axis=1), 1)
        assert len(t.predict_all_leaves_matrix(rows).first()["leaf_memberships"]) == t.stats()["leaves"]
        assert t.predict_with_path(rows).where("degree > 0").count() > 0 and "root" in t.text()
    before = t.stats()["leaves"]
    assert t.prune(10).stats()["leaves"] <= before
    assert tree.gini([1, 1]) == 0.5 and tree.majority([1, 2, 2]) == 1 and tree.cci(50, 75, 100) == 0.5


def test_temporal(spark, rows, variables):
    df = rows.withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)"))
    windows = ((0, 7), (8, 15), (16, 23))
    timed = temporal.time_moments(df, "at", windows)
    assert timed.groupBy("time").count().count() == 3
    assert temporal.classify(df, "at", (0, 0)).count() == 10
    f = temporal.conditional_frequencies(timed, variables).collect()
    assert max(r["frequency"] for r in f) == pytest.approx(1, abs=1e-5)
    found = temporal.temporal_variables(timed, variables)
    assert found[0].time_steps == 3
    bases = [RuleBase(tuple(v.fix(t) for v in found), (Rule((0, -1, -1), 0), Rule((1, -1, -1), 1), Rule((2, -1, -1), 2)), CLASSES, 1) for t in range(3)]
    whole = temporal.TemporalRuleBase(tuple(bases))
    got = whole.predict(timed).collect()
    alone = {r["k"]: r["predicted"] for t in range(3) for r in bases[t].predict(timed.where(F.col("time") == t)).collect()}
    fired = {r["k"] for r in whole.firing(timed).where(F.array_max("firing") > 0).collect()}
    assert all(r["predicted"] == alone[r["k"]] for r in got if r["k"] in fired)
    assert set(temporal.evaluate(timed, whole, "y")) == {None, 0, 1, 2}
    train, test = temporal.assemble(df, "at", windows, "k")
    assert train.count() + test.count() == 240
    assert "time step 0" in whole.text() and len(whole.rules()) == 9
    with pytest.raises(Exception):
        temporal.time_moments(df, "at", ((0, 1),), strict=True).collect()


def test_text_forms(variables, base):
    again = text_format.load_variables(text_format.variables_text(variables))
    assert [s.corners for v in again for s in v.sets] == [pytest.approx(s.corners) for v in variables for s in v.sets]
    text = "Rules for consequent: Class0\nIF A IS Low AND B IS Low WITH DS 0.85, ACC 0.90, WGHT 0.95\nRules for consequent: Class1\nIF C IS High (MOD Very) WITH DS 0.5, ACC 0.7\n"
    b = text_format.load_rules(text, variables)
    assert b.classes == ("Class0", "Class1") and b.rules[0].weight == 0.95 and b.rules[1].modifiers[2] == 2.0
    assert text_format.load_rules(b.text(), variables).rules == b.rules
    assert text_format.load_rules_json(text_format.rules_json(b)).rules == b.rules
    assert "tabular" in text_format.rules_latex(b) and text_format.without_parentheses("a (b) c") == "a c"
    crisp = text_format.load_variables("$$$ Linguistic variable: T $Categorical\nred\n2\n")
    assert [s.value for s in crisp[0].sets] == ["red", 2]
    g = text_format.load_variables("$$$ Linguistic variable: T\nLow;0,1;gauss;0.2,0.1")[0][0]
    assert (g.mean, g.spread) == (0.2, 0.1)


def test_files(spark, tmp_path, variables):
    text_format.write_text(spark, text_format.variables_text(variables), str(tmp_path / "p"))
    assert len(text_format.load_variables(text_format.read_text(spark, str(tmp_path / "p")))) == 3
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert text_format.read_table(spark, str(tmp_path / "t.csv"), "csv").first()["a"] == 1


def test_graph(spark, base, variables):
    b = RuleBase(tuple(variables), (Rule((0, 1, -1), 0), Rule((0, -1, 2), 0)), ("0",))
    assert rule_graph.most_popular(b, spark) == (0, 0) and rule_graph.popular_rules(b, spark) == [0, 1]
    assert rule_graph.connections(b, spark).where("from_variable = 0 and to_variable = 1").first()["weight"] == 0.5
    assert rule_graph.rule_table(b, spark).columns == ["rule", "A", "B", "C", "class", "score"]
    assert "<edge" in rule_graph.gexf(b, spark)


def test_cognitive_maps(spark):
    m = cognitive.CognitiveMap(np.array([[0, 1.0], [-1.0, 0]]), ["a", "b"])
    assert m.set_and_step([1.0, 0.0]).tolist() == [0, 1]
    assert m.set_and_step([0.0, 1.0]).tolist() == [1, 0]  # a negative state is on
    got = {r["node"]: r["value"] for r in cognitive.step_frame(m.edges(spark), spark.createDataFrame([("a", 1.0), ("b", 0.0)], "node string, value double")).collect()}
    assert got == {"a": 0.0, "b": 1.0}
    assert cognitive.threshold_modules(np.array([0.5, 0.1, -0.01]), 0.2).tolist() == [True, False, True]
    still = cognitive.CognitiveMap(np.zeros((2, 2)))
    assert cognitive.attractors(still, 50, 3)[0]["period"] == 1 and "period 1" in cognitive.attractors_report(cognitive.attractors(still, 50, 3))
    assert (m + m).weights[0, 1] == 2


def test_stability(spark, rows, variables):
    s = stability.Stabilizer(lambda: evolve.FuzzyRulesEstimator(FEATURES, 4, 1, variables=variables), "k").generate(rows, "y", 2, how=evolve.Search(n_gen=1, pop_size=4))
    assert s.counts(spark).agg(F.max("n")).first()[0] <= 2
    assert s.usage_by_variable(spark).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert "refits" in s.report(spark) and stability.add_dicts({"a": 1}, {"a": 2, "b": 3}) == {"a": 3, "b": 3}


def test_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    v = fit_partitions(batch, ["value"])
    b = RuleBase(tuple(v), (Rule((0,), 0), Rule((1,), 1), Rule((2,), 2)), CLASSES, 1)
    batch.write.parquet(str(tmp_path / "in"))
    stream = scoring.read_stream(spark, str(tmp_path / "in"), batch)
    q = scoring.score(stream, b).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["winner"] for r in spark.table("scored").collect()) == sorted(r["winner"] for r in b.predict(batch).collect())
    q = scoring.winner_counts(stream, b, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == batch.count()


def test_growth_ends_where_nothing_covers_enough(rows, variables):
    t = tree.FuzzyTree(variables, CLASSES, max_rules=8, min_improvement=0.0, coverage_threshold=0.9).fit(rows, "y")
    assert not t.root.children and 0 < t.best_possible_coverage(rows, "y") < 0.9
    grown = tree.FuzzyTree(variables, CLASSES).grow(rows, "y", [((0, 0),), ((0, 0), (1, 1))])
    assert grown.stats() == {"nodes": 3, "leaves": 1, "depth": 2} and grown.predict(rows).count() == 240
    with pytest.raises(ValueError):
        grown.grow(rows, "y", [((0, 0), (1, 1))])


def test_rulewise_column_exchange(rows, base):
    assert validation.rulewise_column_permutation_test(rows, base, "y", "k", 4) == [pytest.approx(0.2)] * 3
    p = validation.rulewise_column_permutation_test(rows, base, "y", "k", 2, whole_rows=False)
    assert len(p) == 3 and all(0 < x <= 1 for x in p)


def test_trees_grow_on_counted_rows(rows, variables, monkeypatch):
    """Rows of a class with the same memberships are worked out and counted once, not in every iteration."""
    seen, split = [], tree.FuzzyTree._best_split
    monkeypatch.setattr(tree.FuzzyTree, "_best_split", lambda self, r: (seen.append(r.count()), split(self, r))[1])
    make = lambda df: tree.FuzzyTree(variables, CLASSES, max_rules=6, min_improvement=0.0).fit(df, "y")
    one, three = make(rows), make(rows.unionByName(rows).unionByName(rows))
    assert max(seen) <= rows.count() and len(set(seen)) == 1
    assert [n.path for n in three.root.walk()] == [n.path for n in one.root.walk()] and three.rows == 3 * one.rows
    for a, b in zip(one.root.walk(), three.root.walk(), strict=True):
        assert [3 * s for s in a.sums] == pytest.approx(list(b.sums))
