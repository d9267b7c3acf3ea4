"""The rating of whole populations against a plain computation, and searches that go on from a saved state."""

import numpy as np
import pytest

from lumifuzz.functions.membership import Kind, Trapezoid, Variable
from lumifuzz.operators import evolve, rule_quality, stability
from lumifuzz.operators.rules import Rule, RuleBase

FEATURES, CLASSES = ["a", "b"], ("x", "y", "z")


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    rows = [(i, float(a), float(b), CLASSES[int(3 * a * b) if a * b < 1 else 2]) for i, (a, b) in enumerate(draw.random((300, 2)))]
    rows += [(900, None, 0.5, "x"), (901, float("nan"), 0.5, "y"), (902, 0.2, 0.3, None)]
    return spark.createDataFrame(rows, "k long, a double, b double, y string").repartition(3).persist()


def individuals(kind, n=5, seed=2):
    draw = np.random.default_rng(seed)
    genes = evolve.PartitionGenes((("a", 0.0, 1.0), ("b", 0.0, 1.0)), 3, kind)
    out = []
    for i in range(n):
        rules = tuple({Rule((int(draw.integers(-1, 3)), int(draw.integers(0, 3))), int(draw.integers(0, 3)), weight=float(draw.random())) for _ in range(6)})
        out.append(RuleBase(genes.decode(draw.integers(0, 100, len(genes.high()))), rules, CLASSES, i % 3))
    return out


def plain(table, base, vote):
    """Confusion table of one base, row by row, from the memberships of the sets themselves."""
    rows = [r for r in table.collect() if r["y"] is not None]
    y = np.array([CLASSES.index(r["y"]) for r in rows])
    strengths = []
    for r in base.rules:
        both = np.ones((len(rows), 2))
        for v, s, _ in r.parts():
            x = np.array([np.nan if row[FEATURES[v]] is None else row[FEATURES[v]] for row in rows], float)
            m = np.nan_to_num(base.variables[v][s].at(np.clip(x, 0.0, 1.0)), nan=0.0)
            both *= m if m.ndim == 2 else np.stack([m, m], axis=1)
        strengths.append(both.mean(axis=1))
    f = np.array(strengths)
    score = [f[i][y == r.consequent].sum() / len(y) * (f[i][y == r.consequent].sum() / f[i].sum() if f[i].sum() else 0) for i, r in enumerate(base.rules)]
    factor = np.array([1.0 if base.ds_mode == 1 else r.weight if base.ds_mode == 2 else score[i] for i, r in enumerate(base.rules)])
    own = np.array([r.consequent for r in base.rules])
    if vote == "winner":
        said = own[(f * factor[:, None]).argmax(axis=0)]
    else:
        w = factor if base.ds_mode == 2 else np.ones(len(own))
        said = np.array([(f * w[:, None])[own == c].sum(axis=0) for c in range(3)]).argmax(axis=0)
    counts = {}
    for a, b in zip(y.tolist(), said.tolist(), strict=True):
        counts[a, b] = counts.get((a, b), 0) + 1
    return counts, score


@pytest.mark.parametrize("kind", [Kind.T1, Kind.T2])
@pytest.mark.parametrize("vote", ["winner", "additive"])
def test_individuals_with_partitions_of_their_own(table, kind, vote, monkeypatch):
    bases = [*individuals(kind), None]
    population = evolve.Population(table, None, "y", CLASSES, features=FEATURES, kind=kind)
    values, rated = population.rate(bases, vote=vote)
    monkeypatch.setattr(evolve, "BUDGET", 1)
    assert population.rate(bases, vote=vote)[0] == values
    population.uncache()
    assert values[-1] == -1.0 and rated[-1] is None
    for b, v, scored in zip(bases[:-1], values[:-1], rated[:-1], strict=True):
        counts, score = plain(table, b, vote)
        assert v == pytest.approx(rule_quality.matthews(counts), abs=1e-12)
        assert [r.score for r in scored.rules] == pytest.approx(score)


def test_additive_votes_ask_for_no_sums(table, monkeypatch):
    population = evolve.Population(table, None, "y", CLASSES, features=FEATURES)
    monkeypatch.setattr(population, "_sums", lambda keys: pytest.fail("sums were asked for"))
    assert all(-1 <= v <= 1 for v in population.rate(individuals(Kind.T1), vote="additive", scores=False)[0])
    population.uncache()
    with pytest.raises(ValueError):
        population.rate([], vote="loudest")


def test_sums_of_rules_are_remembered(table):
    sets = tuple(Trapezoid(n, c, domain=(0, 1)) for n, c in (("Low", (0, 0, 0.2, 0.6)), ("High", (0.4, 0.7, 1, 1))))
    variables = (Variable("a", sets), Variable("b", sets))
    population = evolve.Population(table, variables, "y", CLASSES)
    one = RuleBase(variables, (Rule((0, 1), 0), Rule((1, -1), 2)), CLASSES)
    first = population.rate([one])
    assert len(population.known) == 2
    again = population.rate([one, RuleBase(variables, (Rule((0, 1), 0), Rule((1, 1), 1)), CLASSES)])
    assert again[0][0] == first[0][0] and len(population.known) == 3
    population.uncache()


def test_a_search_over_partitions_improves(table):
    one = evolve.FuzzyRulesEstimator(FEATURES, 4, 2, optimise_partitions=True, vote="additive").fit(table, "y", evolve.Search(n_gen=5, pop_size=12, seed=3))
    assert one.history == sorted(one.history) and one.history[-1] > one.history[0]
    assert one.base.rules and one.base.variables[0].domain


def test_a_search_cut_in_two_is_the_search_in_one_piece(spark, table, tmp_path):
    sets = tuple(Trapezoid(n, c, domain=(0, 1)) for n, c in (("Low", (0, 0, 0.2, 0.6)), ("High", (0.4, 0.7, 1, 1))))
    variables = (Variable("a", sets), Variable("b", sets))

    def fit(n_gen, folder):
        return evolve.FuzzyRulesEstimator(FEATURES, 4, 2, variables=variables).fit(table, "y", evolve.Search(n_gen=n_gen, pop_size=8, patience=0), checkpoints=2, folder=folder)

    whole = fit(6, None)
    folder = f"file://{tmp_path}/search"
    fit(4, folder)
    assert evolve.Checkpoints(spark, folder).last().generation == 4
    rest = fit(6, folder)
    assert rest.history == whole.history and rest.base == whole.base
    # finished: nothing is left to do
    assert fit(6, folder).history == whole.history
    with pytest.raises(ValueError):
        evolve.FuzzyRulesEstimator(FEATURES, 5, 2, variables=variables).fit(table, "y", evolve.Search(n_gen=1, pop_size=8), folder=folder)


def test_rows_that_agree_are_one_row_with_their_number(table):
    """Memory and time of a generation are those of the different rows."""
    sets = tuple(Trapezoid(n, c, domain=(0, 1)) for n, c in (("Low", (0, 0, 0.2, 0.6)), ("High", (0.4, 0.7, 1, 1))))
    variables = (Variable("a", sets), Variable("b", sets))
    one = RuleBase(variables, (Rule((0, 1), 0), Rule((1, -1), 2), Rule((-1, 0), 1)), CLASSES)
    many = table.unionByName(table).unionByName(table)
    first, copied = evolve.Population(table, variables, "y", CLASSES), evolve.Population(many, variables, "y", CLASSES)
    assert copied.rows.count() == first.rows.count() < first.n and copied.n == 3 * first.n
    assert copied.rate([one])[0] == pytest.approx(first.rate([one])[0])
    first.uncache(), copied.uncache()


def test_refits_read_the_rows_once(spark, table, monkeypatch):
    """The same rules and accuracies as refits to the rows of each split themselves."""
    sets = tuple(Trapezoid(n, c, domain=(0, 1)) for n, c in (("Low", (0, 0, 0.2, 0.6)), ("High", (0.4, 0.7, 1, 1))))
    variables = (Variable("a", sets), Variable("b", sets))
    make = lambda: evolve.FuzzyRulesEstimator(FEATURES, 4, 2, variables=variables, classes=CLASSES)
    how = evolve.Search(n_gen=2, pop_size=6)
    seen = []
    fit = evolve.FuzzyRulesEstimator.fit
    monkeypatch.setattr(evolve.FuzzyRulesEstimator, "fit", lambda self, df, *a, **b: (seen.append(b.get("weight")), fit(self, df, *a, **b))[1])
    counted = stability.Stabilizer(make, "k").generate(table, "y", 3, how=how)
    assert seen == ["_train0", "_train1", "_train2"]
    monkeypatch.setattr(evolve.FuzzyRulesEstimator, "reads", lambda self: None)
    plain_ = stability.Stabilizer(make, "k").generate(table, "y", 3, how=how)
    assert seen[3:] == [None] * 3
    assert counted.accuracies == pytest.approx(plain_.accuracies)
    for a, b in zip(counted.bases, plain_.bases, strict=True):
        assert [(r.antecedents, r.consequent) for r in a.rules] == [(r.antecedents, r.consequent) for r in b.rules]
        assert [(r.score, r.accuracy) for r in a.rules] == [pytest.approx((r.score, r.accuracy)) for r in b.rules]
