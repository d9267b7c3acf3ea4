"""The registered queries of the fuzzy operators and, where SQL can express them, their DuckDB equivalents (formulae in oracles, written out apart from the operators)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Gaussian, IntervalTrapezoid, Kind, Trapezoid, Variable
from lumifuzz.operators import centroids, cognitive, conformal, evolve, mining, rule_graph, rule_quality, stability, temporal, validation
from lumifuzz.operators.partitions import crisp, even, fit_partitions, quantiles, validate_partitions
from lumifuzz.operators.rules import MamdaniRule, Rule, RuleBase, infer_interval, infer_type1, rule_base
from lumifuzz.operators.tree import FuzzyTree, gini
from lumifuzz.plans import oracles as o
from lumifuzz.sources import text_format
from lumifuzz.streaming import state

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABEL, CLASSES = "l_returnflag", ("A", "N", "R")
#: (sets by feature, class place)
RULES = (((0, -1, -1, -1), 0), ((-1, 0, 2, -1), 0), ((2, 2, -1, -1), 1), ((1, -1, -1, 2), 1), ((-1, 1, 0, -1), 2), ((0, -1, 1, 0), 2))
WEIGHTS = (0.9, 0.4, 0.75, 0.6, 0.5, 1.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(modifiers: bool = False) -> tuple[Rule, ...]:
    out = []
    for i, (a, c) in enumerate(RULES):
        m = tuple((0.5, 2.0, 3.0)[(i + j) % 3] if x >= 0 else -1.0 for j, x in enumerate(a)) if modifiers else None
        out.append(Rule(a, c, m, weight=WEIGHTS[i]))
    return tuple(out)


def base_of(variables: Sequence[Variable], **options) -> RuleBase:
    modifiers = options.pop("modifiers", False)
    return RuleBase(tuple(variables), _rules(modifiers), CLASSES, **({"ds_mode": 1} | options))


def fitted(spark: SparkSession, sf_dir: str, shape: str = "trapezoid", kind: Kind = Kind.T1, **options) -> tuple[DataFrame, RuleBase]:
    df = table(spark, sf_dir, "lineitem")
    return df, base_of(fit_partitions(df, FEATURES, 3, shape, kind), **options)


# partitions and memberships


_PARAMS = " union all ".join(f"select '{x}' as feature, unnest(quantile_cont({x}, {o.SIX})) as value, unnest(range(6)) as place from lineitem" for x in o.LETTERS.values())


@query(f"select feature, cast(place as bigint) as place, round(value, 6) as value from ({_PARAMS})")
def t1_partition_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles(table(spark, sf_dir, "lineitem"), FEATURES, even(6))
    return spark.createDataFrame([(f, i, v) for f, values in found.items() for i, v in enumerate(values)], "feature string, place long, value double").withColumn("value", F.round("value", 6))


def _memberships(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    variables = fit_partitions(df, FEATURES, 3, shape)
    return df.groupBy(LABEL).agg(*(F.round(F.avg(F.expr(t)), 6).alias(f"mu_{i}_{j}") for i, v in enumerate(variables) for j, t in enumerate(v.texts())))


def _memberships_sql(count: int, *options) -> str:
    return f"with {o.memberships(*options)} select l_returnflag, {o.averages(count)} from m group by l_returnflag"


@query(_memberships_sql(3))
def t1_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "trapezoid")


@query(_memberships_sql(3, o.TRIANGLES, o.QUARTERS, 5))
def triangular_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "triangular")


@query(_memberships_sql(3, o.BELLS, o.THREE, 3))
def gaussian_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "gaussian")


@query(_memberships_sql(4, o.FOUR_TRAPEZOIDS, o.EIGHT, 8))
def simple_trapezoid_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "simple_trapezoid")


@query(_memberships_sql(4, o.FOUR_BELLS, o.EIGHT, 8))
def simple_gaussian_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "simple_gaussian")


@query(_memberships_sql(3, o.THREE_TRAPEZOIDS, o.FIVE, 5))
def three_trapezoid_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir, "three_trapezoid")


#: Whether neighbouring sets differ, without chance: by how far the mean distance of their memberships is from the mean distance of any two of both sets' memberships, each over the root of the product of variances.
_DISTINCT_PAIRS = " union all ".join(
    f"select '{x}' as feature, {j} as pair, {v}{j} as one, {v}{j + 1} as other from m" for v, x in o.LETTERS.items() for j in range(2)
)
_DISTINCT = f"""pr as ({_DISTINCT_PAIRS}), se as (select feature, pair, avg(abs(one - other)) / sqrt(var_samp(one) * var_samp(other)) as seen from pr group by 1, 2),
 po as (select feature, pair, v, row_number() over (partition by feature, pair order by v) as r, count(*) over (partition by feature, pair) as n from (select feature, pair, one as v from pr union all select feature, pair, other from pr)),
 nu as (select feature, pair, 2 * sum((2.0 * r - n - 1) * v) / (max(n) * (max(n) - 1.0)) / var_samp(v) as expected from po group by 1, 2),
 di as (select feature, min(abs(seen / expected - 1)) > 0.2 as "distinct" from se join nu using (feature, pair) group by feature)"""
_CHECKS = " union all ".join(
    f"""select '{x}' as feature, max(cast({v}0 >= 1 - 1e-9 as int) + cast({v}1 >= 1 - 1e-9 as int) + cast({v}2 >= 1 - 1e-9 as int)) <= 1 as one_full, min(greatest({v}0, {v}1, {v}2)) > 0 as covered,
 (select {v}[1] <= {v}[2] and {v}[5] <= {v}[6] and {v}[1] < {v}[6] from q) as ordered, least(max({v}0), max({v}1), max({v}2)) > 0.99 as fuzzy_numbers from m"""
    for v, x in o.LETTERS.items()
)


@query(f"""with {o.memberships()}, {_DISTINCT}, ch as ({_CHECKS}) select ch.*, "distinct", one_full and covered and ordered and fuzzy_numbers and "distinct" as valid from ch join di using (feature)""")
def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six validity properties and the verdict."""
    df = table(spark, sf_dir, "lineitem")
    names = ("one_full", "covered", "ordered", "fuzzy_numbers", "distinct", "valid")
    found = validate_partitions(df, fit_partitions(df, FEATURES))
    return spark.createDataFrame([(f, *(bool(x[n]) for n in names)) for f, x in found.items()], "feature string, " + ", ".join(f"{n} boolean" for n in names))


@query("select c_mktsegment as value, count(*) as n, round(sum(c_acctbal), 2) as acctbal from customer where c_mktsegment is not null group by c_mktsegment")
def categorical_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    v = crisp(df, "c_mktsegment")
    sums = df.agg(*(F.struct(F.lit(s.name).alias("value"), F.sum(F.expr(t)).cast("long").alias("n"), F.round(F.sum(F.expr(t) * F.col("c_acctbal")), 2).alias("acctbal")).alias(f"s{i}") for i, (s, t) in enumerate(zip(v.sets, v.texts(), strict=True))))
    return sums.select(F.explode(F.array(*sums.columns)).alias("x")).select("x.*")


@query("select c_mktsegment as value, count(*) as n, count(*) as least_n from customer where c_mktsegment is not null group by c_mktsegment")
def categorical_t2_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    v = crisp(df, "c_mktsegment", Kind.T2)
    sums = df.agg(*(F.struct(F.lit(s.name).alias("value"), F.sum(F.expr(hi)).cast("long").alias("n"), F.sum(F.expr(lo)).cast("long").alias("least_n")).alias(f"s{i}") for i, (s, (lo, hi)) in enumerate(zip(v.sets, v.bounds(), strict=True))))
    return sums.select(F.explode(F.array(*sums.columns)).alias("x")).select("x.*")


def _bounds(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    variables = fit_partitions(df, FEATURES, 3, shape, Kind.T2)
    return df.agg(*(F.round(F.avg(F.expr(t)), 6).alias(f"{side}_{i}_{j}") for i, v in enumerate(variables) for j, b in enumerate(v.bounds()) for side, t in zip(("lo", "hi"), b, strict=True)))


@query(f"with {o.memberships(**o.INTERVALS)} select {o.averages(3, to='lo_')}, {o.averages(3, 'u', 'hi_')} from m")
def t2_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, "trapezoid")


@query(f"with {o.memberships(o.NARROW_BELLS, o.THREE, 3, more={'u': o.BELLS})} select {o.averages(3, to='lo_')}, {o.averages(3, 'u', 'hi_')} from m")
def t2_gaussian_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, "gaussian")


_REDUCED = "sum(alpha * lo) / sum(alpha) as lo, sum(alpha * hi) / sum(alpha) as hi"


@query(f"""with {o.memberships()}, {o.CUTS}, {o.general('c')}, red as (select value, label, {_REDUCED} from cut_c group by 1, 2)
 select l_discount, count(*) as n, {', '.join(f'round(any_value(r{j}.{side}), 6) as {side}_{j}' for j in range(3) for side in ('lo', 'hi'))} from lineitem, {', '.join(f'red r{j}' for j in range(3))}
 where {' and '.join(f'r{j}.value = l_discount and r{j}.label = {j}' for j in range(3))} group by l_discount""")
def gt2_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    (v,) = fit_partitions(df, ["l_discount"], kind=Kind.GT2, resolution=2)
    return df.groupBy("l_discount").agg(F.count("*").alias("n")).select("l_discount", "n", *(F.round(F.expr(t), 6).alias(f"{side}_{j}") for j, b in enumerate(v.bounds()) for side, t in zip(("lo", "hi"), b, strict=True)))


@query(f"""with {o.memberships()}, {o.CUTS}, {o.general('b')}, red as (select value, label, {_REDUCED} from cut_b group by 1, 2)
 select l_returnflag, label, count(*) as n, round(avg(lo), 4) as lo, round(avg(hi), 4) as hi from lineitem join red on red.value = l_extendedprice group by 1, 2""")
def gt2_wide_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General type-2 sets over a column of any number of values, in closed form."""
    df = table(spark, sf_dir, "lineitem")
    (v,) = fit_partitions(df, ["l_extendedprice"], kind=Kind.GT2, resolution=2)
    each = F.array(*(F.struct(F.lit(j).alias("label"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi")) for j, (lo, hi) in enumerate(v.bounds())))
    # the sets depend on the value alone: each value of a class is worked out once, however many rows have it
    values = df.groupBy(LABEL, "l_extendedprice").agg(F.count("*").alias("n")).select(LABEL, "n", F.inline(each))
    return values.groupBy(LABEL, "label").agg(F.sum("n").alias("n"), *(F.round(F.sum(F.col("n") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), 4).alias(c) for c in ("lo", "hi")))


@query("""select l_returnflag, round(avg(case when l_quantity < 1 or l_quantity > 30 then 0 when l_quantity < 10 then (l_quantity - 1) / 9 when l_quantity <= 20 then 1 else (30 - l_quantity) / 10 end * exp(-power((l_discount - 0.05) / 0.02, 2))), 6) as degree,
 round(avg(least(case when l_quantity < 1 or l_quantity > 30 then 0 when l_quantity < 10 then (l_quantity - 1) / 9 when l_quantity <= 20 then 1 else (30 - l_quantity) / 10 end, exp(-power((l_discount - 0.05) / 0.02, 2)))), 6) as least_degree from lineitem group by l_returnflag""")
def mamdani_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule over explicit sets, with the product and with the least membership."""
    rule = MamdaniRule((("l_quantity", Trapezoid("some", (1, 10, 20, 30))), ("l_discount", Gaussian("about", 0.05, 0.02))), OUTPUT.sets[0])
    return table(spark, sf_dir, "lineitem").groupBy(LABEL).agg(F.round(F.avg(rule.membership()), 6).alias("degree"), F.round(F.avg(rule.membership(F.least)), 6).alias("least_degree"))


# scoring


@query(f"with {o.fired()} select l_returnflag, winner, count(*) as n, round(sum(strength), 6) as strength from w group by 1, 2")
def flagship_winner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return base.explain(df).groupBy(LABEL, "winner").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 6).alias("strength"))


def _array_sums(df: DataFrame, column: str, n: int, prefix: str = "r") -> DataFrame:
    return df.agg(*(F.round(F.sum(F.col(column)[i]), 6).alias(f"{prefix}{i}") for i in range(n)))


@query(f"with {o.fired()} select {o.sums()} from w")
def rule_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return _array_sums(base.firing(df), "firing", len(base))


@query(f"with {o.fired(o.LEASTS)} select {o.sums()} from w")
def rule_firing_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir, tnorm="min")
    return _array_sums(base.firing(df), "firing", len(base))


@query(f"with {o.fired()} select round(sum(f0 * 0.9), 6) as r0, round(sum(f1 * 0.4), 6) as r1, round(sum(f2 * 0.75), 6) as r2, round(sum(f3 * 0.6), 6) as r3, round(sum(f4 * 0.5), 6) as r4, round(sum(f5), 6) as r5 from w")
def weighted_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir, ds_mode=2)
    return _array_sums(base.association(df), "association", len(base))


@query(f"with {o.fired(o.HEDGED)} select {o.sums()} from w")
def hedged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir, modifiers=True)
    return _array_sums(base.firing(df), "firing", len(base))


_SCALED = ", ".join(f"f{i} / nullif(f{i - i % 2} + f{i - i % 2 + 1}, 0) as f{i}" for i in range(6))


@query(f"with {o.fired()}, k as (select {_SCALED} from w) select {', '.join(f'round(sum(coalesce(f{i}, 0)), 6) as r{i}' for i in range(6))} from k")
def scaled_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths over their sum among the rules of a class."""
    df, base = fitted(spark, sf_dir)
    return _array_sums(base.firing(df, scaled=True), "firing", len(base))


_GT2_RULES = ((0, -1, 0), (1, 1, 0), (2, 0, 1), (-1, 2, 1))
#: (rule, class, set of l_discount, set of l_tax); -1: any
_GT2_ROWS = ", ".join(f"({i}, {c}, {x}, {y})" for i, (x, y, c) in enumerate(_GT2_RULES))


@query(f"""with {o.memberships()}, {o.CUTS}, {o.general('c')}, {o.general('d')}, ru(rule, class, lc, ld) as (values {_GT2_ROWS}), pair as (select l_discount as vc, l_tax as vd, count(*) as n from lineitem group by 1, 2),
 fire as (select vc, vd, n, rule, class, al.alpha, coalesce(c.lo, 1) * coalesce(d.lo, 1) as lo, coalesce(c.hi, 1) * coalesce(d.hi, 1) as hi from pair cross join ru cross join al left join cut_c c on c.value = vc and c.label = lc and c.alpha = al.alpha left join cut_d d on d.value = vd and d.label = ld and d.alpha = al.alpha),
 scaled as (select vc, vd, n, rule, alpha, lo / nullif(sum(lo) over (partition by vc, vd, class, alpha), 0) as lo, hi / nullif(sum(hi) over (partition by vc, vd, class, alpha), 0) as hi from fire),
 red as (select vc, vd, any_value(n) as n, rule, (sum(alpha * coalesce(lo, 0)) + sum(alpha * coalesce(hi, 0))) / 2 / sum(alpha) as f from scaled group by vc, vd, rule)
 select cast(rule as bigint) as rule, round(sum(n * f), 4) as firing from red group by rule""")
def gt2_rule_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over general type-2 sets: each alpha cut is scaled by itself, then the cuts are weighted by their alphas."""
    df = table(spark, sf_dir, "lineitem")
    base = RuleBase(tuple(fit_partitions(df, ["l_discount", "l_tax"], kind=Kind.GT2, resolution=2)), tuple(Rule((x, y), c) for x, y, c in _GT2_RULES), ("A", "B"), 1)
    return base.firing(df).select(F.posexplode("firing").alias("rule", "f")).groupBy(F.col("rule").cast("long").alias("rule")).agg(F.round(F.sum("f"), 4).alias("firing"))


@query(f"with {o.fired()} select l_returnflag, {o.SAID} as predicted, count(*) as n from w group by 1, 2")
def winner_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return base.predict(df).groupBy(LABEL, "predicted").agg(F.count("*").alias("n"))


@query(f"with {o.fired()} select l_returnflag, case when strength = 0 then -1 else {o.SAID} end as predicted, count(*) as n from w group by 1, 2")
def winner_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir, allow_unknown=True)
    return base.predict(df).groupBy(LABEL, "predicted").agg(F.count("*").alias("n"))


@query(f"with {o.fired()} select {o.sums(o.CLASS_BEST, 'c')} from w")
def class_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return _array_sums(base.class_membership(df), "memberships", 3, "c")


@query(f"with {o.fired()}, k as (select {', '.join(f'{x} as k{i}' for i, x in enumerate(o.CLASS_BEST))} from w) select {', '.join(f'round(sum(coalesce(k{i} / nullif(k0 + k1 + k2, 0), 1 / 3.0)), 6) as c{i}' for i in range(3))} from k")
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return _array_sums(base.probabilities(df), "probabilities", 3, "c")


@query(f"with {o.fired()} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, winner, round(strength, 6) as strength from w")
def explain_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its winning rule."""
    df, base = fitted(spark, sf_dir)
    return base.explain(df).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "winner", F.round("strength", 6).alias("strength"))


# quality


def _quality_sql(value: str, **options) -> str:
    return f"with {o.quality(**options)} select cast(rule as bigint) as rule, round({value}, 6) as value from s"


_T2 = {"rules": o.INTERVAL_PRODUCTS, **o.INTERVALS}


def _values(spark: SparkSession, values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "rule long, value double").withColumn("value", F.round("value", 6))


@query(_quality_sql("t / n"))
def antecedent_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.antecedent_support(*fitted(spark, sf_dir), LABEL))


@query(_quality_sql(o.SUPPORT))
def rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.rule_support(*fitted(spark, sf_dir), LABEL))


@query(_quality_sql(o.CONFIDENCE))
def rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.rule_confidence(*fitted(spark, sf_dir), LABEL))


@query(_quality_sql(f"({o.SUPPORT}) * {o.CONFIDENCE}"))
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.dominance(*fitted(spark, sf_dir), LABEL))


@query(_quality_sql(o.SUPPORT, **_T2))
def t2_rule_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.rule_support(*fitted(spark, sf_dir, kind=Kind.T2), LABEL))


@query(_quality_sql(o.CONFIDENCE, **_T2))
def t2_rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, rule_quality.rule_confidence(*fitted(spark, sf_dir, kind=Kind.T2), LABEL))


_AUX = " union all ".join(f"select cast({i} as bigint) as rule, l_returnflag as class, sum(f{i}) as s, (select count(*) from w) as n, (select sum(f{i}) from w) as t from w group by l_returnflag" for i in range(6))


@query(f"with {o.fired()} select rule, class, round(s / n, 6) as support, round(coalesce(s / nullif(t, 0), 0), 6) as confidence from ({_AUX})")
def aux_support_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    rows = [(i, CLASSES[c], s, k) for i, row in enumerate(rule_quality.by_class(df, base, LABEL)) for c, (s, k, _) in enumerate(row)]
    return spark.createDataFrame(rows, "rule long, class string, support double, confidence double").withColumns({c: F.round(c, 6) for c in ("support", "confidence")})


_ACCURACY = "a as (select r.rule, coalesce(avg(case when y = r.class then 1.0 when y is not null then 0.0 end), 0) as accuracy from (select rule, class from s) r left join w on w.winner = r.rule group by 1)"


@query(f"with {o.quality()}, {_ACCURACY} select cast(rule as bigint) as rule, round(accuracy, 6) as value from a")
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return _values(spark, [r.accuracy for r in rule_quality.with_accuracy(df, base, LABEL).rules])


@query(f"with {o.fired()}, {o.CONFUSION} select * from k")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.confusion(*fitted(spark, sf_dir), LABEL)


@query(f"with {o.fired()}, {o.CONFUSION}, {o.MERIT} select round(accuracy, 6) as accuracy, round(mcc, 6) as mcc from merit")
def mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rule_quality.classification(*fitted(spark, sf_dir), LABEL)
    return spark.createDataFrame([(got["accuracy"], got["mcc"])], "accuracy double, mcc double").withColumns({c: F.round(c, 6) for c in ("accuracy", "mcc")})


_SCORED = f"{o.quality()}, {_ACCURACY}, sc as (select s.rule, class, s / n as support, {o.CONFIDENCE} as confidence, s / n * {o.CONFIDENCE} as score, accuracy from s join a on a.rule = s.rule)"
#: The rules with one of them repeated, as a matrix.
MATRIX, CONSEQUENTS = [list(a) for a, _ in RULES] + [list(RULES[2][0])], [c for _, c in RULES] + [RULES[2][1]]
_ANTECEDENTS = "(case rule " + " ".join(f"when {i} then '{','.join(map(str, a))}'" for i, (a, _) in enumerate(RULES)) + " end)"


@query(f"with {_SCORED} select {_ANTECEDENTS} as antecedents, substr('ANR', class + 1, 1) as class, round(support, 6) as support, round(confidence, 6) as confidence, round(score, 6) as score, round(accuracy, 6) as accuracy, case rule when 0 then 0.9 when 1 then 0.4 when 2 then 0.75 when 3 then 0.6 when 4 then 0.5 else 1.0 end::double as weight from sc where score >= 0.008 and accuracy <> 0")
def evaluated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base from a matrix that repeats a rule: without the repeat, evaluated, and without rules that score too little."""
    df = table(spark, sf_dir, "lineitem")
    base = replace(rule_base(MATRIX, CONSEQUENTS, fit_partitions(df, FEATURES), [*WEIGHTS, WEIGHTS[2]], CLASSES), ds_mode=1)
    found = rule_quality.full_evaluation(df, base, LABEL).purged(0.008).frame(spark)
    return found.select(F.concat_ws(",", F.transform("antecedents", lambda a: a.cast("string"))).alias("antecedents"), "class", *(F.round(c, 6).alias(c) for c in ("support", "confidence", "score", "accuracy")), "weight")


@query(f"with {_SCORED}, k as (select max(score) filter (rule = 0) as s0, max(score) filter (rule = 1) as s1, max(score) filter (rule = 2) as s2, max(score) filter (rule = 3) as s3, max(score) filter (rule = 4) as s4, max(score) filter (rule = 5) as s5 from sc) select {', '.join(f'round(sum(f{i} * s{i}), 6) as r{i}' for i in range(6))} from w, k")
def association_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firing strengths times the rules' dominance."""
    df, base = fitted(spark, sf_dir)
    return _array_sums(rule_quality.association_degrees(df, base, LABEL), "association", len(base))


@query(f"with {_SCORED}, g as (select count(*) as n, sum(case rule when 0 then 1 when 5 then 3 else 2 end) as used from sc where score > 0.01) select round(1 - used / (n * 4.0), 6) as economy, round(n / 6.0, 6) as effective from g")
def rule_economy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    scored = rule_quality.scored(df, base, LABEL)
    return spark.createDataFrame([(rule_quality.size_antecedents(scored, 0.01), rule_quality.effective_rules(scored, 0.01))], "economy double, effective double").withColumns({c: F.round(c, 6) for c in ("economy", "effective")})


_PER_CLASS = """c as (select z, coalesce(sum(n) filter (actual = z and predicted = z), 0) as hit, coalesce(sum(n) filter (predicted = z), 0) as said, coalesce(sum(n) filter (actual = z), 0) as there from k, (select unnest([0, 1, 2]) as z) group by z),
 pr as (select coalesce(hit / nullif(said, 0), 0) as p, coalesce(hit / nullif(there, 0), 0) as r from c), av as (select avg(p) as p, avg(r) as r, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) as f from pr)"""


@query(f"with {o.fired()}, {o.CONFUSION}, {o.MERIT}, {_PER_CLASS} select unnest(['accuracy_score', 'matthews_corrcoef', 'precision_score', 'recall_score', 'f1_score', 'mcc_loss']) as metric, round(unnest([accuracy, mcc, p, r, f, mcc]), 6) as value from merit, av")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    judge = rule_quality.Evaluator(base, LABEL)
    rows = [(m, judge.get_metric(m, df)) for m in ("accuracy_score", "matthews_corrcoef", "precision_score", "recall_score", "f1_score")]
    return spark.createDataFrame([*rows, ("mcc_loss", rule_quality.mcc_loss(df, base, LABEL))], "metric string, value double").withColumn("value", F.round("value", 6))


@query(f"with {o.quality()}, k as (select class, sum(case when y = class then 1 else 0 end) as k from w, (select unnest([0, 1, 2]) as class) group by class) select cast(rule as bigint) as rule, round(s / k - (t - s) / (n - k), 6) as value from s join k on k.class = s.class")
def quality_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean firing strength on a rule's class less that on the others."""
    return _values(spark, validation.rule_quality_gaps(*fitted(spark, sf_dir), LABEL))


def _kept_base(spark: SparkSession, sf_dir: str) -> RuleBase:
    """The rules that score enough on the data."""
    df, base = fitted(spark, sf_dir)
    return rule_quality.full_evaluation(df, base, LABEL).purged(0.008)


_KEPT = f"{_SCORED}, kept as (select rule from sc where score >= 0.008 and accuracy <> 0)"
_TEXTS = ("IF l_quantity IS Low", "IF l_extendedprice IS Low AND l_discount IS High", "IF l_quantity IS High AND l_extendedprice IS High", "IF l_quantity IS Medium AND l_tax IS High", "IF l_extendedprice IS Medium AND l_discount IS Low", "IF l_quantity IS Low AND l_discount IS Medium AND l_tax IS Low")


@query(f"with {_KEPT}, t(rule, text, class) as (values {', '.join(f'({i}, {x!r}, {c!r})' for i, (x, c) in enumerate(zip(_TEXTS, 'AANNRR', strict=True)))}) select text, class from t join kept using (rule)")
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that score enough, as text without their scores."""
    base = _kept_base(spark, sf_dir)
    return spark.createDataFrame([(base.rule_text(replace(r, score=None)), base.classes[r.consequent]) for r in base.rules], "text string, class string")


@query(f"with {o.quantiles()}, g as (select a[1] + (a[6] - a[1]) * i / 10.0 as xa, a from q, range(11) as r(i)) select round(xa, 6) as value, unnest(['Low', 'Medium', 'High']) as label, round(unnest([{', '.join(o._over(o.TRAPEZOIDS, 'a'))}]), 6) as membership from g")
def sampled_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind a plot of a variable's sets."""
    (v,) = fit_partitions(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    return spark.createDataFrame([(x, label, low) for x, label, low, _ in v.sampled(11)], "value double, label string, membership double").withColumns({c: F.round(c, 6) for c in ("value", "membership")})


# regression

OUTPUT = Variable("risk", (Trapezoid("Low", (0.0, 0.0, 0.2, 0.5), domain=(0.0, 1.0)), Trapezoid("Medium", (0.2, 0.4, 0.6, 0.8), domain=(0.0, 1.0)), Trapezoid("High", (0.5, 0.8, 1.0, 1.0), domain=(0.0, 1.0))))


@query(f"with {o.fired()}, {o.OUTPUT}, v as (select l_returnflag, (f0 * k0 + f1 * k0 + f2 * k1 + f3 * k1 + f4 * k2 + f5 * k2) / nullif(f0 + f1 + f2 + f3 + f4 + f5, 0) as v from w, oc) select l_returnflag, count(v) as n, round(avg(v), 6) as inferred from v group by l_returnflag")
def t1_centroid_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return infer_type1(base, OUTPUT, df).groupBy(LABEL).agg(F.count("inferred").alias("n"), F.round(F.avg("inferred"), 6).alias("inferred"))


@query(f"with {o.type_reduced()} select l_returnflag, round(avg(lo), 6) as lo, round(avg(hi), 6) as hi from e group by l_returnflag")
def t2_centroid_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir, kind=Kind.T2)
    return infer_interval(base, OUTPUT, df).groupBy(LABEL).agg(F.round(F.avg("inferred.lo"), 6).alias("lo"), F.round(F.avg("inferred.hi"), 6).alias("hi"))


#: Points of l_discount from its least value to its greatest, a thousandth apart, with the memberships of its three sets.
_DISCOUNTS = f"""pt as (select c[1] + i * 0.001 as xc, c from q, range(10000) as r(i) where c[1] + i * 0.001 < c[6])"""


@query(f"with {o.quantiles()}, {_DISCOUNTS}, mc as (select xc, {', '.join(f'{t} as m{j}' for j, t in enumerate(o._over(o.TRAPEZOIDS, 'c')))} from pt) " + " union all ".join(f"select '{name}' as label, round(sum(xc * m{j}) / sum(m{j}), 6) as centroid from mc" for j, name in enumerate(("Low", "Medium", "High"))))
def output_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the sets that were fitted to a column."""
    (v,) = fit_partitions(table(spark, sf_dir, "lineitem"), ["l_discount"])
    return spark.createDataFrame([(s.name, centroids.set_centroid(s)) for s in v.sets], "label string, centroid double").withColumn("centroid", F.round("centroid", 6))


_DISCOUNT_INTERVAL = f"{o.quantiles()}, {_DISCOUNTS}, o as (select xc as z, {o._over(o.INNER, 'c')[1]} as low, {o._over(o.TRAPEZOIDS, 'c')[1]} as high from pt)"


@query(f"select * from (with {_DISCOUNT_INTERVAL}, {o.settled(True)} select round(y, 6) as lo from y10), (with {_DISCOUNT_INTERVAL}, {o.settled(False)} select round(y, 6) as hi from y10)")
def interval_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of the centroid of an interval set that was fitted to a column."""
    (v,) = fit_partitions(table(spark, sf_dir, "lineitem"), ["l_discount"], kind=Kind.T2)
    return spark.createDataFrame([tuple(map(float, centroids.interval_centroid(v[1])))], "lo double, hi double").withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


# mining


def _mined(spark: SparkSession, sf_dir: str, depth: int, by_class: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    found = mining.mine_itemsets(df, fit_partitions(df, FEATURES), 0.05, depth, LABEL if by_class else None, CLASSES)
    rows = [(" ".join(f"{a}:{b}" for a, b in m.items), CLASSES[m.class_place] if by_class else "", m.support) for m in found if len(m.items) == depth]
    out = spark.createDataFrame(rows, "items string, class string, support double").withColumn("support", F.round("support", 6))
    return out if by_class else out.drop("class")


@query(o.itemsets(1))
def itemsets_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, 1)


@query(o.itemsets(2))
def itemsets_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, 2)


@query(o.itemsets(3))
def itemsets_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, 3)


@query(o.itemsets(2, True))
def class_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, 2, True)


_MERITS = " union all ".join(f"select cast({i} as bigint) as rule, avg({x}) as g, avg(case when y = {c} then {x} end) as s, avg(case when y = {c} then 1.0 else 0.0 end) as p from w" for i, (x, (_, c)) in enumerate(zip(o.EVERY, RULES, strict=True)))


@query(f"with {o.fired(o.LEASTS)} select rule, round(s / g, 6) as confidence, round(s / g / p, 6) as lift from ({_MERITS})")
def rule_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    rows = [(i, m.confidence, m.lift) for i, m in enumerate(mining.merits(df, base, LABEL))]
    return spark.createDataFrame(rows, "rule long, confidence double, lift double").withColumns({c: F.round(c, 6) for c in ("confidence", "lift")})


def _items(antecedents: str = "antecedents") -> str:
    return f"array_join(filter(transform({antecedents}, (s, v) -> case when s >= 0 then concat(v, ':', s) end), x -> x is not null), ' ')"


def _mined_sql() -> str:
    """Itemsets of one or two items of each class whose rules pass the thresholds of confidence and lift."""
    from itertools import combinations, product

    rows = []
    for c, name in enumerate(CLASSES):
        for k in (1, 2):
            for vs in combinations(range(4), k):
                for ss in product(range(3), repeat=k):
                    names = [f"{'abcd'[v]}{x}" for v, x in zip(vs, ss, strict=True)]
                    least = names[0] if k == 1 else f"least({', '.join(names)})"
                    items = " ".join(f"{v}:{x}" for v, x in zip(vs, ss, strict=True))
                    rows.append(f"select '{name}' as class, '{items}' as items, avg({least}) as g, avg(case when y = {c} then {least} end) as s, avg(case when y = {c} then 1.0 else 0.0 end) as p from k")
    return f"with {o.memberships()}, k as (select *, {o.CLASS} as y from m) select class, items, round(s, 6) as support from ({' union all '.join(rows)}) where s > 0.05 and s / g >= 0.05 and s / g / p >= 1.0"


@query(_mined_sql())
def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return mining.mine_classes(df, LABEL, CLASSES, fit_partitions(df, FEATURES), 0.05, 2, 0.05, 1.0).frame(spark).select("class", F.expr(_items()).alias("items"), F.round("support", 6).alias("support"))


@query(f"select * from ({o.itemsets(1)}) union all select * from ({o.itemsets(2)})")
def mined_rule_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without a class from the itemsets of all rows."""
    df = table(spark, sf_dir, "lineitem")
    return mining.simple_mine(df, FEATURES, max_depth=2).frame(spark).select(F.expr(_items()).alias("items"), F.round("support", 6).alias("support"))


# temporal

WINDOWS = ((0, 5), (6, 11), (12, 17), (18, 23))


@query("select case when hour(ts) between 0 and 5 then 0 when hour(ts) between 6 and 11 then 1 when hour(ts) between 12 and 17 then 2 else 3 end as time, event_type, count(*) as n, round(avg(value), 6) as value from events where ts is not null group by 1, 2")
def time_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = temporal.time_moments(table(spark, sf_dir, "events"), "ts", WINDOWS)
    return made.groupBy("time", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


@query(f"with {o.FREQUENCIES} select 'value' as variable, time, label, n, round(frequency, 6) as frequency from h")
def conditional_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = temporal.time_moments(table(spark, sf_dir, "events"), "ts", WINDOWS)
    return temporal.conditional_frequencies(df, fit_partitions(df, ["value"])).withColumn("frequency", F.round("frequency", 6))


_NAMES = ("click", "error", "purchase", "signup", "view")
#: Each step's rules say the sets' classes, shifted by the step; what a set is worth is scaled by its frequency at that step.
_TEMPORAL = f"""{o.FREQUENCIES}, p as (select m.time, event_type, coalesce(m.a0, 0) * coalesce(h0.frequency, 0) as d0, coalesce(m.a1, 0) * coalesce(h1.frequency, 0) as d1, coalesce(m.a2, 0) * coalesce(h2.frequency, 0) as d2
 from m left join h h0 on h0.time = m.time and h0.label = 0 left join h h1 on h1.time = m.time and h1.label = 1 left join h h2 on h2.time = m.time and h2.label = 2),
 said as (select time, event_type, case when greatest(d0, d1, d2) = 0 then 0 when d0 >= d1 and d0 >= d2 then time % 5 when d1 >= d2 then (time + 1) % 5 else (time + 2) % 5 end as predicted from p)"""


def _temporal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, temporal.TemporalRuleBase]:
    df = temporal.time_moments(table(spark, sf_dir, "events"), "ts", WINDOWS)
    steps = range(len(WINDOWS))
    variables = temporal.temporal_variables(df, fit_partitions(df, ["value"]))
    return df.where("time is not null"), temporal.TemporalRuleBase(tuple(RuleBase(tuple(v.fix(t) for v in variables), (Rule((0,), t % 5), Rule((1,), (t + 1) % 5), Rule((2,), (t + 2) % 5)), _NAMES, 1) for t in steps))


@query(f"with {_TEMPORAL} select time, predicted, count(*) as n from said group by 1, 2")
def temporal_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = _temporal(spark, sf_dir)
    return base.predict(df).groupBy("time", "predicted").agg(F.count("*").alias("n"))


@query(f"with {_TEMPORAL} select coalesce(time, -1) as time, round(avg(case when event_type = list_extract(['click', 'error', 'purchase', 'signup', 'view'], predicted + 1) then 1.0 else 0.0 end), 6) as accuracy from said group by rollup(time)")
def temporal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = _temporal(spark, sf_dir)
    rows = [(-1 if t is None else t, x["accuracy"]) for t, x in temporal.evaluate(df, base, "event_type").items()]
    return spark.createDataFrame(rows, "time int, accuracy double").withColumn("accuracy", F.round("accuracy", 6))


@query("select event_type, count(*) as n, round(sum(value), 4) as value from events where hour(ts) between 6 and 11 group by 1")
def temporal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.classify(table(spark, sf_dir, "events"), "ts", (6, 11))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("select case when hour(ts) between 0 and 7 then 0 else 1 end as time, count(*) as n from events where hour(ts) between 0 and 7 or hour(ts) between 16 and 23 group by 1")
def temporal_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of an assembled data set together hold every row of its windows."""
    train, test = temporal.assemble(table(spark, sf_dir, "events"), "ts", ((0, 7), (16, 23)), "event_id")
    return train.unionByName(test).groupBy("time").agg(F.count("*").alias("n"))


# trees


def _root_sql() -> str:
    return f"with c as (select {LABEL}, count(*) as n from lineitem group by 1), t as (select sum(n) as n from c) select round(1 - sum((c.n / cast(t.n as double)) * (c.n / cast(t.n as double))), 6) as gini from c, t"


@query(_root_sql)
def tree_root_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [r["count"] for r in table(spark, sf_dir, "lineitem").groupBy(LABEL).count().collect()]
    return spark.createDataFrame([(gini(counts),)], "gini double").withColumn("gini", F.round("gini", 6))


_SPLITS = " union all ".join(f"select '{x}' as feature, cast({j} as bigint) as label, l_returnflag as c, sum({v}{j}) as s from m group by l_returnflag" for v, x in o.LETTERS.items() for j in range(3))


@query(f"with {o.memberships()}, s as ({_SPLITS}), t as (select feature, label, sum(s) as t from s group by 1, 2) select s.feature as feature, s.label as label, round(1 - sum((s / t) * (s / t)), 6) as gini, round(any_value(t) / (select count(*) from lineitem), 6) as coverage from s join t on s.feature = t.feature and s.label = t.label group by 1, 2")
def tree_split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    tree = FuzzyTree(fit_partitions(df, FEATURES), CLASSES, metric="purity")
    rows = tree._with_mu(df.withColumn("_y", rule_quality.class_place(LABEL, CLASSES)))
    asked = tree._candidates()
    sums, n = tree._sums(rows, asked), df.count()
    return spark.createDataFrame([(FEATURES[f], s, gini(v), sum(v) / n) for (_, f, s), v in zip(asked, sums, strict=True)], "feature string, label long, gini double, coverage double").withColumns({c: F.round(c, 6) for c in ("gini", "coverage")})


#: A tree with a root, three children and a child of the first of them.
PATHS = (((0, 0),), ((0, 2),), ((2, 1),), ((0, 0), (1, 2)))
#: Its nodes: leaves by the length of their paths, then the root and the inner node, which speak where their children are silent.
_NODES = {"root_F0_L2": "a2", "root_F2_L1": "c1", "root_F0_L0_F1_L2": "a0 * b2", "root": "1", "root_F0_L0": "a0"}
_SPOKEN = ("a2", "c1", "a0 * b2", "case when a0 <= 0.000001 and a2 <= 0.000001 and c1 <= 0.000001 then 1 else 0 end", "case when a0 * b2 <= 0.000001 then a0 else 0 end")
_SUMS = " union all ".join(f"select {i} as i, '{n}' as node, sum(case when y = 0 then {x} else 0 end) as s0, sum(case when y = 1 then {x} else 0 end) as s1, sum(case when y = 2 then {x} else 0 end) as s2 from k" for i, (n, x) in enumerate(_NODES.items()))
_TREE = f"""{o.memberships()}, k as (select *, {o.CLASS} as y from m), su as ({_SUMS}), sh as (select *, case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as said, s0 + s1 + s2 as s from su),
 g as (select *, {', '.join(f'{x} as g{i}' for i, x in enumerate(_SPOKEN))} from k), wi as (select *, greatest(g0, g1, g2, g3, g4) as degree, case greatest(g0, g1, g2, g3, g4) when g0 then 0 when g1 then 1 when g2 then 2 when g3 then 3 else 4 end as i from g)"""


def _grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FuzzyTree]:
    df = table(spark, sf_dir, "lineitem")
    return df, FuzzyTree(fit_partitions(df, FEATURES), CLASSES).grow(df, LABEL, PATHS)


@query(f"with {_TREE} select node, said, round(s / (select count(*) from k), 6) as coverage, round(1 - (s0 * s0 + s1 * s1 + s2 * s2) / (s * s), 6) as gini from sh")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a tree of given paths: what they say, how much of the rows they cover and how pure they are."""
    from lumifuzz.operators.tree import coverage, majority

    _, tree = _grown(spark, sf_dir)
    rows = [(n.name, majority(n.sums), coverage(n.sums, tree.rows), gini(n.sums)) for n in tree.root.walk()]
    return spark.createDataFrame(rows, "node string, said int, coverage double, gini double").withColumns({c: F.round(c, 6) for c in ("coverage", "gini")})


@query(f"with {_TREE} select sh.node as path, said as predicted, count(*) as n, round(avg(degree), 6) as degree from wi join sh on sh.i = wi.i group by 1, 2")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, tree = _grown(spark, sf_dir)
    return tree.predict_with_path(df).groupBy("path", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("degree"))


@query(f"with {_TREE} select round(avg(case when said = y then 1.0 else 0.0 end), 6) as accuracy from wi join sh on sh.i = wi.i")
def tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, tree = _grown(spark, sf_dir)
    return spark.createDataFrame([(tree.score(df, LABEL),)], "accuracy double").withColumn("accuracy", F.round("accuracy", 6))


@query(f"with {_TREE}, sc as (select {', '.join(f'max(s{c} / s) filter (i = {i}) as q{c}_{i}' for c in range(3) for i in range(5))} from sh), ma as (select {', '.join(' + '.join(f'g{i} * q{c}_{i}' for i in range(5)) + f' as p{c}' for c in range(3))} from g, sc) select {', '.join(f'round(avg(coalesce(p{c} / nullif(p0 + p1 + p2, 0), 1 / 3.0)), 6) as c{c}' for c in range(3))} from ma")
def tree_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, tree = _grown(spark, sf_dir)
    return tree.predict_proba(df).agg(*(F.round(F.avg(F.col("probabilities")[c]), 6).alias(f"c{c}") for c in range(3)))


@query(f"with {_TREE} select round(avg(a2), 6) as l0, round(avg(c1), 6) as l1, round(avg(a0 * b2), 6) as l2 from k")
def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean membership in each leaf."""
    df, tree = _grown(spark, sf_dir)
    return tree.predict_all_leaves_matrix(df).agg(*(F.round(F.avg(F.col("leaf_memberships")[i]), 6).alias(f"l{i}") for i in range(3)))


#: What the subtree of the inner node gains: the wrong mass of the node less that of its only leaf.
_COST = "(s - greatest(s0, s1, s2)) / (select count(*) from k)"


@query(f"with {_TREE}, co as (select max({_COST}) filter (node = 'root') as r, max({_COST}) filter (node = 'root_F0_L0') as i, max({_COST}) filter (node = 'root_F0_L0_F1_L2') as l, max({_COST}) filter (node = 'root_F0_L2') as a, max({_COST}) filter (node = 'root_F2_L1') as c from sh), we as (select (r - (l + a + c)) / 2 as whole, i - l as part from co) select case when whole <= part then 'root' else 'root_F0_L0' end as node, round(least(whole, part), 6) as gain from we")
def tree_weakest_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner node that pruning would cut first."""
    _, tree = _grown(spark, sf_dir)
    gain, node = tree.weakest_link()
    return spark.createDataFrame([(node.name, gain)], "node string, gain double").withColumn("gain", F.round("gain", 6))


def _tree(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, FuzzyTree]:
    df = table(spark, sf_dir, "lineitem")
    return df, FuzzyTree(fit_partitions(df, FEATURES), CLASSES, **({"max_rules": 4, "min_improvement": 0.0} | options)).fit(df, LABEL)


@query()
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, tree = _tree(spark, sf_dir)
    return tree.predict_with_path(df).groupBy("path", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("degree"), 6).alias("degree"))


@query()
def feature_tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, tree = _tree(spark, sf_dir, split="feature", metric="purity", max_rules=6)
    return tree.predict(df).groupBy(LABEL, "predicted").agg(F.count("*").alias("n"))


# conformal


def _calibrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, conformal.Calibrated]:
    df, base = fitted(spark, sf_dir)
    return df, conformal.calibrate(df.where("l_orderkey % 5 = 0"), base, LABEL)


_SCORES = ", ".join(f"1 - {x} as s{c}" for c, x in enumerate(o.CLASS_BEST))
_RANKS = ", ".join(f"r{c} as (select s, sum(n) over (order by s desc) as n, sum(n) over () as total from (select s{c} as s, count(*) as n from e where l_orderkey % 5 = 0 and y = {c} group by 1))" for c in range(3))
_PS = ", ".join(f"(coalesce(x{c}.n, 0) + 1) / (t{c}.total + 1) as p{c}" for c in range(3))
_MET = " ".join(f"cross join (select any_value(total) as total from r{c}) t{c} asof left join r{c} x{c} on e.s{c} <= x{c}.s" for c in range(3))
#: Up to p: the p-values of every row outside the calibration part, which is every fifth order. Scores are compared as they are.
_CONFORMAL = f"with {o.fired()}, e as materialized (select *, {_SCORES} from w), {_RANKS}, p as (select e.*, {_PS} from e {_MET} where l_orderkey % 5 <> 0)"
_SET_SIZE = "(case when p0 > 0.3 then 1 else 0 end) + (case when p1 > 0.3 then 1 else 0 end) + (case when p2 > 0.3 then 1 else 0 end)"


@query(f"{_CONFORMAL} select l_returnflag, round(avg(p0), 6) as p0, round(avg(p1), 6) as p1, round(avg(p2), 6) as p2 from p group by 1")
def conformal_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row outside the calibration part, as in the next ones."""
    df, cal = _calibrated(spark, sf_dir)
    made = conformal.p_values(df.where("l_orderkey % 5 <> 0"), cal)
    return made.groupBy(LABEL).agg(*(F.round(F.avg(F.col("p_values")[c]), 6).alias(f"p{c}") for c in range(3)))


@query(f"{_CONFORMAL} select l_returnflag, {_SET_SIZE} as set_size, count(*) as n from p group by 1, 2")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal = _calibrated(spark, sf_dir)
    made = conformal.predict_set(df.where("l_orderkey % 5 <> 0"), cal, 0.3)
    return made.groupBy(LABEL, F.size("prediction_set").alias("set_size")).agg(F.count("*").alias("n"))


@query(f"{_CONFORMAL} select round(avg(case when (case y when 0 then p0 when 1 then p1 else p2 end) > 0.3 then 1.0 else 0.0 end), 6) as coverage, round(avg({_SET_SIZE}), 6) as average_set_size from p")
def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal = _calibrated(spark, sf_dir)
    total, _ = conformal.coverage(df.where("l_orderkey % 5 <> 0"), cal, LABEL, 0.3)
    return spark.createDataFrame([(total["coverage"], total["average_set_size"])], "coverage double, average_set_size double").withColumns({c: F.round(c, 6) for c in ("coverage", "average_set_size")})


_FIRED_RANKS = " union all ".join(f"select {i} as rule, f{i} as s, count(*) as n from w where l_orderkey % 5 = 0 and y = {c} group by 2" for i, (_, c) in enumerate(RULES))
_FIRED = " union all ".join(f"select {i} as rule, f{i} as s from w where l_orderkey % 5 <> 0 and f{i} > 0" for i in range(6))


@query(f"""with {o.fired()}, c as (select rule, s, sum(n) over (partition by rule order by s) as n, sum(n) over (partition by rule) as total from ({_FIRED_RANKS})), f2 as ({_FIRED})
 select f2.rule, count(*) as n, round(avg(coalesce(c.n, 0) / t.total), 6) as confidence from f2 join (select rule, any_value(total) as total from c group by rule) t on t.rule = f2.rule asof left join c on c.rule = f2.rule and f2.s >= c.s group by 1""")
def conformal_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, cal = _calibrated(spark, sf_dir)
    made = conformal.predict_set_with_rules(df.where("l_orderkey % 5 <> 0"), cal, 0.3).select(F.explode("contributions").alias("x"))
    return made.groupBy("x.rule").agg(F.count("*").alias("n"), F.round(F.avg("x.confidence"), 6).alias("confidence"))


_INFO = " union all ".join(f"select '{name}' as class, count(*) as rows, round(avg(1 - {x}), 4) as mean, round(min(1 - {x}), 4) as least, round(max(1 - {x}), 4) as most from w where l_orderkey % 5 = 0 and y = {c}" for c, (name, x) in enumerate(zip(CLASSES, o.CLASS_BEST, strict=True)))


@query(f"with {o.fired()} {_INFO}")
def calibration_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cal = _calibrated(spark, sf_dir)
    rows = [(x["class"], x["rows"], x["mean"], x["least"], x["most"]) for x in conformal.calibration_info(cal)]
    return spark.createDataFrame(rows, "class string, rows long, mean double, least double, most double").withColumns({c: F.round(c, 4) for c in ("mean", "least", "most")})


_SPLIT_DRAW = "cast('0x' || substr(md5('42|' || cast(o_orderkey as varchar)), 1, 13) as bigint)"


@query(f"""with d as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {_SPLIT_DRAW}) as r, count(*) over (partition by o_orderpriority) as n from orders where o_orderpriority is not null)
 select o_orderpriority, count(*) filter (r <= round_even(0.2 * n, 0)) as calibration, count(*) filter (r > round_even(0.2 * n, 0)) as training, cast(sum(o_orderkey) filter (r <= round_even(0.2 * n, 0)) as bigint) as keys from d group by 1""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly a fifth of the orders of each priority for calibration."""
    train, held = conformal.split(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, label="o_orderpriority")
    both = held.withColumn("held", F.lit(1)).unionByName(train.withColumn("held", F.lit(0)))
    counts = [F.sum((F.col("held") == x).cast("long")).alias(name) for x, name in ((1, "calibration"), (0, "training"))]
    return both.groupBy("o_orderpriority").agg(*counts, F.sum(F.when(F.col("held") == 1, F.col("o_orderkey"))).alias("keys"))


# streams


@query(f"""with {o.memberships(letters={'a': 'value'}, table='events', keep='event_type, ts')}, w as (select event_type, ts, greatest(a0, a1, a2) as strength, case greatest(a0, a1, a2) when a0 then 0 when a1 then 1 else 2 end as winner from m where ts is not null)
 select event_type, strftime(ts, '%Y-%m-%d') as day, winner, count(*) as n, count(*) filter (strength < 0.75) as doubtful from w group by 1, 2, 3""")
def streamed_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream to its end: winners by type and day from keyed state."""
    base = RuleBase(tuple(fit_partitions(table(spark, sf_dir, "events"), ["value"])), tuple(Rule((i,), i) for i in range(3)), ("low", "medium", "high"), 1)
    told = state.run(state.read_table(spark, f"{sf_dir}/events.parquet"), base, "ts", "event_type", doubt=0.75)
    return state.totals(told).select(F.col("key").alias("event_type"), F.date_format("window_start", "yyyy-MM-dd").alias("day"), "winner", "n", "doubtful")


# validation, search, graphs


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    got = validation.with_intervals(_keyed(df), base, LABEL, "row_key")
    return spark.createDataFrame([(i, *r.support_interval, *r.confidence_interval) for i, r in enumerate(got.rules)], "rule long, support_lo double, support_hi double, confidence_lo double, confidence_hi double")


@query()
def permutation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    rows = [(i, p) for i, p in enumerate(validation.rulewise_label_permutation_test(df, base, LABEL))]
    return spark.createDataFrame([*rows, (-1, validation.label_permutation_test(df, base, LABEL))], "rule long, p double")


@query(f"with {o.fired()}, r(rule, class) as (values {', '.join(f'({i}, {c})' for i, (_, c) in enumerate(RULES))}) select cast(rule as bigint) as rule, round(avg(case when (winner = rule) <> (y = class) then 1.0 else 0.0 end), 6) as error, round(1 / 21.0, 6) as p from r, w group by rule")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's one-against-all error, and its p-value when whole rows are exchanged."""
    df, base = fitted(spark, sf_dir)
    won = validation._by_winner(df, base, LABEL)
    total = {c: sum(by.get(c, 0) for by in won.values()) for c in range(len(CLASSES))}
    p = validation.rulewise_column_permutation_test(df, base, LABEL, "l_orderkey")
    rows = [(i, e, x) for i, (e, x) in enumerate(zip(validation._own_errors(base, won, total), p, strict=True))]
    return spark.createDataFrame(rows, "rule long, error double, p double").withColumns({c: F.round(c, 6) for c in ("error", "p")})


_VALIDITY_SQL = f"""with {o.memberships()}, k as (select *, {o.CLASS} as y from m), n as (select count(*) as n, max(c) as top from (select count(*) as c from k group by y), (select count(*) as n from k)), rw as (select count(*) as n from k),
 ch as ({' union all '.join(f"select '{x}' as feature, sum({v}{j}) as s, greatest(sum(case when y = 0 then {v}{j} else 0 end), sum(case when y = 1 then {v}{j} else 0 end), sum(case when y = 2 then {v}{j} else 0 end)) as t from k" for v, x in o.LETTERS.items() for j in range(3))}),
 va as (select feature, sum(s * (2 * t - s) / (select n from rw)) / sum(s) as after from ch group by feature), be as (select (2 * top - (select n from rw)) / (select n from rw) as before from n)
 select feature, round(case when before = 0 or (before < 0) <> (after < 0) then after else (after - before) / before end, 6) as gain from va, be"""


_KEPT_MOMENTS = ", ".join(f"round(sum({x}), 2) as sum_{v}, round(stddev_pop({x}), 4) as spread_{v}, min({x}) as least_{v}, max({x}) as most_{v}, count(distinct {x}) as distinct_{v}" for v, x in o.LETTERS.items())


@query(f"select cast(range as bigint) as replicate, l_returnflag, count(*) as n, {_KEPT_MOMENTS} from lineitem cross join range(3) group by 1, 2")
def exchanged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three exchanges of every column within each class must leave as it was."""
    df = table(spark, sf_dir, "lineitem")
    moved = validation.exchanged(df, FEATURES, rule_quality.class_place(LABEL, CLASSES), 3)
    # each value with its count, a row for one column: distinct counts of several columns at once would send whole rows for each of them
    each = F.array(*(F.struct(F.lit(v).alias("v"), F.col(f).alias("x")) for v, f in o.LETTERS.items()))
    counted = moved.select("replicate", "_y", F.inline(each)).groupBy("replicate", "_y", "v", "x").agg(F.count("*").alias("rows"), F.count("x").alias("n"))
    moments = [F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.min("x").alias("least"), F.max("x").alias("most"), F.count("x").alias("distinct"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("q")]
    # a row for each replicate, class and column
    by = counted.groupBy("replicate", "_y", "v").agg(*moments).withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))))
    of = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c)))
    kept = [x for v in o.LETTERS for x in (F.round(of(v, "s"), 2).alias(f"sum_{v}"), F.round(of(v, "spread"), 4).alias(f"spread_{v}"), *(of(v, c).alias(f"{c}_{v}") for c in ("least", "most", "distinct")))]
    return by.groupBy(F.col("replicate").cast("long").alias("replicate"), F.array(*map(F.lit, CLASSES))[F.col("_y")].alias(LABEL)).agg(F.max("rows").alias("n"), *kept)


@query()
def column_permutation_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rules use how a class's columns go together: twenty exchanges of every column, for the base and for each rule."""
    df, base = fitted(spark, sf_dir)
    whole, each = validation.column_permutation_tests(df, base, LABEL)
    return spark.createDataFrame([*enumerate(each), (-1, whole)], "rule long, p double")


@query(_VALIDITY_SQL)
def tree_validity_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What splitting the root by each feature gains in validity."""
    from lumifuzz.operators.tree import validity, validity_gain

    df = table(spark, sf_dir, "lineitem")
    tree = FuzzyTree(fit_partitions(df, FEATURES), CLASSES).grow(df, LABEL, [((f, s),) for f in range(len(FEATURES)) for s in range(3)])
    before, out = validity(tree.root.sums, tree.rows), []
    for f, name in enumerate(FEATURES):
        own = [c.sums for c in tree.root.children if c.path[0][0] == f]
        after = sum(sum(s) * validity(s, tree.rows) for s in own) / sum(map(sum, own))
        out.append((name, validity_gain(before, after)))
    return spark.createDataFrame(out, "feature string, gain double").withColumn("gain", F.round("gain", 6))


@query()
def null_rule_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, base = fitted(spark, sf_dir)
    return _values(spark, [r.p_values[0] for r in validation.rule_p_values(df, base, LABEL).rules])


@query()
def evolved_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    found = evolve.FuzzyRulesEstimator(FEATURES, n_rules=6, n_ants=2, variables=fit_partitions(df, FEATURES), classes=CLASSES).fit(df, LABEL, evolve.Search())
    return found.base.frame(spark)


@query()
def stable_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _keyed(table(spark, sf_dir, "lineitem"))
    variables = fit_partitions(df, FEATURES)
    one = stability.Stabilizer(lambda: evolve.FuzzyRulesEstimator(FEATURES, 4, 2, variables=variables, classes=CLASSES), "row_key").generate(df, LABEL, 10, how=evolve.Search(n_gen=2, pop_size=8))
    return one.counts(spark)


def _fitness_sql(rules: tuple[int, ...]) -> str:
    """The correlation of a base of some of the rules, whose degrees are dominance times strength."""
    best = "greatest(" + ", ".join(f"g{i}" for i in rules) + ")"
    said = "case " + " ".join(f"when g{i} = {best} then {RULES[i][1]}" for i in rules) + " end"
    return f"(with g as (select y, {', '.join(f'f{i} * s{i} as g{i}' for i in rules)} from w, kk), k as (select y as actual, {said} as predicted, count(*) as n from g group by 1, 2), {o.MERIT} select round(mcc, 6) as fitness from merit)"


_KK = f"kk as (select {', '.join(f'max(score) filter (rule = {i}) as s{i}' for i in range(6))} from sc)"
SUBSETS = ((0, 1, 2, 3, 4, 5), (0, 2, 4), (1, 3, 5))


@query(f"with {_SCORED}, {_KK} " + " union all ".join(f"select cast({i} as bigint) as base, (select fitness from {_fitness_sql(s)}) as fitness" for i, s in enumerate(SUBSETS)))
def population_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule bases rated in the same two jobs."""
    df = table(spark, sf_dir, "lineitem")
    variables, rules = fit_partitions(df, FEATURES), _rules()
    rows = evolve.Population(df, variables, LABEL, CLASSES)
    values, _ = rows.rate([RuleBase(tuple(variables), tuple(rules[i] for i in s), CLASSES) for s in SUBSETS])
    rows.uncache()
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "base long, fitness double").withColumn("fitness", F.round("fitness", 6))


#: Genes of three partitions: eleven steps for each feature.
SHAPES = tuple({v: tuple((7 * g + 13 * (11 * i + j)) % 40 for j in range(11)) for i, v in enumerate(o.LETTERS)} for g in range(3))
_VOTES = {
    "winner": f"case greatest({', '.join(f'f{i} * s{i}' for i in range(6))}) " + " ".join(f"when f{i} * s{i} then {c}" for i, (_, c) in enumerate(RULES)) + " end",
    "additive": "case greatest(f0 + f1, f2 + f3, f4 + f5) when f0 + f1 then 0 when f2 + f3 then 1 else 2 end",
}


def _shaped_sql() -> str:
    """For each individual and vote: rules scored by support times confidence, predictions, correlation."""
    rows = []
    for g, steps in enumerate(SHAPES):
        scores = ", ".join(f"coalesce(sum(case when y = {c} then f{i} end) / count(*) * (sum(case when y = {c} then f{i} end) / nullif(sum(f{i}), 0)), 0) as s{i}" for i, (_, c) in enumerate(RULES))
        for vote, said in _VOTES.items():
            rows.append(f"select cast({g} as bigint) as individual, '{vote}' as vote, (with {o.shaped(steps)}, sc as (select {scores} from f), k as (select y as actual, {said} as predicted, count(*) as n from f, sc group by 1, 2), {o.MERIT} select round(mcc, 6) from merit) as fitness")
    return " union all ".join(rows)


@query(_shaped_sql)
def shaped_population_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three individuals with partitions of their own, rated together under both votes: two jobs for the first, one for the second."""
    df = table(spark, sf_dir, "lineitem")
    low = df.agg(*(x for f in FEATURES for x in (F.min(f), F.max(f)))).first()
    genes = evolve.PartitionGenes(tuple((f, float(low[2 * i]), float(low[2 * i + 1])) for i, f in enumerate(FEATURES)), 3)
    bases = [RuleBase(genes.decode(np.array([x for own in steps.values() for x in own])), _rules(), CLASSES) for steps in SHAPES]
    rows = evolve.Population(df, None, LABEL, CLASSES, features=FEATURES)
    found = [(i, vote, v) for vote in _VOTES for i, v in enumerate(rows.rate(bases, vote=vote, scores=False)[0])]
    rows.uncache()
    return spark.createDataFrame(found, "individual long, vote string, fitness double").withColumn("fitness", F.round("fitness", 6))


@query(f"with {o.fired()} select winner, count(*) as n from w group by 1")
def decoded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of a rule base that went through its gene."""
    df, base = fitted(spark, sf_dir)
    genes = evolve.RuleGenes(base.variables, len(CLASSES), len(base), 3)
    return genes.decode(genes.encode(base), CLASSES, 1).predict(df).groupBy("winner").agg(F.count("*").alias("n"))


def _graph_sql() -> str:
    rows = " union all ".join(f"select {i} as r, {c} as class, {v} as v, {s} as l" for i, (a, c) in enumerate(RULES) for v, s in enumerate(a) if s >= 0)
    return f"with {_KEPT}, u as (select x.* from ({rows}) x join kept on rule = r) select a.class as class, a.v as from_variable, a.l as from_label, b.v as to_variable, b.l as to_label, count(*) / 2e0 as weight from u a join u b on a.r = b.r and (a.v <> b.v or a.l <> b.l) group by 1, 2, 3, 4, 5"


@query(_graph_sql)
def rule_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_graph.connections(_kept_base(spark, sf_dir), spark)


def _usage_sql() -> str:
    rows = " union all ".join(f"select {i} as r, {v} as variable, {s} as label" for i, (a, _) in enumerate(RULES) for v, s in enumerate(a) if s >= 0)
    return f"with {_KEPT} select variable, label, count(*) as n from ({rows}) x join kept on rule = r group by 1, 2"


@query(_usage_sql)
def rule_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_graph.histogram(_kept_base(spark, sf_dir), spark)


#: A map of regions: the nations' keys say how strongly each moves another, with a sign.
_EDGES = "e as (select n_regionkey as source, n_nationkey % 5 as target, sum(case when n_nationkey % 3 = 0 then -0.4 else 0.7 end) as weight from nation group by 1, 2)"
_MOVED = "select r_regionkey as node, coalesce((select sum(weight * value) from e, {0} s where target = r_regionkey and s.node = source), 0) as value from region"


def _step_sql(before: str) -> str:
    """One step: 1 above the threshold and for every negative value, else 0."""
    return f"select node, case when abs(value) > 0.5 * sign(value) then cast(1 as double) else cast(0 as double) end as value from ({_MOVED.format(before)})"


def _map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weight = F.when(F.col("n_nationkey") % 3 == 0, -0.4).otherwise(0.7)
    edges = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("source"), (F.col("n_nationkey") % 5).cast("string").alias("target")).agg(F.sum(weight).alias("weight"))
    return edges, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("node"), ((F.col("r_regionkey") + 1) / 5.0).alias("value"))


_START = "s0 as (select r_regionkey as node, (r_regionkey + 1) / 5.0 as value from region)"


@query(f"with {_EDGES}, {_START} select cast(node as varchar) as node, value from ({_step_sql('s0')})")
def cognitive_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of a map, as a join and a sum."""
    return cognitive.step_frame(*_map(spark, sf_dir))


@query(f"with {_EDGES}, {_START}, s1 as ({_step_sql('s0')}), s2 as ({_step_sql('s1')}), s3 as ({_step_sql('s2')}) " + " union all ".join(f"select {i} as step, cast(node as varchar) as node, value from s{i}" for i in (1, 2, 3)))
def cognitive_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the same map held as a matrix, put together from two halves."""
    edges, states = _map(spark, sf_dir)
    rows = {(r["source"], r["target"]): r["weight"] for r in edges.collect()}
    names = [str(i) for i in range(5)]
    whole = np.array([[rows.get((a, b), 0.0) for b in names] for a in names])
    fcm = cognitive.CognitiveMap(whole / 2, names).add(cognitive.CognitiveMap(whole / 2, names))
    start = {r["node"]: r["value"] for r in states.collect()}
    run = fcm.set_and_simulate([start[n] for n in names], 3)
    return spark.createDataFrame([(i + 1, n, float(v)) for i, state in enumerate(run) for n, v in zip(names, state, strict=True)], "step int, node string, value double")


@query(f"with {o.fired()} select l_returnflag, winner, count(*) as n from w group by 1, 2")
def persisted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring with rules and partitions that went through their text forms."""
    df, base = fitted(spark, sf_dir)
    again = text_format.load_rules(base.text(), text_format.load_variables(text_format.variables_text(base.variables)), CLASSES)
    return replace(again, ds_mode=1).predict(df).groupBy(LABEL, "winner").agg(F.count("*").alias("n"))


# features from several tables

_JOINED = "select o_orderstatus, o_totalprice, c_acctbal, c_mktsegment, n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


_PRICES = o.memberships(letters={"a": "o_totalprice", "b": "c_acctbal"}, table="j", keep="c_mktsegment, n_regionkey")


@query(f"""with j as ({_JOINED}), {_PRICES}, f as (select *, a0 * b0 as f0, a2 as f1, b2 as f2 from m), w as (select *, greatest(f0, f1, f2) as best, case greatest(f0, f1, f2) when f0 then 0 when f1 then 1 else 2 end as winner from f)
 select c_mktsegment, n_regionkey, count(*) as n, round(avg(best), 6) as degree, cast(sum(case when winner = 1 then 1 else 0 end) as bigint) as rich from w group by rollup(c_mktsegment, n_regionkey)""")
def joined_features_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over features of three tables, rolled up by segment and region."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("o_orderstatus", "o_totalprice", "c_acctbal", "c_mktsegment", "n_regionkey")
    base = RuleBase(tuple(fit_partitions(joined, ["o_totalprice", "c_acctbal"])), (Rule((0, 0), 0), Rule((2, -1), 1), Rule((-1, 2), 2)), ("F", "O", "P"), 1)
    return base.applied(joined).rollup("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.round(F.avg("_best"), 6).alias("degree"), F.sum((F.col("_winner") == 1).cast("long")).alias("rich"))
