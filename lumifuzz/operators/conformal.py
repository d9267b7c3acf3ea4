"""Conformal prediction over a rule base: calibrated p-values, prediction sets and their coverage.

A calibration is a written table of scores, told apart to the last bit and counted: by class the nonconformity of its rows, by rule its strengths on the rows
of its class. A row's rank among them comes from one exact rank join (`ranks`), for any number of calibration rows and of new rows. What reaches the driver is
one number for each class and rule, and one for each range of scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q
from lumifuzz.operators import ranks
from lumifuzz.operators.partitions import at_ranks
from lumifuzz.operators.rule_quality import class_place
from lumifuzz.operators.rules import RuleBase
from lumifuzz.sources import shared

SCORES = ("membership", "association", "entropy")


def draw(key: str, seed: int = 42) -> Column:
    """A whole number below 2 ** 52 from a key's text, as a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")


def split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(training, calibration) rows, the same at every run.

    label: exactly that share (rounded to whole rows) of each class, found as the row of that rank by a draw from the key, which must tell rows apart; rows without a class are for training. Without
    a label, about the share of all rows. A null key draws like an empty one.
    """
    drawn = df.withColumn("_draw", F.coalesce(draw(key, seed), F.lit(0.0)))
    if label is None:
        held = F.col("_draw") < share * 2.0**52
    else:
        counts = [(r[label], r["count"]) for r in df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()]  # a row for each class
        wanted = [(c, round(share * n)) for c, n in counts if round(share * n)]
        values = drawn.select(*(F.when(F.col(label) == c, F.col("_draw")).alias(f"v{i}") for i, (c, _) in enumerate(wanted)))
        found = at_ranks(values, [n - 1 for _, n in wanted])
        held = F.lit(False)
        for (c, _), most in zip(wanted, found, strict=True):
            held = held | ((F.col(label) == c) & (F.col("_draw") <= most))
        held = F.coalesce(held, F.lit(False))
    return drawn.where(~held).drop("_draw"), drawn.where(held).drop("_draw")


def score_text(base: RuleBase, kind: str, c: int) -> str:
    """Nonconformity with class c, over the columns of a base with its classes."""
    if kind == "membership":
        return f"1e0 - _m{c}"
    if kind == "association":
        own = [f"_f{i}" for i, r in enumerate(base.rules) if r.consequent == c]
        return f"1e0 - {base._greatest(own)}"
    if kind == "entropy":
        parts = [f"greatest(_p{k}, 1e-10)" for k in range(len(base.classes))]
        k = len(parts)
        text = "-(" + q.total([f"({p}) * ln({p})" for p in parts]) + ")"
        return f"({text}) / {q.number(math.log(k))}" if k > 1 else text
    raise ValueError(f"unknown score: {kind}")


@dataclass(frozen=True)
class Calibrated:
    base: RuleBase
    kind: str
    #: group, value, n: groups below the number of classes are classes, those after them rules.
    scores: DataFrame
    #: Calibration rows of each group.
    rows: tuple[int, ...]

    def forget(self) -> None:
        """Deletes the written scores."""
        shared.drop(self.scores)


def _values(columns: Sequence[tuple[int, str]], when: Sequence[Column] | None = None) -> Column:
    """An array of (group, value) for inline(); when: where each of them counts."""
    made = [F.struct(F.lit(g).alias("group"), (F.expr(x) + F.lit(0.0)).alias("value")) for g, x in columns]
    return F.array(*made) if when is None else F.filter(F.array(*(F.when(w, x) for w, x in zip(when, made, strict=True))), lambda x: x.isNotNull())


def calibrate(df: DataFrame, base: RuleBase, label: str, kind: str = "membership", coded: bool = False, with_rules: bool = True) -> Calibrated:
    """Counts the scores of each class, and the strengths of each rule on the rows of its class, in one aggregate."""
    y, k = F.col(label).cast("int") if coded else class_place(label, base.classes), len(base.classes)
    made = base.with_classes(df).withColumn("_y", y).where("_y is not null")
    columns, when = [(c, score_text(base, kind, c)) for c in range(k)], [F.col("_y") == c for c in range(k)]
    if with_rules:
        columns += [(k + i, f"_f{i}") for i in range(len(base))]
        when += [F.col("_y") == r.consequent for r in base.rules]
    each = made.select(F.inline(_values(columns, when)))
    scores = shared.cut(each.groupBy("group", "value").agg(F.count("*").alias("n")), "conformal-scores")
    found = {r["group"]: r["n"] for r in scores.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    return Calibrated(base, kind, scores, tuple(found.get(g, 0) for g in range(k + (len(base) if with_rules else 0))))


def _ranked(df: DataFrame, cal: Calibrated, kind: str, rules: bool = False) -> DataFrame:
    """df, _at_least (for each class the calibration rows that score as much as a row or more) and, for rules, _strengths and _at_most (the calibration rows on which each rule fired as strongly or less)."""
    base, k = cal.base, len(cal.base.classes)
    made = base.with_classes(df)
    texts = [score_text(base, kind, c) for c in range(k)] + ([f"_f{i}" for i in range(len(base))] if rules else [])
    names = [f"_s{g}" for g in range(len(texts))]
    scored = made.select(*(F.col(f"`{c}`") for c in df.columns), *((F.expr(x) + F.lit(0.0)).alias(n) for n, x in zip(names, texts, strict=True)))
    # rows of the same scores have the same ranks, so each case is asked for once; written, so that it keeps its number
    cases = shared.cut(scored.select(*names).distinct().withColumn("_row", F.monotonically_increasing_id()), "conformal-cases")
    # rules that do not fire are asked for nothing
    asked = cases.select(F.col("_row").alias("row"), F.inline(_values(list(enumerate(names))))).where((F.col("group") < k) | (F.col("value") > 0))
    scores = cal.scores if rules else cal.scores.where(F.col("group") < k)
    found, _ = ranks.rank(scores, asked, F.col("group") >= k)
    of = lambda g: F.max(F.when(F.col("group") == g, F.col("n")))
    at_least = F.array(*(F.lit(cal.rows[c]) - of(c) for c in range(k))).alias("_at_least")
    at_most = F.array(*(of(k + i) for i in range(len(base)))).alias("_at_most")
    by_row = found.groupBy("row").agg(at_least, *([at_most] if rules else [])).withColumnRenamed("row", "_row")
    known = shared.cut(cases.join(by_row, "_row").drop("_row"), "conformal-ranks")
    # the rows themselves are not written: of their columns, only what is asked for goes through the join
    with_ranks = scored.join(known, names)
    if rules:
        with_ranks = with_ranks.withColumn("_strengths", F.array(*names[k:]))
    return with_ranks.drop(*names)


def _p_values(ranked: DataFrame, cal: Calibrated) -> Column:
    return F.array(*((F.col("_at_least")[c] + 1) / F.lit(float(n + 1)) if n else F.lit(0.0) for c, n in enumerate(cal.rows[: len(cal.base.classes)]))).alias("p_values")


def p_values(df: DataFrame, cal: Calibrated, kind: str = "membership") -> DataFrame:
    """df and p_values: for each class (calibration rows with at least the score + 1) / (rows + 1); 0 for a class that was not seen. New rows are scored by membership unless another kind is asked for."""
    ranked = _ranked(df, cal, kind)
    return ranked.select(*(F.col(f"`{c}`") for c in df.columns), _p_values(ranked, cal))


def _with_set(made: DataFrame, alpha: float) -> DataFrame:
    placed = F.filter(F.transform("p_values", lambda p, i: F.when(p > alpha, i)), lambda x: x.isNotNull())
    return made.withColumn("prediction_set", placed)


def predict_set(df: DataFrame, cal: Calibrated, alpha: float = 0.1, kind: str = "membership") -> DataFrame:
    """df, p_values and prediction_set: the places of the classes whose p-value is above alpha."""
    return _with_set(p_values(df, cal, kind), alpha)


def predict_set_with_rules(df: DataFrame, cal: Calibrated, alpha: float = 0.1) -> DataFrame:
    """predict_set and contributions: the firing rules, the strongest first, with the share of calibration rows of their class on which they fired at most as strongly."""
    base, k = cal.base, len(cal.base.classes)
    if len(cal.rows) < k + len(base):
        raise ValueError("calibrate with the rules first")
    ranked = _ranked(df, cal, "membership", rules=True)
    said = []
    for i, r in enumerate(base.rules):
        n = cal.rows[k + i]
        sure = F.col("_at_most")[i] / F.lit(float(n)) if n else F.lit(0.0)
        said.append(F.struct(F.col("_strengths")[i].alias("strength"), F.lit(-i).alias("order"), F.lit(i).alias("rule"), F.lit(r.consequent).alias("class"), sure.alias("confidence")))
    ordered = F.sort_array(F.filter(F.array(*said), lambda x: x["strength"] > 0), asc=False)
    contributions = F.transform(ordered, lambda x: F.struct(x["rule"].alias("rule"), x["class"].alias("class"), x["strength"].alias("strength"), x["confidence"].alias("confidence")))
    return _with_set(ranked.select(*(F.col(f"`{c}`") for c in df.columns), contributions.alias("contributions"), _p_values(ranked, cal)), alpha)


def calibration_info(cal: Calibrated) -> list[dict]:
    """By class: rows, and the mean, least and greatest score."""
    k = len(cal.base.classes)
    found = cal.scores.where(F.col("group") < k).groupBy("group").agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    by = {r["group"]: r for r in found.collect()}
    return [{"class": name, "rows": by[c]["rows"] if c in by else 0, **{x: by[c][x] if c in by else None for x in ("mean", "least", "most")}} for c, name in enumerate(cal.base.classes)]


def coverage(df: DataFrame, cal: Calibrated, label: str, alpha: float = 0.1, coded: bool = False) -> tuple[dict[str, float], dict[str, float]]:
    """(coverage, average_set_size, efficiency, empty_sets, singletons; coverage by class), in one aggregate."""
    y = F.col(label).cast("int") if coded else class_place(label, cal.base.classes)
    made = predict_set(df, cal, alpha).withColumn("_y", y).where("_y is not null")
    size = F.size("prediction_set")
    rows = made.groupBy("_y").agg(F.count("*").alias("n"), F.sum(F.array_contains("prediction_set", F.col("_y")).cast("int")).alias("hit"), F.sum(size).alias("size"), F.sum((size == 0).cast("int")).alias("none"), F.sum((size == 1).cast("int")).alias("one")).collect()
    n = sum(r["n"] for r in rows)
    if not n:
        return {}, {}
    total = {k: sum(r[k] for r in rows) / n for k in ("hit", "size", "none", "one")}
    return {"coverage": total["hit"], "average_set_size": total["size"], "efficiency": 1 - total["size"] / len(cal.base.classes), "empty_sets": total["none"], "singletons": total["one"]}, {cal.base.classes[r["_y"]]: r["hit"] / r["n"] for r in sorted(rows, key=lambda r: r["_y"])}


class ConformalClassifier:
    """A fitted base (or an estimator with fit) behind calibrated prediction sets."""

    def __init__(self, base: RuleBase | None = None, estimator=None, score_type: str = "membership"):
        if score_type not in SCORES:
            raise ValueError(f"unknown score: {score_type}")
        self.base, self.estimator, self.score_type, self.calibrated = base, estimator, score_type, None

    def fit(self, df: DataFrame, label: str, key: str, share: float = 0.2, **options) -> ConformalClassifier:
        train, rest = split(df, key, share, label=label)
        if self.estimator is not None:
            self.base = self.estimator.fit(train, label=label, **options).base
        return self.calibrate(rest, label)

    def calibrate(self, df: DataFrame, label: str) -> ConformalClassifier:
        self.calibrated = calibrate(df, self.base, label, self.score_type)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.base.predict(df)

    def predict_set(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        return predict_set(df, self._ready(), alpha)

    def predict_set_with_rules(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        return predict_set_with_rules(df, self._ready(), alpha)

    def calibration_info(self) -> list[dict]:
        return calibration_info(self._ready())

    def print_rules(self) -> str:
        return self.base.text()

    def _ready(self) -> Calibrated:
        if self.calibrated is None:
            raise ValueError("calibrate first")
        return self.calibrated


def sets_as_names(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """prediction_set with class names instead of places."""
    return df.withColumn("prediction_set", F.transform("prediction_set", lambda i: F.element_at(F.array(*map(F.lit, classes)), i.cast("int") + 1)))
