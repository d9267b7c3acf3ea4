"""How good rules are: supports, confidences, dominance, accuracies, and classification metrics.

Everything over rows is an aggregate: sums of firing strengths in one pass for all rules and classes (map-side combined, one
short row out), counts by winner, and a confusion table of classes x classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.operators.rules import RuleBase

#: Aggregates of one job: wider ones exceed what the JVM compiles.
WIDTH = 48


def class_place(label: str, classes: Sequence[str]) -> Column:
    """The class place of a label column that holds places or class names."""
    out = F.when(F.col(label).isNull(), None)
    for i, c in enumerate(classes):
        out = out.when(F.col(label).cast("string") == str(c), i)
    return out


def _labelled(df: DataFrame, base: RuleBase, label: str, coded: bool) -> DataFrame:
    return base.applied(df).withColumn("_y", F.col(label).cast("int") if coded else class_place(label, base.classes))


def sums(df: DataFrame, base: RuleBase, label: str, coded: bool = False, weight: Column | None = None) -> tuple[float, dict[int, float], list[float], list[list[float]]]:
    """(rows, rows by class, firing by rule, firing by rule and class); weight: of each row."""
    made = _labelled(df, base, label, coded).withColumn("_w", F.lit(1.0) if weight is None else weight)
    k, places = len(base.classes), range(len(base))
    n, by_class, firing, inside = 0.0, dict.fromkeys(range(k), 0.0), [0.0] * len(base), [[0.0] * k for _ in places]
    # a row for each class, and one for rows without: the classes cost no aggregates of their own
    for start in range(0, max(1, len(base)), WIDTH):
        some = places[start : start + WIDTH]
        for r in made.groupBy("_y").agg(F.sum("_w").alias("n"), *(F.sum(F.col(f"_f{i}") * F.col("_w")).alias(f"s{i}") for i in some)).collect():
            known = r["_y"] is not None and 0 <= r["_y"] < k
            if not start:
                n += float(r["n"] or 0)
                if known:
                    by_class[r["_y"]] = float(r["n"] or 0)
            for i in some:
                firing[i] += float(r[f"s{i}"] or 0)
                if known:
                    inside[i][r["_y"]] = float(r[f"s{i}"] or 0)
    return n, by_class, firing, inside


def antecedent_support(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> list[float]:
    """Mean firing strength of each rule."""
    n, _, s, _ = sums(df, base, label, coded)
    return [x / n if n else 0.0 for x in s]


def rule_support(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> list[float]:
    """Mean of the firing strength on rows of the rule's class (0 on others)."""
    n, _, _, by = sums(df, base, label, coded)
    return [by[i][r.consequent] / n if n else 0.0 for i, r in enumerate(base.rules)]


def rule_confidence(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> list[float]:
    """The share of a rule's firing strength on rows of its class; 0 where it never fires."""
    _, _, s, by = sums(df, base, label, coded)
    return [by[i][r.consequent] / s[i] if s[i] else 0.0 for i, r in enumerate(base.rules)]


def dominance(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> list[float]:
    """Support times confidence."""
    return [r.score for r in scored(df, base, label, coded).rules]


def by_class(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> list[list[tuple[float, float, float]]]:
    """For each rule and class: support, confidence and dominance as if the rule concluded that class."""
    n, _, s, by = sums(df, base, label, coded)
    out = []
    for i in range(len(base)):
        row = [(x / n if n else 0.0, x / s[i] if s[i] else 0.0) for x in by[i]]
        out.append([(a, b, a * b) for a, b in row])
    return out


def scored(df: DataFrame, base: RuleBase, label: str, coded: bool = False, aux: bool = False) -> RuleBase:
    """The base with support, confidence and score (dominance) on its rules; aux: for every class, too."""
    every = by_class(df, base, label, coded)
    rules = []
    for r, row in zip(base.rules, every, strict=True):
        s, c, d = row[r.consequent]
        rules.append(replace(r, support=s, confidence=c, score=d, aux=tuple(row) if aux else r.aux))
    return replace(base, rules=tuple(rules))


def association_degrees(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> DataFrame:
    """df and association: dominance times firing strength of each rule."""
    return replace(scored(df, base, label, coded), ds_mode=0).association(df)


def with_accuracy(df: DataFrame, base: RuleBase, label: str, coded: bool = False, weight: str | None = None) -> RuleBase:
    """The base with accuracies: the share of the rows each rule wins that are of its class; 0 where it never wins. weight: how often each row counts."""
    w = F.lit(1) if weight is None else F.col(weight)
    rows = _labelled(df, base, label, coded).groupBy("_winner").agg(F.sum(w).alias("n"), *(F.sum(F.when(F.col("_y") == c, w).otherwise(0)).alias(f"c{c}") for c in range(len(base.classes)))).collect()
    won = {r["_winner"]: r for r in rows}
    return replace(base, rules=tuple(replace(r, accuracy=won[i][f"c{r.consequent}"] / won[i]["n"] if i in won else 0.0) for i, r in enumerate(base.rules)))


def confusion(df: DataFrame, base: RuleBase, label: str, coded: bool = False, by: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows by true and predicted class place (and by another column); weight: how often each row counts."""
    made = _labelled(df, base, label, coded).withColumn("_p", F.expr(base.predicted_text()))
    keys = [F.col("_y").alias("actual"), F.col("_p").alias("predicted")]
    return made.groupBy(*([F.col(by)] if by else []), *keys).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def matthews(counts: dict[tuple[int, int], int]) -> float:
    """The multiclass correlation coefficient of a confusion table; 0 where one side has a single class."""
    n = sum(counts.values())
    right = sum(v for (a, b), v in counts.items() if a == b)
    actual: dict[int, int] = {}
    predicted: dict[int, int] = {}
    for (a, b), v in counts.items():
        actual[a] = actual.get(a, 0) + v
        predicted[b] = predicted.get(b, 0) + v
    both = sum(v * predicted.get(k, 0) for k, v in actual.items())
    spread = (n * n - sum(v * v for v in predicted.values())) * (n * n - sum(v * v for v in actual.values()))
    return (right * n - both) / math.sqrt(spread) if spread > 0 else 0.0


def collected(table: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["actual"], r["predicted"]): r["n"] for r in table.collect()}


METRICS: dict[str, Callable[[dict[tuple[int, int], int]], float]] = {}


def metric(f: Callable) -> Callable:
    METRICS[f.__name__] = f
    return f


@metric
def accuracy_score(counts: dict[tuple[int, int], int]) -> float:
    n = sum(counts.values())
    return sum(v for (a, b), v in counts.items() if a == b) / n if n else 0.0


@metric
def matthews_corrcoef(counts: dict[tuple[int, int], int]) -> float:
    return matthews(counts)


def _per_class(counts: dict[tuple[int, int], int]) -> list[tuple[float, float]]:
    out = []
    for c in sorted({a for a, _ in counts} | {b for _, b in counts}):
        hit = counts.get((c, c), 0)
        said = sum(v for (_, b), v in counts.items() if b == c)
        there = sum(v for (a, _), v in counts.items() if a == c)
        out.append((hit / said if said else 0.0, hit / there if there else 0.0))
    return out


@metric
def precision_score(counts: dict[tuple[int, int], int]) -> float:
    """Macro average."""
    p = _per_class(counts)
    return sum(a for a, _ in p) / len(p) if p else 0.0


@metric
def recall_score(counts: dict[tuple[int, int], int]) -> float:
    p = _per_class(counts)
    return sum(b for _, b in p) / len(p) if p else 0.0


balanced_accuracy_score = METRICS.setdefault("balanced_accuracy_score", recall_score)


@metric
def f1_score(counts: dict[tuple[int, int], int]) -> float:
    p = _per_class(counts)
    return sum(2 * a * b / (a + b) if a + b else 0.0 for a, b in p) / len(p) if p else 0.0


def classification(df: DataFrame, base: RuleBase, label: str, coded: bool = False, weight: str | None = None) -> dict[str, float]:
    counts = collected(confusion(df, base, label, coded, weight=weight))
    return {"accuracy": accuracy_score(counts), "mcc": matthews(counts)}


def size_antecedents(base: RuleBase, tolerance: float = 0.1) -> float:
    """1 less the share of possible antecedents in use, over rules above the tolerance; 0 if a class has no rule."""
    if any(not base.of_class(c) for c in range(len(base.classes))):
        return 0.0
    good = [r for r in base.rules if (r.score or 0) > tolerance]
    possible = len(good) * len(base.variables)
    return 1 - sum(map(len, good)) / possible if possible else 0.0


def effective_rules(base: RuleBase, tolerance: float = 0.1) -> float:
    """The share of rules above the tolerance; 0 if a class has no rule."""
    if not base.rules or any(not base.of_class(c) for c in range(len(base.classes))):
        return 0.0
    return sum((r.score or 0) > tolerance for r in base.rules) / len(base.rules)


def full_evaluation(df: DataFrame, base: RuleBase, label: str, coded: bool = False) -> RuleBase:
    """Scores, then accuracies of the scored base."""
    return with_accuracy(df, scored(df, base, label, coded, aux=True), label, coded)


def mcc_loss(df: DataFrame, base: RuleBase, label: str, tolerance: float = 0.0, alpha: float = 0.99, beta: float = 0.0125, gamma: float = 0.0125, coded: bool = False) -> float:
    """The fitness of a rule base: its correlation coefficient."""
    return classification(df, base, label, coded)["mcc"]


class Evaluator:
    """Reports on a fitted base."""

    def __init__(self, base: RuleBase, label: str, coded: bool = False):
        self.base, self.label, self.coded = base, label, coded

    def predict(self, df: DataFrame) -> DataFrame:
        return self.base.predict(df)

    def get_metric(self, name: str, df: DataFrame) -> float:
        if name not in METRICS:
            raise ValueError(f"unknown metric: {name}; there are {', '.join(sorted(METRICS))}")
        return METRICS[name](collected(confusion(df, self.base, self.label, self.coded)))

    def report(self, train: DataFrame, test: DataFrame, rules: bool = True) -> str:
        out = []
        for name, df in (("train", train), ("test", test)):
            counts = collected(confusion(df, self.base, self.label, self.coded))
            out.append(f"{name}: accuracy {accuracy_score(counts):.4f}, MCC {matthews(counts):.4f}")
        return "\n".join(out + ([self.base.text()] if rules else []))
