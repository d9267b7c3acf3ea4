"""Rules that depend on the time of day (or another part of a timestamp)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q
from lumifuzz.functions.membership import TemporalSet, Variable
from lumifuzz.operators import rule_quality
from lumifuzz.operators.partitions import fit_partitions
from lumifuzz.operators.rules import Rule, RuleBase, RuleError

PARTS: dict[str, Callable[[Column], Column]] = {"hour": F.hour, "minute": F.minute, "second": F.second, "day": F.dayofmonth, "month": F.month, "year": F.year, "weekday": F.weekday}


def part(column: str, resolution: str) -> Column:
    if resolution not in PARTS:
        raise ValueError(f"unknown part of a timestamp: {resolution}")
    return PARTS[resolution](F.col(column).cast("timestamp_ntz"))


def classify(df: DataFrame, column: str, cuts: tuple[int, int], resolution: str = "hour") -> DataFrame:
    """The rows whose part lies between two cuts, both included."""
    return df.where(part(column, resolution).between(*cuts))


def time_moments(df: DataFrame, column: str, windows: Sequence[tuple[int, int]], resolution: str = "hour", to: str = "time", strict: bool = False) -> DataFrame:
    """df and the place of the first window that a row lies in; a row in none has null, or is an error where strict."""
    p = part(column, resolution)
    out = F.when(F.col(column).isNull(), None)
    for i, (a, b) in enumerate(windows):
        out = out.when(p.between(a, b), i)
    if strict:
        out = out.otherwise(F.raise_error(F.lit("a row lies in no window")).cast("int"))
    return df.withColumn(to, out.cast("int"))


def _winner_text(v: Variable) -> str:
    texts = [f"coalesce({t}, 0e0)" for t in v.texts()]
    return q.first_max(texts, q.greatest(texts))


def conditional_frequencies(df: DataFrame, variables: Sequence[Variable], time: str = "time") -> DataFrame:
    """variable, time, label, n and frequency: how often a set is the fullest one at a time, over its most frequent time's count (plus 1e-6). One aggregate for all variables."""
    said = [F.struct(F.lit(v.name).alias("variable"), F.expr(f"cast({_winner_text(v)} as int)").alias("label")) for v in variables]
    long = df.where(F.col(time).isNotNull()).select(F.col(time).alias("time"), F.explode(F.array(*said)).alias("x")).groupBy("x.variable", "time", "x.label").agg(F.count("*").alias("n"))
    return long.withColumn("frequency", F.col("n") / (F.max("n").over(Window.partitionBy("variable", "label")) + 1e-6))


def temporal_variables(df: DataFrame, variables: Sequence[Variable], time: str = "time") -> list[Variable]:
    """The variables with sets scaled by their conditional frequencies, over all rows."""
    rows = {(r["variable"], r["label"], r["time"]): r["frequency"] for r in conditional_frequencies(df, variables, time).collect()}  # variables x sets x times
    steps = max((t for _, _, t in rows), default=-1) + 1
    return [Variable(v.name, tuple(TemporalSet(s.name, s, tuple(rows.get((v.name, i, t), 0.0) for t in range(steps)), time, domain=s.domain) for i, s in enumerate(v.sets)), v.units) for v in variables]


def temporal_variables_by_step(df: DataFrame, features: Sequence[str], steps: Sequence[int], time: str = "time", **options) -> list[list[Variable]]:
    """Variables fitted to the rows of each step, with that step's frequencies fixed."""
    out = []
    for t in steps:
        rows = df.where(F.col(time) == t)
        found = temporal_variables(rows, fit_partitions(rows, features, **options), time)
        out.append([v.fix(t) for v in found])
    return out


def assemble(df: DataFrame, column: str, windows: Sequence[tuple[int, int]], key: str, resolution: str = "hour", share: float = 0.33, seed: int = 33) -> tuple[DataFrame, DataFrame]:
    """(train, test): each window's rows, split by a hash of the key, put one after the other with the window as time."""
    parts = [classify(df, column, w, resolution).withColumn("time", F.lit(i)) for i, w in enumerate(windows)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    test = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("time")), F.lit(10_000)) < int(share * 10_000)
    return whole.where(~test), whole.where(test)


@dataclass(frozen=True)
class TemporalRuleBase:
    """A rule base for each time step; a rule fires only on rows of its step."""

    bases: tuple[RuleBase, ...]
    time: str = "time"

    def __post_init__(self):
        if not self.bases:
            raise RuleError("no time steps")
        object.__setattr__(self, "bases", tuple(self.bases))

    def __len__(self) -> int:
        return len(self.bases)

    def __getitem__(self, step: int) -> RuleBase:
        return self.bases[step]

    def rules(self) -> list[Rule]:
        return [r for b in self.bases for r in b.rules]

    def scores(self) -> list[float | None]:
        return [r.score for r in self.rules()]

    def consequents(self) -> list[int]:
        return [r.consequent for r in self.rules()]

    def matrix(self) -> list[list[list[int]]]:
        return [b.matrix() for b in self.bases]

    def add(self, rule: Rule, step: int) -> TemporalRuleBase:
        return TemporalRuleBase(tuple(b.add(rule) if i == step else b for i, b in enumerate(self.bases)), self.time)

    def with_base(self, base: RuleBase, step: int) -> TemporalRuleBase:
        return TemporalRuleBase((*self.bases[:step], base, *self.bases[step + 1 :]), self.time)

    def purged(self, tolerance: float = 0.001) -> TemporalRuleBase:
        return TemporalRuleBase(tuple(b.purged(tolerance) for b in self.bases), self.time)

    def text(self) -> str:
        return "\n".join(f"Rules for time step {i}\n{b.text()}" for i, b in enumerate(self.bases))

    def firing(self, df: DataFrame) -> DataFrame:
        """df and firing: the strengths of all steps' rules, 0 where the row's step is another."""
        out, names = df, []
        for t, b in enumerate(self.bases):
            made = b.firing(out).withColumnRenamed("firing", f"_step{t}")
            out = made
            names.append(F.transform(f"_step{t}", _masked(F.col(self.time) == t)))
        return out.withColumn("firing", F.concat(*names)).drop(*(f"_step{t}" for t in range(len(self.bases))))

    def predict(self, df: DataFrame, names: bool = False) -> DataFrame:
        """df, winner (over the rules of all steps) and predicted: of each row by the rules of its own step; rows without a step get the first rule's class."""
        factors = F.array(*(F.lit(b.factor(r)) for b in self.bases for r in b.rules))
        made = self.firing(df).withColumn("_a", F.zip_with("firing", factors, lambda f, s: f * s))
        first = (F.array_position("_a", F.array_max("_a")) - 1).cast("int")
        said = F.array(*(F.lit(b.classes[r.consequent] if names else r.consequent) for b in self.bases for r in b.rules))
        return made.withColumn("winner", first).withColumn("predicted", F.element_at(said, F.col("winner") + 1)).drop("_a", "firing")


def _masked(on: Column) -> Callable[[Column], Column]:
    return lambda f: F.when(on, f).otherwise(0.0)


class TemporalClassifier:
    """One fitted rule base for each time step."""

    def __init__(self, make: Callable[[Sequence[Variable] | None], object], variables: Sequence[Sequence[Variable]] | None = None, time: str = "time"):
        self.make, self.variables, self.time, self.base = make, variables, time, None

    def fit(self, df: DataFrame, label: str, steps: Sequence[int], **options) -> TemporalClassifier:
        bases = []
        for i, t in enumerate(steps):
            own = self.make(None if self.variables is None else self.variables[i])
            bases.append(own.fit(df.where(F.col(self.time) == t), label=label, **options).base)
        self.base = TemporalRuleBase(tuple(bases), self.time)
        return self

    def predict(self, df: DataFrame, names: bool = False) -> DataFrame:
        return self.base.predict(df, names)


def evaluate(df: DataFrame, base: TemporalRuleBase, label: str) -> dict[int | None, dict[str, float]]:
    """Accuracy and MCC at each step and, under None, over all: from one confusion table by step."""
    y = rule_quality.class_place(label, base.bases[0].classes)
    rows = base.predict(df).withColumn("_y", y).groupBy(base.time, "_y", "predicted").count().collect()
    tables: dict[int | None, dict[tuple[int, int], int]] = {None: {}}
    for r in rows:
        for t in (None, r[base.time]):
            cell = tables.setdefault(t, {})
            k = (r["_y"], r["predicted"])
            cell[k] = cell.get(k, 0) + r["count"]
    return {t: {"accuracy": rule_quality.accuracy_score(c), "mcc": rule_quality.matthews(c)} for t, c in tables.items()}
