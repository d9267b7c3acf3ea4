"""Rules, rule bases and what they say about rows.

A rule names at most one set of each variable (-1: any). Rules and variables are small and stay on the driver; a rule base
compiles to projections: memberships, firing strengths (product of the memberships; least of them where asked for), association degrees
and the winner. No step shuffles.

Semantics: a rule without antecedents fires 0; null memberships count as 0; a modifier m raises a membership to the power of m; of
equal degrees the first rule wins, in class-major order; a row that nothing fires for goes to the first rule's class, or to -1 where
allow_unknown. Type-2 degrees are the means of their bounds; general type 2 normalises the firing strengths of each alpha cut
by their sum over the rules of a class first, and then weights the cuts by their alphas.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q
from lumifuzz.functions.membership import FAR, FuzzySet, Kind, TriangularType2, Variable


class RuleError(ValueError):
    """A rule base that cannot be used."""


@dataclass(frozen=True)
class Rule:
    antecedents: tuple[int, ...]
    consequent: int = 0
    modifiers: tuple[float, ...] | None = None
    score: float | None = field(default=None, compare=False)
    support: float | None = field(default=None, compare=False)
    confidence: float | None = field(default=None, compare=False)
    weight: float | None = field(default=None, compare=False)
    accuracy: float | None = field(default=None, compare=False)
    p_values: tuple[float, ...] | None = field(default=None, compare=False)
    support_interval: tuple[float, float] | None = field(default=None, compare=False)
    confidence_interval: tuple[float, float] | None = field(default=None, compare=False)
    aux: tuple[tuple[float, float, float], ...] | None = field(default=None, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "antecedents", tuple(int(a) for a in self.antecedents))

    def __len__(self) -> int:
        return sum(a >= 0 for a in self.antecedents)

    def __getitem__(self, i: int) -> int:
        return self.antecedents[i]

    def parts(self) -> list[tuple[int, int, float]]:
        """(variable, set, modifier) of the antecedents."""
        m = self.modifiers or (-1,) * len(self.antecedents)
        return [(v, a, 1.0 if m[v] == -1 else float(m[v])) for v, a in enumerate(self.antecedents) if a >= 0]


def mu(v: int, s: int, side: str = "") -> str:
    return f"_mu{v}_{s}{side}"


@dataclass(frozen=True)
class RuleBase:
    """The rules of all classes, class by class, over a list of variables."""

    variables: tuple[Variable, ...]
    rules: tuple[Rule, ...]
    classes: tuple[str, ...] = ()
    ds_mode: int = 0
    allow_unknown: bool = False
    tnorm: str = "product"

    def __post_init__(self):
        object.__setattr__(self, "variables", tuple(self.variables))
        ordered = sorted(dict.fromkeys(self.rules), key=lambda r: r.consequent)
        object.__setattr__(self, "rules", tuple(ordered))
        n = max((r.consequent for r in ordered), default=-1) + 1
        object.__setattr__(self, "classes", tuple(self.classes) or tuple(str(i) for i in range(n)))
        if n > len(self.classes):
            raise RuleError("a rule names a class that does not exist")
        for r in ordered:
            if len(r.antecedents) != len(self.variables) or any(a >= len(v) for a, v in zip(r.antecedents, self.variables, strict=False)):
                raise RuleError(f"{r.antecedents} does not fit the variables")
        if self.tnorm not in ("product", "min"):
            raise RuleError(f"unknown t-norm: {self.tnorm}")

    # the collection

    def __len__(self) -> int:
        return len(self.rules)

    def __iter__(self):
        return iter(self.rules)

    def __getitem__(self, i: int) -> Rule:
        return self.rules[i]

    def __add__(self, other: RuleBase) -> RuleBase:
        return replace(self, rules=self.rules + other.rules, classes=max(self.classes, other.classes, key=len))

    def copy(self) -> RuleBase:
        return copy.deepcopy(self)

    def of_class(self, c: int) -> list[Rule]:
        return [r for r in self.rules if r.consequent == c]

    def add(self, *rules: Rule) -> RuleBase:
        return replace(self, rules=self.rules + tuple(rules))

    def remove(self, places: Iterable[int]) -> RuleBase:
        gone = set(places)
        return replace(self, rules=tuple(r for i, r in enumerate(self.rules) if i not in gone))

    def renamed(self, classes: Sequence[str]) -> RuleBase:
        return replace(self, classes=tuple(classes))

    def purged(self, tolerance: float = 0.001) -> RuleBase:
        """Without rules whose score is under the tolerance or whose accuracy is 0; classes keep their places."""
        return replace(self, rules=tuple(r for r in self.rules if (r.score or 0) >= tolerance and r.accuracy != 0))

    @property
    def kind(self) -> Kind:
        return self.variables[0].kind

    def matrix(self) -> list[list[int]]:
        return [list(r.antecedents) for r in self.rules]

    def scores(self) -> list[float | None]:
        return [r.score for r in self.rules]

    def weights(self) -> list[float]:
        return [1.0 if r.weight is None else r.weight for r in self.rules]

    def consequents(self) -> list[int]:
        return [r.consequent for r in self.rules]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table."""
        rows = [(i, list(r.antecedents), r.consequent, self.classes[r.consequent], *(None if x is None else float(x) for x in (r.score, r.support, r.confidence, r.weight, r.accuracy))) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule int, antecedents array<int>, consequent int, class string, score double, support double, confidence double, weight double, accuracy double")

    # text

    def rule_text(self, r: Rule, validation: bool = True) -> str:
        said = []
        for v, a, m in r.parts():
            more = "" if m == 1.0 else f" (MOD {_hedge(m)})"
            said.append(f"{self.variables[v].name} IS {self.variables[v][a].name}{more}")
        out = "IF " + " AND ".join(said)
        if r.score is not None:
            out += f" WITH DS {r.score}"
            if r.accuracy is not None:
                out += f", ACC {r.accuracy}"
            if r.weight is not None:
                out += f", WGHT {r.weight}"
        if validation and r.p_values:
            out += " (p-values " + ", ".join(f"{p:.3f}{stars(p)}" for p in r.p_values) + ")"
        if validation and r.support_interval:
            out += f" (support {r.support_interval[0]:.3f} - {r.support_interval[1]:.3f}"
            out += f", confidence {r.confidence_interval[0]:.3f} - {r.confidence_interval[1]:.3f})" if r.confidence_interval else ")"
        return out

    def text(self, validation: bool = True) -> str:
        out = []
        for c, label in enumerate(self.classes):
            out += [f"Rules for consequent: {label}", "----------------"] + [self.rule_text(r, validation) for r in self.of_class(c)] + [""]
        return "\n".join(out)

    __str__ = text

    # compilation

    def _cuts(self) -> tuple[float, ...]:
        """Alpha cuts of a general type-2 base; else one."""
        return getattr(self.variables[0][0], "base", self.variables[0][0]).cuts if self.kind is Kind.GT2 else (1.0,)

    def _firing(self) -> tuple[list[str], list[str], list[str]]:
        """Projections of the used values, of their memberships in the used sets, and of each rule's firing strength: by side (l, and u but for type 1) and alpha cut, never null."""
        cuts, sides = self._cuts(), "l" if self.kind is Kind.T1 else "lu"
        used = sorted({(v, a) for r in self.rules for v, a, _ in r.parts()})
        values = [f"{self.variables[v].sure_value()} as _x{v}" for v in sorted({v for v, _ in used})]
        memberships = [f"{text} as {mu(v, a, side)}{j}" for v, a in used for j, pair in enumerate(self.variables[v][a].sure_cuts(f"_x{v}", len(cuts))) for side, text in zip(sides, pair, strict=False)]

        def fold(r: Rule, side: str, j: int) -> str:
            parts = [f"{mu(v, a, side)}{j}" if m == 1.0 else f"power({mu(v, a, side)}{j}, {q.number(m)})" for v, a, m in r.parts()]
            if not parts:
                return "0e0"
            return "(" + " * ".join(parts) + ")" if self.tnorm == "product" else q.least(parts)

        return values, memberships, [f"{fold(r, side, j)} as _f{side}{i}_{j}" for i, r in enumerate(self.rules) for side in sides for j in range(len(cuts))]

    def factor(self, r: Rule) -> float:
        if self.ds_mode == 1:
            return 1.0
        if self.ds_mode == 2:
            return 1.0 if r.weight is None else float(r.weight)
        return 1.0 if r.score is None else float(r.score)

    def steps(self, scaled: bool | None = None) -> list[list[str]]:
        """Projections, each added to the columns before: values, memberships, firing strengths _fl<i> and _fu<i> with their mean _f<i>, association degrees _a<i>, and the best of those and its rule, _best and _winner.

        scaled: strengths are divided by their sum over the rules of the same class, for each side and alpha cut (the default for general type 2). Every expression is short and never null, and what
        is used more than once is a column, so that the code that is generated for a whole base stays small enough to be compiled.
        """
        if not self.rules:
            raise RuleError("the rule base has no rules")
        n, cuts, sides = range(len(self.rules)), self._cuts(), "l" if self.kind is Kind.T1 else "lu"
        scaled = self.kind is Kind.GT2 if scaled is None else scaled
        if self._in_batches():
            return [[f"get(_gt.{side}, {i}) as _f{side}{i}" for side in sides for i in n], *self._degrees()]
        out = [x for x in self._firing() if x]
        held = {(side, i, j): f"_f{side}{i}_{j}" for side in sides for i in n for j in range(len(cuts))}
        if scaled:
            sums = [(side, c, j) for side in sides for c in sorted({r.consequent for r in self.rules}) for j in range(len(cuts))]
            out.append([f"{q.total([held[side, i, j] for i in n if self.rules[i].consequent == c])} as _s{side}{c}_{j}" for side, c, j in sums])
            for (side, i, j), x in held.items():
                s = f"_s{side}{self.rules[i].consequent}_{j}"
                held[side, i, j] = f"(case when {s} > 0e0 then {x} / {s} else {x} end)"
        if len(cuts) > 1:
            reduced = {(side, i): f"{q.total([f'{held[side, i, j]} * {q.number(a)}' for j, a in enumerate(cuts)])} / {q.number(sum(cuts))}" for side in sides for i in n}
        else:
            reduced = {(side, i): held[side, i, 0] for side in sides for i in n}
        out.append([f"{x} as _f{side}{i}" for (side, i), x in reduced.items()])
        return [*out, *self._degrees()]

    def _degrees(self) -> list[list[str]]:
        """Projections over the bounds of the strengths: their means, association degrees, the best of those and its rule."""
        n, out = range(len(self.rules)), []
        out.append([f"_fl{i} as _f{i}" if self.kind is Kind.T1 else f"(_fl{i} + _fu{i}) / 2e0 as _f{i}" for i in n])
        out.append([f"_f{i} * {q.number(self.factor(r))} as _a{i}" for i, r in enumerate(self.rules)])
        out.append([f"array({', '.join(f'_a{i}' for i in n)}) as _as"])
        out.append(["array_max(_as) as _best"])
        place = "cast(array_position(_as, _best) as int) - 1"
        out.append([f"case when _best = 0e0 then -1 else {place} end as _winner" if self.allow_unknown else f"{place} as _winner"])
        return out

    def _in_batches(self) -> bool:
        """Whether strengths are computed over Arrow batches: a dozen cuts of each closed general type-2 set would be more generated code than the JVM compiles."""
        return any(isinstance(self.variables[v][a], TriangularType2) for r in self.rules for v, a, _ in r.parts())

    def _cut_strengths(self, scaled: bool) -> Callable[..., pd.DataFrame]:
        """Values of the used variables to the strengths of all rules, weighted over the alpha cuts."""
        alphas = np.array(self._cuts())
        parts = [r.parts() for r in self.rules]
        used = sorted({v for own in parts for v, _, _ in own})
        sets = {(v, a): self.variables[v][a] for own in parts for v, a, _ in own}
        own_class, least = np.array(self.consequents()), self.tnorm == "min"

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            values = {v: batch.iloc[:, i].to_numpy(float) for i, v in enumerate(used)}
            cut = {(v, a): np.where((values[v] == FAR)[:, None, None], 0.0, one.all_cuts(values[v])) for (v, a), one in sets.items()}
            f = np.zeros((len(parts), len(batch), len(alphas), 2))
            for i, own in enumerate(parts):
                if own:
                    each = [cut[v, a] if m == 1.0 else cut[v, a] ** m for v, a, m in own]
                    f[i] = np.minimum.reduce(each) if least else np.multiply.reduce(each)
            if scaled:
                for c in np.unique(own_class):
                    total = f[own_class == c].sum(axis=0)
                    f[own_class == c] /= np.where(total > 0, total, 1.0)
            reduced = (f * alphas[:, None]).sum(axis=2) / alphas.sum()
            return pd.DataFrame({"l": list(reduced[:, :, 0].T), "u": list(reduced[:, :, 1].T)})

        return run

    def applied(self, df: DataFrame, scaled: bool | None = None) -> DataFrame:
        if self.rules and self._in_batches():
            used = sorted({v for r in self.rules for v, _, _ in r.parts()})
            run = F.pandas_udf(self._cut_strengths(self.kind is Kind.GT2 if scaled is None else scaled), "l array<double>, u array<double>")
            df = df.withColumn("_gt", run(F.struct(*(F.expr(self.variables[v].sure_value()).alias(f"x{v}") for v in used))))
        for step in self.steps(scaled):
            df = df.select("*", *map(F.expr, step))
        return df

    def _pick(self, values: Sequence[str], otherwise: str) -> str:
        """What a literal array holds for the winner."""
        return f"coalesce(get(array({', '.join(values)}), _winner), {otherwise})"

    def predicted_text(self, names: bool = False) -> str:
        values = [q.text(self.classes[r.consequent]) if names else str(r.consequent) for r in self.rules]
        return self._pick(values, q.text("Unknown") if names else "-1")

    # on rows

    def _outputs(self, df: DataFrame, *made: Column) -> DataFrame:
        return self.applied(df).select(*(F.col(f"`{c}`") for c in df.columns), *made)

    def firing(self, df: DataFrame, scaled: bool | None = None) -> DataFrame:
        """df and firing: array of the rules' strengths."""
        return self.applied(df, scaled).select(*(F.col(f"`{c}`") for c in df.columns), F.array(*(F.col(f"_f{i}") for i in range(len(self)))).alias("firing"))

    def association(self, df: DataFrame) -> DataFrame:
        """df and association: array of the rules' degrees."""
        return self._outputs(df, F.array(*(F.col(f"_a{i}") for i in range(len(self)))).alias("association"))

    def predict(self, df: DataFrame, names: bool = False) -> DataFrame:
        """df, winner (place of the winning rule) and predicted (class place, or name). Without rules: -1, or Unknown."""
        if not self.rules:
            return df.select("*", F.lit(-1).alias("winner"), F.lit("Unknown" if names else -1).alias("predicted"))
        return self._outputs(df, F.col("_winner").alias("winner"), F.expr(self.predicted_text(names)).alias("predicted"))

    __call__ = predict

    def explain(self, df: DataFrame, names: bool = False) -> DataFrame:
        """df, predicted, winner, strength (the highest firing strength) and interval (the winner's confidence interval times it)."""
        strength = F.expr(self._greatest([f"_f{i}" for i in range(len(self))]))
        ends = [[str((r.confidence_interval or (1.0, 1.0))[k]) for r in self.rules] for k in (0, 1)]
        interval = F.struct(*((F.expr(self._pick([q.number(float(x)) for x in e], "0e0")) * strength).alias(side) for e, side in zip(ends, ("lo", "hi"), strict=True)))
        return self._outputs(df, F.expr(self.predicted_text(names)).alias("predicted"), F.col("_winner").alias("winner"), strength.alias("strength"), interval.alias("interval"))

    @staticmethod
    def _greatest(parts: Sequence[str]) -> str:
        return f"array_max(array({', '.join(parts)}))" if parts else "0e0"

    def class_steps(self) -> list[list[str]]:
        """Projections over an applied base: _m<c>, for each class the highest association degree of its rules, and _p<c>, that over the sum for all classes (uniform where it is 0)."""
        k = range(len(self.classes))
        best = [f"{self._greatest([f'_a{i}' for i, r in enumerate(self.rules) if r.consequent == c])} as _m{c}" for c in k]
        return [best, [f"{q.total([f'_m{c}' for c in k])} as _mt"], [f"(case when _mt = 0e0 then {q.number(1 / len(self.classes))} else _m{c} / _mt end) as _p{c}" for c in k]]

    def with_classes(self, df: DataFrame) -> DataFrame:
        """The applied base with the columns of class_steps()."""
        made = self.applied(df)
        for step in self.class_steps():
            made = made.select("*", *map(F.expr, step))
        return made

    def _class_outputs(self, df: DataFrame, column: str, name: str) -> DataFrame:
        return self.with_classes(df).select(*(F.col(f"`{c}`") for c in df.columns), F.array(*(F.col(f"{column}{c}") for c in range(len(self.classes)))).alias(name))

    def class_membership(self, df: DataFrame) -> DataFrame:
        """df and memberships: for each class the highest association degree of its rules."""
        return self._class_outputs(df, "_m", "memberships")

    def probabilities(self, df: DataFrame) -> DataFrame:
        """df and probabilities: the class memberships over their sum; uniform where it is 0."""
        return self._class_outputs(df, "_p", "probabilities")


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


#: The words for modifiers.
HEDGES = {0.5: "Somewhat", 1.0: "", 1.3: "A little", 1.7: "Slightly", 2.0: "Very", 3.0: "Extremely", 4.0: "Very very"}


def _hedge(m: float) -> str:
    return HEDGES.get(m) or repr(m)


def rule_base(matrix: Sequence[Sequence[int]], consequents: Sequence[int], variables: Sequence[Variable], weights: Sequence[float] | None = None, classes: Sequence[str] = ()) -> RuleBase:
    rules = [Rule(tuple(m), int(c), weight=None if weights is None else float(weights[i])) for i, (m, c) in enumerate(zip(matrix, consequents, strict=True))]
    return RuleBase(tuple(variables), tuple(rules), tuple(classes))


@dataclass(frozen=True)
class MamdaniRule:
    """A rule over explicit sets, one for each of some columns, with a fuzzy consequent."""

    antecedents: tuple[tuple[str, FuzzySet], ...]
    consequent: FuzzySet

    def membership(self, tnorm: Callable[[Column, Column], Column] = lambda a, b: a * b) -> Column:
        columns = [F.expr(s.text(q.clean(q.name(c)))) for c, s in self.antecedents]
        out = columns[0]
        for c in columns[1:]:
            out = tnorm(out, c)
        return out

    def consequent_centroid(self) -> float:
        from lumifuzz.operators.centroids import set_centroid

        return set_centroid(self.consequent, 0.05)


# regression: rules whose consequents are sets of one output variable


def infer_type1(base: RuleBase, output: Variable, df: DataFrame, column: str = "inferred") -> DataFrame:
    """df and the sum of the consequents' centroids, weighted by the firing strengths; null where nothing fires."""
    from lumifuzz.operators.centroids import set_centroid

    c = [set_centroid(s) for s in output.sets]
    up = q.total([f"_f{i} * {q.number(c[r.consequent])}" for i, r in enumerate(base.rules)])
    return base._outputs(df, F.expr(q.ratio(up, q.total([f"_f{i}" for i in range(len(base))]))).alias(column))


def infer_interval(base: RuleBase, output: Variable, df: DataFrame, column: str = "inferred") -> DataFrame:
    """df and a struct of lo and hi: the type-reduced centroids over the rules' firing intervals, of each row (the search depends on the order of the rules; it runs in numpy over Arrow batches, for all rows of a batch at once)."""
    from lumifuzz.operators.centroids import consequent_centroids, interval_centroid

    ends = np.array([interval_centroid(s) for s in output.sets])
    mine = np.array([ends[r.consequent] for r in base.rules])
    n = len(base)

    @F.pandas_udf("lo double, hi double")
    def reduce(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        both = [np.stack(x.to_numpy()) if len(x) else np.empty((0, n)) for x in (low, high)]
        return pd.DataFrame(dict(zip(("lo", "hi"), consequent_centroids(np.stack(both, axis=2), mine), strict=True)))

    side = "_fl" if base.kind is Kind.T1 else "_fu"
    return base._outputs(df, reduce(F.array(*(F.col(f"_fl{i}") for i in range(n))), F.array(*(F.col(f"{side}{i}") for i in range(n)))).alias(column))


def forward(base: RuleBase, output: Variable, df: DataFrame) -> float | None:
    """The mean inferred value over all rows (and both ends)."""
    if base.kind is Kind.T1:
        return infer_type1(base, output, df).agg(F.avg("inferred")).first()[0]
    return infer_interval(base, output, df).agg(F.avg((F.col("inferred.lo") + F.col("inferred.hi")) / 2)).first()[0]
