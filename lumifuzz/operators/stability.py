"""How stable learned patterns are over refits on different splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.operators import rule_quality
from lumifuzz.operators.rules import RuleBase
from lumifuzz.operators.spread import over_cores
from lumifuzz.sources import shared

#: Refits at a time: their jobs are short, and mostly waiting.
AT_ONCE = 5


def add_dicts(a: dict, b: dict) -> dict:
    """Sums of values."""
    return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}


def first_dicts(a: dict, b: dict) -> dict:
    """Values of a, of b where a has none."""
    return {**b, **a}


def unique_patterns(base: RuleBase) -> list[tuple[int, tuple[int, ...], float]]:
    """(class, antecedents, score) of the base's different rules."""
    return list(dict.fromkeys((r.consequent, r.antecedents, float(r.score or 0)) for r in base.rules))


@dataclass
class Stabilizer:
    """make(): a new estimator with fit(df, label=...) and base. Splits are by a hash of the key (or of a group column, whose rows then stay together).

    For an estimator that says which columns it reads(), one pass counts, for rows that agree in their memberships() and the label, how many there are and how many each split tests with. All refits run
    on these counts, which are held in memory once, several refits at a time.
    """

    make: Callable[[], object]
    key: str
    bases: list[RuleBase] = field(default_factory=list)
    accuracies: list[float] = field(default_factory=list)

    def generate(self, df: DataFrame, label: str, n: int = 30, test_size: float = 0.33, group: str | None = None, **options) -> Stabilizer:
        tested = [F.pmod(F.xxhash64(F.lit(i), F.col(group or self.key)), F.lit(10_000)) < int(test_size * 10_000) for i in range(n)]
        one = self.make()
        names = one.reads() if hasattr(one, "reads") else None
        counted = None
        if names is not None and n:
            cases = [F.expr(t).alias(f"_m{i}") for i, t in enumerate(one.memberships())]
            # any values stand for those of equal memberships
            kept = [F.min(F.col(f"`{c}`")).alias(c) for c in names if c != label]
            sums = [F.count("*").alias("_n"), *(F.count_if(f"_t{i}").alias(f"_test{i}") for i in range(n))]
            each = df.select(F.col(f"`{label}`"), *(F.col(f"`{c}`") for c in names if c != label), *cases, *(t.alias(f"_t{i}") for i, t in enumerate(tested)))
            counted = shared.cut(each.groupBy(F.col(f"`{label}`"), *(f"_m{i}" for i in range(len(cases)))).agg(*kept, *sums), "stability-counts")
            rows = over_cores(counted).persist()

        def split(i: int) -> tuple[DataFrame, DataFrame, dict, str | None]:
            if counted is None:
                return df.where(~tested[i]), df.where(tested[i]), {}, None
            train = rows.withColumn(f"_train{i}", F.col("_n") - F.col(f"_test{i}")).where(f"_train{i} > 0")
            return train, rows.where(f"_test{i} > 0"), {"weight": f"_train{i}", "grouped": True}, f"_test{i}"

        def refit(made: tuple[DataFrame, DataFrame, dict, str | None]) -> tuple[RuleBase, float]:
            train, test, more, weight = made
            base = self.make().fit(train, label=label, **options, **more).base
            return base, rule_quality.classification(test, base, label, weight=weight)["accuracy"] if base.rules else 0.0

        if counted is None:
            done = [refit(split(i)) for i in range(n)]
        else:
            with ThreadPoolExecutor(min(n, AT_ONCE)) as pool:
                done = list(pool.map(refit, [split(i) for i in range(n)]))
            rows.unpersist()
            shared.drop(counted)
        self.bases += [b for b, _ in done]
        self.accuracies += [a for _, a in done]
        return self

    def patterns(self, spark: SparkSession) -> DataFrame:
        """run, class, antecedents, score: a row for each different rule of each refit."""
        rows = [(i, b.classes[c], list(a), s) for i, b in enumerate(self.bases) for c, a, s in unique_patterns(b)]
        return spark.createDataFrame(rows, "run int, class string, antecedents array<int>, score double")

    def counts(self, spark: SparkSession) -> DataFrame:
        """class, antecedents, n (refits that found the rule), score (its mean)."""
        return self.patterns(spark).groupBy("class", "antecedents").agg(F.count_distinct("run").alias("n"), F.avg("score").alias("score"))

    def usage(self, spark: SparkSession) -> DataFrame:
        """class, variable, label, n: how often each set is used."""
        return self.patterns(spark).select("class", F.posexplode("antecedents").alias("variable", "label")).where("label >= 0").groupBy("class", "variable", "label").agg(F.count("*").alias("n"))

    def usage_by_variable(self, spark: SparkSession, class_name: str | None = None) -> DataFrame:
        """variable and its share of all uses (of one class): the table behind the charts."""
        u = self.usage(spark)
        u = u if class_name is None else u.where(F.col("class") == class_name)
        n = u.agg(F.sum("n")).first()[0] or 1
        return u.groupBy("variable").agg((F.sum("n") / n).alias("share"))

    def usage_by_label(self, spark: SparkSession, variable: int, class_name: str | None = None) -> DataFrame:
        u = self.usage(spark).where(F.col("variable") == variable)
        u = u if class_name is None else u.where(F.col("class") == class_name)
        n = u.agg(F.sum("n")).first()[0] or 1
        return u.groupBy("label").agg((F.sum("n") / n).alias("share"))

    def report(self, spark: SparkSession, cutoff: int = 5) -> str:
        n = len(self.bases)
        mean = sum(self.accuracies) / n if n else 0.0
        spread = (sum((a - mean) ** 2 for a in self.accuracies) / n) ** 0.5 if n else 0.0
        out = [f"{n} refits, accuracy {mean:.3f} ± {spread:.3f}"]
        for b in self.bases[:1]:
            rows = self.counts(spark).orderBy(F.desc("n"), F.desc("score"), F.col("antecedents").cast("string")).limit(cutoff * max(1, len(b.classes))).collect()
            for r in rows:
                out.append(f"{r['class']}: {list(r['antecedents'])} in {r['n']} of {n}, dominance {r['score']:.4f}")
            for r in self.usage(spark).orderBy("class", F.desc("n"), "variable", "label").collect():
                v = b.variables[r["variable"]]
                out.append(f"{r['class']}: {v.name} IS {v[r['label']].name} {r['n']} times")
        return "\n".join(out)


def var_report(counts: Sequence[tuple[str, int]], cutoff: int = 10) -> str:
    return "\n".join(f"{name}: {n}" for name, n in sorted(counts, key=lambda x: (-x[1], x[0]))[:cutoff])
