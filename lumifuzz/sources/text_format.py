"""Rules and partitions as text, and their other forms (JSON, LaTeX).

Partitions: a line `$$$ Linguistic variable: <name>` (crisp ones end in `$Categorical`), then a line for each set: `name;lo,hi;trap;a,b,c,d`,
`name;lo,hi;gauss;mean,spread`, with the upper function's numbers and the height as more fields for interval sets.
Rules: a line `Rules for consequent: <class>`, then `IF v IS s [(MOD m)] AND ... WITH DS d, ACC a[, WGHT w]`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lumifuzz.functions.membership import Category, FuzzySet, Gaussian, IntervalCategory, IntervalGaussian, IntervalTrapezoid, Kind, Trapezoid, Variable
from lumifuzz.operators.rules import HEDGES, Rule, RuleBase

_HEAD, _CRISP = "$$$ Linguistic variable:", "$Categorical"
_MOD = re.compile(r"\s*\(MOD ([^)]*)\)")
_WORDS = {w: m for m, w in HEDGES.items() if w}


def mod_word(text: str) -> str | None:
    """What stands in `(MOD ...)`."""
    m = _MOD.search(text)
    return m[1] if m else None


def without_mod(text: str) -> str:
    return _MOD.sub("", text)


def without_parentheses(text: str) -> str:
    return re.sub(r"\s*\([^)]*\)", "", text)


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def _plain(x: float) -> str:
    return repr(round(float(x), 10))


def set_text(s: FuzzySet) -> str:
    domain = ",".join(map(_plain, s.domain)) if s.domain else ""
    if isinstance(s, Category):
        return f"{s.name}"
    if isinstance(s, Trapezoid):
        return f"{s.name};{domain};trap;{','.join(map(_plain, s.corners))}"
    if isinstance(s, Gaussian):
        return f"{s.name};{domain};gauss;{_plain(s.mean)},{_plain(s.spread)}"
    if isinstance(s, IntervalTrapezoid | IntervalGaussian):
        kind = "trap" if isinstance(s, IntervalTrapezoid) else "gauss"
        return f"{s.name};{domain};{kind};{','.join(map(_plain, s.lower))};{','.join(map(_plain, s.upper))};{_plain(s.height)}"
    raise ValueError(f"{s.name}: sets of this kind have no text form")


def variable_text(v: Variable) -> str:
    crisp = isinstance(v.sets[0], Category)
    return "\n".join([f"{_HEAD} {v.name}{' ' + _CRISP if crisp else ''}", *map(set_text, v.sets)])


def variables_text(variables: Sequence[Variable]) -> str:
    return "\n\n".join(map(variable_text, variables)) + "\n"


def load_variables(text: str, kind: Kind = Kind.T1) -> list[Variable]:
    """kind: of crisp sets, whose text does not tell it. Their values are read as numbers where they are numbers."""
    out: list[Variable] = []
    name, sets, crisp = None, [], False

    def close() -> None:
        if name is not None:
            out.append(Variable(name, tuple(sets)))

    for line in map(str.strip, text.split("\n")):
        if line.startswith(_HEAD):
            close()
            name, sets, crisp = line[len(_HEAD) :].strip(), [], False
            if name.endswith(_CRISP):
                name, crisp = name[: -len(_CRISP)].strip(), True
        elif line and name is not None:
            if crisp:
                try:
                    value: str | float = float(line) if "." in line or "e" in line.lower() else int(line)
                except ValueError:
                    value = line
                sets.append((Category if kind is Kind.T1 else IntervalCategory)(line, value))
                continue
            label, domain, shape, *rest = line.split(";")
            where = _numbers(domain) if domain else None
            if shape not in ("trap", "gauss"):
                raise ValueError(f"unknown shape: {shape}")
            p = _numbers(rest[0])
            if len(rest) == 1:
                sets.append(Trapezoid(label, p, domain=where) if shape == "trap" else Gaussian(label, *p, domain=where))
            else:
                height = float(rest[2]) if len(rest) > 2 else 1.0
                sets.append((IntervalTrapezoid if shape == "trap" else IntervalGaussian)(label, p, _numbers(rest[1]), height, domain=where))
    close()
    return out


def load_rules(text: str, variables: Sequence[Variable], classes: Sequence[str] = ()) -> RuleBase:
    """The rule base of a printed text; classes in the order of their headings unless given."""
    found, rules, at = list(classes), [], 0
    places = {v.name: i for i, v in enumerate(variables)}
    for line in map(str.strip, text.split("\n")):
        if line.startswith("Rules for consequent:"):
            label = line.split(":", 1)[1].strip()
            if label not in found:
                found.append(label)
            at = found.index(label)
        elif line.startswith("IF "):
            body, _, tail = line[3:].partition(" WITH ")
            antecedents, modifiers = [-1] * len(variables), [-1.0] * len(variables)
            for said in body.split(" AND "):
                word = mod_word(said)
                v, label = without_mod(said).split(" IS ", 1)
                i = places[v.strip()]
                antecedents[i] = variables[i].labels.index(label.strip())
                if word is not None:
                    modifiers[i] = _WORDS[word] if word in _WORDS else float(word)
            number = {k: float(x) for k, x in re.findall(r"(DS|ACC|WGHT) \[?([-+.\deE]+)", tail)}
            rules.append(Rule(tuple(antecedents), at, tuple(modifiers) if any(m != -1 for m in modifiers) else None, number.get("DS"), accuracy=number.get("ACC"), weight=number.get("WGHT")))
    return RuleBase(tuple(variables), tuple(rules), tuple(found))


def rules_json(base: RuleBase) -> str:
    return json.dumps({"classes": base.classes, "ds_mode": base.ds_mode, "allow_unknown": base.allow_unknown, "variables": variables_text(base.variables), "rules": [{"antecedents": r.antecedents, "consequent": r.consequent, "modifiers": r.modifiers, "score": r.score, "accuracy": r.accuracy, "weight": r.weight} for r in base.rules]})


def load_rules_json(text: str) -> RuleBase:
    d = json.loads(text)
    rules = [Rule(tuple(r["antecedents"]), r["consequent"], tuple(r["modifiers"]) if r["modifiers"] else None, r["score"], accuracy=r["accuracy"], weight=r["weight"]) for r in d["rules"]]
    return RuleBase(tuple(load_variables(d["variables"])), tuple(rules), tuple(d["classes"]), d["ds_mode"], d["allow_unknown"])


def rules_latex(base: RuleBase) -> str:
    """A table of the rules, class by class."""
    head = " & ".join([v.name for v in base.variables] + ["Class", "DS"])
    lines = [r"\begin{tabular}{" + "l" * (len(base.variables) + 2) + "}", head + r" \\", r"\hline"]
    for r in base.rules:
        cells = [v[a].name if a >= 0 else "-" for v, a in zip(base.variables, r.antecedents, strict=True)]
        lines.append(" & ".join([*cells, base.classes[r.consequent], "" if r.score is None else f"{r.score:.4f}"]) + r" \\")
    return "\n".join([*lines, r"\end{tabular}"])


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small text file from any store that Spark reads."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file in a folder, in any store that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_rules(base: RuleBase, spark: SparkSession, path: str) -> None:
    """The rules as a Parquet table."""
    base.frame(spark).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """A feature table: parquet, csv (with a header and inferred types unless told otherwise), json, orc."""
    defaults = {"header": True, "inferSchema": True} if form == "csv" else {}
    return spark.read.format(form).options(**{**defaults, **options}).load(path)
