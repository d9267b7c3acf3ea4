"""Frequent fuzzy itemsets and rules from them.

The support of an itemset is the mean of the least membership of its items. Each task adds up the supports of all candidates, for all rows
and for each class, with numpy over Arrow batches of the features themselves; memberships are computed there, once for each batch, and
one short row for each task and candidate is shuffled. While all possible itemsets are few (ONE_PASS), they are one job, whatever
their depth; beyond that one level is one job, with candidates joined from the itemsets kept on the level before, as a support only
falls when items are added (the same result).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.functions.membership import Category, Kind, Variable
from lumifuzz.operators.partitions import fit_partitions
from lumifuzz.operators.rule_quality import class_place
from lumifuzz.operators.rules import Rule, RuleBase
from lumifuzz.operators.spread import over_cores

#: ((variable, set), ...), ascending by variable.
Itemset = tuple[tuple[int, int], ...]
_NO_CLASS = -1
#: Candidates up to which all levels are counted in one job.
ONE_PASS = 2000
#: By (variable, set): the lower and upper membership of a batch's rows.
Memberships = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


class _Rows:
    """Rows by class place and what their memberships are computed from; averaged: type-2 memberships count as the means of their bounds."""

    def __init__(self, df: DataFrame, variables: Sequence[Variable], label: str | None, classes: Sequence[str], averaged: bool = False):
        y = F.coalesce(class_place(label, classes) if label else F.lit(None), F.lit(_NO_CLASS)).cast("int").alias("y")
        self.variables = tuple(variables)
        #: Sets that depend on other columns than their own (temporal ones) are computed by SQL.
        self.values = all(hasattr(s, "at") for v in variables for s in v.sets)
        columns = [f"{v.value()} as x{i}" if isinstance(v.sets[0], Category) else f"cast({v.value()} as double) as x{i}" for i, v in enumerate(variables)] if self.values else [f"{t} as m{i}_{j}_{k}" for i, v in enumerate(variables) for j, pair in enumerate(v.bounds()) for k, t in enumerate(pair)]
        self.df = over_cores(df.select(y, *map(F.expr, columns)))
        self.averaged, self.type1 = averaged, averaged or all(v.kind is Kind.T1 for v in variables)

    def memberships(self, batch: pa.RecordBatch) -> Memberships:
        out: Memberships = {}
        for i, v in enumerate(self.variables):
            if not self.values:
                for j in range(len(v)):
                    low, high = (np.nan_to_num(batch.column(f"m{i}_{j}_{k}").to_numpy(zero_copy_only=False).astype(float)) for k in (0, 1))
                    out[i, j] = low, high
                continue
            x = batch.column(f"x{i}").to_numpy(zero_copy_only=False)
            if x.dtype != object:
                x = x.astype(float)
                missing = np.isnan(x)
                x = np.where(missing, 0.0, x)
            else:
                missing = np.zeros(len(x), bool)  # a null equals no category
            for j, s in enumerate(v.sets):
                m = np.asarray(s.at(x), float)
                m[missing] = 0.0
                out[i, j] = (m, m) if m.ndim == 1 else (m[:, 0], m[:, 1])
        return out

    def __getstate__(self) -> dict:
        """What tasks need: all but the rows themselves."""
        return {k: v for k, v in self.__dict__.items() if k != "df"}

    def totals(self, candidates: list[Itemset]) -> tuple[dict[int, int], dict[int, dict[int, float]]]:
        """Rows by class place; and by candidate and class place the sum of least memberships (for type 2 the mean of both bounds')."""

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], float] = {}
            for batch in batches:
                y = batch.column("y").to_numpy()
                # rows of a class lie together, so that each class is a slice
                order = np.argsort(y, kind="stable")
                places, starts = np.unique(y[order], return_index=True)
                held = {k: (((low + high) / 2)[order],) if self.averaged else (low[order], high[order]) for k, (low, high) in self.memberships(batch).items()}
                for c, n in zip(places.tolist(), np.diff([*starts, len(y)]).tolist(), strict=True):
                    total[-1, c] = total.get((-1, c), 0.0) + n
                for i, items in enumerate(candidates):
                    least = _least([held[k][0] for k in items])
                    if not self.type1:
                        least = (least + _least([held[k][1] for k in items])) / 2
                    for c, t in zip(places.tolist(), np.add.reduceat(least, starts).tolist(), strict=True):
                        total[i, c] = total.get((i, c), 0.0) + t
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32()), pa.array([total[k] for k in keys], pa.float64())], ["item", "y", "s"])

        sizes: dict[int, int] = {}
        out: dict[int, dict[int, float]] = {}
        for r in self.df.mapInArrow(add_up, "item int, y int, s double").groupBy("item", "y").agg(F.sum("s").alias("s")).collect():  # candidates x classes
            if r["item"] < 0:
                sizes[r["y"]] = int(r["s"])
            else:
                out.setdefault(r["item"], {})[r["y"]] = r["s"]
        return sizes, out


def _least(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = np.minimum(out, p)
    return out


def _every(variables: Sequence[Variable], depth: int) -> list[Itemset] | None:
    """All itemsets of at most depth items, if they are few."""
    out: list[Itemset] = []
    for k in range(1, depth + 1):
        for vs in combinations(range(len(variables)), k):
            if len(out) > ONE_PASS:
                return None
            out += [tuple(zip(vs, ss, strict=True)) for ss in product(*(range(len(variables[v])) for v in vs))]
    return out if len(out) <= ONE_PASS else None


def _next_level(kept: list[Itemset], singles: list[Itemset]) -> list[Itemset]:
    held = set(kept)
    out = []
    for items in kept:
        for (last,) in singles:
            if last[0] > items[-1][0]:
                new = (*items, last)
                if all(sub in held for sub in combinations(new, len(items))):
                    out.append(new)
    return out


@dataclass(frozen=True)
class Mined:
    items: Itemset
    #: Of all rows, or of one class.
    support: float
    class_place: int | None = None


def mine_itemsets(df: DataFrame, variables: Sequence[Variable], threshold: float = 0.05, max_depth: int | None = None, label: str | None = None, classes: Sequence[str] = ()) -> list[Mined]:
    """Itemsets of at most max_depth items with a support above the threshold: over all rows, or, with a label, over the rows of each class."""
    rows, depth = _Rows(df, variables, label, classes), max_depth or len(variables)
    groups = list(range(len(classes))) if label else [None]
    level: dict[int | None, list[Itemset]] = {g: [((i, j),) for i, v in enumerate(variables) for j in range(len(v))] for g in groups}
    singles: dict[int | None, list[Itemset]] = {}
    known = _every(variables, min(depth, len(variables)))
    if known is not None:
        sizes, totals = rows.totals(known)
    out: list[Mined] = []
    for _ in range(depth):
        asked = sorted({s for items in level.values() for s in items})
        if not asked:
            break
        if known is None:
            sizes, totals = rows.totals(asked)
        place = {s: i for i, s in enumerate(asked if known is None else known)}
        for g in groups:
            kept = []
            n = sizes.get(g, 0) if label else sum(sizes.values())
            for s in level[g]:
                by = totals.get(place[s], {})
                total = sum(by.values()) if g is None else by.get(g, 0.0)
                if n and total / n > threshold:
                    kept.append(s)
                    out.append(Mined(s, total / n, g))
            level[g] = _next_level(kept, singles.setdefault(g, kept))
    return out


def rules_of(itemsets: Sequence[Mined], n_variables: int) -> list[Rule]:
    out = []
    for m in itemsets:
        a = [-1] * n_variables
        for v, s in m.items:
            a[v] = s
        out.append(Rule(tuple(a), m.class_place or 0, support=m.support))
    return out


def mine_rules(df: DataFrame, variables: Sequence[Variable], threshold: float = 0.05, max_depth: int = 3) -> RuleBase:
    """Rules without a class, from the itemsets of all rows."""
    return RuleBase(tuple(variables), tuple(rules_of(mine_itemsets(df, variables, threshold, max_depth), len(variables))), ("0",))


@dataclass(frozen=True)
class Merit:
    global_support: float
    class_support: float
    #: class_support / global_support, and that over the share of the class: the names under which rules are pruned.
    confidence: float | None
    lift: float | None
    #: The share of the rule's support that lies on its class.
    true_confidence: float | None


def merits(df: DataFrame, base: RuleBase, label: str) -> list[Merit]:
    """Of each rule, with the least membership as its strength (for type 2 of the bounds' means)."""
    rows = _Rows(df, base.variables, label, base.classes, averaged=True)
    items = [tuple((v, s) for v, s, _ in r.parts()) for r in base.rules]
    asked = sorted({i for i in items if i})
    sizes, totals = rows.totals(asked)
    n = sum(sizes.values())
    out = []
    for r, own in zip(base.rules, items, strict=True):
        by = totals.get(asked.index(own), {}) if own else {}
        k = sizes.get(r.consequent, 0)
        everywhere, inside = sum(by.values()) / n if n else 0.0, by.get(r.consequent, 0.0) / k if k else 0.0
        confidence = inside / everywhere if everywhere else None
        out.append(Merit(everywhere, inside, confidence, confidence / (k / n) if confidence is not None and k else None, by.get(r.consequent, 0.0) / sum(by.values()) if sum(by.values()) else None))
    return out


def prune(df: DataFrame, base: RuleBase, label: str, confidence: float = 0.5, lift: float = 1.05) -> RuleBase:
    """Without the rules below either threshold; a rule whose figures are undefined (0 / 0) stays."""
    bad = [i for i, m in enumerate(merits(df, base, label)) if (m.confidence is not None and m.confidence < confidence) or (m.lift is not None and m.lift < lift)]
    return base.remove(bad)


def mine_classes(df: DataFrame, label: str, classes: Sequence[str], variables: Sequence[Variable], threshold: float = 0.05, max_depth: int = 3, confidence: float = 0.05, lift: float = 1.05) -> RuleBase:
    """Rules for each class from the itemsets of its rows, pruned."""
    found = mine_itemsets(df, variables, threshold, max_depth, label, classes)
    return prune(df, RuleBase(tuple(variables), tuple(rules_of(found, len(variables))), tuple(classes)), label, confidence, lift)


def simple_mine(df: DataFrame, features: Sequence[str], kind: Kind = Kind.T1, threshold: float = 0.05, max_depth: int = 3) -> RuleBase:
    return mine_rules(df, fit_partitions(df, features, kind=kind), threshold, max_depth)


def simple_mine_classes(df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], kind: Kind = Kind.T1, threshold: float = 0.05, max_depth: int = 3, confidence: float = 0.5, lift: float = 1.1) -> RuleBase:
    return mine_classes(df, label, classes, fit_partitions(df, features, kind=kind), threshold, max_depth, confidence, lift)
