"""Fuzzy decision trees.

A node is a path of (feature, set) choices; a row's membership in it is the product of the chosen memberships. The tree grows
on the driver; every iteration is one aggregate over the rows that holds, for all open splits at once, the class sums of path membership times
candidate membership (and, for the accuracy index, how many rows a split would turn right or wrong). Candidates are split into jobs of
bounded width. Prediction is a projection.

split="label" adds one child at a time (a set of a feature); split="feature" adds a child for every set of a feature. metric: "purity"
(weighted Gini improvement), "cci" (relative accuracy gain) or "validity" (relative gain of right less wrong mass, from the class sums alone). Ties go to the shallower node, then the lower feature, then the
lower set. The variables are used unclipped. max_depth is honoured.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q
from lumifuzz.functions.membership import Variable
from lumifuzz.operators import rule_quality
from lumifuzz.operators.rule_quality import class_place
from lumifuzz.operators.spread import over_cores
from lumifuzz.sources import shared

#: A row takes a split's class if its membership in the child is above this.
ACTIVE = 0.01
#: An inner node may predict where none of its children has more.
NEAR_ZERO = 1e-6


def gini(sums: Sequence[float]) -> float:
    """1 less the sum of squared shares; infinite for an empty node."""
    n = sum(sums)
    return 1 - sum((s / n) ** 2 for s in sums) if n > 0 else float("inf")


def coverage(sums: Sequence[float], rows: float) -> float:
    return sum(sums) / rows if rows else 0.0


def fuzzy_purity(sums: Sequence[float], rows: float, least: float = 0.0) -> float:
    """Weighted Gini of a node, infinite below the least coverage."""
    return float("inf") if coverage(sums, rows) < least else gini(sums)


def cci(right_before: float, right_after: float, rows: float) -> float:
    """Relative gain of accuracy."""
    before, after = (right_before / rows, right_after / rows) if rows else (0.0, 0.0)
    return (after - before) / before if before else after


def validity(sums: Sequence[float], rows: float) -> float:
    """The mass of a node that its majority gets right, less what it gets wrong, over all rows."""
    return (2 * max(sums, default=0.0) - sum(sums)) / rows if rows else 0.0


def validity_gain(before: float, after: float) -> float:
    """Relative gain of validity; where the two differ in sign, or there was none, the new one itself."""
    if before == 0 or (before < 0) != (after < 0):
        return after
    return (after - before) / before


def majority(sums: Sequence[float]) -> int:
    """The first class with the largest sum."""
    return max(range(len(sums)), key=lambda c: (sums[c], -c)) if sums else 0


def probabilities(sums: Sequence[float]) -> list[float]:
    n = sum(sums)
    return [s / n for s in sums] if n else [1 / len(sums)] * len(sums)


@dataclass
class Node:
    path: tuple[tuple[int, int], ...] = ()
    sums: tuple[float, ...] = ()
    children: list[Node] = field(default_factory=list)

    @property
    def name(self) -> str:
        return "root" + "".join(f"_F{f}_L{s}" for f, s in self.path)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if not n.children]


class FuzzyTree:
    def __init__(self, variables: Sequence[Variable], classes: Sequence[str], max_rules: int = 10, max_depth: int | None = None, coverage_threshold: float = 0.0, min_improvement: float = 0.01, ccp_alpha: float = 0.0, metric: str = "cci", split: str = "label"):
        if metric not in ("cci", "purity", "validity") or split not in ("label", "feature"):
            raise ValueError("metric is cci, purity or validity, split is label or feature")
        self.variables = [v.unclipped() for v in variables]
        self.classes, self.max_rules, self.max_depth, self.coverage_threshold, self.min_improvement, self.ccp_alpha, self.metric, self.split = list(classes), max_rules, max_depth, coverage_threshold, min_improvement, ccp_alpha, metric, split
        self.root = Node()
        self.rows = 0.0

    # text of memberships

    def _mu(self) -> list[str]:
        return [f"coalesce({t}, 0e0) as _t{i}_{j}" for i, v in enumerate(self.variables) for j, t in enumerate(v.texts())]

    @staticmethod
    def _path(path: Sequence[tuple[int, int]]) -> str:
        return " * ".join(f"_t{f}_{s}" for f, s in path) if path else "1e0"

    def _with_mu(self, df: DataFrame) -> DataFrame:
        return df.select("*", *map(F.expr, self._mu()))

    # growth

    def fit(self, df: DataFrame, label: str, patience: int = 3, coded: bool = False) -> FuzzyTree:
        y = F.col(label).cast("int") if coded else class_place(label, self.classes)
        # every iteration asks rows of a class with the same memberships the same, so these are worked out and counted once
        each = self._with_mu(df.withColumn("_y", y).where("_y is not null")).select("_y", *(f"_t{i}_{j}" for i, v in enumerate(self.variables) for j in range(len(v))))
        counted = shared.cut(each.groupBy(*each.columns).agg(F.count("*").cast("double").alias("_w")), "tree-rows")
        rows = over_cores(counted).persist()
        k = range(len(self.classes))
        first = rows.agg(F.sum("_w").alias("n"), *(F.sum((F.col("_y") == c).cast("double") * F.col("_w")).alias(f"c{c}") for c in k)).first()
        self.rows = float(first["n"] or 0)
        self.root = Node((), tuple(float(first[f"c{c}"] or 0) for c in k))
        bad = 0
        while len(self.root.leaves()) < self.max_rules and bad < patience:
            best = self._best_split(rows)
            if best is None:
                break
            gain, node, children = best
            if gain < self.min_improvement:
                bad += 1
            node.children += children
        rows.unpersist()
        shared.drop(counted)
        if self.ccp_alpha:
            self.prune(self.ccp_alpha)
        return self

    def grow(self, df: DataFrame, label: str, paths: Sequence[Sequence[tuple[int, int]]], coded: bool = False) -> FuzzyTree:
        """The tree of given paths of (feature, set) pairs, each after the paths that it goes on from, with the class sums of the rows: one aggregate, whatever the depth."""
        y = F.col(label).cast("int") if coded else class_place(label, self.classes)
        rows = self._with_mu(df.withColumn("_y", y).where("_y is not null"))
        self.root = Node()
        nodes = {(): self.root}
        for path in map(tuple, paths):
            if path[:-1] not in nodes or path in nodes:
                raise ValueError(f"{path} repeats a path, or comes before the one that it goes on from")
            nodes[path] = Node(path)
            nodes[path[:-1]].children.append(nodes[path])
        inner = [(nodes[p[:-1]], *p[-1]) for p in nodes if p]
        counts = {r["_y"]: float(r["count"]) for r in rows.groupBy("_y").count().collect()}
        self.rows = sum(counts.values())
        self.root.sums = tuple(counts.get(c, 0.0) for c in range(len(self.classes)))
        for path, sums in zip([p for p in nodes if p], self._sums(rows, inner), strict=True):
            nodes[path].sums = tuple(sums)
        return self

    def _candidates(self) -> list[tuple[Node, int, int]]:
        out = []
        for node in sorted(self.root.walk(), key=lambda n: len(n.path)):
            if self.max_depth is not None and len(node.path) >= self.max_depth:
                continue
            if self.split == "feature" and node.children:
                continue
            taken = {c.path[-1] for c in node.children} | set(node.path)
            for f, v in enumerate(self.variables):
                if self.split == "feature" and any(g == f for g, _ in node.path):
                    continue
                out += [(node, f, s) for s in range(len(v)) if (f, s) not in taken]
        return out

    def _best_split(self, rows: DataFrame) -> tuple[float, Node, list[Node]] | None:
        asked = self._candidates()
        if not asked:
            return None
        k = range(len(self.classes))
        sums = self._sums(rows, asked)
        made: list[tuple[Node, Node]] = [(node, Node((*node.path, (f, s)), tuple(sums[i]))) for i, (node, f, s) in enumerate(asked)]
        gains: list[float] = []
        if self.metric == "cci":
            now = self._predicted_text()
            guess = rows.select("*", F.expr(f"cast({now} as int)").alias("_now"))
            stats = [F.sum((F.col("_now") == F.col("_y")).cast("double") * F.col("_w")).alias("right")]
            for i, (_, child) in enumerate(made):
                turned = F.when(F.expr(f"{self._path(child.path)} > {q.number(ACTIVE)}"), majority(child.sums)).otherwise(F.col("_now"))
                stats.append(F.sum((turned == F.col("_y")).cast("double") * F.col("_w")).alias(f"r{i}"))
            got: dict[str, float] = {}
            for i in range(0, len(stats), rule_quality.WIDTH):
                got |= guess.agg(*stats[i : i + rule_quality.WIDTH]).first().asDict()
            gains = [cci(got["right"] or 0, got[f"r{i}"] or 0, self.rows) for i in range(len(made))]
        if self.metric == "validity":
            gains = [validity_gain(validity(node.sums, self.rows), validity(child.sums, self.rows)) for node, child in made]
        purity = [gini(node.sums) - fuzzy_purity(child.sums, self.rows, self.coverage_threshold) for node, child in made]
        allowed = [coverage(c.sums, self.rows) >= self.coverage_threshold and sum(c.sums) > 0 for _, c in made]
        if not any(allowed):
            return None  # no split that is left can cover enough
        if self.split == "label":
            order = [(gains[i] if gains else purity[i], purity[i], -i) for i in range(len(made)) if allowed[i] and purity[i] > -float("inf")]
            if not order:
                return None
            g, _, i = max(order)
            node, child = made[-i]
            return g, node, [child]
        groups: dict[tuple[str, int], list[int]] = {}
        for i, (node, f, _) in enumerate(asked):
            groups.setdefault((node.name, f), []).append(i)
        best = None
        for own in groups.values():
            good = [i for i in own if allowed[i]]
            weight = sum(sum(made[i][1].sums) for i in good)
            if not weight:
                continue
            if self.metric == "validity":
                # the children's validity, weighted by their mass, against the node's
                after = sum(sum(made[i][1].sums) * validity(made[i][1].sums, self.rows) for i in good) / weight
                value = validity_gain(validity(made[good[0]][0].sums, self.rows), after)
            else:
                value = sum(sum(made[i][1].sums) * (gains[i] if gains else purity[i]) for i in good) / weight
            if best is None or value > best[0]:
                best = value, made[good[0]][0], [made[i][1] for i in good]
        return best

    def best_possible_coverage(self, df: DataFrame, label: str, coded: bool = False) -> float:
        """The greatest coverage that any split that is left could have: below the threshold, growth ends."""
        y = F.col(label).cast("int") if coded else class_place(label, self.classes)
        rows = self._with_mu(df.withColumn("_y", y).where("_y is not null"))
        asked = self._candidates()
        return max((coverage(s, self.rows) for s in self._sums(rows, asked)), default=0.0) if asked else 0.0

    def _sums(self, rows: DataFrame, asked: list[tuple[Node, int, int]]) -> list[list[float]]:
        """Class sums of every candidate child's membership; a row counts as often as its column _w says, if there is one."""
        weight = " * _w" if "_w" in rows.columns else ""
        out: list[list[float]] = []
        width = max(1, rule_quality.WIDTH)
        for i in range(0, len(asked), width):
            part = asked[i : i + width]
            got = {r["_y"]: r for r in rows.groupBy("_y").agg(*(F.sum(F.expr(self._path((*node.path, (f, s))) + weight)).alias(f"s{j}") for j, (node, f, s) in enumerate(part))).collect()}
            out += [[float(got[c][f"s{j}"] or 0) if c in got else 0.0 for c in range(len(self.classes))] for j in range(len(part))]
        return out

    # prediction

    def _nodes(self) -> list[Node]:
        """Leaves by path length, then inner nodes."""
        leaves = sorted(self.root.leaves(), key=lambda n: len(n.path))
        return leaves + [n for n in self.root.walk() if n.children]

    def _degree_texts(self) -> list[str]:
        out = []
        for n in self._nodes():
            text = f"({self._path(n.path)})"
            if n.children:
                # an inner node speaks only where its children are silent; what it says then is not more than a leaf's
                silent = " and ".join(f"({self._path(c.path)}) <= {q.number(NEAR_ZERO)}" for c in n.children)
                text = f"(case when {silent} then {text} else 0e0 end)"
            out.append(text)
        return out

    def _winner_text(self) -> str:
        degrees = self._degree_texts()
        return q.first_max(degrees, q.greatest(degrees))

    def _predicted_text(self) -> str:
        return f"(case ({self._winner_text()}) " + " ".join(f"when {i} then {majority(n.sums)}" for i, n in enumerate(self._nodes())) + " end)"

    def predict(self, df: DataFrame, names: bool = False) -> DataFrame:
        """df and predicted: the class of the node with the highest membership."""
        made = self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.expr(f"cast({self._predicted_text()} as int)").alias("predicted"))
        if not names:
            return made
        return made.withColumn("predicted", F.element_at(F.array(*map(F.lit, self.classes)), F.col("predicted") + 1))

    def predict_with_path(self, df: DataFrame) -> DataFrame:
        """df, predicted, path (the node's name) and degree."""
        nodes, degrees = self._nodes(), self._degree_texts()
        path = f"(case ({self._winner_text()}) " + " ".join(f"when {i} then {q.text(n.name)}" for i, n in enumerate(nodes)) + " end)"
        return self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.expr(f"cast({self._predicted_text()} as int)").alias("predicted"), F.expr(path).alias("path"), F.expr(q.greatest(degrees)).alias("degree"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df and probabilities: the nodes' class shares, weighted by their memberships; uniform where those are all 0."""
        nodes, degrees = self._nodes(), self._degree_texts()
        shares = [probabilities(n.sums) for n in nodes]
        mass = [q.total([f"{d} * {q.number(s[c])}" for d, s in zip(degrees, shares, strict=True)]) for c in range(len(self.classes))]
        n = q.total(mass)
        said = [F.expr(f"case when {n} = 0e0 then {q.number(1 / len(mass))} else ({m}) / {n} end") for m in mass]
        return self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.array(*said).alias("probabilities"))

    def predict_all_leaves(self, df: DataFrame) -> DataFrame:
        """df and leaves: a struct of the membership in each leaf, by name."""
        leaves = sorted(self.root.leaves(), key=lambda n: len(n.path))
        return self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.struct(*(F.expr(self._path(n.path)).alias(n.name) for n in leaves)).alias("leaves"))

    def predict_all_leaves_matrix(self, df: DataFrame) -> DataFrame:
        """df and leaf_memberships: the same as an array."""
        leaves = sorted(self.root.leaves(), key=lambda n: len(n.path))
        return self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.array(*(F.expr(self._path(n.path)) for n in leaves)).alias("leaf_memberships"))

    def leaf_membership(self, df: DataFrame, name: str) -> DataFrame:
        node = next(n for n in self.root.walk() if n.name == name)
        return self._with_mu(df).select(*(F.col(f"`{c}`") for c in df.columns), F.expr(self._path(node.path)).alias("membership"))

    def score(self, df: DataFrame, label: str, coded: bool = False) -> float:
        y = F.col(label).cast("int") if coded else class_place(label, self.classes)
        return float(self.predict(df.withColumn("_y", y)).agg(F.avg((F.col("predicted") == F.col("_y")).cast("double"))).first()[0] or 0.0)

    # pruning: by the class sums that the nodes hold

    def _cost(self, n: Node) -> float:
        """Weight of the rows that a node's majority gets wrong, over all rows."""
        return (sum(n.sums) - max(n.sums, default=0.0)) / self.rows if self.rows else 0.0

    def weakest_link(self) -> tuple[float, Node] | None:
        """The inner node whose subtree gains least for each leaf more."""
        out = None
        for n in self.root.walk():
            if n.children:
                leaves = n.leaves()
                a = (self._cost(n) - sum(map(self._cost, leaves))) / max(1, len(leaves) - 1)
                if out is None or a < out[0]:
                    out = a, n
        return out

    def prune(self, alpha: float) -> FuzzyTree:
        """Cost-complexity pruning: weakest links go while they gain at most alpha a leaf."""
        while (weak := self.weakest_link()) is not None and weak[0] <= alpha:
            weak[1].children.clear()
        return self

    def fit_with_pruning(self, train: DataFrame, valid: DataFrame, label: str, alphas: Sequence[float] = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0), coded: bool = False) -> FuzzyTree:
        """Fits, then keeps the pruned tree that does best on the validation rows (the smaller one of equals)."""
        self.fit(train, label, coded=coded)
        best, full = (self.score(valid, label, coded), copy.deepcopy(self.root)), copy.deepcopy(self.root)
        for a in alphas:
            self.root = copy.deepcopy(full)
            self.prune(a)
            s = self.score(valid, label, coded)
            if s >= best[0]:
                best = s, copy.deepcopy(self.root)
        self.root = best[1]
        return self

    # reports

    def stats(self) -> dict[str, int]:
        return {"nodes": sum(1 for _ in self.root.walk()), "leaves": len(self.root.leaves()), "depth": max(len(n.path) for n in self.root.walk())}

    def text(self, node: Node | None = None, indent: str = "") -> str:
        node = node or self.root
        said = "root" if not node.path else f"{self.variables[node.path[-1][0]].name} IS {self.variables[node.path[-1][0]][node.path[-1][1]].name}"
        lines = [f"{indent}{said}: {self.classes[majority(node.sums)]} (coverage {coverage(node.sums, self.rows):.3f})"]
        for c in node.children:
            lines.append(self.text(c, indent + "  "))
        return "\n".join(lines)
