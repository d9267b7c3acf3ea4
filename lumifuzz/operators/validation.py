"""Statistical checks of rules and classifiers: bootstrap intervals, permutation tests, null rules.

A bootstrap replicate weights each row by a Poisson(1) draw from a hash of its key and the replicate's number: it can be
recomputed anywhere, needs no second copy of the rows, and all replicates are added up in one pass. Label permutations only need the confusion
table: how many predictions agree with shuffled labels is drawn from its margins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lumifuzz.functions.membership import Variable
from lumifuzz.operators import rule_quality
from lumifuzz.operators.rule_quality import class_place
from lumifuzz.operators.rules import Rule, RuleBase
from lumifuzz.operators.spread import over_cores
from lumifuzz.sources import shared


def poisson_weight(key: str, replicate: int, seed: int = 33):
    """A Poisson(1) draw for each row, from a hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(replicate), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    out, p, total = F.lit(8), np.exp(-1.0), 0.0
    steps = []
    for k in range(8):
        total += p
        steps.append((float(total), k))
        p /= k + 1
    for edge, k in reversed(steps):
        out = F.when(u < edge, k).otherwise(out)
    return out


def bootstrap_sample(df: DataFrame, key: str, replicate: int, seed: int = 33) -> DataFrame:
    """A resample with replacement: each row as often as its weight says."""
    w = poisson_weight(key, replicate, seed)
    return df.withColumn("_times", F.explode(F.array_repeat(F.lit(1), w))).drop("_times")


def bootstrap(df: DataFrame, base: RuleBase, label: str, key: str, n: int = 100, seed: int = 33) -> pd.DataFrame:
    """replicate, rule, support, confidence: n replicates of all rules, in one pass; a task keeps (n, rules) sums."""
    made = base.applied(df).withColumn("_y", class_place(label, base.classes)).where("_y is not null")
    k, consequents = len(base), np.array(base.consequents())
    rows = over_cores(made.select(F.col("_y").alias("y"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), *(F.col(f"_f{i}") for i in range(k))))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 2 * k + 1))
        for batch in batches:
            f, y, h = batch[[f"_f{i}" for i in range(k)]].to_numpy(), batch["y"].to_numpy(), batch["h"].to_numpy().astype(np.uint64)
            mine = f * (y[:, None] == consequents[None, :])
            stacked = np.hstack([f, mine, np.ones((len(f), 1))])
            for r in range(n):
                x = h ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
                total[r] += np.searchsorted(_POISSON, u, "right") @ stacked
        yield pd.DataFrame({"replicate": np.repeat(np.arange(n), 2 * k + 1), "at": np.tile(np.arange(2 * k + 1), n), "s": total.ravel()})

    got = np.zeros((n, 2 * k + 1))
    for r in rows.mapInPandas(add_up, "replicate int, at int, s double").groupBy("replicate", "at").agg(F.sum("s").alias("s")).collect():  # replicates x rules
        got[r["replicate"], r["at"]] = r["s"]
    count = np.maximum(got[:, -1:], 1)
    support = got[:, k : 2 * k] / count
    confidence = np.divide(got[:, k : 2 * k], got[:, :k], out=np.zeros((n, k)), where=got[:, :k] > 0)
    return pd.DataFrame({"replicate": np.repeat(np.arange(n), k), "rule": np.tile(np.arange(k), n), "support": support.ravel(), "confidence": confidence.ravel()})


_POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320]))


def with_intervals(df: DataFrame, base: RuleBase, label: str, key: str, n: int = 100) -> RuleBase:
    """The base with [2.5, 97.5] percent bootstrap intervals of support and confidence."""
    drawn = bootstrap(df, base, label, key, n)
    rules = []
    for i, r in enumerate(base.rules):
        own = drawn[drawn["rule"] == i]
        s, c = np.percentile(own["support"], [2.5, 97.5]), np.percentile(own["confidence"], [2.5, 97.5])
        rules.append(replace(r, support_interval=(float(s[0]), float(s[1])), confidence_interval=(float(c[0]), float(c[1]))))
    return replace(base, rules=tuple(rules))


def random_rules(n: int, n_ants: int, variables: Sequence[Variable], n_classes: int, seed: int = 33) -> list[Rule]:
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = [-1] * len(variables)
        for v in draw.choice(len(variables), min(n_ants, len(variables)), replace=False).tolist():
            a[v] = int(draw.integers(0, len(variables[v])))
        out.append(Rule(tuple(a), int(draw.integers(0, n_classes))))
    return out


def rule_quality_gaps(df: DataFrame, base: RuleBase, label: str) -> list[float]:
    """For each rule: its mean firing strength on rows of its class less that on the others; the variables are used unclipped."""
    plain = replace(base, variables=tuple(v.unclipped() for v in base.variables))
    n, by, s, inside = rule_quality.sums(df, plain, label)
    out = []
    for i, r in enumerate(plain.rules):
        k = by[r.consequent]
        other = n - k
        mine = inside[i][r.consequent]
        out.append((mine / k if k else 0.0) - ((s[i] - mine) / other if other else 0.0))
    return out


def null_distribution(df: DataFrame, base: RuleBase, label: str, n: int = 100, n_ants: int = 3, seed: int = 33) -> list[float]:
    """Quality gaps of n random rules, in one aggregate."""
    drawn = RuleBase(base.variables, tuple(random_rules(n, n_ants, base.variables, len(base.classes), seed)), base.classes)
    return rule_quality_gaps(df, drawn, label)


def rule_p_values(df: DataFrame, base: RuleBase, label: str, n: int = 100, n_ants: int = 3) -> RuleBase:
    """The base with, for each rule, the share of random rules that do better."""
    null = np.array(null_distribution(df, base, label, n, n_ants))
    return replace(base, rules=tuple(replace(r, p_values=(float(np.mean(g < null)),)) for r, g in zip(base.rules, rule_quality_gaps(df, base, label), strict=True)))


def p_permutation(errors: Sequence[float], seen: float) -> float:
    """(permutations with a smaller error + 1) / (permutations + 1)."""
    return (sum(e < seen for e in errors) + 1) / (len(errors) + 1)


def _shuffled_errors(table: dict[tuple[int, int], int], k: int, draw: np.random.Generator) -> list[float]:
    """Error rates after shuffling the labels of all rows, k times: agreements by predicted class are drawn without replacement from the labels left."""
    classes = sorted({c for pair in table for c in pair})
    actual = np.array([sum(v for (a, _), v in table.items() if a == c) for c in classes])
    predicted = [sum(v for (_, b), v in table.items() if b == c) for c in classes]
    n = int(actual.sum())
    out = []
    for _ in range(k):
        left, right = actual.copy(), 0
        for i, m in enumerate(predicted):
            taken = draw.multivariate_hypergeometric(left, m, method="marginals")
            right += int(taken[i])
            left -= taken
        out.append(1 - right / n)
    return out


def label_permutation_test(df: DataFrame, base: RuleBase, label: str, k: int = 100, seed: int = 33) -> float:
    """p-value of the classifier's error under shuffled labels."""
    table = rule_quality.collected(rule_quality.confusion(df, base, label))
    return p_permutation(_shuffled_errors(table, k, np.random.default_rng(seed)), 1 - rule_quality.accuracy_score(table))


def column_permutation_test(df: DataFrame, base: RuleBase, label: str, key: str = "", k: int = 20, whole_rows: bool = False, seed: int = 33) -> float:
    """p-value of the error when each column's values are exchanged among all rows of the same class. whole_rows: rows are exchanged as they are, which leaves the error unchanged. Rows without a class have no part in it."""
    seen = _error(base, _by_winner(df, base, label))
    if whole_rows:
        return p_permutation([seen] * k, seen)
    return p_permutation([_error(base, won) for won in _exchanged_winners(df, base, label, k, seed)], seen)


def column_permutation_tests(df: DataFrame, base: RuleBase, label: str, k: int = 20, seed: int = 33) -> tuple[float, list[float]]:
    """column_permutation_test and, for each rule, rulewise_column_permutation_test, each column by itself, from the same exchanges."""
    won, moved = _by_winner(df, base, label), _exchanged_winners(df, base, label, k, seed)
    return p_permutation([_error(base, x) for x in moved], _error(base, won)), _rulewise(base, won, moved)


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudo-random bijection of the whole numbers below n: a Feistel network on the next even power of two, applied again to what falls outside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1 << 62, 1 << 63, (6, 2), dtype=np.uint64) | np.uint64(1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for a, b in keys:
            h = (right + b) * a
            h ^= h >> np.uint64(31)
            left, right = right, (left ^ (h * b >> np.uint64(20))) & mask
        return left << np.uint64(half) | right

    out = once(np.asarray(x, np.uint64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


#: Distinct values of a column up to which its exchanges are drawn from their counts; rows of a class that numpy draws from; rows of a piece that a task orders at once, and the entries of all replicates' pieces.
FEW, MOST_DRAWN, PIECE, ENTRIES = 1000, 10**9, 65_536, 12_000_000


class _Pieces:
    """Random orders of values that are known by their counts, one piece of rows at a time: each half of the pieces draws its values from the whole's without replacement, by a seed of its own, so that any task finds any piece by itself."""

    def __init__(self, counts: dict[tuple[int, int], np.ndarray], parts: dict[int, list[tuple[int, int]]], size: int, seed: int):
        self.counts, self.size, self.seed = counts, size, seed
        self.parts = {y: {p: i for i, (p, _) in enumerate(own)} for y, own in parts.items()}
        self.before = {y: np.r_[0, np.cumsum([n for _, n in own])] for y, own in parts.items()}
        self.paths: dict[tuple[int, int, int], list[tuple[tuple[int, int], np.ndarray]]] = {}
        self.last: dict[tuple[int, int, int], tuple[tuple[int, int], np.ndarray]] = {}

    def _begin(self, y: int, at: tuple[int, int]) -> int:
        """Number in its class of the first row of piece at[1] of the part in place at[0]."""
        before = self.before[y]
        return int(min(before[at[0]] + at[1] * self.size, before[at[0] + 1])) if at[0] + 1 < len(before) else int(before[-1])

    def codes(self, i: int, j: int, y: int, part: int, piece: int) -> np.ndarray:
        """Places of the values of column j in the rows of a piece, in replicate i."""
        key, at = (i, j, y), (self.parts[y][part], piece)
        if key in self.last and self.last[key][0] == at:
            return self.last[key][1]
        # halves of the parts, then of the part's pieces; what the last piece's path has in common with this one's is kept
        low, high, inner, path, held = 0, len(self.parts[y]), False, [], self.paths.get(key, [])
        counts = self.counts[y, j]
        while True:
            if not inner and high - low == 1:
                low, high, inner = 0, -(-int(self.before[y][at[0] + 1] - self.before[y][at[0]]) // self.size), True
            if high - low == 1:
                break
            mid = (low + high) // 2
            first, middle, end = ((at[0], x) if inner else (x, 0) for x in (low, mid, high))
            begin, cut = self._begin(y, first), self._begin(y, middle)
            left = (at[1] if inner else at[0]) < mid
            node = (begin, cut if left else self._begin(y, end))
            if len(path) < len(held) and held[len(path)][0] == node:
                counts = held[len(path)][1]
            else:
                held = held[: len(path)]
                drawn = np.random.default_rng((self.seed, i, j, y, begin, cut)).multivariate_hypergeometric(counts, cut - begin, method="marginals")
                counts = drawn if left else counts - drawn
            path.append((node, counts))
            low, high = (low, mid) if left else (mid, high)
        self.paths[key] = path
        out = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) <= 1 << 16 else np.uint32), counts)
        np.random.default_rng((self.seed, i, j, y, *at, 1)).shuffle(out)
        self.last[key] = at, out
        return out


def exchanged(df: DataFrame, features: Sequence[str], y: Column, k: int, seed: int = 33) -> DataFrame:
    """_y, replicate and the features: k copies of the rows whose class place y is not null, in each of which every feature's values are permuted among all rows of a class.

    Rows are numbered by class where they lie: a task counts its own, and what the tasks before it have is added (one number for each task and class goes through the driver). The column of most distinct values
    stays where it is, since only how the columns lie to each other counts. A column of FEW distinct values at most needs no shuffle: which of its values a piece of rows gets is drawn from their counts (`_Pieces`).
    The values of any other column know the row they go to in each replicate, by a bijection of the class's numbers, and all replicates meet their rows in one shuffle, whose keys are as many as the rows.
    """
    text = [f for f in features if not isinstance(df.schema[f].dataType, NumericType)]
    plain = [f for f in features if f not in text]
    every = [*plain, *text]
    of = {f: "double" if f in plain else "string" for f in every}
    values = df.select(y.cast("int").alias("_y"), *(F.col(f"`{f}`").cast(of[f]).alias(f) for f in every)).where("_y is not null")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            c = batch.column("_y").to_numpy()
            at = np.empty(len(c), np.int64)
            for v in np.unique(c).tolist():
                own = np.flatnonzero(c == v)
                at[own] = held.get(v, 0) + np.arange(len(own))
                held[v] = held.get(v, 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(np.full(len(c), part, np.int32)), pa.array(at), *(batch.column(f) for f in every)], ["_y", "_part", "_at", *every])

    numbered = shared.cut(values.mapInArrow(number, "_y int, _part int, _at long, " + ", ".join(f"`{f}` {of[f]}" for f in every)), "exchange-rows")
    sizes: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in numbered.groupBy("_part", "_y").count().orderBy("_part").collect():  # tasks x classes
        before[r["_part"], r["_y"]] = sizes.get(r["_y"], 0)
        parts.setdefault(r["_y"], []).append((r["_part"], r["count"]))
        sizes[r["_y"]] = sizes.get(r["_y"], 0) + r["count"]
    about = numbered.agg(*(F.approx_count_distinct(F.col(f"`{f}`"), 0.02).alias(f"n{j}") for j, f in enumerate(every))).first()
    stays, *others = sorted(range(len(every)), key=lambda j: (-about[f"n{j}"], j))
    few = [j for j in others if about[f"n{j}"] <= FEW and max(sizes.values(), default=0) < MOST_DRAWN]
    sent_on = [j for j in others if j not in few]
    names, counts = {j: [] for j in few}, {}
    if few:
        each = F.array(*(F.struct(F.lit(j).alias("j"), (F.col(f"`{every[j]}`") if every[j] in plain else F.lit(None).cast("double")).alias("v"), (F.col(f"`{every[j]}`") if every[j] in text else F.lit(None).cast("string")).alias("t")) for j in few))
        found: dict[tuple[int, int], dict[object, int]] = {}
        for r in numbered.select("_y", F.inline(each)).groupBy("_y", "j", "v", "t").count().orderBy("j", "v", "t", "_y").collect():  # columns x classes x FEW
            value = r["v"] if every[r["j"]] in plain else r["t"]
            place = "nan" if value != value else value
            if place not in found.setdefault((-1, r["j"]), {}):
                found[-1, r["j"]][place] = len(names[r["j"]])
                names[r["j"]].append(value)
            found.setdefault((r["_y"], r["j"]), {})[found[-1, r["j"]][place]] = r["count"]
        counts = {(c, j): np.array([own.get(i, 0) for i in range(len(names[j]))]) for (c, j), own in found.items() if c >= 0}
    size = max(1024, min(PIECE, ENTRIES // max(1, k * len(few) * max(1, len(sizes)))))
    sent = df.sparkSession.sparkContext.broadcast((before, sizes, parts, counts, names))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sizes, parts, counts, names = sent.value
        pieces = _Pieces(counts, parts, size, seed)
        listed = {j: pa.array(names[j], pa.float64() if every[j] in plain else pa.string()) for j in few}
        for whole in batches:
            for start in range(0, whole.num_rows, 16_384):
                batch = whole.slice(start, 16_384)
                n = batch.num_rows
                c, part, at = (batch.column(x).to_numpy() for x in ("_y", "_part", "_at"))
                own = {}
                for p, v in set(zip(part.tolist(), c.tolist(), strict=True)):
                    mine = np.flatnonzero((part == p) & (c == v))
                    for piece in np.unique(at[mine] // size).tolist():
                        rows = mine[at[mine] // size == piece]
                        own[v, p, piece] = rows, at[rows] - piece * size
                number = np.empty(n, np.int64)
                for (v, p, _), (rows, _) in own.items():
                    number[rows] = at[rows] + before[p, v]
                for i in range(k):
                    codes = {j: np.empty(n, np.int64) for j in few}
                    for j in few:
                        for (v, p, piece), (rows, inside) in own.items():
                            codes[j][rows] = pieces.codes(i, j, v, p, piece)[inside]
                    drawn = {j: listed[j].take(pa.array(codes[j])) for j in few}
                    if not sent_on:
                        yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(np.full(n, i, np.int32)), *(drawn[j] if j in drawn else batch.column(f) for j, f in enumerate(every))], ["_y", "replicate", *every])
                        continue
                    for j in (stays, *sent_on):
                        to = number.copy() if j == stays else np.empty(n, np.int64)
                        if j != stays:
                            for v in np.unique(c).tolist():
                                to[c == v] = permuted(number[c == v], sizes[v], (seed << 24) + (i << 12) + j)
                        f = every[j]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("_y"), pa.array(np.full(n, i, np.int32)), pa.array(to), pa.array(np.full(n, j, np.int32)), batch.column(f) if f in plain else pa.nulls(n, pa.float64()),
                                batch.column(f) if f in text else pa.nulls(n, pa.string()), *(drawn[x] if j == stays else pa.nulls(n, listed[x].type) for x in few),
                            ],
                            ["_y", "replicate", "_to", "_j", "v", "t", *(f"d{x}" for x in few)],
                        )

    if not sent_on:
        met = numbered.mapInArrow(deal, "_y int, replicate int, " + ", ".join(f"`{f}` {of[f]}" for f in every))
    else:
        dealt = numbered.mapInArrow(deal, "_y int, replicate int, _to long, _j int, v double, t string" + "".join(f", d{j} {of[every[j]]}" for j in few))
        met = dealt.groupBy("_y", "replicate", "_to").agg(*(F.max(f"d{j}").alias(f) if j in few else F.max(F.when(F.col("_j") == j, F.col("v" if f in plain else "t"))).alias(f) for j, f in enumerate(every)))
    return met.select("_y", "replicate", *(F.col(f"`{f}`").cast(df.schema[f].dataType).alias(f) for f in features))


def _exchanged_winners(df: DataFrame, base: RuleBase, label: str, k: int, seed: int) -> list[dict[int, dict[int, int]]]:
    """For each of k exchanges, the rows of each class by winning rule, all in one job."""
    made = base.applied(exchanged(df, [v.name for v in base.variables], class_place(label, base.classes), k, seed))
    out: list[dict[int, dict[int, int]]] = [{} for _ in range(k)]
    for r in made.groupBy("replicate", "_winner", "_y").count().collect():  # replicates x rules x classes
        out[r["replicate"]].setdefault(r["_winner"], {})[r["_y"]] = r["count"]
    return out


def _error(base: RuleBase, won: dict[int, dict[int, int]]) -> float:
    n = sum(sum(by.values()) for by in won.values())
    right = sum(by.get(base.rules[i].consequent, 0) for i, by in won.items() if i >= 0)
    return 1 - right / n if n else 1.0


def _by_winner(df: DataFrame, base: RuleBase, label: str) -> dict[int, dict[int, int]]:
    made = base.applied(df).withColumn("_y", class_place(label, base.classes)).where("_y is not null")
    out: dict[int, dict[int, int]] = {}
    for r in made.groupBy("_winner", "_y").count().collect():  # rules x classes
        out.setdefault(r["_winner"], {})[r["_y"]] = r["count"]
    return out


def rulewise_label_permutation_test(df: DataFrame, base: RuleBase, label: str, k: int = 100, seed: int = 33) -> list[float]:
    """For each rule, the p-value of the one-against-all classifier that says its class where it wins."""
    won = _by_winner(df, base, label)
    total: dict[int, int] = {}
    for by in won.values():
        for c, n in by.items():
            total[c] = total.get(c, 0) + n
    n, draw, out = sum(total.values()), np.random.default_rng(seed), []
    for i, r in enumerate(base.rules):
        by = won.get(i, {})
        hit, fired, there = by.get(r.consequent, 0), sum(by.values()), total.get(r.consequent, 0)
        table = {(1, 1): hit, (0, 1): fired - hit, (1, 0): there - hit, (0, 0): n - fired - there + hit}
        out.append(p_permutation(_shuffled_errors(table, k, draw), 1 - (table[1, 1] + table[0, 0]) / n if n else 1.0))
    return out


def _own_errors(base: RuleBase, won: dict[int, dict[int, int]], total: dict[int, int]) -> list[float]:
    """For each rule, the error of the one-against-all classifier that says its class where it wins."""
    n, out = sum(total.values()), []
    for i, r in enumerate(base.rules):
        by = won.get(i, {})
        out.append((sum(by.values()) + total.get(r.consequent, 0) - 2 * by.get(r.consequent, 0)) / n if n else 1.0)
    return out


def rulewise_column_permutation_test(df: DataFrame, base: RuleBase, label: str, key: str = "", k: int = 20, whole_rows: bool = True, seed: int = 33) -> list[float]:
    """For each rule, the p-value of its one-against-all error when the rows of its class are exchanged among each other. whole_rows: as they are, which leaves every error unchanged, so that the p-value says how many exchanges there were; else each column by itself, in one exchange of all classes for all rules, of which each rule counts the rows of its class."""
    won = _by_winner(df, base, label)
    if whole_rows:
        return [p_permutation([e] * k, e) for e in _own_errors(base, won, _by_class(won))]
    return _rulewise(base, won, _exchanged_winners(df, base, label, k, seed))


def _by_class(won: dict[int, dict[int, int]]) -> dict[int, int]:
    total: dict[int, int] = {}
    for by in won.values():
        for c, n in by.items():
            total[c] = total.get(c, 0) + n
    return total


def _rulewise(base: RuleBase, won: dict[int, dict[int, int]], exchanges: list[dict[int, dict[int, int]]]) -> list[float]:
    total = _by_class(won)
    errors: list[list[float]] = [[] for _ in base.rules]
    for moved in exchanges:
        for j, r in enumerate(base.rules):
            # rows of other classes stay as they were
            mixed = {**{c: n for c, n in won.get(j, {}).items() if c != r.consequent}, r.consequent: moved.get(j, {}).get(r.consequent, 0)}
            errors[j].append((sum(mixed.values()) + total.get(r.consequent, 0) - 2 * mixed[r.consequent]) / max(1, sum(total.values())))
    return [p_permutation(e, s) for e, s in zip(errors, _own_errors(base, won, total), strict=True)]


def with_validation(df: DataFrame, base: RuleBase, label: str, key: str, n: int = 100) -> RuleBase:
    """The base with label-permutation p-values and bootstrap intervals."""
    p = rulewise_label_permutation_test(df, base, label, n)
    return with_intervals(df, replace(base, rules=tuple(replace(r, p_values=(x,)) for r, x in zip(base.rules, p, strict=True))), label, key, n)
