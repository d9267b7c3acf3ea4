"""Linguistic variables from the quantiles of columns.

Quantiles are exact (linear interpolation, nulls and NaN left out) and found by rank selection: approximate percentiles of all
features bracket each wanted rank in one pass, then one grouped count of what lies in the brackets, with a row for each value there and
one for each gap between brackets, settles the ranks. Brackets that hold more than MOST_VALUES rows are narrowed first by percentiles of
their own rows. So no task or driver holds the distinct values of a column, whatever its size.
exact=False stops at the approximate percentiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q
from lumifuzz.functions.membership import EPSILON, Category, Gaussian, IntervalCategory, IntervalGaussian, IntervalTrapezoid, Kind, Trapezoid, Triangle, TriangularType2, Variable
from lumifuzz.operators import pairings
from lumifuzz.sources import shared

#: The probabilities of the quantile sets.
QUARTILES = (0, 0.25, 0.5, 1)
FIXED = (0, 0.2, 0.3, 0.45, 0.55, 0.7, 0.8, 1)
THREE = (0, 0.2, 0.5, 0.8, 1)
TRIANGLE = (0, 0.25, 0.5, 0.75, 1)


def even(n: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, n)]


#: Relative error of the approximate percentiles, as one in so many; and the rows of a bracket up to which they are counted value by value.
ACCURACY, MOST_VALUES = 10_000, 20_000
NEAR = 1.5 / ACCURACY


def quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], exact: bool = True) -> dict[str, list[float]]:
    """The quantiles of each feature."""
    if not features:
        return {}
    places, asked = range(len(features)), [float(p) for p in probabilities]
    values = df.select(*(F.expr(q.clean(f"cast({q.name(c)} as double)")).alias(f"v{i}") for i, c in enumerate(features)))
    around = F.array(*(F.lit(min(1.0, max(0.0, p + d))) for p in asked for d in (-NEAR, 0.0, NEAR)))
    row = values.agg(*(x for i in places for x in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"least{i}"), F.max(f"v{i}").alias(f"most{i}"), F.percentile_approx(f"v{i}", around, ACCURACY).alias(f"q{i}")))).first()
    missing = [c for i, c in enumerate(features) if not row[f"n{i}"]]
    if missing:
        raise ValueError(f"no values in {', '.join(missing)}")
    if not exact:
        return {c: list(map(float, row[f"q{i}"][1::3])) for i, c in enumerate(features)}
    wanted: dict[tuple[int, int], tuple[float, float]] = {}
    for i in places:
        for j, p in enumerate(asked):
            few = row[f"n{i}"] <= MOST_VALUES
            bracket = (row[f"least{i}"] if few or p <= NEAR else row[f"q{i}"][3 * j], row[f"most{i}"] if few or p >= 1 - NEAR else row[f"q{i}"][3 * j + 2])
            wanted |= {(i, r): bracket for r in _ranks(p, row[f"n{i}"])}
    at = _select(values, wanted, {i: _inside(row[f"n{i}"]) for i in places})
    out: dict[str, list[float]] = {}
    for i, c in enumerate(features):
        n = row[f"n{i}"]
        ends = [(p * (n - 1), *(at[i, r] for r in _ranks(p, n))) for p in asked]
        out[c] = [float(a + (b - a) * (x - np.floor(x))) for x, a, b in ends]
    return out


def at_ranks(values: DataFrame, ranks: Sequence[int]) -> list[float]:
    """The value of rank ranks[i], from 0, among those of column v<i> that are not null."""
    if not ranks:
        return []
    row = values.agg(*(x for i in range(len(ranks)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"least{i}"), F.max(f"v{i}").alias(f"most{i}")))).first()
    found = _select(values, {(i, r): (row[f"least{i}"], row[f"most{i}"]) for i, r in enumerate(ranks)}, {i: row[f"n{i}"] for i in range(len(ranks))})
    return [found[i, r] for i, r in enumerate(ranks)]


def _ranks(p: float, n: int) -> tuple[int, int]:
    """The ranks, from 0, between which a quantile lies."""
    return int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))


def _inside(n: int) -> float:
    """About how many of n rows a bracket around one of their ranks holds."""
    return n if n <= MOST_VALUES else 4 * NEAR * n


def _select(values: DataFrame, wanted: dict[tuple[int, int], tuple[float, float]], inside: dict[int, float]) -> dict[tuple[int, int], float]:
    """The values at ranks of columns v<i>, by (i, rank). wanted: a bracket that probably holds each; inside: about how many rows the brackets of a column hold each."""
    known: dict[tuple[int, int], float] = {}
    while wanted:
        spans = {i: _merged([b for (k, _), b in wanted.items() if k == i]) for i in sorted({i for i, _ in wanted})}
        # each value falls into a bracket (odd places) or between two (even places)
        cells = []
        for i, own in spans.items():
            x, place, fine = F.col(f"v{i}"), F.lit(2 * len(own)), F.lit(False)
            for k, (low, high) in reversed(list(enumerate(own))):
                place = F.when(x < low, 2 * k).when(x <= high, 2 * k + 1).otherwise(place)
                if low == high or inside[i] <= MOST_VALUES:
                    fine = fine | x.between(low, high)
            cells.append(F.struct(F.lit(i).alias("i"), place.alias("place"), F.when(fine, x).alias("x"), x.isNotNull().alias("there")))
        counted: dict[int, list[tuple[int, float | None, int]]] = {}
        for r in values.select(F.explode(F.array(*cells)).alias("c")).where("c.there").groupBy("c.i", "c.place", "c.x").count().collect():
            counted.setdefault(r["i"], []).append((r["place"], r["x"], r["count"]))
        left: dict[tuple[int, int], tuple[float | None, float | None, bool, int, float]] = {}
        for i in spans:
            before = 0
            for place, x, n in sorted(counted[i], key=lambda c: (c[0], c[1] is not None, c[1])):
                for r in [r for k, r in wanted if k == i and before <= r < before + n]:
                    if x is not None:
                        known[i, r] = x
                    else:
                        left[i, r] = (*_sides(spans[i], place), place % 2 == 1, n, (r - before) / max(1, n - 1))
                before += n
        wanted = _narrowed(values, left) if left else {}
        inside = {i: max(_inside(n) for (k, _), (*_, n, _) in left.items() if k == i) for i in {k for k, _ in left}}
    return known


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _sides(spans: list[tuple[float, float]], place: int) -> tuple[float | None, float | None]:
    """Where a bracket, or a gap between two, begins and ends."""
    k = place // 2
    if place % 2:
        return spans[k]
    return spans[k - 1][1] if k else None, spans[k][0] if k < len(spans) else None


def _narrowed(values: DataFrame, left: dict[tuple[int, int], tuple[float | None, float | None, bool, int, float]]) -> dict[tuple[int, int], tuple[float, float]]:
    """Brackets from the approximate percentiles of the rows of a bracket (with its ends) or gap (without) alone; of a few rows, all of them."""
    asked = []
    for (i, r), (low, high, ends, _, p) in left.items():
        x, on = F.col(f"v{i}"), F.lit(True)
        if low is not None:
            on = on & (x >= low if ends else x > low)
        if high is not None:
            on = on & (x <= high if ends else x < high)
        held = F.when(on, x)
        around = F.array(F.lit(max(0.0, p - 2 * NEAR)), F.lit(min(1.0, p + 2 * NEAR)))
        asked.append(F.struct(F.min(held).alias("least"), F.max(held).alias("most"), F.percentile_approx(held, around, ACCURACY).alias("q")).alias(f"{i}_{r}"))
    row = values.agg(*asked).first()
    out = {}
    for (i, r), (*_, n, p) in left.items():
        one, few = row[f"{i}_{r}"], n <= MOST_VALUES
        out[i, r] = (one["least"] if few or p <= 2 * NEAR else one["q"][0], one["most"] if few or p >= 1 - 2 * NEAR else one["q"][1])
    return out


def labels_for(n: int) -> list[str]:
    """The names of three or five sets."""
    return {3: ["Low", "Medium", "High"], 5: ["Very Low", "Low", "Medium", "High", "Very High"]}.get(n, [str(i) for i in range(n)])


def trapezoids(v: Sequence[float], n: int) -> list[tuple[float, ...]]:
    """n overlapping trapezoids from 4 + 2 (n - 2) even quantiles: each next one rises where the one before falls."""
    low, high = v[0] - EPSILON, v[-1] + EPSILON
    inner = [tuple(v[2 * i - 1 : 2 * i + 3]) for i in range(1, n - 1)]
    return [(low, low, v[1], v[2]), *inner, (v[-3], v[-2], high, high)]


def simple_trapezoids(v: Sequence[float]) -> list[tuple[float, ...]]:
    """Four trapezoids from the fixed quantiles."""
    return [(v[0], v[0], v[1], v[2]), tuple(v[1:5]), tuple(v[4:8]), (v[-3], v[-2], v[-1], v[-1])]


def three_trapezoids(v: Sequence[float]) -> list[tuple[float, ...]]:
    """Three trapezoids, the middle one flat around the median."""
    low, high = v[0] - EPSILON, v[4] + EPSILON
    return [(low, low, v[1], v[2]), (v[1], (v[1] + v[2]) / 2, (v[2] + v[3]) / 2, v[3]), (v[2], v[3], high, high)]


def triangles(v: Sequence[float]) -> list[tuple[float, ...]]:
    low, high = v[0] - EPSILON, v[4] + EPSILON
    return [(low, low, low, v[2]), (v[1], v[2], v[2], v[3]), (v[2], high, high, high)]


def gaussians(v: Sequence[float]) -> list[tuple[float, float]]:
    """A bell at each quantile, as wide as half the way between its neighbours. (Indexing past the last quantile, which a plain reading of the formula would do for three sets, is not reproduced.)"""
    n = len(v)
    wide = [(v[min(i + 1, n - 1)] - v[max(i - 1, 0)]) / (2 if 0 < i < n - 1 else 1) for i in range(n)]
    return [(m, w if w > 0 else EPSILON) for m, w in zip(v, wide, strict=True)]


def simple_gaussians(v: Sequence[float]) -> list[tuple[float, float]]:
    """Four bells from the fixed quantiles."""
    out = [(v[1], (v[2] - v[0]) / 2), (v[2], (v[3] - v[1]) / 2), (v[5], (v[6] - v[4]) / 2), (v[-2], (v[-1] - v[-3]) / 2)]
    return [(m, w if w > 0 else EPSILON) for m, w in out]


def interval_trapezoids(v: Sequence[float], n: int) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    """(lower, upper) of n trapezoids: the legs of the lower one start half way."""
    half = lambda a, b: a + (b - a) / 2
    first = ((v[0] - EPSILON, v[0], v[1], half(v[1], v[2])), (v[0] - EPSILON, v[0], v[1], v[2]))
    last = ((half(v[-3], v[-2]), v[-2], v[-1], v[-1] + EPSILON), (v[-3], v[-2], v[-1], v[-1] + EPSILON))
    inner = []
    for i in range(1, n - 1):
        a, b, c, d = v[2 * i - 1 : 2 * i + 3]
        inner.append(((half(a, b), b, c, half(c, d)), (a, b, c, d)))
    return [first, *inner, last]


def crisp(df: DataFrame, column: str, kind: Kind = Kind.T1) -> Variable:
    """One crisp set for each distinct value, in ascending order, nulls left out."""
    make = Category if kind is Kind.T1 else IntervalCategory
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return Variable(column, tuple(make(str(v), v) for v in values))


def fit_partitions(df: DataFrame, features: Sequence[str], n: int = 3, shape: str = "trapezoid", kind: Kind = Kind.T1, categorical: Sequence[str] = (), exact: bool = True, resolution: int = 2) -> list[Variable]:
    """A variable for each feature, in their order.

    shape: trapezoid, gaussian or triangular (three sets), for type 1; simple_trapezoid and simple_gaussian give four sets,
    three_trapezoid three. categorical: features whose distinct values become crisp sets. resolution: for general
    type 2, the decimals of the grid.
    """
    plain = [f for f in features if f not in categorical]
    probabilities = {"gaussian": even(n), "triangular": TRIANGLE, "simple_trapezoid": FIXED, "simple_gaussian": FIXED, "three_trapezoid": THREE}.get(shape, even(4 + 2 * (n - 2)))
    if kind is not Kind.T1:
        probabilities = even(4 + 2 * (n - 2)) if shape != "gaussian" else even(n)
    if shape == "triangular" and n != 3:
        raise ValueError("triangular partitions have three sets")
    if shape not in ("trapezoid", "gaussian", "triangular", "simple_trapezoid", "simple_gaussian", "three_trapezoid"):
        raise ValueError(f"unknown shape: {shape}")
    found = quantiles(df, plain, probabilities, exact)
    return [crisp(df, f, kind) if f in categorical else _variable(f, found[f], n, shape, kind, resolution) for f in features]


def _variable(feature: str, v: list[float], n: int, shape: str, kind: Kind, resolution: int) -> Variable:
    domain = (v[0], v[-1])
    if kind is Kind.T1:
        if shape in ("gaussian", "simple_gaussian"):
            made = gaussians(v) if shape == "gaussian" else simple_gaussians(v)
            return Variable(feature, tuple(Gaussian(s, m, w, domain=domain) for s, (m, w) in zip(labels_for(len(made)), made, strict=True)))
        made = {"triangular": triangles, "simple_trapezoid": simple_trapezoids, "three_trapezoid": three_trapezoids}.get(shape, lambda x: trapezoids(x, n))(v)
        make = Triangle if shape == "triangular" else Trapezoid
        return Variable(feature, tuple(make(s, c, domain=domain) for s, c in zip(labels_for(len(made)), made, strict=True)))
    if shape == "gaussian":
        sets = tuple(IntervalGaussian(s, (m, w / 2), (m, w), domain=domain) for s, (m, w) in zip(labels_for(n), gaussians(v), strict=True))
    else:
        sets = tuple(IntervalTrapezoid(s, lo, up, domain=domain) for s, (lo, up) in zip(labels_for(n), interval_trapezoids(v, n), strict=True))
    if kind is Kind.T2:
        return Variable(feature, sets)
    # a grid point for every step from the least value to the greatest
    points = int(np.ceil((v[-1] + 10.0**-resolution - v[0]) / 10.0**-resolution))
    return Variable(feature, tuple(TriangularType2(s.name, s, float(v[0]), points, resolution, domain=domain) for s in sets))


def validate_partitions(df: DataFrame, variables: Sequence[Variable], permutations: int = 1000, sample: int | None = None, p_needed: float = 0.05, key: Sequence[str] = ()) -> dict[str, dict[str, bool]]:
    """The six properties of each type-1 variable, and valid, which holds if all do.

    one_full: at most one set is full at any value. fuzzy_numbers: every set reaches 1. covered: no value is outside all sets. ordered: the first set is full at the left end
    of the domain and the last one at the right end. distinct: the memberships of neighbouring sets differ, by a permutation test of their
    mean distance over the root of the product of their variances. Rows are counted once by their memberships of each variable; everything else is worked out on the counts of all rows.

    sample: if given, the permutation test (and nothing else) takes at most so many rows instead of all: those with the least hash of their key, which every task finds among its own rows before they
    are merged. key: columns that tell rows apart there; by default all columns together with the row's place, so that rows of equal values are drawn as often as others.
    A row without a value belongs to no set. A table without rows has no distinct sets.
    """
    if not variables:
        return {}
    m = [F.col(f"m{j}") for j in range(max(map(len, variables)))]
    held = lambda v: [F.coalesce(F.expr(t), F.lit(0.0)) for t in v.texts()]
    each = [F.struct(F.lit(i).alias("i"), *(x.alias(f"m{j}") for j, x in enumerate([*held(v), *[F.lit(None).cast("double")] * (len(m) - len(v))]))) for i, v in enumerate(variables)]
    names = ["i", *(f"m{j}" for j in range(len(m)))]
    counted = shared.cut(df.select(F.explode(F.array(*each)).alias("c")).select("c.*").groupBy(*names).agg(F.count("*").alias("n")), "partition-memberships")
    full = sum((F.when(x >= 1.0 - 1e-9, 1).otherwise(0) for x in m), F.lit(0))
    checks = [F.sum("n").alias("n"), F.max(full).alias("full"), F.min(F.greatest(*m) if len(m) > 1 else m[0]).alias("least"), *(F.max(x).alias(f"top{j}") for j, x in enumerate(m))]
    rows = {r["i"]: r for r in counted.groupBy("i").agg(*checks).collect()}
    differ = {}
    if sample is None and rows and rows[0]["n"] > 1:
        pairs = [(i, j) for i, v in enumerate(variables) for j in range(len(v) - 1)]
        differ = dict(zip(pairs, pairings.p_values(counted, pairs, permutations), strict=True))
    elif rows and rows[0]["n"] > 1 and sample > 1:
        told = [F.col(f"`{c}`") for c in key] or [*(F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))), F.monotonically_increasing_id()]
        # memberships of the drawn rows only
        columns = [x.alias(f"m{i}_{j}") for i, v in enumerate(variables) for j, x in enumerate(held(v))]
        drawn = df.withColumn("_draw", F.xxhash64(F.lit(33), *told)).orderBy("_draw").limit(sample).select(*columns).toPandas()
        differ = {(i, j): permutation_p(drawn[f"m{i}_{j}"].to_numpy(), drawn[f"m{i}_{j + 1}"].to_numpy(), permutations) for i, v in enumerate(variables) for j in range(len(v) - 1)}
    shared.drop(counted)
    out = {}
    for i, v in enumerate(variables):
        row = rows.get(i)
        known = {"one_full": row is None or row["full"] <= 1, "covered": row is not None and row["least"] > 0, "fuzzy_numbers": row is not None and all(row[f"top{j}"] > 0.99 for j in range(len(v)))}
        if v.domain and hasattr(v.sets[0], "at"):
            first, last = (float(np.asarray(s.at(np.array([e]))).ravel()[0]) for s, e in ((v.sets[0], v.domain[0]), (v.sets[-1], v.domain[1])))
            known["ordered"] = first >= 0.99 and last >= 0.99
        known["distinct"] = row is not None and row["n"] > 1 and (sample is None or sample > 1) and all(differ[i, j] < p_needed for j in range(len(v) - 1))
        out[v.name] = known | {"valid": all(known.values())}
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean distance of paired memberships over the root of the product of their variances, of each row of pairs."""
    return np.abs(a - b).mean(axis=-1) / (np.sqrt(a.var(axis=-1, ddof=1) * b.var(axis=-1, ddof=1)) + 1e-10)


def permutation_p(a: np.ndarray, b: np.ndarray, permutations: int = 1000, seed: int = 33) -> float:
    """Two-sided p-value of how far apart two sets' memberships of the same rows are, where all memberships are dealt to both sets anew."""
    draw = np.random.default_rng(seed)
    seen, both = _apart(a, b), np.concatenate([a, b])
    null = np.array([_apart(*np.split(draw.permutation(both), 2)) for _ in range(permutations)])
    near = 1e-12 * abs(seen)
    low, high = ((null <= seen + near).sum() + 1) / (permutations + 1), ((null >= seen - near).sum() + 1) / (permutations + 1)
    return float(min(1.0, 2 * min(low, high)))
