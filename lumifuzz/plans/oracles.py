"""DuckDB equivalents of the registered queries, with every formula written out by hand.

They share no code with the operators: memberships are piecewise formulae over the quantiles that the query computes for itself, and rules
are spelled out as products of named columns. a, b, c and d stand for the features l_quantity, l_extendedprice, l_discount
and l_tax; a0, a1, a2 for the memberships of l_quantity in Low, Medium and High; f0 to f5 for the firing strengths of the rules.
"""

from __future__ import annotations

import re
from itertools import combinations, product

LETTERS = {"a": "l_quantity", "b": "l_extendedprice", "c": "l_discount", "d": "l_tax"}
CLASS = "(case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 end)"
SIX = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
KEEP = "l_orderkey, l_linenumber, l_returnflag"


def quantiles(table: str = "lineitem", probabilities: str = SIX, letters: dict[str, str] = LETTERS) -> str:
    return "q as (select " + ", ".join(f"quantile_cont({x}, {probabilities}) as {v}" for v, x in letters.items()) + f" from {table})"


def clipped(v: str, last: int) -> str:
    """The value of a feature, x, inside the outermost quantiles."""
    return f"case when x{v} < {v}[1] then {v}[1] when x{v} > {v}[{last}] then {v}[{last}] else x{v} end"


#: Piecewise memberships of x over the quantiles v[1] to v[6]: flat, a straight fall or rise, zero.
TRAPEZOIDS = (
    "case when x <= v[2] then 1 when x >= v[3] then 0 else (v[3] - x) / (v[3] - v[2]) end",
    "case when x < v[2] or x > v[5] then 0 when x < v[3] then (x - v[2]) / (v[3] - v[2]) when x <= v[4] then 1 else (v[5] - x) / (v[5] - v[4]) end",
    "case when x >= v[5] then 1 when x <= v[4] then 0 else (x - v[4]) / (v[5] - v[4]) end",
)
#: The lower functions of interval sets: their legs begin half way.
INNER = (
    "case when x <= v[2] then 1 when x >= (v[2] + v[3]) / 2 then 0 else ((v[2] + v[3]) / 2 - x) / ((v[3] - v[2]) / 2) end",
    "case when x < (v[2] + v[3]) / 2 or x > (v[4] + v[5]) / 2 then 0 when x < v[3] then (x - (v[2] + v[3]) / 2) / ((v[3] - v[2]) / 2) when x <= v[4] then 1 else ((v[4] + v[5]) / 2 - x) / ((v[5] - v[4]) / 2) end",
    "case when x >= v[5] then 1 when x <= (v[4] + v[5]) / 2 then 0 else (x - (v[4] + v[5]) / 2) / ((v[5] - v[4]) / 2) end",
)
#: Over five quantiles; the outer ends lie 0.0001 outside.
TRIANGLES = (
    "case when x >= v[3] then 0 else (v[3] - x) / (v[3] - v[1] + 0.0001) end",
    "case when x <= v[2] or x >= v[4] then 0 when x <= v[3] then (x - v[2]) / (v[3] - v[2]) else (v[4] - x) / (v[4] - v[3]) end",
    "case when x <= v[3] then 0 else (x - v[3]) / (v[5] + 0.0001 - v[3]) end",
)
#: Over three quantiles.
BELLS = ("exp(-power((x - v[1]) / (v[2] - v[1]), 2))", "exp(-power((x - v[2]) / ((v[3] - v[1]) / 2), 2))", "exp(-power((x - v[3]) / (v[3] - v[2]), 2))")
NARROW_BELLS = ("exp(-power((x - v[1]) / ((v[2] - v[1]) / 2), 2))", "exp(-power((x - v[2]) / ((v[3] - v[1]) / 4), 2))", "exp(-power((x - v[3]) / ((v[3] - v[2]) / 2), 2))")
#: Four sets over the quantiles at 0, 0.2, 0.3, 0.45, 0.55, 0.7, 0.8 and 1.
EIGHT = "[0.0, 0.2, 0.3, 0.45, 0.55, 0.7, 0.8, 1.0]"
FOUR_TRAPEZOIDS = (
    "case when x <= v[2] then 1 when x >= v[3] then 0 else (v[3] - x) / (v[3] - v[2]) end",
    "case when x < v[2] or x > v[5] then 0 when x < v[3] then (x - v[2]) / (v[3] - v[2]) when x <= v[4] then 1 else (v[5] - x) / (v[5] - v[4]) end",
    "case when x < v[5] or x > v[8] then 0 when x < v[6] then (x - v[5]) / (v[6] - v[5]) when x <= v[7] then 1 else (v[8] - x) / (v[8] - v[7]) end",
    "case when x >= v[7] then 1 when x <= v[6] then 0 else (x - v[6]) / (v[7] - v[6]) end",
)
FOUR_BELLS = (
    "exp(-power((x - v[2]) / ((v[3] - v[1]) / 2), 2))",
    "exp(-power((x - v[3]) / ((v[4] - v[2]) / 2), 2))",
    "exp(-power((x - v[6]) / ((v[7] - v[5]) / 2), 2))",
    "exp(-power((x - v[7]) / ((v[8] - v[6]) / 2), 2))",
)
#: Three sets over the quantiles at 0, 0.2, 0.5, 0.8 and 1; the middle one is flat half way around the median.
FIVE = "[0.0, 0.2, 0.5, 0.8, 1.0]"
THREE_TRAPEZOIDS = (
    "case when x <= v[2] then 1 when x >= v[3] then 0 else (v[3] - x) / (v[3] - v[2]) end",
    "case when x < v[2] or x > v[4] then 0 when x < (v[2] + v[3]) / 2 then (x - v[2]) / ((v[3] - v[2]) / 2) when x <= (v[3] + v[4]) / 2 then 1 else (v[4] - x) / ((v[4] - v[3]) / 2) end",
    "case when x >= v[4] then 1 when x <= v[3] then 0 else (x - v[3]) / (v[4] - v[3]) end",
)
QUARTERS = "[0.0, 0.25, 0.5, 0.75, 1.0]"
THREE = "[0.0, 0.5, 1.0]"


def _over(pieces: tuple[str, ...], v: str) -> list[str]:
    return [re.sub(r"\bv\[", f"{v}[", re.sub(r"\bx\b", f"x{v}", p)) for p in pieces]


def memberships(pieces: tuple[str, ...] = TRAPEZOIDS, probabilities: str = SIX, last: int = 6, clip: bool = True, more: dict[str, tuple[str, ...]] | None = None, letters: dict[str, str] = LETTERS, table: str = "lineitem", keep: str = KEEP) -> str:
    """CTEs q and m: the kept columns, and the memberships a0, a1, ... of each feature, and others with a letter after them."""
    values = ", ".join(f"{clipped(v, last).replace(f'x{v}', x) if clip else x} as x{v}" for v, x in letters.items())
    sets = [f"{t} as {v}{j}{letter}" for letter, some in ({"": pieces} | (more or {})).items() for v in letters for j, t in enumerate(_over(some, v))]
    return f"{quantiles(table, probabilities, letters)}, x as (select {keep}, {values}, {', '.join(letters)} from {table}, q), m as (select {keep}, {', '.join(sets)} from x)"


#: The rules, as products of memberships. Classes: f0 and f1 say A, f2 and f3 N, f4 and f5 R.
PRODUCTS = "a0 as f0, b0 * c2 as f1, a2 * b2 as f2, a1 * d2 as f3, b1 * c0 as f4, a0 * c1 * d0 as f5"
LEASTS = "a0 as f0, least(b0, c2) as f1, least(a2, b2) as f2, least(a1, d2) as f3, least(b1, c0) as f4, least(a0, c1, d0) as f5"
HEDGED = "sqrt(a0) as f0, power(b0, 3) * sqrt(c2) as f1, power(a2, 3) * sqrt(b2) as f2, sqrt(a1) * sqrt(d2) as f3, power(b1, 3) * sqrt(c0) as f4, power(a0, 3) * power(c1, 2) * power(d0, 3) as f5"
#: The means of the lower and the upper product, where a0 is the lower membership and a0u the upper one.
INTERVAL_PRODUCTS = "(a0 + a0u) / 2 as f0, (b0 * c2 + b0u * c2u) / 2 as f1, (a2 * b2 + a2u * b2u) / 2 as f2, (a1 * d2 + a1u * d2u) / 2 as f3, (b1 * c0 + b1u * c0u) / 2 as f4, (a0 * c1 * d0 + a0u * c1u * d0u) / 2 as f5"
INTERVALS = {"pieces": INNER, "more": {"u": TRAPEZOIDS}}
EVERY = ("f0", "f1", "f2", "f3", "f4", "f5")
BEST = "greatest(f0, f1, f2, f3, f4, f5)"
FIRST = "(case greatest(f0, f1, f2, f3, f4, f5) when f0 then 0 when f1 then 1 when f2 then 2 when f3 then 3 when f4 then 4 else 5 end)"
SAID = "(case when winner < 2 then 0 when winner < 4 then 1 else 2 end)"
CLASS_BEST = ("greatest(f0, f1)", "greatest(f2, f3)", "greatest(f4, f5)")


def fired(rules: str = PRODUCTS, **options) -> str:
    """CTEs up to w: firing strengths, strength and winner of each row."""
    return f"{memberships(**options)}, f as (select *, {rules} from m), w as (select *, {BEST} as strength, {FIRST} as winner, {CLASS} as y from f)"


def sums(names: tuple[str, ...] = EVERY, to: str = "r") -> str:
    return ", ".join(f"round(sum({x}), 6) as {to}{i}" for i, x in enumerate(names))


def averages(count: int, side: str = "", to: str = "mu_") -> str:
    return ", ".join(f"round(avg({v}{j}{side}), 6) as {to}{i}_{j}" for i, v in enumerate(LETTERS) for j in range(count))


def itemsets(k: int, by_class: bool = False) -> str:
    """Mean least memberships of all combinations of k features and their sets, above 0.05."""
    rows = []
    for where, name in [(f" where l_returnflag = '{c}'", c) for c in "ANR"] if by_class else [("", "")]:
        for vs in combinations(range(4), k):
            for ss in product(range(3), repeat=k):
                columns = ", ".join(f"{'abcd'[v]}{s}" for v, s in zip(vs, ss, strict=True))
                items = " ".join(f"{v}:{s}" for v, s in zip(vs, ss, strict=True))
                rows.append(f"select '{items}' as items, '{name}' as class, avg({f'least({columns})' if k > 1 else columns}) as support from m{where}")
    return f"with {memberships()}, s as ({' union all '.join(rows)}) select items{', class' if by_class else ''}, round(support, 6) as support from s where support > 0.05"


def quality(rules: str = PRODUCTS, **options) -> str:
    """CTEs up to s: for each rule its class, the sums of its firing strength over all rows (t) and over those of its class (s), and the number of rows n."""
    own = " union all ".join(f"select {i} as rule, {c} as class, sum(f{i}) as t, sum(case when y = {c} then f{i} else 0 end) as s, count(*) as n from w" for i, c in enumerate((0, 0, 1, 1, 2, 2)))
    return f"{fired(rules, **options)}, s as ({own})"


SUPPORT, CONFIDENCE = "s / n", "coalesce(s / nullif(t, 0), 0)"

#: Accuracy and multiclass correlation of a table k (actual, predicted, n).
MERIT = """n as (select sum(n) as n, sum(case when actual = predicted then n else 0 end) as c from k),
 e as (select (select sum(v * v) from (select sum(n) as v from k group by predicted)) as pp, (select sum(v * v) from (select sum(n) as v from k group by actual)) as aa,
  (select coalesce(sum(p.v * a.v), 0) from (select predicted as z, sum(n) as v from k group by 1) p join (select actual as z, sum(n) as v from k group by 1) a on p.z = a.z) as pa),
 merit as (select c / n as accuracy, case when (n * n - pp) * (n * n - aa) <= 0 then 0 else (c * n - pa) / sqrt((cast(n as double) * n - pp) * (cast(n as double) * n - aa)) end as mcc from n, e)"""
CONFUSION = f"k as (select y as actual, {SAID} as predicted, count(*) as n from w group by 1, 2)"

#: Events by six-hour windows, and the memberships of their value.
WINDOW = "case when hour(ts) < 6 then 0 when hour(ts) < 12 then 1 when hour(ts) < 18 then 2 else 3 end"
EVENTS = {"letters": {"a": "value"}, "table": "t", "keep": "time, event_type"}
TIMED = f"t as (select {WINDOW} as time, event_type, value from events where ts is not null)"
FULLEST = "case when coalesce(a0, 0) >= coalesce(a1, 0) and coalesce(a0, 0) >= coalesce(a2, 0) then 0 when coalesce(a1, 0) >= coalesce(a2, 0) then 1 else 2 end"
FREQUENCIES = f"{TIMED}, {memberships(**EVENTS)}, g as (select time, {FULLEST} as label, count(*) as n from m group by 1, 2), h as (select time, label, n, n / (max(n) over (partition by label) + 0.000001) as frequency from g)"

#: A thousand points of the output, and its three sets.
OUTPUT = """z as (select i / 1000.0 as z from range(1000) as r(i)), o as (select z, case when z <= 0.2 then 1 when z >= 0.5 then 0 else (0.5 - z) / 0.3 end as m0,
 case when z < 0.2 or z > 0.8 then 0 when z < 0.4 then (z - 0.2) / 0.2 when z <= 0.6 then 1 else (0.8 - z) / 0.2 end as m1, case when z >= 0.8 then 1 when z <= 0.5 then 0 else (z - 0.5) / 0.3 end as m2 from z),
 oc as (select sum(z * m0) / sum(m0) as k0, sum(z * m1) / sum(m1) as k1, sum(z * m2) / sum(m2) as k2 from o)"""


def settled(left: bool, steps: int = 10) -> str:
    """CTEs y0, y1, ...: the centroid of an interval set (table o: z, low, high), with the switch point put where the centroid was."""
    out = ["y0 as (select sum(z * (low + high)) / sum(low + high) as y from o)"]
    side = "z < y" if left else "z > y"
    for i in range(steps):
        out.append(f"y{i + 1} as (select sum(z * case when {side} then high else low end) / sum(case when {side} then high else low end) as y from o, y{i})")
    return ", ".join(out)


def type_reduced(steps: int = 7) -> str:
    """CTEs up to e: both ends of the type-reduced output of each row. l0 and u0 are the rules' lower and upper strengths; rules come in order of their consequents, so that a switch point is always after a whole class, or after the first rule."""
    pairs = "a0 as l0, b0 * c2 as l1, a2 * b2 as l2, a1 * d2 as l3, b1 * c0 as l4, a0 * c1 * d0 as l5, a0u as u0, b0u * c2u as u1, a2u * b2u as u2, a1u * d2u as u3, b1u * c0u as u4, a0u * c1u * d0u as u5"
    own = ("k0", "k0", "k1", "k1", "k2", "k2")

    def value(inner: str, outer: str, k: int) -> str:
        w = [f"{inner if i <= k else outer}{i}" for i in range(6)]
        return f"coalesce(({' + '.join(f'{x} * {c}' for x, c in zip(w, own, strict=True))}) / nullif({' + '.join(w)}, 0), 0)"

    ctes = [memberships(**INTERVALS), OUTPUT, f"v as (select *, {pairs} from m)"]
    first = f"({' + '.join(f'(l{i} + u{i}) * {c}' for i, c in enumerate(own))}) / nullif({' + '.join(f'l{i} + u{i}' for i in range(6))}, 0)"
    points = ", ".join(f"{value('u', 'l', k)} as vl{k}, {value('l', 'u', k)} as vh{k}" for k in (0, 1, 3, 5))
    ctes.append(f"e0 as (select v.*, oc.*, {first} as lo, {first} as hi, {points} from v, oc)")

    def moved(x: str, p: str) -> str:
        return f"case when {x} is null or {x}_done then {x} when {x} >= k2 - 1e-9 then {p}5 when {x} >= k1 - 1e-9 then {p}3 when {x} >= k0 - 1e-9 then {p}1 else {p}0 end as {x}_next"

    # it ends when a value returns
    ctes[-1] = ctes[-1].replace(f"{first} as lo, {first} as hi", f"{first} as lo, {first} as hi, false as lo_done, false as hi_done, [{first}] as lo_seen, [{first}] as hi_seen")
    for i in range(steps):
        again = ", ".join(f"{x}_done or len(list_filter({x}_seen, lambda v: abs(v - {x}_next) <= 1e-9)) > 0 as {x}_done, list_append({x}_seen, {x}_next) as {x}_seen, {x}_next as {x}" for x in ("lo", "hi"))
        ctes.append(f"n{i} as (select *, {moved('lo', 'vl')}, {moved('hi', 'vh')} from e{i})")
        ctes.append(f"e{i + 1} as (select * exclude (lo, hi, lo_done, hi_done, lo_seen, hi_seen, lo_next, hi_next), {again} from n{i})")
    ctes.append(f"e as (select l_returnflag, coalesce(lo, 0) as lo, coalesce(hi, 0) as hi from e{steps})")
    return ", ".join(ctes)


#: Alpha cuts, and the points of the unit interval.
CUTS = "al as (select unnest([0.2, 0.4, 0.5, 0.7, 0.9, 1.0]) as alpha), un as (select i / 100.0 as u from range(101) as r(i))"


def general(v: str) -> str:
    """CTEs for the general type-2 sets of a feature with two decimals: cut_v holds for each value, set and alpha the ends of the units whose secondary membership (a triangle between the lower and the upper membership at the grid point) reaches alpha."""
    pieces = [(lo, hi) for lo, hi in zip(_over(INNER, v), _over(TRAPEZOIDS, v), strict=True)]
    rows = " union all ".join(f"select distinct x{v}, {j} as label, {lo} as lo, {hi} as hi from x" for j, (lo, hi) in enumerate(pieces))
    peak = "(lo + hi) / 2"
    # ends that agree to a billionth are one point, wherever rounding put them
    inside = f"case when hi - lo < 1e-9 then case when abs(u - lo) < 1e-9 then 1 else 0 end when u <= {peak} then (u - lo) / ({peak} - lo) else (hi - u) / (hi - {peak}) end"
    reached = f"select x{v}, label, alpha, min(u) as first, max(u) as last from g_{v}, un, al where {inside} >= alpha - 0.000000001 group by 1, 2, 3"
    return f"g_{v} as ({rows}), r_{v} as ({reached}), cut_{v} as (select g.x{v} as value, g.label, al.alpha, coalesce(first, 0) as lo, coalesce(last, 0) as hi from g_{v} g cross join al left join r_{v} r on r.x{v} = g.x{v} and r.label = g.label and r.alpha = al.alpha)"


def shaped(steps: dict[str, tuple[int, ...]]) -> str:
    """CTEs up to f: the rules' strengths over partitions whose eleven steps (each plus one) divide a feature's range; the corners are the first eight points, counted from 0. Low is full up to the second and ends at the third, Medium stands on the second to the fifth, High rises from the fourth to the fifth."""
    ends = "d as (select " + ", ".join(f"min({x}) as {v}lo, max({x}) - min({x}) as {v}w" for v, x in LETTERS.items()) + " from lineitem)"
    corners = []
    for v, own in steps.items():
        total = sum(own) + len(own)
        corners += [f"{v}lo + {v}w * ({sum(own[:k]) + k}.0 / {total}) as {v}_{k}" for k in (2, 3, 4, 5)]
    sets = []
    for v, x in LETTERS.items():
        sets.append(f"case when {x} <= {v}_2 then 1 when {x} >= {v}_3 then 0 else ({v}_3 - {x}) / ({v}_3 - {v}_2) end as {v}0")
        sets.append(f"case when {x} <= {v}_2 or {x} >= {v}_5 then 0 when {x} < {v}_3 then ({x} - {v}_2) / ({v}_3 - {v}_2) when {x} <= {v}_4 then 1 else ({v}_5 - {x}) / ({v}_5 - {v}_4) end as {v}1")
        sets.append(f"case when {x} >= {v}_5 then 1 when {x} <= {v}_4 then 0 else ({x} - {v}_4) / ({v}_5 - {v}_4) end as {v}2")
    return f"{ends}, k0 as (select {', '.join(corners)} from d), m as (select {CLASS} as y, {', '.join(sets)} from lineitem, k0), f as (select y, {PRODUCTS} from m)"
