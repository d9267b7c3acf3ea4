"""Fuzzy sets and linguistic variables.

Every set renders its membership in a value as SQL text (bounds: lower and upper; they agree for type 1) and computes
it with numpy for small grids on the driver (at). A null or NaN value has null membership. Degenerate trapezoids are folded when
the text is made: a set whose four corners coincide is crisp equality; a vertical left or right side is
moved out by EPSILON.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumifuzz.functions import sqltext as q

EPSILON = 1e-4


class Kind(Enum):
    T1 = "t1"
    T2 = "t2"
    GT2 = "gt2"
    TEMPORAL = "temporal"
    TEMPORAL_T2 = "temporal_t2"


def extended_kinds(names: Sequence[str]) -> type[Enum]:
    """Kind with more members."""
    return Enum("Kind", {k.name: k.value for k in Kind} | {n.upper(): n for n in names})


def trapezoid_text(x: str, a: str, b: str, c: str, d: str) -> str:
    """Membership for corners that are SQL expressions themselves, whatever their order of equality."""
    left = f"(case when {b} = {a} then {a} - {q.number(EPSILON)} else {a} end)"
    right = f"(case when {c} = {d} then {d} + {q.number(EPSILON)} else {d} end)"
    slopes = f"least(({x} - {left}) / ({b} - {left}), ({right} - {x}) / ({right} - {c}))"
    return f"(case when {x} is null then null when {a} = {d} then case when {x} = {a} then 1e0 else 0e0 end else greatest(0e0, least(1e0, {slopes})) end)"


def trapezoid(x: str, corners: Sequence[float]) -> str:
    a, b, c, d = map(float, corners)
    if a == d:
        return f"(case when {x} is null then null when {x} = {q.number(a)} then 1e0 else 0e0 end)"
    a, d = (a - EPSILON if a == b else a), (d + EPSILON if c == d else d)
    rise = f"({x} - {q.number(a)}) / {q.number(b - a)}"
    fall = f"({q.number(d)} - {x}) / {q.number(d - c)}"
    return f"(case when {x} is null then null else greatest(0e0, least(1e0, least({rise}, {fall}))) end)"


#: Stands for a missing value where expressions must not be null: outside every set, so that its membership is 0.
FAR = -1e300


def sure_trapezoid(x: str, corners: Sequence[float]) -> str:
    """The same for an x that is never null: no branch, so that compiled code stays short."""
    a, b, c, d = map(float, corners)
    if a == d:
        return f"(case when {x} = {q.number(a)} then 1e0 else 0e0 end)"
    a, d = (a - EPSILON if a == b else a), (d + EPSILON if c == d else d)
    return f"greatest(0e0, least(1e0, ({x} - {q.number(a)}) / {q.number(b - a)}, ({q.number(d)} - {x}) / {q.number(d - c)}))"


def trapezoid_at(x: np.ndarray, corners: Sequence[float]) -> np.ndarray:
    a, b, c, d = map(float, corners)
    x = np.asarray(x, float)
    if a == d:
        return np.where(np.isnan(x), np.nan, (x == a).astype(float))
    a, d = (a - EPSILON if a == b else a), (d + EPSILON if c == d else d)
    return np.clip(np.minimum((x - a) / (b - a), (d - x) / (d - c)), 0, 1)


def gaussian(x: str, mean: float, spread: float) -> str:
    z = f"({x} - {q.number(mean)}) / {q.number(spread)}"
    return f"exp(-(({z}) * ({z})))"


@dataclass(frozen=True)
class FuzzySet:
    name: str
    domain: tuple[float, float] | None = field(default=None, kw_only=True)
    kind = Kind.T1
    shape = "set"

    def bounds(self, x: str) -> tuple[str, str]:
        m = self.text(x)
        return m, m

    def text(self, x: str) -> str:
        """The membership, for type 2 the mean of its bounds."""
        low, high = self.bounds(x)
        return f"(({low} + {high}) / 2e0)"

    def sure(self, x: str) -> tuple[str, str]:
        """The bounds for an x that is never null (FAR where there is no value), never null themselves."""
        low, high = self.bounds(x)
        return f"coalesce({low}, 0e0)", f"coalesce({high}, 0e0)"

    def sure_cuts(self, x: str, n: int) -> list[tuple[str, str]]:
        """The same for each of n alpha cuts."""
        return [self.sure(x)] * n

    def membership(self, x: str) -> Column:
        """A column: a double for type 1, a struct of lo and hi for type 2."""
        low, high = self.bounds(q.name(x))
        return F.expr(low) if self.kind is Kind.T1 else F.struct(F.expr(low).alias("lo"), F.expr(high).alias("hi"))

    __call__ = membership


@dataclass(frozen=True)
class Trapezoid(FuzzySet):
    corners: tuple[float, float, float, float]
    shape = "trapezoid"

    def text(self, x: str) -> str:
        return trapezoid(x, self.corners)

    def sure(self, x: str) -> tuple[str, str]:
        m = sure_trapezoid(x, self.corners)
        return m, m

    def at(self, x: np.ndarray) -> np.ndarray:
        return trapezoid_at(x, self.corners)


@dataclass(frozen=True)
class Triangle(Trapezoid):
    shape = "triangular"


@dataclass(frozen=True)
class Gaussian(FuzzySet):
    """exp(-((x - mean) / spread) ** 2)."""

    mean: float
    spread: float
    shape = "gaussian"

    def text(self, x: str) -> str:
        return gaussian(x, self.mean, self.spread)

    def sure(self, x: str) -> tuple[str, str]:
        return self.bounds(x)

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-(((np.asarray(x, float) - self.mean) / self.spread) ** 2))


@dataclass(frozen=True)
class Category(FuzzySet):
    value: str | float
    shape = "categorical"

    def text(self, x: str) -> str:
        return f"(case when {x} is null then null when {x} = {q.text(self.value)} then 1e0 else 0e0 end)"

    def at(self, x: np.ndarray) -> np.ndarray:
        return (np.asarray(x) == self.value).astype(float)


@dataclass(frozen=True)
class IntervalTrapezoid(FuzzySet):
    """Interval type 2: a lower trapezoid of some height inside an upper one. As sets are used as given, a lower bound above the upper one is only refused where strict."""

    lower: tuple[float, float, float, float]
    upper: tuple[float, float, float, float]
    height: float = 1.0
    strict: bool = False
    kind = Kind.T2
    shape = "trapezoid"

    def __post_init__(self):
        lo, up = self.lower, self.upper
        if self.strict and not (up[0] <= lo[0] and lo[3] <= up[3] and up[1] <= lo[1] and lo[2] <= up[2] and 0 < self.height <= 1):
            raise ValueError(f"{self.name}: the lower function is not inside the upper one")

    def bounds(self, x: str) -> tuple[str, str]:
        return f"({trapezoid(x, self.lower)} * {q.number(self.height)})", trapezoid(x, self.upper)

    def sure(self, x: str) -> tuple[str, str]:
        low = sure_trapezoid(x, self.lower)
        return low if self.height == 1 else f"({low} * {q.number(self.height)})", sure_trapezoid(x, self.upper)

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.stack([trapezoid_at(x, self.lower) * self.height, trapezoid_at(x, self.upper)], axis=-1)


@dataclass(frozen=True)
class IntervalGaussian(FuzzySet):
    lower: tuple[float, float]
    upper: tuple[float, float]
    height: float = 1.0
    kind = Kind.T2
    shape = "gaussian"

    def bounds(self, x: str) -> tuple[str, str]:
        return f"({gaussian(x, *self.lower)} * {q.number(self.height)})", gaussian(x, *self.upper)

    def sure(self, x: str) -> tuple[str, str]:
        return self.bounds(x)

    def at(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return np.stack([self.height * np.exp(-(((x - self.lower[0]) / self.lower[1]) ** 2)), np.exp(-(((x - self.upper[0]) / self.upper[1]) ** 2))], axis=-1)


@dataclass(frozen=True)
class IntervalCategory(Category):
    kind = Kind.T2

    def at(self, x: np.ndarray) -> np.ndarray:
        m = super().at(x)
        return np.stack([m, m], axis=-1)


def _unless_far(x: str, membership: str) -> str:
    return f"(case when {x} = {q.number(FAR)} then 0e0 else coalesce({membership}, 0e0) end)"


@dataclass(frozen=True)
class GeneralType2(FuzzySet):
    """General type 2 over a grid of step 10 ** -decimals: for each grid point and alpha cut, an interval of memberships. A value is looked up at its grid point, truncated towards zero; outside the grid, at its ends.

    table: intervals as (points, cuts, 2).
    """

    table: np.ndarray = field(compare=False)
    first: int = 0
    decimals: int = 1
    cuts: tuple[float, ...] = (0.2, 0.4, 0.5, 0.7, 0.9, 1.0)
    kind = Kind.GT2
    shape = "general"

    @classmethod
    def over(cls, label: str, secondary: dict[float, Trapezoid], decimals: int, cuts: Sequence[float] = (0.2, 0.4, 0.5, 0.7, 0.9, 1.0), resolution: float = 0.01, domain: tuple[float, float] | None = None) -> GeneralType2:
        """From a secondary set for each grid point: an alpha cut is the first and the last unit point at or above alpha, or (0, 0)."""
        points = sorted(secondary)
        unit = np.arange(0, 1 + resolution / 2, resolution)
        table = np.zeros((len(points), len(cuts), 2))
        for i, p in enumerate(points):
            m = secondary[p].at(unit)
            for j, a in enumerate(cuts):
                on = np.flatnonzero(m >= a - 1e-9)
                if len(on):
                    table[i, j] = unit[on[0]], unit[on[-1]]
        return cls(label, table, round(points[0] * 10**decimals), decimals, tuple(cuts), domain=domain or (points[0], points[-1]))

    def reduced(self) -> np.ndarray:
        """(points, 2): the intervals, weighted by their alphas."""
        a = np.array(self.cuts)
        return (self.table * a[None, :, None]).sum(axis=1) / a.sum()

    def _row(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.trunc(np.asarray(x, float) * 10**self.decimals + 1e-9).astype(int) - self.first, 0, len(self.table) - 1)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self.reduced()[self._row(x)]

    def all_cuts(self, x: np.ndarray) -> np.ndarray:
        return self.table[self._row(x)]

    def place(self, x: str) -> str:
        """The row of the table for a value, from 0."""
        return f"cast(least(greatest(cast({x} * {q.number(10**self.decimals)} + 1e-9 as bigint) - {self.first}, 0), {len(self.table) - 1}) as int)"

    def _looked_up(self, x: str, values: np.ndarray) -> str:
        # a literal array, folded once when the query is planned, and one lookup for each row
        listed = ", ".join(map(q.number, values.tolist()))
        return f"(case when {x} is null then null else get(array({listed}), {self.place(x)}) end)"

    def bounds(self, x: str) -> tuple[str, str]:
        r = self.reduced()
        return self._looked_up(x, r[:, 0]), self._looked_up(x, r[:, 1])

    def sure(self, x: str) -> tuple[str, str]:
        return tuple(_unless_far(x, t) for t in self.bounds(x))

    def sure_cuts(self, x: str, n: int) -> list[tuple[str, str]]:
        return [tuple(_unless_far(x, self._looked_up(x, self.table[:, j, side])) for side in (0, 1)) for j in range(n)]


@dataclass(frozen=True)
class TriangularType2(FuzzySet):
    """General type 2 in closed form: at every value, the secondary set is a triangle between the bounds of an interval set, with its peak half way.

    Values go to a grid of step 10 ** -decimals that begins at start (truncated towards zero, outside the grid to its ends, the last of which is the end of the domain). An alpha cut is the first and the last multiple of
    resolution at which the triangle reaches alpha, or (0, 0) where it reaches it at none; both follow from the bounds by one rounding, so nothing is held for the grid's
    points, of which there may be any number.
    """

    of: FuzzySet
    start: float = 0.0
    points: int = 1
    decimals: int = 1
    cuts: tuple[float, ...] = (0.2, 0.4, 0.5, 0.7, 0.9, 1.0)
    resolution: float = 0.01
    kind = Kind.GT2
    shape = "general"
    #: What counts as reached, as a share of alpha, and as a share of a step.
    near = (1e-9, 1e-10)

    def snapped(self, x: str) -> str:
        ten, first = 10**self.decimals, round(self.start * 10**self.decimals)
        place = f"cast(least(greatest({x} * {q.number(ten)} + 1e-9, {q.number(first)}), {q.number(first + self.points - 1)}) as bigint) - {first}"
        at = f"({q.number(self.start)} + ({place}) * {q.number(10.0**-self.decimals)})"
        return f"least({at}, {q.number(self.domain[1])})" if self.domain else at

    def grid(self, x: np.ndarray) -> np.ndarray:
        k = np.trunc(np.asarray(x, float) * 10**self.decimals + 1e-9) - round(self.start * 10**self.decimals)
        at = self.start + np.clip(k, 0, self.points - 1) * 10.0**-self.decimals
        return np.minimum(at, self.domain[1]) if self.domain else at

    def all_cuts(self, x: np.ndarray) -> np.ndarray:
        """(values, cuts, 2)"""
        m = self.of.at(self.grid(x))
        steps = 1 / self.resolution
        inside = (np.array(self.cuts) - self.near[0]) / 2 * steps * (m[:, 1] - m[:, 0])[:, None]
        first, last = np.ceil(m[:, 0, None] * steps + inside - self.near[1]), np.floor(m[:, 1, None] * steps - inside + self.near[1])
        return np.where((first > last)[..., None], 0.0, np.stack([first, last], axis=-1) * self.resolution)

    def at(self, x: np.ndarray) -> np.ndarray:
        a = np.array(self.cuts)
        return (self.all_cuts(x) * a[None, :, None]).sum(axis=1) / a.sum()

    def edges(self, x: str) -> tuple[str, str]:
        """The bounds at a value that is never null (FAR where there is none), never null themselves."""
        return tuple(_unless_far(x, t) for t in self.of.sure(self.snapped(x)))

    def cut_arrays(self, low: str, high: str) -> tuple[str, str]:
        """Arrays of the lower and of the upper ends of all alpha cuts, for bounds that are columns. One short lambda for all cuts, so that the code of a rule base does not grow with them."""
        steps = 1 / self.resolution
        halves = ", ".join(q.number((a - self.near[0]) / 2 * steps) for a in self.cuts)
        first, last = f"ceil({low} * {q.number(steps)} + _h * ({high} - {low}) - {q.number(self.near[1])})", f"floor({high} * {q.number(steps)} - _h * ({high} - {low}) + {q.number(self.near[1])})"
        return tuple(f"transform(array({halves}), _h -> case when {first} > {last} then 0e0 else {x} * {q.number(self.resolution)} end)" for x in (first, last))

    def bounds(self, x: str) -> tuple[str, str]:
        weights = f"array({', '.join(q.number(a / sum(self.cuts)) for a in self.cuts)})"
        cuts = [f"zip_with({t}, {weights}, (c, w) -> c * w)" for t in self.cut_arrays(*(f"get({side}, 0)" for side in ("_s.lo", "_s.hi")))]
        held = f"array(named_struct('lo', array({self.of.bounds(self.snapped(x))[0]}), 'hi', array({self.of.bounds(self.snapped(x))[1]})))"
        # the bounds are worked out once, then summed over the cuts
        return tuple(f"(case when {q.clean(x)} is null then null else transform({held}, _s -> aggregate({t}, 0e0, (s, c) -> s + c))[0] end)" for t in cuts)

    def sure(self, x: str) -> tuple[str, str]:
        return tuple(_unless_far(x, t) for t in self.bounds(x))

    def sure_cuts(self, x: str, n: int) -> list[tuple[str, str]]:
        low, high = self.cut_arrays(*self.edges(x))
        return [(f"get({low}, {j})", f"get({high}, {j})") for j in range(n)]


@dataclass(frozen=True)
class TemporalSet(FuzzySet):
    """A set whose membership is scaled by a frequency for each time step: of the time column, or of one fixed step."""

    base: FuzzySet
    frequencies: tuple[float, ...]
    time: str | int = "time"
    kind = Kind.TEMPORAL

    def fix(self, step: int | str) -> TemporalSet:
        return replace(self, time=step)

    def factor(self) -> str:
        if isinstance(self.time, int):
            return q.number(self.frequencies[self.time])
        return "(case " + q.name(self.time) + " " + " ".join(f"when {i} then {q.number(f)}" for i, f in enumerate(self.frequencies)) + " end)"

    def bounds(self, x: str) -> tuple[str, str]:
        low, high = self.base.bounds(x)
        return f"({low} * {self.factor()})", f"({high} * {self.factor()})"

    def sure(self, x: str) -> tuple[str, str]:
        low, high = self.base.sure(x)
        return self._scaled(low), self._scaled(high)

    def sure_cuts(self, x: str, n: int) -> list[tuple[str, str]]:
        return [(self._scaled(low), self._scaled(high)) for low, high in self.base.sure_cuts(x, n)]

    def _scaled(self, membership: str) -> str:
        return f"coalesce({membership} * {self.factor()}, 0e0)"

    def membership(self, x: str) -> Column:
        low, high = self.bounds(q.name(x))
        return F.expr(low) if self.base.kind is Kind.T1 else F.struct(F.expr(low).alias("lo"), F.expr(high).alias("hi"))


@dataclass(frozen=True)
class Variable:
    """A linguistic variable: a column and its sets. Values outside the first set's domain count as its ends."""

    name: str
    sets: tuple[FuzzySet, ...]
    units: str | None = None
    clipped: bool = True

    def __post_init__(self):
        object.__setattr__(self, "sets", tuple(self.sets))

    def __len__(self) -> int:
        return len(self.sets)

    def __iter__(self):
        return iter(self.sets)

    def __getitem__(self, i: int) -> FuzzySet:
        return self.sets[i]

    @property
    def kind(self) -> Kind:
        s = self.sets[0]
        return s.base.kind if isinstance(s, TemporalSet) else s.kind

    @property
    def labels(self) -> list[str]:
        return [s.name for s in self.sets]

    @property
    def domain(self) -> tuple[float, float] | None:
        return self.sets[0].domain

    def with_set(self, s: FuzzySet) -> Variable:
        return replace(self, sets=(*self.sets, s))

    def with_replaced(self, i: int, s: FuzzySet) -> Variable:
        return replace(self, sets=tuple(s if j == i else x for j, x in enumerate(self.sets)))

    def unclipped(self) -> Variable:
        return replace(self, clipped=False)

    def fix(self, step: int | str) -> Variable:
        return replace(self, sets=tuple(s.fix(step) if isinstance(s, TemporalSet) else s for s in self.sets))

    @property
    def time_steps(self) -> int:
        return max((len(s.frequencies) for s in self.sets if isinstance(s, TemporalSet)), default=0)

    def value(self) -> str:
        x = q.name(self.name)
        first = self.sets[0]
        if isinstance(first, Category):
            return x
        x = q.clean(x)
        return q.clip(x, *self.domain) if self.clipped and self.domain and not isinstance(first, TemporalSet) else x

    def sure_value(self) -> str:
        """value(), with FAR where it is null."""
        x = q.name(self.name)
        if isinstance(self.sets[0], Category):
            return x
        x = f"cast({x} as double)"
        if self.clipped and self.domain and not isinstance(self.sets[0], TemporalSet):
            low, high = map(q.number, self.domain)
            x = f"case when isnan({x}) then {q.number(FAR)} when {x} < {low} then {low} when {x} > {high} then {high} else {x} end"
        else:
            x = f"nullif({x}, cast('NaN' as double))"
        return f"coalesce({x}, {q.number(FAR)})"

    def texts(self) -> list[str]:
        return [s.text(self.value()) for s in self.sets]

    def bounds(self) -> list[tuple[str, str]]:
        return [s.bounds(self.value()) for s in self.sets]

    def memberships(self) -> Column:
        """array of the memberships, in the order of the sets: doubles, or structs of lo and hi."""
        if self.kind is Kind.T1:
            return F.array(*map(F.expr, self.texts()))
        return F.array(*(F.struct(F.expr(lo).alias("lo"), F.expr(hi).alias("hi")) for lo, hi in self.bounds()))

    def sampled(self, points: int = 200) -> list[tuple[float, str, float, float]]:
        """(value, label, lower, upper) over the domain, for a plot."""
        x = np.linspace(*(self.domain or (0.0, 1.0)), points)
        out = []
        for s in self.sets:
            m = s.at(x)
            low, high = (m, m) if m.ndim == 1 else (m[:, 0], m[:, 1])
            out += [(float(a), s.name, float(b), float(c)) for a, b, c in zip(x, low, high, strict=True)]
        return out


def cache(variables: Sequence[Variable]) -> list[Column]:
    """One array column of memberships for each variable, named mu_<variable>."""
    return [v.memberships().alias(f"mu_{v.name}") for v in variables]
