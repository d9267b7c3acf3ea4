"""Centroids and type reduction, on small grids and on the firing intervals of one row."""

from __future__ import annotations

import numpy as np

from lumifuzz.functions.membership import FuzzySet


def center(z: np.ndarray, w: np.ndarray) -> float:
    """The mean of z weighted by w; NaN where the weights are all 0."""
    n = float(np.sum(w))
    return float(np.dot(z, w)) / n if n else float("nan")


def grid(s: FuzzySet, step: float) -> np.ndarray:
    low, high = s.domain or (0.0, 1.0)
    return np.arange(low, high, step)


def set_centroid(s: FuzzySet, step: float = 0.001) -> float:
    z = grid(s, step)
    m = s.at(z)
    return center(z, m if m.ndim == 1 else m.mean(axis=1))


def _settle(z: np.ndarray, w: np.ndarray, weights_for) -> float:
    """Repeats: weights from the present centre, centre from the weights, until a centre returns."""
    now, seen = center(z, w), set()
    while now not in seen and not np.isnan(now):
        seen.add(now)
        now = center(z, weights_for(now))
    return now


def centroid_ends(z: np.ndarray, memberships: np.ndarray) -> tuple[float, float]:
    """Left and right end of the centroid of an interval set sampled at ascending z (memberships: lower, upper): the upper function counts left of the switch point for the left end, and right of it for the right end."""
    low, high = memberships[:, 0], memberships[:, 1]
    middle = memberships.mean(axis=1)
    left = _settle(z, middle, lambda y: np.where(z < y, high, low))
    right = _settle(z, middle, lambda y: np.where(z > y, high, low))
    return left, right


def interval_centroid(s: FuzzySet, step: float = 0.001) -> tuple[float, float]:
    z = grid(s, step)
    m = s.at(z)
    return centroid_ends(z, m if m.ndim == 2 else np.stack([m, m], axis=1))


#: Values that differ by less are the same.
SAME = 1e-9


def _reduce(firing: np.ndarray, centroids: np.ndarray, first: int) -> np.ndarray:
    """The switch search over rules in their given order, for all rows at once (firing: rows, rules, 2): up to and with the last rule whose centroid is not above the present value, column `first` of the firing intervals counts, after it the other one. Without any weight the value is 0. A row ends when a value returns (values may alternate for ever): switch points whose values were passed are marked."""
    rows, n, _ = firing.shape
    middle = firing.mean(axis=2)
    total = middle.sum(axis=1)
    now = np.divide(middle @ centroids, total, out=np.full(rows, np.nan), where=total != 0)
    inner, outer = firing[:, :, first], firing[:, :, 1 - first]

    def switched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        after = np.cumsum(b[:, ::-1], axis=1)[:, ::-1]
        return np.cumsum(a, axis=1) + np.hstack([after[:, 1:], np.zeros((rows, 1))])

    weight = switched(inner, outer)
    value = np.divide(switched(inner * centroids, outer * centroids), weight, out=np.zeros((rows, n)), where=weight != 0)
    open_ = np.flatnonzero(~np.isnan(now))
    passed = np.abs(value - now[:, None]) <= SAME
    while len(open_):
        # equal up to rounding is not above: where one consequent fires alone, the value is its centroid but for the last digits
        not_above = centroids[None, :] <= now[open_, None] + SAME
        k = np.where(not_above.any(axis=1), n - 1 - not_above[:, ::-1].argmax(axis=1), 0)
        ended, now[open_] = passed[open_, k], value[open_, k]
        passed[open_] |= np.abs(value[open_] - now[open_, None]) <= SAME
        open_ = open_[~ended]
    return now


def consequent_centroids(firing: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Type-reduced ends of rows: firing (rows, rules, 2) and the consequents' centroids (rules, 2). Nothing fires: 0, 0."""
    silent = ~firing.any(axis=(1, 2))
    low, high = _reduce(firing, centroids[:, 0], 1), _reduce(firing, centroids[:, 1], 0)
    low[silent] = high[silent] = 0.0
    return low, high


def consequent_centroid(firing: np.ndarray, centroids: np.ndarray) -> tuple[float, float]:
    """The same for one row: firing (rules, 2)."""
    low, high = consequent_centroids(firing[None], centroids)
    return float(low[0]), float(high[0])
