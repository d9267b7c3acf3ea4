"""Pieces of SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import math


def number(x: float) -> str:
    """A double literal, in parentheses if negative (a minus after a minus would start a comment)."""
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        raise ValueError("a parameter is not finite")
    text = f"{x!r}" if "e" in repr(x) else f"{x!r}e0"
    return f"({text})" if x < 0 else text


def name(column: str) -> str:
    """A plain column name; SQL keywords and signs are not for feature names here."""
    if not column.replace("_", "a").isalnum():
        raise ValueError(f"not a plain column name: {column!r}")
    return column


def text(value: object) -> str:
    """A string or number literal."""
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return number(value) if isinstance(value, float) else str(int(value))


def clean(x: str) -> str:
    """x, with NaN as null."""
    return f"nullif({x}, cast('NaN' as double))"


def clip(x: str, low: float, high: float) -> str:
    """x inside a domain; null stays null (least and greatest would skip it)."""
    return f"(case when {x} < {number(low)} then {number(low)} when {x} > {number(high)} then {number(high)} else {x} end)"


def ratio(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"({a}) / nullif({b}, 0e0)"


def total(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")" if parts else "0e0"


def greatest(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"greatest({', '.join(parts)})"


def least(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"


def first_max(parts: list[str], best: str) -> str:
    """The place of the first of parts that equals best, their maximum."""
    return "case " + " ".join(f"when {p} = {best} then {i}" for i, p in enumerate(parts)) + " end"
