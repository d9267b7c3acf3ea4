"""Column expressions for intervals of regular-expression matches, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: Column | str, group: Column | int = 0) -> Column:
    """array<struct<start, end, size>>: the leftmost non-overlapping matches (never empty ones) in code points, end exclusive, and the length of a group in each. What lies between the matches gives their places; a text without a match is read once."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    group = F.lit(group) if isinstance(group, int) else group
    none = F.array().cast("array<struct<start:int,end:int,size:int>>")

    def place(x: Column) -> Column:
        sized = F.transform(x["hits"], lambda h, i: F.struct(F.length(F.get(x["gaps"], i)).alias("gap"), F.length(h).alias("n"), F.length(F.get(x["parts"], i)).alias("size")))

        def add(acc: Column, s: Column) -> Column:
            start = acc["pos"] + s["gap"]
            end = start + s["n"]
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["size"].alias("size")))).alias("out"))

        return F.aggregate(sized, F.struct(F.lit(0).alias("pos"), none.alias("out")), add, lambda acc: acc["out"])

    def some(hits: Column) -> Column:
        parts = F.when(group == 0, hits).otherwise(F.regexp_extract_all(text, pattern, group))
        return let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"), parts.alias("parts")), place)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(some(hits)))
