"""Exact ranks of values among the points of their group, for any number of both.

Points (added up by group and value) and asked values are dealt out by ranges of (group, value), sorted, and counted through once: a task knows how many
points of a group lie before each of its asked values in its own range, and how many points its range has. The driver adds up the latter, one
number for each range and group that meet, and each row adds the number of points in the ranges before its own. A value that many rows ask for is
spread over several ranges by a hash of the row; its points stand before or after all of its rows, so it does not matter in which of these ranges
they are. Nothing is held in memory but one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.sources import shared

#: Parts that the rows of one asked value are spread over at most.
SALTS = 1024

_LOCAL = "row long, group int, n long, part long, first_group int, first_value double, first_side int, first_salt int"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each asked row the points of its group before it in this range; then a row for each group of the range, without a row number, with all its points."""
    from pyspark import TaskContext

    part, first, group, held = TaskContext.get().partitionId(), None, None, 0
    ends: list[tuple[int, int]] = []

    def out(row: pa.Array, groups: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(groups)
        fixed = [pa.array([x] * size, t) for x, t in zip((part, *first), (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([row, pa.array(groups, pa.int32()), pa.array(n, pa.int64()), *fixed], [x.split()[0] for x in _LOCAL.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        g, n = batch.column("group").to_numpy(), batch.column("n").to_numpy()
        if first is None:
            first = tuple(batch.column(c)[0].as_py() for c in ("group", "value", "side", "salt"))
            group = int(g[0])
        total = np.cumsum(n)
        starts = np.flatnonzero(np.r_[g[0] != group, g[1:] != g[:-1]])
        # what to take off: the points of the groups before; the group that goes on from the last batch keeps what it had
        base = np.full(len(g), -held)
        for s in starts.tolist():
            before = int(total[s - 1]) if s else 0
            ends.append((group, before - int(base[s - 1]) if s else held))
            base[s:], group = before, int(g[s])
        local = total - base
        held = int(local[-1])
        asked = np.flatnonzero(batch.column("row").is_valid().to_numpy(zero_copy_only=False))
        if len(asked):
            yield out(batch.column("row").take(pa.array(asked)), g[asked], local[asked])
    if first is not None:
        ends.append((group, held))
        yield out(pa.nulls(len(ends), pa.int64()), np.array([x for x, _ in ends]), np.array([x for _, x in ends]))


def rank(points: DataFrame, asked: DataFrame, inclusive: Column) -> tuple[DataFrame, DataFrame]:
    """row, group and n for each asked row: how many points of its group have a value below its own or, where inclusive (over the column group) holds, at most its own. points: group int, value double, n long (several points of one value); asked: row long, group int, value double. Values are neither null nor NaN. Also the written table that the result is read from."""
    spark = points.sparkSession
    own = points.groupBy("group", "value").agg(F.sum("n").alias("n")).select(
        "group", "value", F.when(inclusive, -1).otherwise(1).alias("side"), F.lit(0).alias("salt"), F.lit(None).cast("long").alias("row"), "n"
    )
    rows = asked.select("group", "value", F.lit(0).alias("side"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"), "row", F.lit(0).cast("long").alias("n"))
    order = ["group", "value", "side", "salt"]
    dealt = own.unionByName(rows).repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    counted = shared.cut(dealt.mapInArrow(_count, _LOCAL), "ranks-counted")
    ends = counted.where("row is null").collect()  # a row for each range and group that meet
    before: dict[int, int] = {}
    offsets = []
    for r in sorted(ends, key=lambda r: (r["first_group"], r["first_value"], r["first_side"], r["first_salt"])):
        offsets.append((r["part"], r["group"], before.get(r["group"], 0)))
        before[r["group"]] = before.get(r["group"], 0) + r["n"]
    # one short row for each of those ranges
    known = F.broadcast(spark.createDataFrame(offsets, "part long, group int, before long"))
    return counted.where("row is not null").join(known, ["part", "group"]).select("row", "group", (F.col("n") + F.col("before")).alias("n")), counted
