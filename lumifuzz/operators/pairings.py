"""A permutation test of paired memberships over all rows, whatever their number.

The statistic is that of two neighbouring sets: the mean distance of a row's two memberships over the root of the product of their variances. Under the null
hypothesis all memberships of both sets are dealt anew to the two sides of the rows. Each such deal is drawn over all rows, without moving any:

Memberships are counted by value and cut, in ascending order, into buckets of values, a value that many rows have being one of its own. How many members of a bucket
lie on either side, and face a lower bucket, a higher one or their own, is drawn on the driver from the sizes of the buckets alone, bucket by bucket (hypergeometric
numbers, for all deals at once). A member that faces a higher bucket counts against its value in the sum of distances, one that faces a lower one for it, and only pairs inside a bucket
have to be told apart. So these numbers and the ends of the buckets bound the statistic of a deal. Where the bounds leave open whether it is above that of the rows, the rest of the deal is drawn: which
members they are is independent from bucket to bucket, and a task shuffles the members of its bucket for each such deal. So the deals have exactly the distribution of permutations of all memberships, no task holds more than a bucket and the driver no values but those of single-valued buckets.

Pairs of sets have less than 500 million rows, the limit of numpy's hypergeometric numbers; more raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.sources import shared

#: Members of a bucket at least, where there are as many, and buckets of a pair, about; a value of an eighth of a bucket is one of its own.
MEMBERS, BUCKETS, SHARE = 1000, 400, 8


def _roles(sizes: Sequence[int], n: int, deals: int, draw: np.random.Generator) -> np.ndarray:
    """(buckets, 5, deals): members on the left and right that face a lower bucket, pairs inside, members on the left and right that face a higher one, where n pairs are dealt."""
    out = np.zeros((len(sizes), 5, deals), np.int64)
    # pairs with a lower member on the left only, on the right only, and with none
    left, right, empty = np.zeros(deals, np.int64), np.zeros(deals, np.int64), np.full(deals, n)
    for one, size in zip(out, sizes, strict=True):
        one[1] = draw.hypergeometric(left, right + 2 * empty, size)
        one[0] = draw.hypergeometric(right, 2 * empty, size - one[1])
        rest = size - one[0] - one[1]
        on_left = draw.hypergeometric(empty, empty, rest)
        on_right = rest - on_left
        one[2] = draw.hypergeometric(on_left, empty - on_left, on_right)
        one[3], one[4] = on_left - one[2], on_right - one[2]
        left, right, empty = left - one[1] + one[3], right - one[0] + one[4], empty - rest + one[2]
    return out


def _bucketed(members: int):
    """Numbers the buckets of sorted (pair, v, n): a new one for a pair, for a value of many rows, after that value, and after so many members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket, last, total = TaskContext.get().partitionId() << 40, (-1, False, 0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, n = batch.column("pair").to_numpy(), batch.column("n").to_numpy()
            many, part = n * SHARE >= members, (total + np.cumsum(n)) // members
            before = [np.r_[x, own[:-1]] for x, own in zip(last, (pair, many, part), strict=True)]
            numbers = bucket + np.cumsum((pair != before[0]) | many | (before[1] != 0) | (part != before[2]))
            last, bucket, total = (pair[-1], many[-1], part[-1]), int(numbers[-1]), total + int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["pair", "v", "n", "bucket"])

    return run


def _dealt(values: np.ndarray, counts: np.ndarray, roles: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """(3, deals): what the members of a bucket add to the sum of distances, to the left side's sum and to its sum of squares."""
    held = np.repeat(values, counts)
    out = np.empty((3, roles.shape[1]))
    for k, (low_left, low_right, inside, high_left, high_right) in enumerate(roles.T.tolist()):
        draw.shuffle(held)
        # left: facing a lower bucket, a higher one, their own; then right: their own, a higher one, a lower one
        a, b = low_left, low_left + high_left
        c = b + inside
        d, e = c + inside, c + inside + high_right
        left = held[:c]
        out[0, k] = held[:a].sum() - held[a:b].sum() + np.abs(held[b:c] - held[c:d]).sum() - held[d:e].sum() + held[e:].sum()
        out[1, k], out[2, k] = left.sum(), left @ left
    return out


def _squares(n: int, s, ss, squares: float):
    """Centred sum of squares; what is left by rounding is nothing."""
    out = ss - s * s / n
    return np.where(out <= 1e-13 * squares, 0.0, out)


def _statistic(n: int, distance, left, left_squares, whole: float, squares: float):
    """Mean distance over the root of the product of variances, from sums over memberships less their mean: of the left side, and of both (whole, squares)."""
    return distance / n / (np.sqrt(_squares(n, left, left_squares, squares) * _squares(n, whole - left, squares - left_squares, squares)) / (n - 1) + 1e-10)


def _bounds(n: int, least: np.ndarray, most: np.ndarray, whole: float, squares: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest statistic for sums (distance, left, left_squares) between these."""
    sides = []
    for (s0, s1), (q0, q1) in (((least[1], most[1]), (least[2], most[2])), ((whole - most[1], whole - least[1]), (squares - most[2], squares - least[2]))):
        near, far = np.where((s0 < 0) & (s1 > 0), 0.0, np.minimum(abs(s0), abs(s1))), np.maximum(abs(s0), abs(s1))
        sides.append((_squares(n, far, q0, squares), _squares(n, near, q1, squares)))
    (a0, a1), (b0, b1) = sides
    return np.maximum(least[0], 0) / n / (np.sqrt(a1 * b1) / (n - 1) + 1e-10), most[0] / n / (np.sqrt(a0 * b0) / (n - 1) + 1e-10)


def p_values(counted: DataFrame, pairs: Sequence[tuple[int, int]], permutations: int = 1000, seed: int = 33) -> list[float]:
    """The two-sided p-value of each pair (i, j), sets j and j + 1 of variable i. counted: i, the memberships m0, m1, ... and n, the number of rows that have them."""
    if not pairs:
        return []
    spark, w = counted.sparkSession, F.col("n").cast("double")
    own = lambda i, j, x: F.sum(F.when(F.col("i") == i, x))
    sides = {(i, j): (F.col(f"m{j}"), F.col(f"m{j + 1}")) for i, j in pairs}
    row = counted.agg(*(x for k, (i, j) in enumerate(pairs) for x in (own(i, j, F.col("n")).alias(f"n{k}"), own(i, j, w * (sides[i, j][0] + sides[i, j][1])).alias(f"s{k}")))).first()
    sizes = [int(row[f"n{k}"] or 0) for k in range(len(pairs))]
    if min(sizes) < 2:
        raise ValueError("a permutation test needs two rows")
    centres = [row[f"s{k}"] / (2 * n) for k, n in enumerate(sizes)]
    sums = []
    for k, (i, j) in enumerate(pairs):
        a, b = (m - F.lit(centres[k]) for m in sides[i, j])
        sums += [own(i, j, w * x).alias(f"{name}{k}") for name, x in (("d", F.abs(a - b)), ("l", a), ("ll", a * a), ("r", b), ("rr", b * b))]
    seen = counted.agg(*sums).first()
    both = [(seen[f"l{k}"] + seen[f"r{k}"], seen[f"ll{k}"] + seen[f"rr{k}"]) for k in range(len(pairs))]
    of_rows = [(one := float(_statistic(n, seen[f"d{k}"], seen[f"l{k}"], seen[f"ll{k}"], *both[k])), 1e-9 * abs(one)) for k, n in enumerate(sizes)]

    members = max(MEMBERS, 2 * max(sizes) // BUCKETS)
    each = F.array(*(F.struct(F.lit(k).alias("pair"), F.when(F.col("i") == i, m).alias("v")) for k, (i, j) in enumerate(pairs) for m in sides[i, j]))
    pool = counted.select(F.explode(each).alias("c"), "n").where("c.v is not null").groupBy("c.pair", "c.v").agg(F.sum("n").alias("n"))
    dealt = pool.repartitionByRange(shared.partitions(spark), "pair", "v").sortWithinPartitions("pair", "v")
    buckets = shared.cut(dealt.mapInArrow(_bucketed(members), "pair int, v double, n long, bucket long"), "membership-buckets")
    found = buckets.groupBy("pair", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("least"), F.max("v").alias("most")).collect()  # some BUCKETS of each pair
    total, open_deals = np.zeros((len(pairs), 3, permutations)), {}
    low, high = np.zeros(len(pairs), int), np.zeros(len(pairs), int)
    asked: dict[tuple[int, int], np.ndarray] = {}
    for k, n in enumerate(sizes):
        mine = sorted((r for r in found if r["pair"] == k), key=lambda r: r["least"])
        dealt_out = _roles([r["n"] for r in mine], n, permutations, np.random.default_rng([seed, k]))
        least, most = np.zeros((2, 3, permutations))
        for r, roles in zip(mine, dealt_out, strict=True):
            a, b, left = r["least"] - centres[k], r["most"] - centres[k], roles[0] + roles[2] + roles[3]
            below, above, inside = roles[0] + roles[1], roles[3] + roles[4], roles[2]
            least += np.stack([a * below - b * above, a * left, (0.0 if a < 0 < b else min(a * a, b * b)) * left])
            most += np.stack([b * below - a * above + (b - a) * inside, b * left, max(a * a, b * b) * left])
            if r["values"] == 1:
                total[k] += np.stack([a * (below - above), a * left, a * a * left])
        one, near = of_rows[k]
        bound = _bounds(n, least, most, *both[k])
        under, over = bound[1] * (1 + 1e-9) < one - near, bound[0] * (1 - 1e-9) > one + near
        low[k], high[k] = under.sum(), over.sum()
        open_deals[k] = np.flatnonzero(~(under | over))
        if len(open_deals[k]):
            asked |= {(k, r["bucket"]): roles[:, open_deals[k]].astype(np.int32) for r, roles in zip(mine, dealt_out, strict=True) if r["values"] > 1}

    def deal(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, bucket = map(int, key)
        if (k, bucket) not in asked:
            return pd.DataFrame({"pair": [], "deal": [], "d": [], "l": [], "ll": []})
        # the same members in the same order, wherever the task runs
        part = part.sort_values("v")
        d, left, squares = _dealt(part["v"].to_numpy() - centres[k], part["n"].to_numpy(), asked[k, bucket], np.random.default_rng([seed, k, bucket]))
        return pd.DataFrame({"pair": k, "deal": open_deals[k], "d": d, "l": left, "ll": squares})

    if asked:
        by = buckets.repartition(shared.partitions(spark), "pair", "bucket").groupBy("pair", "bucket").applyInPandas(deal, "pair int, deal int, d double, l double, ll double")
        for r in by.groupBy("pair", "deal").agg(*(F.sum(c).alias(c) for c in ("d", "l", "ll"))).collect():  # pairs x deals
            total[r["pair"], :, r["deal"]] += r["d"], r["l"], r["ll"]
    shared.drop(buckets)

    out = []
    for k, (n, (one, near)) in enumerate(zip(sizes, of_rows, strict=True)):
        null = _statistic(n, *total[k][:, open_deals[k]], *both[k])
        ends = low[k] + (null <= one + near).sum(), high[k] + (null >= one - near).sum()
        out.append(float(min(1.0, 2 * (min(ends) + 1) / (permutations + 1))))
    return out
