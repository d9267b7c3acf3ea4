"""Whitening of embeddings: a covariance that keeps every digit, its eigenvectors, and each row's coordinates along them.

Entries become whole numbers x = floor(64 * c) + 1000000. The fit list is every distinct x vector once, written to the shared folder. Over it run

1. exact sums: each task adds the upper and lower 32 bits of its entries as longs, Spark adds these as decimals; so n and S are exact, and the mean S / n is
   known as an unevaluated sum of two doubles;
2. the covariance. x - S / n is an unevaluated pair of doubles (an error-free difference, less the mean's low part). Each block of ROWS centred vectors is
   cut into slices of BITS bits, so that the products of two slices, added up over the block, fit into a double: their matrix products have no
   rounding error at all. The exact block products are added to a running matrix of pairs (high, low) by error-free sums, and the pairs of
   all tasks are merged by the same sums, first in groups of MERGED tasks, then altogether. What lies under the last slice, 66 bits below a block's largest
   entry, is all that is lost;
3. on the driver, which holds dimension ** 2 pairs and nothing that grows with the rows: reduction to a tridiagonal matrix and its divide-and-conquer
   eigen-solve (LAPACK's syevd), then first-order corrections from residuals that are taken from the pairs by the same exact products, so that
   small eigenvalues beside large ones come out as well;
4. one more pass over the fit list, which measures the covariance of the whitened vectors against the identity.

Every row is then projected where it lies; nothing but the fit list is shuffled.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are entries that no long can hold (64 * c beyond 2 ** 62), and vectors
without entries. Where lengths differ, those of the length that most rows have are used (of several, the longest) and the others dropped.
Repeated rows and repeated or null ids each give their own result rows. Components whose eigenvalue is nothing but rounding (at most dimension * 2 ** -52 of the largest) have no unit variance to
scale to and are left out: a fit list of one vector, or of equal entries everywhere, gives no rows. Other columns play no part; an empty table gives an empty
result. A deviation beyond a long raises an OverflowError rather than a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Vectors of a block, and the bits and number of its slices: 2 * BITS + log2(ROWS) + 1 <= 53.
ROWS, BITS, SLICES = 256, 22, 3
#: Tasks whose matrices are merged together first, and cells of a matrix that travel as one row.
MERGED, CELLS = 64, 4096
_MOST = 2.0**62


def two_sum(a, b):
    """a + b as an unevaluated sum of the rounded result and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b as an unevaluated sum of the rounded result and its error."""
    p = a * b
    c, d = a * 134217729.0, b * 134217729.0
    a1, b1 = c - (c - a), d - (d - b)
    return p, ((a1 * b1 - p) + a1 * (b - b1) + (a - a1) * b1) + (a - a1) * (b - b1)


def add_pairs(high, low, more_high, more_low):
    """The sum of two unevaluated sums, as one."""
    s, e = two_sum(high, more_high)
    t, f = two_sum(low, more_low)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _vectors(batch: pa.RecordBatch, size: int, column: str = "x") -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, size)


def _pair(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


@dataclass(frozen=True)
class Moments:
    """Size of the fit list, exact sums by dimension, and the mean as pairs of doubles."""

    n: int
    sums: tuple[int, ...]

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [_pair(Fraction(s, self.n)) for s in self.sums]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


@dataclass(frozen=True)
class Model:
    """What whitens a row: moments, components as columns, their eigenvalues, the trace, and how far the whitened covariance is from the identity."""

    moments: Moments
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def _centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean, as pairs. Longs beyond 2 ** 53 keep their lower bits in a double of their own."""
    top = x.astype(np.float64)
    rest = (x - top.astype(np.int64)).astype(np.float64)
    high, low = two_sum(top, -mean[0])
    return two_sum(high, low + (rest - mean[1]))


def _sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices of BITS bits that add up to high + low but for what lies under the last; each dimension has its own scale."""
    out = []
    most = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, (np.frexp(np.where(most > 0, most, 1.0))[1] - BITS).astype(np.int64))
    for _ in range(SLICES):
        cut = np.rint(high / unit) * unit
        out.append(cut)
        high, low = two_sum(high - cut, low)
        unit = np.ldexp(unit, -BITS)
    return out


def block_product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of a block's rows on the left with those on the right (or the same), as pairs. Every matrix product here is exact."""
    s = _sliced(*left)
    t = s if right is None else _sliced(*right)
    total = s[0].T @ t[0]
    rest = np.zeros_like(total)
    for i, j in ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (1, 2), (2, 1)):
        part = part.T if right is None and i > j else s[i].T @ t[j]  # noqa: F821
        total, rest = add_pairs(total, rest, part, 0.0)
    return total, rest


def _products(size: int, mean: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            x = _vectors(batch, size)
            for at in range(0, len(x), ROWS):
                total, rest = add_pairs(total, rest, *block_product(_centred(x[at : at + ROWS], mean)))
        yield _cells(total[np.triu_indices(size)], rest[np.triu_indices(size)])

    return run


def _cells(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    starts = range(0, len(high), CELLS)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts))), *(pa.array([x[i : i + CELLS].tobytes() for i in starts], pa.binary()) for x in (high, low))], ["block", "high", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: the error-free sum of its rows."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, high, low in zip(*(batch.column(c).to_pylist() for c in ("block", "high", "low")), strict=True):
            own = np.frombuffer(high), np.frombuffer(low)
            sums[block] = add_pairs(*sums[block], *own) if block in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), *(pa.array([p[i].tobytes() for p in sums.values()], pa.binary()) for i in (0, 1))], ["block", "high", "low"])


def _merged(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all tasks of what _cells made of their matrices, as flat pairs."""
    n = common.partitions(made.sparkSession)
    few = made.withColumn("_group", F.floor(F.spark_partition_id() / MERGED)).repartition(n, "block", "_group").select(made.columns).mapInArrow(_merge, made.schema)
    rows = sorted(few.repartition(n, "block").mapInArrow(_merge, made.schema).collect(), key=lambda r: r["block"])  # as many cells as one task has
    return tuple(np.concatenate([np.frombuffer(r[c]) for r in rows]) for c in ("high", "low"))


def clean(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """_key and x of the rows that take part, whatever their length."""
    scaled = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * SCALE)
    # a null, a NaN and what a long cannot hold all fail this comparison
    sound = F.forall("_scaled", lambda c: F.coalesce((c > -_MOST) & (c < _MOST), F.lit(False)))
    whole = rows.select(F.col(f"`{key}`").alias("_key"), scaled.alias("_scaled")).where(F.col("_scaled").isNotNull() & (F.size("_scaled") > 0) & sound)
    return whole.select("_key", F.transform("_scaled", lambda c: F.floor(c).cast("long") + OFFSET).alias("x"))


def _moments(listed: DataFrame, size: int) -> Moments:
    """Exact, by the upper and the lower half of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, lower, n = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            x = _vectors(batch, size)
            upper, lower, n = upper + (x >> 32).sum(axis=0), lower + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(upper), pa.array(lower), pa.array(np.full(size, n))], ["dimension", "upper", "lower", "n"])

    added = listed.select("x").mapInArrow(run, "dimension long, upper long, lower long, n long").groupBy("dimension")
    found = {r["dimension"]: r for r in added.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower", "n"))).collect()}  # a row for each dimension
    return Moments(int(found[0]["n"]), tuple((int(found[d]["upper"]) << 32) + int(found[d]["lower"]) for d in range(size)))


def covariance(listed: DataFrame, moments: Moments) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of a list of vectors (column x), divisor n, as pairs of doubles."""
    size, n = len(moments.sums), float(moments.n)
    high, low = _merged(listed.select("x").mapInArrow(_products(size, moments.mean), "block long, high binary, low binary"))
    top = high / n
    product, error = two_product(top, n)
    top, under = two_sum(top, ((high - product) - error + low) / n)
    out = []
    for part in (top, under):
        square = np.zeros((size, size))
        square[np.triu_indices(size)] = part
        out.append(square + np.triu(square, 1).T)
    return out[0], out[1]


def _applied(high: np.ndarray, low: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symmetric matrix of pairs times vectors, as pairs."""
    total = rest = np.zeros_like(vectors)
    for at in range(0, len(high), ROWS):
        some = slice(at, at + ROWS)
        total, rest = add_pairs(total, rest, *block_product((high[some], low[some]), (vectors[some], np.zeros_like(vectors[some]))))
    return total, rest


def eigen(high: np.ndarray, low: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix of pairs."""
    values, vectors = np.linalg.eigh(high)
    for _ in range(2):
        applied = _applied(high, low, vectors)
        values = np.einsum("ij,ij->j", vectors, applied[0]) + np.einsum("ij,ij->j", vectors, applied[1])
        p, e = two_product(vectors, values)
        t, f = add_pairs(*applied, -p, -e)
        residual, gap = vectors.T @ (t + f), values[None, :] - values[:, None]
        # to first order, where eigenvalues are far enough apart for it; the rest is their common space's own choice
        turn = np.divide(residual, gap, out=np.zeros_like(gap), where=np.abs(gap) > 1e-12 * np.maximum(values[None, :], values[:, None]))
        vectors = vectors + vectors @ np.where(np.abs(turn) < 0.01, turn, 0.0)
        vectors = vectors / np.linalg.norm(vectors, axis=0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    sound = values > len(values) * 2.0**-52 * max(values[0], 0.0)
    return values[sound][:most], vectors[:, sound][:, :most]


def _whitened(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray], components: np.ndarray, eigenvalues: np.ndarray) -> np.ndarray:
    high, low = _centred(x, mean)
    return (high @ components + low @ components) / np.sqrt(eigenvalues)


def _identity_error(listed: DataFrame, moments: Moments, components: np.ndarray, eigenvalues: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on them."""
    size, wide, mean = len(moments.sums), len(eigenvalues), moments.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest, ones, more = np.zeros((wide, wide)), np.zeros((wide, wide)), np.zeros(wide), np.zeros(wide)
        for batch in batches:
            x = _vectors(batch, size)
            for at in range(0, len(x), ROWS):
                w = _whitened(x[at : at + ROWS], mean, components, eigenvalues)
                total, rest = add_pairs(total, rest, w.T @ w, 0.0)
                ones, more = add_pairs(ones, more, w.sum(axis=0), 0.0)
        yield _cells(np.concatenate([total.ravel(), ones]), np.concatenate([rest.ravel(), more]))

    high, low = _merged(listed.select("x").mapInArrow(run, "block long, high binary, low binary"))
    flat = (high + low) / moments.n
    # whitened vectors are centred by construction; what their mean is off by is taken out all the same
    square, mean_of = flat[: wide * wide].reshape(wide, wide), flat[wide * wide :]
    return float(np.abs(square - np.outer(mean_of, mean_of) - np.eye(wide)).max())


def fit(cleaned: DataFrame, most: int = COMPONENTS) -> Model | None:
    """The model of cleaned vectors of one length; None where no component has a variance."""
    listed = common.cut(cleaned.select("x").distinct(), "whitening-list")
    try:
        size = len((listed.first() or [[]])[0])
        if not size:
            return None
        moments = _moments(listed, size)
        high, low = covariance(listed, moments)
        eigenvalues, components = eigen(high, low, most)
        if not len(eigenvalues):
            return None
        trace = float(np.trace(high) + np.trace(low))
        return Model(moments, components, eigenvalues, trace, _identity_error(listed, moments, components, eigenvalues))
    finally:
        common.drop(listed)


def _deviations(x: np.ndarray, moments: Moments) -> list[int]:
    """Sums over dimensions of (n * x - S) ** 2; in longs where they fit, else in Python's whole numbers."""
    apart = np.abs(x.astype(np.float64) * moments.n - np.array(moments.sums, np.float64)).max(initial=0.0)
    if apart * apart * len(moments.sums) < _MOST and np.abs(x).max(initial=0) * float(moments.n) < _MOST:
        d = x * moments.n - np.array(moments.sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    out = [sum((v * moments.n - s) ** 2 for v, s in zip(row, moments.sums, strict=True)) for row in x.tolist()]
    if max(out, default=0) >> 63:
        raise OverflowError("a deviation is beyond a long")
    return out


def apply(cleaned: DataFrame, model: Model, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component."""
    moments, wide = model.moments, len(model.eigenvalues)
    size, mean = len(moments.sums), moments.mean
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _vectors(part, size)
                w = _whitened(x, mean, model.components, model.eigenvalues)
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), wide))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_key").take(each), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), rows)), pa.array(np.full(rows * wide, moments.n)),
                        pa.array(np.repeat(np.array(_deviations(x, moments), np.int64), wide)), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * wide, model.identity_error)),
                    ],
                    ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = cleaned.schema["_key"].dataType.simpleString()
    return cleaned.mapInArrow(run, f"_key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("_key", key)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each row that takes part and each of up to most components."""
    cleaned = clean(rows, key, vector)
    # a row for each length that occurs
    sizes = cleaned.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("size")).first()
    if sizes:
        cleaned = cleaned.where(F.size("x") == sizes["size"])
        model = fit(cleaned, most)
    if not sizes or model is None:
        kind = cleaned.schema["_key"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return apply(cleaned, model, key)
