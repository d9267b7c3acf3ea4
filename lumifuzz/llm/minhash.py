"""Near duplicates by exact similarity of word shingles, with MinHash bands as the candidate search.

A node is a distinct sequence of lower-cased words. Two nodes are linked if the Jaccard similarity of their sets of shingles is at least
SIMILAR, counted exactly. Only nodes that share one of BANDS cells (a hash of ROWS minima each) are compared: a pair of similarity s
shares none with probability (1 - s ** ROWS) ** BANDS, 3e-5 at 0.8. The links join exactly what the links of all pairs of every cell
join, though few of the pairs are made:

- each member of a cell is compared with the cell's least member, each pair of nodes once whatever number of cells it shares;
- a cell whose members are now in one component is settled: whatever its other pairs are, they join nothing. Cells of two are settled anyway;
- in the others, the members outside the cell's largest component are compared with all members that are not in their own component and not of a
  size that no similar set has. Both sides are dealt to blocks of about BLOCK shingles, and each pair of blocks is a task of its own.

So no task holds more than two blocks, and a crowd of copies costs one comparison for each member.

Null texts count as empty; texts without a word are one node; texts of fewer words than a shingle are one shingle. Keys may be null or
repeat, on equal or on different texts; a null key never becomes a component id unless all keys of its component are null. Other
columns play no part in links; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from lumifuzz.llm import common, simhash
from lumifuzz.llm.simhash import components

SEED = 42
SHINGLE = 5
BANDS, ROWS = 20, 4
#: Least similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Shingles of a block of a cell's members, and the least members that a block is made for.
BLOCK, MEMBERS = 500_000, 8
_ODD = np.random.default_rng(20240305).integers(1 << 62, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
#: Shingles that are taken through the bands at once.
_AT_ONCE = 200_000


def shingles(text: str, n: int = SHINGLE) -> tuple[int, np.ndarray]:
    """Digest of a text's words and its sorted distinct shingles of n words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    whole = xxh64_intdigest(b" ".join(words), SEED)
    if len(words) <= n:
        return whole, np.array([whole] if words else [], np.uint64)
    return whole, np.unique(np.array([xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))], np.uint64))


def _cells(sets: list[np.ndarray]) -> np.ndarray:
    """The cells of each set that is not empty, as rows."""
    every = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        cell = np.full(len(sets), b + 1, np.uint64) * _ODD[b, ROWS]
        for r in range(ROWS):
            cell = (cell ^ np.minimum.reduceat(every * _ODD[b, r], starts)) * _ODD[b, ROWS]
            cell ^= cell >> np.uint64(29)
        out[:, b] = cell
    return out


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, and what gives the cells of sets (as rows) that candidates share."""

    shingle: int = SHINGLE
    cells: Callable[[list[np.ndarray]], np.ndarray] = _cells


FIVE_WORDS = Scheme()


def _marks(texts: list[str], scheme: Scheme) -> list[pa.Array]:
    """Node, number of shingles and cells of each text."""
    common.release()
    nodes, sizes = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    cells: list[list[int]] = [[] for _ in texts]
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        nodes[i], found = shingles(t, scheme.shingle)
        sizes[i] = len(found)
        if len(found):
            waiting.append((i, found))
            size += len(found)
        if waiting and (size > _AT_ONCE or i + 1 == len(texts)):
            for (at, _), row in zip(waiting, scheme.cells([s for _, s in waiting]).view(np.int64).tolist(), strict=True):
                cells[at] = row
            waiting, size = [], 0
    return [pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(cells, pa.list_(pa.int64()))]


def _sets(n: int) -> Callable[[list[str]], dict[str, pa.Array]]:
    return lambda texts: {"shingles": pa.array([shingles(t, n)[1].view(np.int64) for t in texts], pa.list_(pa.int64()))}


def similar(shared, one, other):
    """Whether sets of so many members, of which they share so many, are similar enough; for numbers, arrays and columns."""
    low, high = SIMILAR
    return shared * (low + high) >= (one + other) * low


class _Members:
    """An inverted index of some sets, to find those that are similar to another."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def like(self, one: np.ndarray) -> np.ndarray:
        """Which members are similar to a set."""
        low = np.searchsorted(self.every, one, "left")
        n = np.searchsorted(self.every, one, "right") - low
        held = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return similar(np.bincount(self.owner[held], minlength=len(self.sizes)), len(one), self.sizes)


def _links(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _lists(part: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x.values).view(np.uint64) for x in part.column("shingles").combine_chunks()]


def _search_between(pair: pa.Table) -> pa.Table:
    """Links of a block of apart members (those outside the cell's largest component) with a block of members of other components; of several from one member into one component, one. Where a cell is one block, its members come once, for both sides."""
    apart = pair.filter(pair.column("apart"))
    rest = pair if pair.num_rows and pair.column("whole")[0].as_py() else pair.filter(pc.invert(pair.column("apart")))
    a, b = [], []
    if apart.num_rows and rest.num_rows:
        members, ids, roots = _Members(_lists(rest)), rest.column("node").to_numpy(), rest.column("root").to_numpy()
        for node, root, own in zip(apart.column("node").to_pylist(), apart.column("root").to_pylist(), _lists(apart), strict=True):
            near = np.flatnonzero((roots != root) & members.like(own))
            near = near[np.unique(roots[near], return_index=True)[1]]
            a += [node] * len(near)
            b += ids[near].tolist()
    return _links(a, b)


def _blocks(size, n):
    """How many blocks a cell's members are dealt to."""
    return F.greatest(F.lit(1), F.ceil(F.least(size / BLOCK, n / MEMBERS))).cast("long")


def _open(members: DataFrame, found: DataFrame, cut, made: list[DataFrame]) -> DataFrame:
    """The members of cells that are not settled by the links found: cell, node, root, apart, size, and both sides' numbers of blocks."""
    placed = members.where("n > 2").join(components(found, made), "node", "left").select("cell", "node", "size", F.coalesce("root", "node").alias("root"))
    placed = cut(placed, "minhash-placed")
    # a row for each component in a cell, then one for each cell
    sized = placed.groupBy("cell", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("size").alias("least"), F.max("size").alias("most"))
    top = sized.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).where("top.n < all").select("cell", F.col("top.root").alias("main"), F.col("all"))
    beside = sized.join(top, "cell").groupBy("cell", "main", "all").agg(
        F.sum("size").alias("size_all"), *(F.expr(f"{f}(case when root <> main then {x} end)").alias(f"{x}_apart") for f, x in (("sum", "n"), ("sum", "size"), ("min", "least"), ("max", "most")))
    )
    asked = beside.select("cell", "main", _blocks(F.col("size_all"), F.col("all")).alias("blocks"), _blocks(F.col("size_apart"), F.col("n_apart")).alias("parts"), "least_apart", "most_apart")
    low, high = SIMILAR
    fits = (F.col("size") * high >= F.col("least_apart") * low) & (F.col("most_apart") * high >= F.col("size") * low)
    return cut(placed.join(asked, "cell").withColumn("apart", F.col("root") != F.col("main")).where(F.col("apart") | fits).drop("main", "least_apart", "most_apart"), "minhash-open")


def _between(open_: DataFrame, sets: DataFrame) -> DataFrame:
    names = ["cell", "node", "root", "apart", "whole", "part", "block"]

    def dealt(own: str, other: str, own_n: str, other_n: str, apart: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("node", F.lit(own)), F.col(own_n)).alias(own)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)).alias(other)
        some = open_.where("parts * blocks > 1" + (" and apart" if apart else ""))
        return some.select("cell", "node", "root", F.lit(apart).alias("apart"), F.lit(False).alias("whole"), mine, each).select(names)

    one = open_.where("parts * blocks = 1").select("cell", "node", "root", "apart", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("block"))
    both = one.unionByName(dealt("part", "block", "parts", "blocks", True)).unionByName(dealt("block", "part", "blocks", "parts", False))
    return both.join(sets, "node").groupBy("cell", "part", "block").applyInArrow(_search_between, "a long, b long")


def links(marked: DataFrame, made: list[DataFrame], shingle: int = SHINGLE, more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join exactly the nodes that are similar and share a cell; marked: node, size, cells, words; more: node and cell of further cells. made: gets the written tables that the links are read from."""

    def cut(df: DataFrame, name: str) -> DataFrame:
        made.append(common.cut(df, name))
        return made[-1]

    nodes = cut(marked.groupBy("node").agg(F.min("size").alias("size"), F.min("cells").alias("cells")), "minhash-distinct")
    gridded = nodes.select("node", "size", F.explode("cells").alias("cell"))
    if more is not None:
        gridded = gridded.unionByName(nodes.where("size > 0").join(more, "node").select("node", "size", "cell"))
    # cells of the same members are one: told by their number, least member and two digests
    digest = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor("node").alias("y")]
    shared = gridded.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("a"), *digest).where("n > 1")
    shared = cut(shared.groupBy("n", "a", "x", "y").agg(F.min("cell").alias("cell")).select("cell", "n", "a"), "minhash-cells")
    members = cut(common.filtered(gridded, shared.select("cell"), "cell", "left_semi").join(shared, "cell"), "minhash-members")
    # sets of sizes that no similar sets have are not compared
    pairs = members.where("node <> a").select("a", F.col("node").alias("b"), F.col("size").alias("size_b")).distinct()
    low, high = SIMILAR
    sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a")
    star = cut(sized.where(F.least("size_a", "size_b") * high >= F.greatest("size_a", "size_b") * low).select("a", "b"), "minhash-pairs")
    needed = star.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.where("n > 2").select("node"))
    needed = cut(needed.distinct(), "minhash-needed")
    texts = common.filtered(marked.select("node", "words"), needed, "node", "left_semi").groupBy("node").agg(F.max("words").alias("words"))
    sets = cut(common.map_texts(texts, _sets(shingle), "shingles array<long>", "node", "words"), "minhash-sets")
    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    alike = star.join(one, "a").join(other, "b").where(similar(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b")
    found = cut(alike, "minhash-links")
    open_ = _open(members, found, cut, made)
    return found if open_.isEmpty() else found.unionByName(_between(open_, sets))


def _roots(marked: DataFrame, shingle: int = SHINGLE, more: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """node and root, and the written tables that they are read from."""
    made: list[DataFrame] = []
    held: list[DataFrame] = []
    out = components(links(marked, made, shingle, more), held)
    common.drop(*made)
    return out, held


def marked(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), words: bool = True, scheme: Scheme = FIVE_WORDS, prints: bool = False) -> DataFrame:
    """keep (columns of docs), and node, size and cells of each text, with the text as words and its SimHash fingerprint as fp where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch, "_words"):
                more = ({"words": pa.array(texts, pa.string())} if words else {}) | ({"fp": simhash.prints(texts)} if prints else {})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *_marks(texts, scheme), *more.values()], [*keep, "node", "size", "cells", *more])

    kind = StructType([docs.schema[c] for c in keep]).add("node", "long").add("size", "long").add("cells", ArrayType(LongType()))
    kind = kind.add("words", "string") if words else kind
    return docs.select(*keep, F.col(text).alias("_words")).mapInArrow(run, kind.add("fp", "long") if prints else kind)


def grouped(docs: DataFrame, key: str, text: str, scheme: Scheme) -> DataFrame:
    """_key, size (number of shingles) and component_id (the smallest key reachable over links) of each row; equal sequences of words are one node, the empty one as well."""
    made = common.cut(marked(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_text", ("_key",), scheme=scheme), "minhash-nodes")
    roots, held = _roots(made, scheme.shingle)
    nodes = made.groupBy("node").agg(F.min("_key").alias("least"), F.count("*").alias("n")).withColumnRenamed("node", "own")
    rooted = nodes.join(roots, nodes["own"] == roots["node"], "left").select("own", "least", "n", F.coalesce("root", "own").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.cut(rooted.join(component, "root").select(F.col("own").alias("node"), "n", "component_id"), "minhash-named")
    common.drop(*held)
    return common.reads(common.join_counted(made.select("_key", "node", "size"), named, "node").select("_key", "size", "component_id"), made, named)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and component_id (the smallest key reachable over links)."""
    found = grouped(docs, key, text, FIVE_WORDS)
    return common.reads(found.select(F.col("_key").alias(key), "component_id"), *found._lumifuzz_reads)


def near_prints(made: DataFrame) -> DataFrame:
    """node and cell, written, for each node (with its fingerprint fp) in a SimHash component of several nodes: fingerprints that reach each other over links of at most 2 bits, as the grid of `simhash` finds them."""
    once = common.cut(made.groupBy("node").agg(F.min("fp").alias("fp")), "minhash-prints")
    nodes = common.cut(once.groupBy("fp").agg(F.count("*").alias("n")), "minhash-fingerprints")
    found: list[DataFrame] = []
    linked: list[DataFrame] = []
    roots = components(simhash.links(nodes, linked), found)
    common.drop(*linked)
    # equal fingerprints of different texts are near, too; what is linked with a shared neighbour alone falls away here
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
    several = grouped.groupBy("root").agg(F.sum("n").alias("all")).where("all > 1").select("root")
    out = common.cut(once.join(grouped.join(several, "root").select("fp", "root"), "fp").select("node", F.xxhash64(F.lit("simhash"), "root").alias("cell")), "minhash-near")
    common.drop(once, nodes, *found)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component, candidates being the members of a SimHash component (`near_prints`) as well as those of a MinHash cell: the row with the least key (null keys last); of several rows with that key, the one with the least digest of all its columns. So every distinct text has a row linked to it that stays, whatever the keys are."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    hashable = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    numbered = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.xxhash64(*(F.col(f"`{c}`") for c in hashable)).alias("_digest"), F.struct(*names).alias("_whole"))
    # the number of a row is made once, and written with it
    made = marked(numbered, "_text", ("_key", "_digest", "_whole"), words=False, prints=True).withColumn("_row", F.monotonically_increasing_id())
    made = common.cut(made, "minhash-rows")
    near = near_prints(made)
    roots, held = _roots(made.select("node", "size", "cells", F.coalesce(F.col("_whole")[text], F.lit("")).alias("words")), more=near)
    common.drop(near)
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "_digest", "_row")
    # first within each text, so that a text with a third of all rows is one row from each task
    least = made.groupBy("node").agg(F.min(order).alias("least")).withColumnRenamed("node", "own")
    grouped = least.join(roots, least["own"] == roots["node"], "left").select("least", F.coalesce("root", "own").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row"))
    gone = common.cut(made.select("_row").join(kept, "_row", "left_anti"), "minhash-gone")
    common.drop(*held)
    return common.reads(common.filtered(made.select("_row", "_whole"), gone, "_row", "left_anti").select("_whole.*"), made, gone)
