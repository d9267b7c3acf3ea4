"""SimHash near-duplicates: fingerprints, a grid join on segment popcounts, and component ids.

A fingerprint of 64 bits is embedded as the popcounts of its SEGMENT_BITS-bit segments, packed in one long. The Manhattan
distance of two embeddings is never more than the Hamming distance of the fingerprints, and if it is at most 2, some grid cell is at
most 1 away from both: each distinct fingerprint is put into its own cell and those one step away (at most 65), and pairs
meet in shared cells. A cell of two is verified at once by the exact Hamming distance. The members of a fuller cell are
verified without making their pairs: two fingerprints differ in at most 2 bits exactly if some 64-bit value is at
most 1 bit from both, so they are linked through the values that at least two of them reach. Work per distinct
fingerprint is constant, however large a group of copies is; equal fingerprints are one node from the start.

Null texts count as empty; texts without a word have fingerprint zero, which is linked like any other. Equal rows give equal
rows, one for one. A null key is kept and never becomes a component id unless all keys of its component are null.
The input's other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common

SEED = 42
SEGMENT_BITS = 2
#: Distance that the grid and the shared neighbours are built for.
RADIUS = 2


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """The definition, for one text."""
    h = _hashes(text, shingle)
    n = len(h)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def _hashes(text: str, shingle: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    return [xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp: the fingerprint of each whole text as a signed long."""

    return common.map_texts(docs, lambda texts: {"fp": prints(texts, shingle)}, "fp long", key, text)


def prints(texts: list[str], shingle: int = 3) -> pa.Array:
    """The fingerprint of each text, as signed longs."""
    common.release()
    out = np.zeros(len(texts), np.uint64)
    start = 0
    hashes: list[int] = []
    sizes: list[int] = []
    for i, t in enumerate(texts):
        h = _hashes(t, shingle)
        hashes += h
        sizes.append(len(h))
        if len(hashes) > 200_000 or i + 1 == len(texts):
            out[start : i + 1] = _majority(np.array(hashes, np.uint64), np.array(sizes))
            start, hashes, sizes = i + 1, [], []
    return pa.array(out.view(np.int64))


def _majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[full]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def embedding(fp: Column) -> Column:
    """Popcounts of the 2-bit segments, each in its own two bits of a long."""
    even = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    # without a sum, which would overflow a signed long: the low bit of a count is a xor b, the high one a and b
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def cells(fp: Column) -> Column:
    """array<long>: the embedding and all embeddings at Manhattan distance 1."""
    e = embedding(fp)
    steps = []
    for s in range(0, 64, SEGMENT_BITS):
        held = F.shiftrightunsigned(e, s).bitwiseAND(F.lit(3))
        # counts 0 and 1 are one step apart and differ in the low bit; 1 and 2 differ in both
        steps += [F.when(held < 2, e.bitwiseXOR(_signed(1 << s))), F.when(held > 0, e.bitwiseXOR(_signed(3 << s)))]
    return F.array_compact(F.array(e, *steps))


def neighbours(fp: Column) -> Column:
    """array<long>: fp and the 64 values one bit away."""
    return F.array(fp, *(fp.bitwiseXOR(_signed(1 << b)) for b in range(64)))


def links(nodes: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints (column fp) at most RADIUS bits apart; b is a fingerprint or a shared neighbour's value. made: gets the written tables that the links are read from."""
    # a node makes up to 65 rows here, so the nodes, few bytes each, are dealt to all cores first
    spread = nodes.select("fp").repartition(common.partitions(nodes.sparkSession), "fp")
    gridded = spread.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    shared = common.cut(gridded.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "simhash-cells")
    made = [] if made is None else made
    made.append(shared)
    pairs = shared.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    crowded = shared.where("n > 2").select("cell")
    members = common.cut(gridded.join(crowded, "cell", "left_semi").select("fp").distinct(), "simhash-crowd")
    made.append(members)
    near = members.repartition(common.partitions(nodes.sparkSession), "fp").select("fp", F.explode(neighbours(F.col("fp"))).alias("at"))
    met = near.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
    hubs = near.join(met, "at", "left_semi").select(F.col("fp").alias("a"), F.col("at").alias("b")).where("a <> b")
    # a shared value lies within 1 bit of each member that reaches it, so those are pairwise within 2
    return pairs.unionByName(hubs).distinct()


def components(edges: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """node and root (the smallest node it is connected to) for every node of edges (a, b): alternating large-star and small-star steps, each written to the shared folder, until nothing changes. made: gets the written table that the result is read from."""
    now = common.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "simhash-edges")
    before, held = None, now
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour of a node goes to the node's least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        now = common.cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "simhash-edges")
        common.drop(held)
        held = now
        # unchanged sums of a one-to-one digest: the star of every component has been reached
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    if made is not None:
        made.append(now)
    rooted = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 lowercase hex digits), component_id (the smallest key reachable over links)."""
    if SEGMENT_BITS != 2 or RADIUS != 2:
        raise ValueError("the grid is built for segments of 2 bits and a distance of 2")
    marked = common.cut(fingerprints(docs, shingle, key, text), "simhash-fingerprints")
    nodes = common.cut(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    made: list[DataFrame] = []
    held: list[DataFrame] = []
    roots = components(links(nodes, made), held)
    common.drop(*made)
    # nodes in no link are their own component; values that are only shared neighbours fall away here
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    component = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.cut(grouped.join(component, "root").select("fp", "n", "component_id"), "simhash-named")
    common.drop(nodes, *held)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return common.reads(common.join_counted(marked, named, "fp").select(key, hexed.alias("fingerprint"), "component_id"), marked, named)
