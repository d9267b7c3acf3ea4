"""How far the sources of a language are from one another and from the language, over its common terms, with exact counts.

1. Sketch. Each task counts the documents of every (lang, term) it meets and adds them to a count-min sketch: DEPTH rows of `width` counters that stop at
   `least`. A counter never holds less than any of its terms has, and the sum of all tasks' counters, merged block by block, neither. A term of which one
   counter stays below `least` is therefore impossible, and never leaves its task in the next step. What is kept of the merged sketch is one bit a counter: whether
   it has reached `least`; DEPTH * MOST_WIDTH bits (8 MB) at most, whatever the input.
2. Count. A second pass counts occurrences and documents by (lang, source, term), drops impossible terms by those bits, and shuffles the others, added up before that.
   The exact number of documents then decides which terms are kept, so a sketch that is too narrow costs shuffle, not correctness: it discards well as
   long as the documents' rare terms together are not more than some 10 * width.
3. Pairs. Two sources differ from their values of an absent term only in terms that one of them has. So a pair is three sparse sums: over the terms of one side, over those of the
   other (each from a histogram of values by source), and a correction over the terms that both have, which meet in a join by (lang, term); plus a product
   for all terms that neither has. No (source, term) without occurrences is ever a row.

Values are whole numbers: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), in decimals of 38 digits, so that no product overflows.

Null text, lang and source count as ''. Repeated rows count each time; doc_id and other columns play no part. Texts without a term count for their
group's existence alone; a language without a kept term has pairs of value 0 and no terms. Ties rank by the item's UTF-8 bytes. An empty table gives an
empty result. A text of any length is cut into terms piece by piece.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifuzz.llm import common

LEAST_DOCUMENTS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Rows of the sketch, and the bounds of their width. Between them it is 8 counters a document.
DEPTH, LEAST_WIDTH, MOST_WIDTH = 4, 1 << 16, 1 << 24
#: Counters that are merged together.
BLOCK = 4096
#: Distinct terms that a task holds before it gives them on, and bytes of a text that are cut into terms at once.
ENTRIES, PIECE = 300_000, 4_000_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Letters A-Z become small; bytes that are neither letters nor of a character beyond ASCII separate terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces."""
    whole, at = raw.translate(_TERM_BYTES), 0
    while at < len(whole):
        end = len(whole)
        if end > at + PIECE:
            end = whole.rfind(b" ", at, at + PIECE)
            if end < 0 and (end := whole.find(b" ", at + PIECE)) < 0:
                end = len(whole)
        yield whole[at:end].split()
        at = end + 1


def _hashes(lang: bytes, found: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang, 7)
    return np.array([xxh64_intdigest(t, seed) for t in found], np.uint64)


def _places(h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - width.bit_length() + 1)
    for odd in _ODD[:DEPTH]:
        yield (h * np.uint64(odd) >> shift).astype(np.int64)


def _kind(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _add(sketch: np.ndarray, at: np.ndarray, n: np.ndarray, least: int) -> None:
    """Adds counts to the counters at some places, which may repeat; they stop at least."""
    places, which = np.unique(at, return_inverse=True)
    sketch[places] = np.minimum(sketch[places] + np.bincount(which, weights=n, minlength=len(places)), least).astype(sketch.dtype)


def _pack(cells: np.ndarray) -> bytes:
    """A block as its counters, or as places and counters where that is shorter."""
    full = np.flatnonzero(cells)
    short = full.astype("<u2").tobytes() + cells[full].tobytes()
    return short if len(short) < cells.nbytes else cells.tobytes()


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if len(packed) == BLOCK * size:
        return np.frombuffer(packed, kind)
    n, out = len(packed) // (2 + size), np.zeros(BLOCK, kind)
    out[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, kind, n, 2 * n)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):  # one text at a time as a Python object
            yield tuple(batch.column(c)[i].as_py() for c in range(3))


def _sketched(width: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        sketch = np.zeros((DEPTH, width), _kind(least))
        seen: dict[bytes, Counter] = defaultdict(Counter)

        def flush() -> None:
            for lang, counts in seen.items():
                n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), least)
                for row, at in zip(sketch, _places(_hashes(lang, list(counts)), width), strict=True):
                    _add(row, at, n, least)
            seen.clear()

        held = 0
        for raw, lang, _ in _rows(batches):
            own = seen[lang]
            before = len(own)
            own.update(set().union(*terms(raw)))
            held += len(own) - before
            if held > ENTRIES:
                flush()
                held = 0
        flush()
        blocks = sketch.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        for some in np.array_split(full, len(full) // 1000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_pack(blocks[b]) for b in some], pa.binary())], ["block", "cells"])

    return run


def _merged(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells = _unpack(packed, _kind(least)).astype(np.uint64)
                sums[block] = np.minimum(sums[block] + cells, least).astype(_kind(least)) if block in sums else cells.astype(_kind(least))
        reached = [(b, np.packbits(cells >= least).tobytes()) for b, cells in sums.items() if (cells >= least).any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in reached], pa.int64()), pa.array([x for _, x in reached], pa.binary())], ["block", "bits"])

    return run


def possible(rows: DataFrame, width: int, least: int) -> np.ndarray:
    """For each row of the merged sketch, one bit a counter: whether it has reached least. rows: text, lang, source as binary."""
    blocks = rows.mapInArrow(_sketched(width, least), "block long, cells binary")
    merged = blocks.repartition(common.partitions(rows.sparkSession), "block").mapInArrow(_merged(least), "block long, bits binary")
    out = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for block, bits in merged.toLocalIterator():  # DEPTH * MOST_WIDTH / 8 bytes at most
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(DEPTH, -1)


def _may(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Which hashed terms are not impossible."""
    out = np.ones(len(h), bool)
    for row, at in zip(bits, _places(h, width), strict=True):
        out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


_COUNTED = "lang binary, source binary, term binary, n long, documents long"


def _counted(bits, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in _COUNTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        occurring: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)
        documents: dict[tuple[bytes, bytes], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in occurring.items():
                found = list(counts)
                in_documents = documents[lang, source]
                may = [found[i] for i in np.flatnonzero(_may(bits.value, _hashes(lang, found), width))]
                # a row without a term for the group itself
                columns = [[None, *may], [0, *(counts[t] for t in may)], [0, *(in_documents[t] for t in may)]]
                n = len(may) + 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.binary()), pa.array([source] * n, pa.binary()), pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)
            occurring.clear()
            documents.clear()

        held = 0
        for raw, lang, source in _rows(batches):
            own = occurring[lang, source]
            before, distinct = len(own), set()
            for piece in terms(raw):
                own.update(piece)
                distinct.update(piece)
            documents[lang, source].update(distinct)
            held += len(own) - before
            if held > ENTRIES:
                yield from flush()
                held = 0
        yield from flush()

    return run


def value(count: Column, total: Column, kept: Column) -> Column:
    """The whole-number value of a count among so many occurrences of so many kept terms; 0 where no term is kept."""
    over = (total + PRIOR * kept).cast("decimal(38,0)")
    scaled = F.lit(SCALE).cast("decimal(38,0)") * (count + PRIOR)
    return F.when(kept > 0, 1 + F.call_function("div", scaled, over)).otherwise(0).cast("long")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language. kept: lang, source, item, p, absent (the group's p of a count of 0); groups: lang, source, kept, held, absent."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("other_absent"), F.col("held").alias("other_held"))
    both = groups.join(other, "lang").where("source <> other")
    # a side's terms against the other's absent value, from how often the side has each value
    bars = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    side = bars.join(other, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("other_absent"))).alias("apart"))
    # terms of both, each pair of sources once
    left, right = kept.select("lang", "item", "source", "p", "absent"), kept.select("lang", "item", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("absent").alias("other_absent"))
    more = F.abs(F.col("p") - F.col("other_p")) - F.abs(F.col("p") - F.col("other_absent")) - F.abs(F.col("other_p") - F.col("absent"))
    shared = left.join(right, ["lang", "item"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(more).alias("more"), F.count("*").alias("common"))
    shared = shared.unionByName(shared.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), "more", "common"))
    back = side.select("lang", F.col("source").alias("other"), F.col("other").alias("source"), F.col("apart").alias("apart_back"))
    keys = ["lang", "source", "other"]
    whole = both.join(side, keys, "left").join(back, keys, "left").join(shared, keys, "left").na.fill(0, ["apart", "apart_back", "more", "common"])
    neither = (F.col("kept") - F.col("held") - F.col("other_held") + F.col("common")) * F.abs(F.col("absent") - F.col("other_absent"))
    return whole.select("lang", "source", F.col("other").alias("item"), (F.col("apart") + F.col("apart_back") + F.col("more") + neither).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language by its distance, part `term` the top terms that the source uses more than its language. width: counters in a row of the sketch, a power of two."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary").alias(c) for c in (text, lang, source)))
    if width is None:
        width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (8 * docs.count()).bit_length()))
    bits = spark.sparkContext.broadcast(possible(rows, width, least))
    parts = rows.mapInArrow(_counted(bits, width), _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    as_text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    counted = common.cut(parts.select(*as_text, F.col("term").cast("string").alias("item"), "n", "documents"), "divergence-counts")
    bits.unpersist()

    of_term = Window.partitionBy("lang", "item")
    kept = counted.where("item is not null").withColumns({"in_lang": F.sum("documents").over(of_term), "lang_n": F.sum("n").over(of_term)}).where(F.col("in_lang") >= least).select("lang", "source", "item", "n", "lang_n")
    kept = common.cut(kept, "divergence-kept")
    langs = kept.groupBy("lang", "item").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = counted.where("item is null").select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = common.cut(groups.withColumn("absent", value(F.lit(0), F.col("total"), F.col("kept"))), "divergence-groups")

    valued = kept.join(groups, ["lang", "source"]).withColumn("p", value(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", value(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    over = _ranked(valued.where("n > 0 and p > q").withColumn("value", F.col("p") - F.col("q")), "term").where(F.col("rank") <= top)
    between = _ranked(_pairs(valued.select("lang", "source", "item", "p", "absent"), groups), "pair")
    return common.reads(between.unionByName(over), counted, kept, groups)
