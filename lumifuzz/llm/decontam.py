"""Benchmark decontamination by spaced-seed hashing.

A word is a run of non-space characters, lower-cased and stripped to its letters and digits (runs without any fall away).
Each mask hashes six words at fixed offsets and ignores those between, so that a substituted word at an ignored position
does not break a hit. Hashes of the benchmark's windows are joined with those of every window of every whole document;
hits are verified along their diagonals: the best run, where a matching word counts 1 and another -3 (so that more than 3
in 4 words match), must hold at least MIN_WORDS matching words. An item is found in a document exactly if some hit's diagonal holds such a run.

For each document and item, the first hit of each seed is verified first, and the best of these overlaps is reported. Only where none
holds, the other hits follow, in slices of SLICE, until one holds. So a text that repeats itself costs no more than its length, memory
is bounded, and there is one overlap for each document and item, however often the item stands in it.

The benchmark is taken in blocks of at most BLOCK_SEEDS hashes (or one longer item), which bounds what is sent to the executors. If there are several,
one pass with a filter of fixed size over the seeds of all blocks leaves the documents that can hold a hit, and the blocks are looked up in
those alone. There is no shuffle of documents, and no cap on hits, items or partners. What several blocks find in a document is merged, so the result does not depend on BLOCK_SEEDS.

Null texts count as empty and match nothing; an empty table on either side gives no contaminated rows. Equal documents give
equal rows. Benchmark rows with a null item_id are used and named by null. Other columns are passed over (mark) or
kept as they are (decontaminate).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common

#: Offsets of the words that a seed holds; the others up to the last are ignored.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 6, 8), (0, 2, 4, 5, 6, 9), (0, 1, 2, 5, 7, 9))
MIN_WORDS = 10
MISMATCH = 3
BLOCK_SEEDS = 2_000_000
_ODD = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, (len(MASKS), 8), dtype=np.uint64) | np.uint64(1)
#: Hits, or cells of compared words, that are looked at once.
SLICE = 1_000_000
_FILTER_BITS = 22


def word_hash(chunk: str) -> int:
    """Hash of a chunk's word, 0 if it has none."""
    from xxhash import xxh64_intdigest

    word = "".join(c for c in chunk.lower() if c.isalnum())
    return (xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0


def word_hashes(text: str) -> np.ndarray:
    memo = common.held("decontam", lambda: common.Memo(word_hash))
    h = np.array(list(map(memo.__getitem__, text.split())), np.uint64)
    return h[h != 0]


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The seed at each position where the whole mask fits."""
    offsets = MASKS[mask]
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, mask, np.uint64)
    for k, o in enumerate(offsets):
        out += words[o : o + n] * _ODD[mask, k]
    return out ^ (out >> np.uint64(29))


#: (document, item, diagonal, window) of hits, as rows: the diagonal is where the item would begin, the window where the hit's seed does.
Hits = np.ndarray
#: By document: (item, first word, word after the last, matching words) of the verified overlaps, one for each item.
Found = dict[int, list[tuple[int, int, int, int]]]


class Block:
    """The seeds of some benchmark items, sorted by hash, item and position, and the items' words. Items of fewer than MIN_WORDS words cannot be found and have no seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        words = [word_hashes(t or "") for _, t in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        hashes, item, at = [], [], []
        for i, w in enumerate(words):
            for m in range(len(MASKS) if len(w) >= MIN_WORDS else 0):
                s = seeds(w, m)
                hashes.append(s)
                item.append(np.full(len(s), i, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int32)
        self.at = np.concatenate(at)[order] if at else np.empty(0, np.int32)
        # of each hash and item the first entry
        lead = np.ones(len(h), bool)
        lead[1:] = (self.hashes[1:] != self.hashes[:-1]) | (self.item[1:] != self.item[:-1])
        self.lead = np.flatnonzero(lead)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first position, last position, seed) of the windows whose seeds the block holds, mask by mask."""
        places, lasts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for m in range(len(MASKS)):
            s = seeds(words, m)
            maybe = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
            if len(maybe) and len(self.hashes):
                near = np.minimum(np.searchsorted(self.hashes, s[maybe]), len(self.hashes) - 1)
                maybe = maybe[self.hashes[near] == s[maybe]]
                places.append(maybe)
                lasts.append(maybe + MASKS[m][-1])
                found.append(s[maybe])
        return np.concatenate(places), np.concatenate(lasts), np.concatenate(found)

    def _hits(self, doc: np.ndarray, at: np.ndarray, seed: np.ndarray, entries: np.ndarray | None) -> Iterator[Hits]:
        """The hits of windows with the given entries (None: all), in slices."""
        held = self.hashes if entries is None else self.hashes[entries]
        low = np.searchsorted(held, seed, "left")
        n = np.searchsorted(held, seed, "right") - low
        last = np.cumsum(n)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(last, (last[start - 1] if start else 0) + SLICE, "right")))
            some = n[start:stop]
            which = np.repeat(np.arange(start, stop), some)
            entry = np.repeat(low[start:stop] - np.cumsum(some) + some, some) + np.arange(some.sum())
            entry = entry if entries is None else entries[entry]
            yield np.stack([doc[which], self.item[entry].astype(np.int64), at[which] - self.at[entry], at[which]], axis=1)
            start = stop

    def _verified(self, words: np.ndarray, ends: np.ndarray, hits: Hits, found: Found, done: np.ndarray) -> np.ndarray:
        """Verifies distinct diagonals, adds the best overlap of each document and item to found, and gives the (document, item) pairs that are done."""
        lines = np.unique(hits[:, :3], axis=0)
        lows = np.where(lines[:, 0] > 0, ends[np.maximum(lines[:, 0] - 1, 0)], 0)
        a = np.maximum(lines[:, 2], lows)
        b = np.minimum(lines[:, 2] + self.sizes[lines[:, 1]], ends[lines[:, 0]])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.argsort(b - a, kind="stable")
        start = 0
        while start < len(order):
            # lines of like length, so that little of the matrix is empty
            width = int((b - a)[order[min(len(order), start + max(1, SLICE // max(1, int((b - a)[order[start]])))) - 1]])
            some = order[start : start + max(1, SLICE // max(1, width))]
            width = int((b - a)[some].max())
            cells = a[some, None] + np.arange(width)
            inside = cells < b[some, None]
            cells = np.where(inside, cells, 0)
            own = self.starts[lines[some, 1], None] + np.where(inside, cells - lines[some, 2, None], 0)
            same = inside & (words[cells] == self.words[np.minimum(own, len(self.words) - 1)])
            first, last, n = best_runs(same, inside)
            for k in np.flatnonzero(n >= MIN_WORDS).tolist():
                d, i, _ = lines[some[k]].tolist()
                at = int(a[some[k]] - lows[some[k]])
                one = (int(n[k]), -(at + int(first[k])), at + int(last[k]))
                if one > best.get((d, i), (0, 0, 0)):
                    best[d, i] = one
            start += len(some)
        for (d, i), (n, first, last) in best.items():
            found.setdefault(d, []).append((i, -first, last, n))
        return np.concatenate([done, np.array(sorted(best), np.int64).reshape(-1, 2)])

    def overlaps(self, words: np.ndarray, ends: np.ndarray) -> Found:
        """ends: where each document's words end, with the documents laid end to end."""
        found: Found = {}
        at, last, seed = self.windows(words)
        doc = np.searchsorted(ends, at, "right")
        # a window that reaches over the end of its document is none
        inside = last < ends[np.minimum(doc, len(ends) - 1)]
        if not inside.any():
            return found
        at, seed, doc = at[inside], seed[inside], doc[inside]
        order = np.lexsort((at, seed, doc))
        at, seed, doc = at[order], seed[order], doc[order]
        lead = np.ones(len(at), bool)
        lead[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])
        done, open_ = np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
        for hits in self._hits(doc[lead], at[lead], seed[lead], self.lead):
            open_ = np.unique(np.concatenate([open_, hits[:, :2]]), axis=0)
            done = self._verified(words, ends, hits, found, done)
        # the same item may have been found in several slices
        for d, own in found.items():
            top: dict[int, tuple[int, int, int, int]] = {}
            for x in own:
                if x[0] not in top or (x[3], -x[1]) > (top[x[0]][3], -top[x[0]][1]):
                    top[x[0]] = x
            found[d] = sorted(top.values())
        open_ = _without(open_, done)
        if len(open_):
            on = np.isin(doc, open_[:, 0])
            for hits in self._hits(doc[on], at[on], seed[on], None):
                hits = hits[_member(hits[:, :2], open_)]
                if len(hits):
                    before = {d: len(v) for d, v in found.items()}
                    done = self._verified(words, ends, hits, found, done)
                    open_ = _without(open_, done)
                    for d, v in found.items():
                        if len(v) > before.get(d, 0):
                            v.sort()
                if not len(open_):
                    break
        return found


def _pairs(x: np.ndarray) -> np.ndarray:
    return x[:, 0] << np.int64(32) | x[:, 1]


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.isin(_pairs(x), _pairs(of))


def _without(x: np.ndarray, gone: np.ndarray) -> np.ndarray:
    return x[~_member(x, gone)]


def best_runs(same: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, after the last, matches) of each row's run with the greatest score, where a match counts 1 and another cell -MISMATCH; the first of equals, as short as can be. Cells that are not inside belong to no run."""
    rows, n = same.shape
    if not n:
        return np.zeros(rows, int), np.zeros(rows, int), np.zeros(rows, int)
    score = np.cumsum(np.where(same, 1, np.where(inside, -MISMATCH, 0)), axis=1)
    before = np.hstack([np.zeros((rows, 1), int), score[:, :-1]])
    least = np.minimum.accumulate(before, axis=1)
    where = np.maximum.accumulate(np.where(before == least, np.arange(n), 0), axis=1)
    at = (score - least).argmax(axis=1)
    row = np.arange(rows)
    first, matches = where[row, at], np.cumsum(same, axis=1)
    found = score[row, at] > least[row, at]
    count = matches[row, at] - np.where(first > 0, matches[row, np.maximum(first - 1, 0)], 0)
    return np.where(found, first, 0), np.where(found, at + 1, 0), np.where(found, count, 0)


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_SEEDS seeds, row by row, one after the other on the driver."""
    items, n = [], 0
    for r in benchmark.select(key, text).toLocalIterator():
        more = (len(r[1] or "") // 2 + 1) * len(MASKS)
        if items and n + more > BLOCK_SEEDS:
            yield Block(items)
            items, n = [], 0
        items.append((r[0], r[1]))
        n += more
    if items:
        yield Block(items)


def _found(block: Block, texts: list[str]) -> Found:
    arrays = [word_hashes(t) for t in texts]
    ends = np.cumsum([len(a) for a in arrays])
    return block.overlaps(np.concatenate(arrays), ends) if len(arrays) else {}


def _possible(docs: DataFrame, benchmark: DataFrame, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows that can hold a hit of some block, and what was written of them, if the benchmark has several blocks; else all rows."""
    seen, n = np.zeros(1 << ALL_BITS, bool), 0
    for block in blocks(benchmark):
        seen[block.hashes >> np.uint64(64 - ALL_BITS)] = True
        n += 1
    if n < 2:
        return docs, None
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for part, texts in common.slices(batch, text):
                keep = []
                for t in texts:
                    w = word_hashes(t)
                    places = np.concatenate([seeds(w, m) for m in range(len(MASKS))]) >> np.uint64(64 - ALL_BITS)
                    keep.append(bool((held[places >> np.uint64(3)] >> (7 - (places & np.uint64(7))) & 1).any()))
                yield part.filter(pa.array(keep, pa.bool_()))

    some = common.cut(docs.mapInArrow(run, docs.schema), "decontam-possible")
    return some, some


#: Bits of the filter over all blocks (8 MB).
ALL_BITS = 26


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each contaminated document: key, item_ids (array<long>), n_items, matched_words (most in one overlap), overlaps (item_id, first word, word after the last, matching words)."""
    kind = docs.schema[key].dataType.simpleString()
    spans_kind = "array<struct<item_id:long,first:long,after:long,matched:long>>"
    span = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "first", "after", "matched")]))
    out, n = None, 0
    docs, made = _possible(docs.select(key, text), benchmark, text)
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, n=n) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                for part, texts in common.slices(batch, text):
                    found = _found(block, texts)
                    at = sorted(found)
                    spans = [[dict(zip(("item_id", "first", "after", "matched"), (block.ids[i], a, b, n), strict=True)) for i, a, b, n in found[d]] for d in at]
                    digests = [hashlib.blake2b(texts[d].encode("utf-8", "surrogatepass"), digest_size=16).digest() for d in at]
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at, pa.int64())), pa.array(digests, pa.binary()), pa.array([n] * len(at), pa.int64()), pa.array(spans, span)], [key, "_digest", "_block", "overlaps"])

        one = docs.mapInArrow(run, f"{key} {kind}, _digest binary, _block long, overlaps {spans_kind}")
        out, n = one if out is None else out.unionByName(one), n + 1
    if out is None:
        out = docs.limit(0).select(key, F.lit(None).cast("binary").alias("_digest"), F.lit(0).cast("long").alias("_block"), F.lit(None).cast(spans_kind).alias("overlaps"))
    if n > 1:
        # equal rows have equal overlaps in each block, so they are counted, merged once and dealt out again
        counted = out.groupBy(key, "_digest", "_block").agg(F.count("*").alias("n"), F.first("overlaps").alias("overlaps"))
        merged = counted.groupBy(key, "_digest").agg(F.max("n").alias("n"), F.flatten(F.collect_list("overlaps")).alias("overlaps"))
        out = merged.select(key, "overlaps", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    # by item, nulls last, in whichever block it was
    nulls_last = F.array_sort(F.transform("overlaps", lambda x: F.struct(x["item_id"].isNull().alias("none"), F.coalesce(x["item_id"], F.lit(0)).alias("id"), x["first"].alias("first"), x["after"].alias("after"), x["matched"].alias("matched"))))
    ordered = F.transform(nulls_last, lambda x: F.struct(F.when(~x["none"], x["id"]).alias("item_id"), x["first"].alias("first"), x["after"].alias("after"), x["matched"].alias("matched"))).cast(spans_kind)
    ids = F.array_distinct(F.transform("overlaps", lambda x: x["item_id"]))
    out = out.select(key, ordered.alias("overlaps")).select(key, ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), F.array_max(F.transform("overlaps", lambda x: x["matched"])).alias("matched_words"), "overlaps")
    return common.reads(out, *([made] if made is not None else []))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, without the contaminated rows."""
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in common.slices(batch, text):
                    found = _found(sent.value, texts)
                    yield part.filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
