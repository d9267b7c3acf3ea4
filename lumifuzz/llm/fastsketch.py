"""Near duplicates over word pairs: fast similarity sketches as the candidate search, links confirmed on whole sets.

A sketch has BINS coordinates. In round i < BINS every shingle of a set is hashed to one bin and leaves the value (i, hash) there if that is the
least so far; in round BINS + b every shingle goes to bin b, so that no bin can stay empty. Values of a later round are larger than those of an
earlier one, so a set whose bins are all filled is done: a set of n shingles takes some BINS * log(BINS) / n rounds, not BINS. Two sets agree in
a coordinate with the probability of their Jaccard similarity, and the share of agreeing coordinates is concentrated about it as it is for
drawing with replacement (coordinates are correlated so that the spread is never larger than that of independent minima).

BANDS cells of ROWS coordinates are the candidate search: a pair of similarity s shares none with probability (1 - s ** ROWS) ** BANDS, 5e-8
at 0.8 and less above. Candidates are then compared as `minhash` states: exactly, on whole sets, each cell's members first with its least member and then
only in cells that stay open, in bounded blocks.

Null texts count as empty; a text without a word has an empty set and is linked with nothing, also not with its like; a text of fewer words than a
shingle is one shingle. Equal rows give equal rows, one for one. A null key is kept: its component_id is the least key that its text reaches, null where
there is none, and kept is then null-safe (a row whose key and component are both null is kept). Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common, minhash

SHINGLE = 2
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Bits of a value that are the hash; the round stands above them.
_HASH_BITS = 40
_KEYS = np.random.default_rng(20240611).integers(1 << 62, 1 << 63, (2 * BINS, 2), dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)


def _hashed(every: np.ndarray, i: int) -> np.ndarray:
    h = every * _KEYS[i, 0]
    h ^= h >> np.uint64(32)
    h *= _KEYS[i, 1]
    return h ^ (h >> np.uint64(29))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of sets that are not empty, as rows of BINS values."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full((len(sets), BINS), _EMPTY)
    flat = out.reshape(-1)
    for i in range(2 * BINS):
        h = _hashed(every, i)
        where = (h >> np.uint64(_HASH_BITS)) * np.uint64(BINS) >> np.uint64(64 - _HASH_BITS) if i < BINS else np.uint64(i - BINS)
        np.minimum.at(flat, owner * BINS + np.asarray(where, np.int64), np.uint64(i << _HASH_BITS) | h & np.uint64((1 << _HASH_BITS) - 1))
        unfilled = (out == _EMPTY).any(axis=1)
        if not unfilled.any():
            break
        left = unfilled[owner]
        every, owner = every[left], owner[left]
    return out


def cells(sets: list[np.ndarray]) -> np.ndarray:
    """The cells of each set that is not empty, as rows: digests of ROWS coordinates each."""
    values = sketches(sets).reshape(len(sets), BANDS, ROWS)
    cell = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
    for r in range(ROWS):
        cell = (cell ^ values[:, :, r]) * _KEYS[r, 0]
        cell ^= cell >> np.uint64(29)
    return cell


WORD_PAIRS = minhash.Scheme(SHINGLE, cells)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles (size of the set), component_id (the smallest key reachable over links) and kept (whether the row has that key)."""
    found = minhash.grouped(docs, key, text, WORD_PAIRS)
    component = F.when(F.col("size") == 0, F.col("_key")).otherwise(F.col("component_id"))
    out = found.select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), component.alias("component_id"))
    return common.reads(out.withColumn("kept", F.col(f"`{key}`").eqNullSafe(F.col("component_id"))), *found._lumifuzz_reads)
