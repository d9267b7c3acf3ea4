"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifuzz.sources.shared import cut, delete, drop, partitions, reads, shared_folder  # noqa: F401  for the operators here

#: Characters of text that a Python worker works on at once.
SLICE_CHARS = 4_000_000
#: Entries of each of the two generations of a worker's memo of distinct words, and the longest word it holds.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64

#: Unicode White_Space; Python's str.split() also cuts at U+001C..U+001F.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_NOT_WHITE = re.compile(f"[^{WHITE}]+")
_CONTROL_SPACE = re.compile("[\x1c-\x1f]")


class Memo(dict):
    """make(word) by word, in bounded memory: when the young generation is full, it becomes the old one, whose words come back when they are asked for."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """An engine with its memo, made once in each worker process. Workers are used again by later stages, so another engine's memory is given back first."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    if _held:
        _held.clear()
        gc.collect()


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def white_split(text: str) -> list[str]:
    """Maximal runs of characters that are not Unicode white space."""
    return _NOT_WHITE.findall(text) if _CONTROL_SPACE.search(text) else text.split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch whose texts (null as empty) hold about SLICE_CHARS characters, or one longer text."""
    texts = [x or "" for x in batch.column(text).to_pylist()]
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > SLICE_CHARS:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def map_texts(docs: DataFrame, work: Callable[[list[str]], dict[str, pa.Array]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and what work() makes of the texts, row by row; schema: the columns after key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text):
                made = work(texts)
                yield pa.RecordBatch.from_arrays([part.column(key), *made.values()], [key, *made])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


#: Keys, of 8 bytes each, that are broadcast at most.
FEW = 4_000_000


def filtered(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with written keys of 8 bytes. As long as they are FEW (32 MB), which is counted first, they go to the rows; beyond that both sides are shuffled."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys.hint("merge"), key, how)


#: A key is hot if it has more than one row in so many: there are fewer hot keys than that in any table.
HOT_ONE_IN = 1000


def join_counted(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of rows with named, which holds each key once and the number of its rows (n, given up). Hot keys, fewer than HOT_ONE_IN by their definition, are broadcast, so that their rows stay where they are; the others meet in a shuffle, in which no key is hot."""
    total = named.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_ONE_IN > total
    few = F.broadcast(named.where(hot).drop(n))
    if not total or named.where(hot).isEmpty():
        return rows.join(named.drop(n), key)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(named.where(~hot).drop(n), key))


def crc_mod(column: str, mod: int):
    """crc32 of a column's text form, modulo mod; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod
