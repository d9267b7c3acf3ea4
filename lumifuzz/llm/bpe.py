"""Byte-pair encoding and decoding with a contiguous rank array.

A short word is held as two flat lists: the ids of its parts and the ranks of the adjacent pairs. The smallest rank is
found by a scan, its boundary is deleted, and the two neighbouring ranks are looked up anew. A word of more than
LONG_WORD characters goes through a heap instead, where the scan would be quadratic; both take the lowest rank, then the
leftmost pair, and give the same ids.

Null texts count as empty, empty texts have no ids, and equal texts give equal rows; rows come back one for one, whatever
other columns the input has. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
import pyarrow as pa
from pyspark.sql import DataFrame

from lumifuzz.llm import common

NO_PAIR = 1 << 60
LONG_WORD = 64

_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class RankArrayBpe:
    """A vocabulary file of the tokenizers library with BPE and word ends, encoded here by rank arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        own = Tokenizer.from_file(path)
        #: The file's own text rules; they are called for distinct words that are not plain ASCII.
        self.normalize, self.pre_tokenize = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = vocab
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        #: rank and merged id of a pair of ids, packed: the order of the packed numbers is the order of the ranks.
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), rank << 20 | vocab[a + b])
        self.memo = common.Memo(self.encode_chunk)

    def encode_word(self, symbols: list[str]) -> list[int]:
        """ids of one pre-token, given as its symbols."""
        parts = [self.vocab[s] for s in symbols]
        if len(parts) > LONG_WORD:
            return self._encode_long(parts)
        pairs = self.pairs
        ranks = [pairs.get(p, NO_PAIR) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_PAIR:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), NO_PAIR)
            if i < len(ranks):
                ranks[i] = pairs.get((parts[i], parts[i + 1]), NO_PAIR)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: a heap of pairs over a doubly linked list."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.pairs[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            packed, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or self.pairs.get((parts[i], parts[j])) != packed:
                continue
            parts[i], parts[j] = packed & 0xFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (p := self.pairs.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (p, left))
        return [x for x in parts if x >= 0]

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a run of characters without white space and special strings."""
        if chunk.isascii():
            words = _ASCII_WORD.findall(chunk.lower())
            plain = chunk.isprintable()
        else:
            plain = False
        if not plain:
            words = [w for w, _ in self.pre_tokenize(self.normalize(chunk))]
        ids: list[int] = []
        for w in words:
            ids += self.encode_word([*w[:-1], w[-1] + self.end])
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if "<|" in text:
            out = []
            for piece in self.special_at.split(text):
                out.append(array("I", [self.special[piece]]).tobytes() if piece in self.special else b"".join(map(self.memo.__getitem__, common.white_split(piece))))
            return b"".join(out)
        return b"".join(map(self.memo.__getitem__, common.white_split(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library gives it for a file without a decoder: the tokens, with spaces between."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def engine(path: str) -> RankArrayBpe:
    """The engine for a vocabulary file, once in each process."""
    return common.held(f"bpe {path}", lambda: RankArrayBpe(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: array<int> of each whole text."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        one = engine(path)
        return {"ids": pa.array([array("i", one.encode(t)) for t in texts], pa.list_(pa.int32()))}

    return common.map_texts(docs, work, "ids array<int>", key, text)


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key and text of each row's ids (null: no ids)."""

    def run(batches):
        for batch in batches:
            one = engine(path)
            texts = [one.decode(array("I", x or []).tobytes()) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return ids.select(key, column).mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, then its ids decoded, in one pass."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        one = engine(path)
        n, of_ids, of_text = [], [], []
        for t in texts:
            ids = one.encode(t)
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(one.decode(ids).encode()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}

    return common.map_texts(docs, work, "n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)
