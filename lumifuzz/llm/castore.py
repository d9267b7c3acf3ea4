"""Content-addressed store of token ids.

Documents are encoded, an end id is appended, and a rolling hash over WINDOW ids cuts each id stream into chunks, so that
equal passages are cut alike wherever they stand. A store is a folder of Parquet files:

rows/      kind 0: hash (SHA-256 of the ids as little-endian unsigned 32-bit integers), n, payload: each chunk once. A payload is the
           zstd frame of the ids, in 16 bits each if the first byte is 2, in 32 if it is 4.
recipes/   doc_id, part, pos, own, n_tokens, root, entries (array of hash and n): the documents in ascending doc_id
           order (null first, equal ids by root), part by part; own counts the ids of the documents before in the part.
parts/     part, before: the ids of all parts before. before + own is where a document's ids start.
manifest/  level, part, block, n, root: a Merkle tree. root of a recipe: SHA-256 of its entries' hashes and sizes; of a block: of its
           BLOCK recipes' roots, ids, starts and sizes in order; of a part: of its blocks' roots; the last level has the one root over all parts.

Reading back checks each chunk against its hash and size, each recipe against its root, and the tree over the stored recipes against the
manifest; what differs raises an error. Payloads cross the network once, when chunks are made unique; a task drops repeats that it has seen itself before that, so a
passage that many documents share costs at most one row a task. Copies of a document share one recipe body.

A null text counts as empty: its only id is the end id. Repeated rows are documents of their own. An empty table gives
an empty store. The input's other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumifuzz.llm import common

WINDOW = 16
MIN_IDS, MAX_IDS = 256, 4096
#: A cut where these bits of the rolling hash are zero: every 512 ids on average, after the least size.
MASK = np.uint32(0x1FF << 16)
BLOCK = 1024
#: Hashes that a task remembers to drop its own repeats.
SEEN = 500_000

#: A space between two white characters, or between one and the end: there the pre-tokeniser may not cut.
_UNSAFE = re.compile(r" (?=\s|\Z)(?<=\s )")


#: Fixed value: the pre-tokeniser pattern of byte-level vocabularies.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(library):
    """An encoder by merge ranks, if a tokenizer is a plain byte-level one whose tokens are numbered in the order of their merges; else None."""
    import tiktoken

    held = json.loads(library.to_str())
    model, cut = held["model"], held["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or held["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in held["added_tokens"]}
    if not all("<|" in t for t in special):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


#: Characters of a text that is looked through for long runs of white space.
LONG = 20_000
_LONG_RUN = re.compile(rf"\s{{{LONG // 2}}}")


class Encoder:
    """Plain byte-level vocabularies by their merge ranks; others by the tokenizers library behind a memo of the pieces between single spaces, at which its pre-tokeniser always cuts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: ids of a piece by what stands after a space, with that space; and of first pieces, without one.
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: ids of a text without special tokens by merge ranks, where the vocabulary allows it: whole texts then take less time than the library takes for the words that it has not seen.
        self.quick = _by_rank(self.library)
        self.marks = {m: array("I", self.library.encode(m, add_special_tokens=False).ids).tobytes() for m in ",."}

    def _known(self, memo: dict[str, bytes], wanted: set[str], old: dict[str, bytes]) -> set[str]:
        """Those of the wanted pieces that neither memo holds; the others are in the younger one then."""
        missing = wanted.difference(memo)
        again = missing.intersection(old)
        if again:
            memo.update({x: old[x] for x in again})
            missing -= again
        return missing

    def _fill(self, memo: dict[str, bytes], wanted: set[str], before: str) -> None:
        old = self.old if before else {}
        missing = self._known(memo, wanted, old)
        # the pre-tokeniser always cuts between a letter and such a mark
        ended = [x for x in missing if x[-1:] in self.marks and x[:-1].isalpha()]
        if ended:
            missing.difference_update(ended)
            missing |= self._known(memo, {x[:-1] for x in ended}, old)
        asked = list(missing)
        encoded = self.library.encode_batch_fast([before + x for x in asked] if before else asked, add_special_tokens=False)
        memo.update(zip(asked, [array("I", e.ids).tobytes() for e in encoded], strict=True))
        memo.update({x: memo[x[:-1]] + self.marks[x[-1]] for x in ended})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        if self.quick:
            # texts that may hold a special token go to the library, and those with a run of white space that the other's pattern cannot get through
            odd = ["<|" in t or len(t) > LONG and _LONG_RUN.search(t) is not None for t in texts]
            return [array("I", self.library.encode(t, add_special_tokens=False).ids if o else self.quick(t)).tobytes() for t, o in zip(texts, odd, strict=True)]
        if len(self.spaced) > common.MEMO_ENTRIES:
            self.old, self.spaced = self.spaced, {}
        self.bare.clear()
        pieces = [[t] if "<|" in t or _UNSAFE.search(t) else t.split(" ") for t in texts]
        first = [p.pop(0) for p in pieces]
        self._fill(self.bare, set(first), "")
        self._fill(self.spaced, set().union(*pieces), " ")
        held = self.spaced.__getitem__
        return [self.bare[f] + b"".join(map(held, p)) for f, p in zip(first, pieces, strict=True)]


def encoder(path: str) -> Encoder:
    return common.held(f"castore {path}", lambda: Encoder(path))


def _gear(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 32-bit number of each id."""
    x = ids.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA6B)
    return x ^ (x >> np.uint32(13))


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For documents laid end to end (ends: where each ends): the ends of their chunks. A cut depends on the document's own ids only."""
    gear = _gear(ids)
    # the sum over the last WINDOW ids of gear << age, by doubling the window
    h, k = gear, 1
    while k < WINDOW and k < len(ids):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h, k = wider, 2 * k
    candidates = (np.flatnonzero((h & MASK) == 0) + 1).tolist()
    out, c, n, start = [], 0, len(candidates), 0
    for end in ends.tolist():
        own, last = [], start
        while c < n and candidates[c] < end:
            at = candidates[c]
            while at - last > MAX_IDS:
                last += MAX_IDS
                own.append(last)
            if at - last >= MIN_IDS:
                own.append(at)
                last = at
            c += 1
        while end - last > MAX_IDS:
            last += MAX_IDS
            own.append(last)
        if end > last:
            own.append(end)
        while c < n and candidates[c] <= end:
            c += 1
        out.append(own)
        start = end
    return out


@lru_cache(maxsize=1)
def _frames():
    """A compressor and a decompressor, once in each process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + _frames()[0].compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(payload: bytes) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    raw = _frames()[1].decompress(payload[1:])
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if payload[0] == 2 else raw


def _body_root(body: list[dict]) -> bytes:
    return hashlib.sha256(b"".join(x["hash"] + x["n"].to_bytes(4, "little") for x in body)).digest()


_ENTRIES = pa.list_(pa.struct([("hash", pa.binary()), ("n", pa.int32())]))


def _encode_rows(batches: Iterator[pa.RecordBatch], key: str, text: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 (a chunk: hash, n, payload) and of kind 1 (a document: key, n, root as hash, entries)."""
    seen: set[bytes] = set()
    for batch in batches:
        for part, texts in common.slices(batch, text):
            end = array("I", [end_id]).tobytes()
            streams = [x + end for x in encoder(path).encode(texts)]
            raw = b"".join(streams)
            ids = np.frombuffer(raw, "<u4")
            ends = np.cumsum([len(x) // 4 for x in streams])
            start, roots, entries, hashes, sizes, payloads = 0, [], [], [], [], []
            for own in cuts(ids, ends):
                body = []
                for stop in own:
                    digest = hashlib.sha256(memoryview(raw)[4 * start : 4 * stop]).digest()
                    body.append({"hash": digest, "n": stop - start})
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        hashes.append(digest)
                        sizes.append(stop - start)
                        payloads.append(pack(ids[start:stop]))
                    start = stop
                entries.append(body)
                roots.append(_body_root(body))
            keys = part.column(key)
            n, m = len(texts), len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), keys, pa.array([len(x) // 4 for x in streams], pa.int64()), pa.array(roots, pa.binary()), pa.nulls(n, pa.binary()), pa.array(entries, _ENTRIES)],
                ["kind", "key", "n", "hash", "payload", "entries"],
            )
            if m:
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.nulls(m, keys.type), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(payloads, pa.binary()), pa.nulls(m, _ENTRIES)], ["kind", "key", "n", "hash", "payload", "entries"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops repeated chunks; all rows of a hash are in one partition, at most one from each task before. It holds half the hash of each chunk of the partition, a small part of what the partition's payloads take."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, h in zip(batch.column("kind").to_pylist(), batch.column("hash").to_pylist(), strict=True):
            keep.append(kind == 1 or h[:16] not in seen)
            if kind == 0:
                seen.add(h[:16])
        yield batch.filter(pa.array(keep, pa.bool_()))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> str:
    """Encodes and stores whole texts; the folder."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"kind int, key {kind}, n long, hash binary, payload binary, entries array<struct<hash:binary,n:int>>"
    rows = docs.select(key, text).mapInArrow(lambda b: _encode_rows(b, key, text, tokenizer, end_id), schema)
    # chunks meet by hash; documents are spread by key and hash, so that copies are spread too
    dealt = rows.repartition(F.when(F.col("kind") == 0, F.xxhash64("hash")).otherwise(F.xxhash64("key", "hash")))
    dealt.mapInArrow(_once, schema).write.partitionBy("kind").option("compression", "none").parquet(f"{folder}/rows")
    recipes = spark.read.schema(schema).parquet(f"{folder}/rows").where("kind = 1").select(F.col("key").alias("doc_id"), F.col("n").alias("n_tokens"), F.col("hash").alias("root"), "entries")
    # equal rows, and rows without an id, are told apart by their place, so that they too can lie in several partitions
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("_tie")]
    ordered = recipes.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = StructType(list(ordered.schema)).add("part", "integer").add("pos", "long").add("own", "long")
    ordered.mapInArrow(_place, placed).write.parquet(f"{folder}/recipes")
    written = spark.read.schema(placed).parquet(f"{folder}/recipes")
    before, offsets = 0, []
    for r in written.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(offsets, "part int, before long").coalesce(1).write.parquet(f"{folder}/parts")
    spark.createDataFrame([(placed.json(),)], "value string").coalesce(1).write.text(f"{folder}/schema")
    common.delete(spark, f"{folder}/rows/kind=1")
    merkle(spark, folder).write.parquet(f"{folder}/manifest")
    return folder


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place of each row in it and the ids before."""
    from pyspark import TaskContext

    part, pos, own = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        ends = own + np.cumsum(n)
        more = [pa.array(np.full(len(n), part, np.int32)), pa.array(pos + np.arange(len(n))), pa.array(ends - n)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "part", "pos", "own"])
        if len(n):
            pos, own = pos + len(n), int(ends[-1])


def _root(*order: str):
    """SHA-256 of the roots of a group, in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, "root"))), lambda x: F.hex(x["root"]))
    return F.unhex(F.sha2(F.unhex(F.array_join(listed, "")), 256))


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    """The recipes and where each starts; with the schema that was stored beside them, as an empty table has no file to tell it."""
    held = spark.read.text(f"{folder}/schema").first()[0]
    recipes = spark.read.schema(StructType.fromJson(json.loads(held))).parquet(f"{folder}/recipes")
    # a row for each partition of the recipes
    parts = F.broadcast(spark.read.schema("part int, before long").parquet(f"{folder}/parts"))
    return recipes.join(parts, "part", "left").withColumn("start", F.col("before") + F.col("own")).drop("before", "own")


def merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The tree over the recipes as they are stored: level 1 blocks, level 2 parts, level 3 the whole."""
    told = F.concat_ws(":", F.hex("root"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens")
    recipes = _recipes(spark, folder).select("part", "pos", F.unhex(F.sha2(told, 256)).alias("root"), (F.col("pos") / BLOCK).cast("long").alias("block"))
    one = recipes.groupBy("part", "block").agg(F.count("*").alias("n"), _root("pos").alias("root"))
    two = one.groupBy("part").agg(F.sum("n").alias("n"), _root("block").alias("root"))
    three = two.agg(F.sum("n").alias("n"), _root("part").alias("root"))
    none = F.lit(None).cast("long")
    return (
        one.select(F.lit(1).alias("level"), F.col("part").cast("long").alias("part"), "block", "n", "root")
        .unionByName(two.select(F.lit(2).alias("level"), F.col("part").cast("long").alias("part"), none.alias("block"), "n", "root"))
        .unionByName(three.where("n > 0").select(F.lit(3).alias("level"), none.alias("part"), none.alias("block"), "n", "root"))
    )


def verify(spark: SparkSession, folder: str) -> int:
    """How many rows of the manifest and of the tree over the stored recipes have no equal on the other side."""
    names = ["level", "part", "block", "n", "root"]
    now = merkle(spark, folder).select(names)
    held = spark.read.schema(now.schema).parquet(f"{folder}/manifest").select(names)
    return held.exceptAll(now).count() + now.exceptAll(held).count()


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("kind int, n long, hash binary, payload binary").parquet(f"{folder}/rows").where("kind = 0").select("hash", "n", "payload")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for h, n, payload in zip(*(batch.column(c).to_pylist() for c in ("hash", "n", "payload")), strict=True):
            raw = unpack(payload)
            if hashlib.sha256(raw).digest() != h or len(raw) != 4 * n:
                raise ValueError(f"chunk {h.hex()} is damaged")
            crc.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crc, pa.int64())], ["hash", "crc"])


@lru_cache(maxsize=1 << 16)
def _shift(n: int) -> tuple[int, ...]:
    """The images of the 32 unit vectors when n zero bytes are appended to what a CRC-32 was taken of (without its final inversion)."""
    if n == 1:
        out = []
        for b in range(32):
            x = 1 << b
            for _ in range(8):
                x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
            out.append(x)
        return tuple(out)
    half = _shift(n // 2)
    twice = [_apply(half, x) for x in half]
    return tuple(_apply(_shift(1), x) for x in twice) if n % 2 else tuple(twice)


def _apply(images: tuple[int, ...], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= images[low.bit_length() - 1]
        x ^= low
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from (crc32, bytes) of its parts."""
    crc = 0
    for c, n in parts:
        crc = (_apply(_shift(n), crc) if n else crc) ^ c
    return crc


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots, n_tokens, crcs = batch.column("root").to_pylist(), [], []
        for root, body in zip(roots, batch.column("body").to_pylist(), strict=True):
            if _body_root(body) != root or any(x["crc"] is None for x in body):
                raise ValueError(f"recipe {root.hex()} is damaged")
            n_tokens.append(sum(x["n"] for x in body))
            crcs.append(joined_crc([(x["crc"], 4 * x["n"]) for x in body]))
        yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.int64()), batch.column("copies")], ["root", "n_tokens", "ids_crc32", "copies"])


def check(spark: SparkSession, folder: str) -> None:
    """Raises an error if the tree over the stored recipes has another root than the manifest."""
    now = merkle(spark, folder)
    held = spark.read.schema(now.schema).parquet(f"{folder}/manifest")
    tops = [sorted((r["n"], bytes(r["root"])) for r in x.where("level = 3").collect()) for x in (now, held)]  # one row each
    if tops[0] != tops[1]:
        raise ValueError(f"the recipes of {folder} are not those of its manifest")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored documents, from the files. The manifest is checked first; every chunk is read and checked where it lies; the CRCs of a document's chunks are joined in the order of its recipe, so no payload moves."""
    check(spark, folder)
    recipes = _recipes(spark, folder)
    held = chunks(spark, folder).mapInArrow(_checked, "hash binary, crc long")
    distinct = recipes.groupBy("root").agg(F.any_value("entries").alias("entries"), F.count("*").alias("copies"))
    entries = distinct.select("root", "copies", F.posexplode("entries").alias("seq", "e")).select("root", "copies", "seq", F.col("e.hash").alias("hash"), F.col("e.n").alias("n"))
    bodies = entries.join(held, "hash", "left").groupBy("root").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("seq", "hash", "n", "crc"))).alias("body"))
    # a row for each distinct document; those with many copies go to the copies
    read = common.cut(bodies.mapInArrow(_bodies, "root binary, n_tokens long, ids_crc32 long, copies long"), "store-digests")
    return common.reads(common.join_counted(recipes.select("doc_id", "start", "root"), read, "root", "copies").select("doc_id", "start", "n_tokens", "ids_crc32"), read)


def read_ids(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids (array<int>) of the stored documents (doc_ids: of these only), rebuilt from their chunks."""
    check(spark, folder)
    recipes = _recipes(spark, folder)
    if doc_ids is not None:
        recipes = recipes.where(F.col("doc_id").isin(doc_ids))
    entries = recipes.select("doc_id", "start", F.posexplode("entries").alias("seq", "e")).select("doc_id", "start", "seq", F.col("e.hash").alias("hash"))
    body = entries.join(chunks(spark, folder), "hash").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(unpack(x["payload"]) for x in b), "<u4").astype(np.int32) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return body.mapInArrow(run, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, ids array<int>")
