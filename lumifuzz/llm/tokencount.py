"""Token counts by a compiled finite-state transducer.

The BPE vocabulary of a sentencepiece file is compiled, on demand, to a deterministic transducer over characters. A state
holds the longest suffix read that begins some piece and, for each position of that suffix, the last piece of the encoding
of the text up to there with its token count relative to now: all that later characters can depend on. Each transition is
annotated with the number of tokens that it adds (which is negative where it merges earlier ones). A piece may follow
another only if BPE leaves the two as they are; that is decided once for each pair.

A text is counted by its chunks. The map of a chunk tells for an entry state the exit state and the tokens between; the maps of two chunks,
one after the other, compose to that of both, and composition is associative:

- No piece holds a space mark after another character, and characters without a piece of their own stand for their bytes, so
  the transducer is in its start state before a run of space marks and around such characters, whatever came before. Chunks between two such
  places have constant maps: they all lead to the start state, and composing them adds their counts. So the prefix scan over the
  chunk maps of all texts of a batch, laid end to end, is one cumulative sum, of which each text is a difference.
- A longer chunk is cut into blocks of BLOCK characters. A block's map is tabulated for the states that any reading of the WARM characters
  before it can end in from the start state and from the states met so far, and for those that a composition asks for later; the
  blocks' maps are composed in a tree.

Null texts count as empty; an empty text has no tokens. Equal texts give equal rows, rows come back one for one, and
the input's other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumifuzz.llm import common

SPACE = "▁"
START = -1
#: States at which a worker's transducer is compiled anew.
MAX_STATES = 300_000
#: Characters of a block of a longer chunk, and of the reading before it that tells its likely entry states.
BLOCK, WARM = 1 << 14, 64


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self.pieces = list(self.score)
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self._automaton()
        self.reset()
        #: Counts of chunk maps: of words after a space, and of chunks as they are.
        self.spaced = common.Memo(lambda word: self.chunk_map(SPACE + word)[1])
        self.bare = common.Memo(lambda chunk: self.chunk_map(chunk)[1])
        self.newline = self.run(0, "\n")[1] if "\n" not in self.score else None

    def _automaton(self) -> None:
        """Aho-Corasick over the pieces: next node, depth, and the lengths of the pieces that end at a node, longest first."""
        self.go: list[dict[str, int]] = [{}]
        self.depth, ends = [0], [False]
        for p in self.pieces:
            node = 0
            for c in p:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = len(self.go)
                    self.go[node][c] = nxt
                    self.go.append({})
                    self.depth.append(self.depth[node] + 1)
                    ends.append(False)
                node = nxt
            ends[node] = True
        self.fail = [0] * len(self.go)
        self.lengths: list[tuple[int, ...]] = [()] * len(self.go)
        queue = list(self.go[0].values())
        for node in queue:
            for c, nxt in self.go[node].items():
                f = self.fail[node]
                while f and c not in self.go[f]:
                    f = self.fail[f]
                self.fail[nxt] = self.go[f].get(c, 0)
                queue.append(nxt)
            self.lengths[node] = ((self.depth[node],) if ends[node] else ()) + self.lengths[self.fail[node]]

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.trans: list[dict[str, tuple[int, int]]] = []
        #: Pairs of pieces that the compiled transitions asked about; they go with them.
        self.follows: dict[tuple[int, int], bool] = {}
        self.state((0, "", ((START, 0),)))

    def state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.trans.append({})
        return at

    def merged(self, text: str) -> list[str]:
        """BPE of a short string by its definition: the pair with the best score first, the leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, before: int, piece: int) -> bool:
        out = self.follows.get((before, piece))
        if out is None:
            b = self.pieces[piece]
            a = [] if before == START else [self.pieces[before]]
            out = self.follows[before, piece] = self.merged("".join([*a, b])) == [*a, b]
        return out

    def step(self, at: int, c: str) -> tuple[int, int]:
        """Compiles the transition from state at on character c: the next state and the tokens it adds."""
        if c not in self.number:
            return 0, len(c.encode("utf-8", "surrogatepass"))
        node, tail, window = self.keys[at]
        while node and c not in self.go[node]:
            node = self.fail[node]
        node = self.go[node].get(c, 0)
        tail += c
        for n in self.lengths[node]:
            piece = self.number[tail[len(tail) - n :]]
            before, count = window[len(window) - n]
            if self.may_follow(before, piece):
                break
        else:
            raise ValueError(f"no encoding of {tail!r}")
        added = count + 1
        d = self.depth[node]
        window = (*((p, k - added) for p, k in window), (piece, 0))[-d - 1 :] if d < len(window) + 1 else (*((p, k - added) for p, k in window), (piece, 0))
        return self.state((node, tail[len(tail) - d :], window)), added

    def run(self, at: int, text: str) -> tuple[int, int]:
        """The state after text, and the tokens it added."""
        if len(self.keys) > MAX_STATES:
            key = self.keys[at]
            self.reset()
            at = self.state(key)
        n, trans = 0, self.trans
        for c in text:
            to = trans[at].get(c)
            if to is None:
                to = trans[at][c] = self.step(at, c)
            at, more = to
            n += more
        return at, n

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut before each run of space marks."""
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE)) if text else []

    def chunk_map(self, chunk: str) -> tuple[int, int]:
        """(exit state, tokens) of a chunk that is entered in the start state, as all are."""
        if len(chunk) <= BLOCK:
            return self.run(0, chunk)
        return reduced([BlockMap(self, chunk, i) for i in range(0, len(chunk), BLOCK)])(0)

    def chunk_counts(self, text: str) -> list[int]:
        """The tokens of a text's chunks, one after the other."""
        if not text:
            return []
        if self.newline is None or SPACE in text or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return list(map(self.bare.__getitem__, self.chunks(text)))
        first, *lines = text.split("\n")
        out = list(map(self.spaced.__getitem__, first.split(" ")))
        for line in lines:
            out.append(self.newline)
            if line:
                head, *rest = line.split(" ")
                out.append(self.bare[head])
                out += map(self.spaced.__getitem__, rest)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts: the prefix scan of their chunk maps, at the ends of the texts."""
        chunks = list(map(self.chunk_counts, texts))
        scan = np.concatenate([[0], np.cumsum(np.fromiter(chain.from_iterable(chunks), np.int64))])
        ends = np.cumsum([len(c) for c in chunks])
        return np.diff(scan[ends], prepend=0) if len(ends) else ends

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])


class BlockMap:
    """The map of a block of a chunk: entry state to (exit state, tokens)."""

    def __init__(self, machine: Transducer, chunk: str, start: int):
        self.machine, self.text, self.key = machine, chunk[start : start + BLOCK], {}
        self.size = len(self.text)
        entries = [machine.keys[0]]
        if start:
            before = chunk[max(0, start - WARM) : start]
            entries += [machine.keys[machine.run(0, before[i:])[0]] for i in (0, len(before) // 2)]
        for e in dict.fromkeys(entries):
            self.by_key(e)

    def by_key(self, entry: tuple) -> tuple[tuple, int]:
        """States are named by what they hold, as numbers change when the transducer is compiled anew."""
        out = self.key.get(entry)
        if out is None:
            at, n = self.machine.run(self.machine.state(entry), self.text)
            out = self.key[entry] = self.machine.keys[at], n
        return out

    def __call__(self, at: int) -> tuple[int, int]:
        key, n = self.by_key(self.machine.keys[at])
        return self.machine.state(key), n


class Composed:
    """The map of two maps, one after the other."""

    def __init__(self, one, other):
        self.machine, self.one, self.other, self.key = one.machine, one, other, {}
        for e in one.key:
            self.by_key(e)

    def by_key(self, entry: tuple) -> tuple[tuple, int]:
        out = self.key.get(entry)
        if out is None:
            middle, n = self.one.by_key(entry)
            end, m = self.other.by_key(middle)
            out = self.key[entry] = end, n + m
        return out

    __call__ = BlockMap.__call__


def reduced(maps: list):
    """The map of all, composed in a tree: neighbours first, then their maps."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def engine(path: str) -> Transducer:
    return common.held(f"tokencount {path}", lambda: Transducer(path))


def count_tokens(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        one = engine(path)
        n = one.counts(texts)
        return {
            "n_bytes": pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array(n > limit, pa.bool_()),
        }

    return common.map_texts(docs, work, "n_bytes long, n_tokens long, over_limit boolean", key, text)
