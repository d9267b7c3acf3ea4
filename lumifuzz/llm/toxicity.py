"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two strings counts the subsequences of LENGTH characters that they share, within a span of SPAN characters; each character
skipped inside a subsequence costs a factor of DECAY. Strings are words with marks for their start and end,
folded to a small alphabet (case, rare letters, digits and signs that stand for letters), so that an insult with gaps or inserted
characters keeps most of its subsequences, and runs of single letters are read as one word.

The machine is trained on labelled sentences as on bags of instances: a toxic text is toxic for some word in it, and no word of a clean text is.
Candidates for witnesses are words and word beginnings that are far more frequent in toxic texts than in others, beyond chance. Witnesses
are chosen from them so that as many toxic texts as possible hold WITNESSES of them, whatever their language, and each text shares a weight
of 1 among those that it holds. They are the landmarks and, with copies that have a letter put in, the positive instances; words of clean texts are the negative ones,
then, in further fits, the clean words that the machine rated highest. A Nyström map over the landmarks turns the kernel machine
into one linear in landmark kernels, which folds into one table of subsequence weights: rating a word is a sum of
table entries. A document's score is a logistic function, fitted to the training documents, of its highest and its third highest word and of the share of its words on the
toxic side, as a word that resembles an insult may stand in a clean text by chance, but seldom several times.

The fit uses at most MAX_TOXIC and MAX_CLEAN labelled documents (least key hashes), LANDMARKS landmarks out of POOL candidates and
NEGATIVES words of clean documents. Null texts count as empty; texts without words have the lowest score; equal texts get equal scores.
Without labels of both kinds every score is 0. An empty table gives an empty result; the input's other columns are never used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common, labelled

LENGTH, SPAN, DECAY = 3, 6, 0.5
MAX_TOXIC, MAX_CLEAN = 4000, 8000
LANDMARKS, POOL, WITNESSES, NEGATIVES, HARD = 300, 3000, 5, 20_000, 1000
PREFIXES = (4, 5, 6)
#: How many times as frequent a witness is in toxic texts, and copies of it with a letter put in.
RATIO, COPIES = 15, 2
#: What errors cost against the size of the weights.
COST = 10.0
PREDICTED_FROM = 0.3
#: Steps from the first character of a subsequence to the others.
_STEPS = [c for c in combinations(range(1, SPAN), LENGTH - 1)]
_WEIGHTS = [DECAY ** (c[-1] - LENGTH + 1) for c in _STEPS]
#: Letters that have a code of their own; others count as their base letter, or as one code for all that have none.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôùûñáíóú"
_START, _END, _OTHER = range(len(_LETTERS) + 1, len(_LETTERS) + 4)
_BASE = _OTHER + 1
_TABLE = _BASE**LENGTH

_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .*_-]{1,2}\w){2,}(?!\S)")


def _code(c: str) -> int:
    c = _SIGNS.get(c, c)
    at = _LETTERS.find(c) if c in _LETTERS else _LETTERS.find(unicodedata.normalize("NFKD", c)[0])
    return at + 1 or _OTHER


_codes: dict[str, int] = {}


def codes(word: str, whole: bool = True) -> list[int]:
    out = [_START]
    for c in word:
        n = _codes.get(c)
        if n is None:
            n = _code(c)
            if len(_codes) < 100_000:
                _codes[c] = n
        out.append(n)
    return [*out, _END] if whole else out


def _size(n: int) -> float:
    """The kernel's norm for strings of n codes: from the number of subsequences alone."""
    return max(1e-9, sum(w * w * max(0, n - c[-1]) for c, w in zip(_STEPS, _WEIGHTS, strict=True))) ** 0.5


def _subsequences(m: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For strings of one length (rows of m): table places of the subsequences of each shape, and the shape's weight."""
    n = m.shape[1]
    for c, w in zip(_STEPS, _WEIGHTS, strict=True):
        k = n - c[-1]
        if k > 0:
            at = m[:, :k]
            for s in c:
                at = at * _BASE + m[:, s : s + k]
            yield at, w


def _by_length(strings: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, strings of one length as rows), in parts of bounded size."""
    lengths = np.array([len(s) for s in strings])
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        most = max(1, 400_000 // n)
        for i in range(0, len(where), most):
            some = where[i : i + most]
            yield some, np.array([strings[j] for j in some], np.int32)


@dataclass
class Model:
    table: np.ndarray | None
    bias: float = 0.0
    #: Weights of a document's features, the last one of a constant.
    curve: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)

    def __getstate__(self) -> tuple:
        """Sent with the table's non-zero entries only."""
        at = None if self.table is None else np.flatnonzero(self.table).astype(np.int32)
        return at, None if at is None else self.table[at], self.bias, self.curve

    def __setstate__(self, state: tuple) -> None:
        at, values, self.bias, self.curve = state
        self.table = None
        if at is not None:
            self.table = np.zeros(_TABLE, np.float32)
            self.table[at] = values

    def rate(self, strings: list[list[int]]) -> np.ndarray:
        """The machine's value of each string."""
        out = np.full(len(strings), self.bias)
        for where, m in _by_length(strings):
            value = np.zeros(len(where))
            for at, w in _subsequences(m):
                value += w * self.table[at].sum(axis=1)
            out[where] += value / _size(m.shape[1])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        """Of documents' features, as rows."""
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.curve[:-1]) + self.curve[-1], -30, 30)))


def word_list(text: str) -> list[str]:
    """The lower-cased words of a text, without signs around them; runs of single letters as one more word each."""
    low = text.lower()
    out = low.split()
    if _SPELLED.search(low):
        out += [re.sub(r"\W|_", "", x) for x in _SPELLED.findall(low)]
    return out


def _trim(chunk: str) -> str:
    return chunk if chunk.isalnum() else _OUTER.sub("", chunk)


def variants(chunk: str) -> list[str]:
    """What a chunk can be read as: without signs around it, and without those inside."""
    word = _trim(chunk)
    if not word:
        return []
    inner = word if word.isalnum() else "".join(c for c in word if c.isalnum())
    return [word] if inner == word else [word, inner]


#: The least value of a word, and of a text without any.
LEAST = -5.0


class Rater:
    """Features of whole texts, with a memo of chunks."""

    def __init__(self, model: Model):
        self.model, self.memo, self.old = model, {}, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text, as rows: the highest value of its words, the third highest (or the lowest of fewer), and the logarithm of the percentage of words above 0, plus 1."""
        if len(self.memo) > common.MEMO_ENTRIES:
            self.old, self.memo = self.memo, {}
        chunks = [word_list(t) for t in texts]
        memo, missing = self.memo, []
        for x in set().union(*chunks) if chunks else ():
            if x not in memo:
                if (held := self.old.get(x)) is None:
                    missing.append(x)
                else:
                    memo[x] = held
        read = [variants(x) for x in missing]
        owner = [i for i, v in enumerate(read) for _ in v]
        value = np.full(len(missing), -np.inf)
        if owner:
            np.maximum.at(value, owner, self.model.rate([codes(v) for r in read for v in r]))
        memo.update(zip(missing, value.tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        out[:, :2] = LEAST
        for i, c in enumerate(chunks):
            if c:
                v = np.fromiter(map(memo.__getitem__, c), float, len(c))
                top = np.partition(v, len(v) - 3)[-3:] if len(v) > 3 else v
                out[i] = max(top.max(), LEAST), max(top.min(), LEAST), np.log1p(100 * np.count_nonzero(v > 0) / len(v))
        return out


def _landmark_kernels(strings: list[list[int]], marks: list[list[int]]) -> np.ndarray:
    """Kernels of strings (rows) and landmarks (columns)."""
    place = np.zeros(_TABLE, np.int32)
    rows: dict[int, int] = {}
    cells: list[tuple[int, int, float]] = []
    for where, m in _by_length(marks):
        for at, w in _subsequences(m):
            for j, row in zip(where.tolist(), at.tolist(), strict=True):
                cells += [(rows.setdefault(u, len(rows) + 1), j, w / _size(m.shape[1])) for u in row]
    dense = np.zeros((len(rows) + 1, len(marks)), np.float32)
    for r, j, w in cells:
        dense[r, j] += w
    for u, r in rows.items():
        place[u] = r
    out = np.zeros((len(strings), len(marks)), np.float32)
    for where, m in _by_length(strings):
        for start in range(0, len(where), 2000):
            part = m[start : start + 2000]
            total = np.zeros((len(part), len(marks)), np.float32)
            for at, w in _subsequences(part):
                spots = place[at]
                for k in range(spots.shape[1]):
                    hit = np.flatnonzero(spots[:, k])
                    total[hit] += w * dense[spots[hit, k]]
            out[where[start : start + 2000]] = total / _size(m.shape[1])
    return out


def train(positives: list[list[int]], weights: np.ndarray, negatives: list[list[int]], marks: list[list[int]]) -> Model:
    """A squared-hinge machine over the landmarks' Nyström map, folded into a table of subsequence weights."""
    k = _landmark_kernels(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = _landmark_kernels(positives + negatives, marks) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    c = np.concatenate([weights / weights.sum(), np.full(len(negatives), 1 / max(1, len(negatives)))]) * COST
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 0.02
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        inside = y * (x @ w) < 1
        a = x[inside] * c[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    beta = root @ w[:-1]
    table = np.zeros(_TABLE, np.float32)
    for where, m in _by_length(marks):
        for at, v in _subsequences(m):
            np.add.at(table, at, (v * beta[where] / _size(m.shape[1]))[:, None])
    return Model(table, float(w[-1]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows and the least hash of their 4-word shingles, which near copies mostly share and others never."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for part, texts in common.slices(batch):
            cut = [t.lower().split() for t in texts]
            least = [min(xxh64_intdigest(" ".join(w[i : i + 4])) >> 1 for i in range(max(1, len(w) - 3))) for w in cut]
            yield part.append_column("bucket", pa.array(least, pa.int64()))


def _bag(text: str) -> Counter:
    """How often each word, as it can be read, and each beginning of one (with a star) stands in a text."""
    out: Counter = Counter()
    for x, n in Counter(word_list(text)).items():
        for v in variants(x):
            if len(v) <= common.MEMO_CHARS:
                out[v] += n
                for k in PREFIXES:
                    if len(v) > k:
                        out[f"{v[:k]}*"] += n
    return out


_COUNTS = ("toxic", "clean", "toxic_n", "clean_n")


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word (or a beginning, with a star), and in how many texts of each kind and how often in all it stands, added up in the task as far as memory is bounded. The empty word counts the texts, and all words."""
    seen: dict[str, list[int]] = {}

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))], ["word", *_COUNTS])
        seen.clear()
        return out

    for batch in batches:
        for part, texts in common.slices(batch):
            for t, label in zip(texts, part.column("label").to_pylist(), strict=True):
                bag = _bag(t)
                bag[""] = len(word_list(t))
                for w, n in bag.items():
                    own = seen.setdefault(w, [0, 0, 0, 0])
                    own[1 - label] += 1
                    own[3 - label] += n
                if len(seen) > 400_000:
                    yield told()
    yield told()


def _log_tail(k: int, n: int, q: float) -> float:
    """Logarithm of the chance of k or more out of n."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log1p(-q) for i in range(k, n + 1)]
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


def _held(toxic: DataFrame, pool: list[str]) -> list[list[int]]:
    """The places of the candidates that each toxic text holds: at most MAX_TOXIC rows."""
    place = {w: i for i, w in enumerate(pool)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in common.slices(batch):
                rows = []
                for t in texts:
                    rows.append(sorted(place[w] for w in _bag(t) if w in place))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["held"])

    return sorted(r["held"] for r in toxic.select("text").mapInArrow(run, "held array<int>").collect())


def _witnesses(held: list[list[int]], n: int) -> tuple[list[int], np.ndarray]:
    """The candidates, one after the other, that most texts with fewer than WITNESSES chosen ones hold (the first of equals), and their weights: each text shares 1 among those that it holds."""
    m = np.zeros((len(held), n), np.float32)
    for i, own in enumerate(held):
        m[i, own] = 1
    lacking, chosen, left = np.full(len(held), float(WITNESSES), np.float32), [], np.ones(n, np.float32)
    while len(chosen) < min(LANDMARKS, n):
        gain = (np.minimum(lacking, 1) @ m) * left
        j = int(gain.argmax())
        if gain[j] <= 0:
            break
        chosen.append(j)
        left[j] = 0
        lacking = np.maximum(lacking - m[:, j], 0)
    own = m[:, chosen]
    shared = own / np.maximum(own.sum(axis=1, keepdims=True), 1)
    return chosen, shared.sum(axis=0) + 1e-3


def _with_copies(words: list[str], weights: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """The words, and copies of the whole ones with a letter put in somewhere, which share half of the weight; the same at every run."""
    draw = np.random.default_rng(33)
    strings, out = [], []
    for w, weight in zip(words, weights.tolist(), strict=True):
        copies = COPIES if w[-1] != "*" and len(w) > 3 else 0
        strings.append(_string(w))
        out.append(weight / 2 if copies else weight)
        for _ in range(copies):
            at = int(draw.integers(1, len(w)))
            strings.append(_string(w[:at] + _LETTERS[int(draw.integers(0, 26))] + w[at:]))
            out.append(weight / 2 / copies)
    return strings, np.array(out)


def _string(word: str) -> list[int]:
    return codes(word[:-1], False) if word[-1] == "*" else codes(word)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    made: list[DataFrame] = []
    try:
        return _fit(docs, labels, learn, label, key, text, made)
    finally:
        common.drop(*made)


def _fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str, key: str, text: str, made: list[DataFrame]) -> Model:
    """made: gets the written tables, of which nothing is read any more once the model is there."""
    spark = docs.sparkSession
    picked = labelled.sample(docs, labels, label, learn, {0: MAX_CLEAN, 1: MAX_TOXIC}, key, text)
    marked = picked.mapInArrow(_buckets, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema) + ", bucket long")
    picked = common.cut(marked, "toxicity-sample")
    made.append(picked)
    # of near copies one, the first by key
    apart = picked.groupBy("bucket", "label").agg(F.min(F.struct("key", "text")).alias("one")).select("label", "one.text")
    n = {r["label"]: r["count"] for r in apart.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(None)
    found = apart.mapInArrow(_instances, "word string, " + ", ".join(f"{c} long" for c in _COUNTS))
    words = common.cut(found.groupBy("word").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "toxicity-words")
    made.append(words)
    every = words.where("word = ''").first()
    words = words.where("word <> ''")
    a, b = F.col("toxic") / n[1], F.col("clean") / n[0]
    share = (F.col("toxic") + F.col("clean")) / (n[0] + n[1])
    surprise = (a - b) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    # frequent among the words of toxic texts, and in several of them
    often = F.col("toxic_n") / max(1, every["toxic_n"]) > RATIO * F.col("clean_n") / max(1, every["clean_n"])
    ranked = words.withColumn("z", surprise).where((F.col("toxic") > 1) & often).orderBy(F.desc("z"), F.length("word"), "word")
    total = words.count()
    pool = [(r["word"], _log_tail(r["toxic"], r["toxic"] + r["clean"], n[1] / (n[0] + n[1]))) for r in ranked.limit(POOL).collect()]
    # not by chance: of those kept, one in twenty would be, if so many words were drawn at random
    by_chance = sorted(p for _, p in pool)
    worst = max((p for k, p in enumerate(by_chance, 1) if p <= math.log(0.05 * k / total)), default=-math.inf)
    pool = [w for w, p in pool if p <= worst] or [w for w, _ in pool[:10]]
    if not pool:
        return Model(None)
    chosen, weights = _witnesses(_held(apart.where("label = 1"), pool), len(pool))
    landmarks = [_string(pool[j]) for j in chosen]
    positives, weights = _with_copies([pool[j] for j in chosen], weights)
    clean = words.where("clean > 0 and not endswith(word, '*')")
    others = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()]
    marks = landmarks + [codes(w) for w in others[: max(20, len(landmarks) // 3)]]
    model = train(positives, weights, [codes(w) for w in others], marks)
    for _ in range(2):
        sent = spark.sparkContext.broadcast(model)

        def rated(batches, sent=sent):
            for batch in batches:
                w = batch.column("word").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(sent.value.rate([codes(x) for x in w]), pa.float64())], ["word", "value"])

        hard = clean.select("word").mapInArrow(rated, "word string, value double").orderBy(F.desc("value"), "word").limit(HARD)
        others += [r["word"] for r in hard.collect()]
        model = train(positives, weights, [codes(w) for w in dict.fromkeys(others)], marks)
    sent = spark.sparkContext.broadcast(model)

    def told(batches):
        rater = Rater(sent.value)
        for batch in batches:
            for part, texts in common.slices(batch):
                x = rater.features(texts)
                yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(x[:, k]) for k in range(3))], ["label", "x0", "x1", "x2"])

    # a row for each document of the sample
    rows = sorted(tuple(r) for r in picked.mapInArrow(told, "label int, x0 double, x1 double, x2 double").collect())
    model.curve = _logistic(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, ...]:
    """Weights of the features, and of a constant, of a ridge-penalised logistic curve; no feature counts for a clean text."""
    m = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(m.shape[1])
    w[0] = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        slope = m.T @ (y - p) - 0.01 * w
        bend = (m * (p * (1 - p))[:, None]).T @ m + 0.01 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step / max(1, np.abs(step).max() / 3)
        w[:-1] = np.maximum(w[:-1], 0)
    return tuple(map(float, w))


def rate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted (1 from PREDICTED_FROM) of each whole text."""
    if model.table is None:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        model = sent.value
        rater = common.held("toxicity", lambda: Rater(model))
        if rater.model is not model:
            common.release()
            rater = common.held("toxicity", lambda: Rater(model))
        s = model.score(rater.features(texts))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= PREDICTED_FROM).astype(np.int32), pa.int32())}

    return common.map_texts(docs, work, "score double, predicted int", key, text)
