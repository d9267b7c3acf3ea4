"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has a score linear in features of its text. A document labelled good is preferred to one labelled bad with
probability sigmoid(difference of the scores): the weights minimise this logistic loss over preference pairs, on
feature differences. Documents are then kept above a quantile of the training scores, the one that tells the labels apart best at
the labels' own shares; the reported score is a sigmoid around it, so 0.5 is the threshold.

The fit uses a bounded sample: at most MAX_GOOD and MAX_BAD labelled documents (the least key hashes) and PAIRS pairs for each bad
one. Null texts count as empty, empty texts get the score of their features, equal texts get equal scores. Without labels of
both kinds nothing can be preferred: every score is 0.5. An empty table gives an empty result; the input's other columns
are never used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifuzz.llm import common, labelled, linequality

MAX_GOOD, MAX_BAD = 8000, 8000
PAIRS = 12
RIDGE = 1e-3
FEATURES = ("symbols", "bars", "shouts", "capitals", "doubled", "repeated", "repeated_lines", "variety", "length", "word_length", "stops", "ends", "digits", "short")


def features(texts: list[str]) -> np.ndarray:
    """A row for each text, every value between 0 and 1 or so."""
    common.release()
    words = [t.split() for t in texts]
    repeated = linequality.repeated_words([np.array(list(map(hash, w)), np.int64) for w in words]).tolist()
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (t, w, r) in enumerate(zip(texts, words, repeated, strict=True)):
        n = len(w)
        m = max(n, 1)
        lines = [x for x in t.split("\n") if x]
        out[i] = (
            min(1, sum(map(t.count, "#*$%&")) / m),
            min(1, t.count("|") / m),
            min(1, t.count("!!") / m),
            sum(map(str.isupper, w)) / m,
            sum(map(eq, w, w[1:])) / m,
            r / m,
            1 - len(set(lines)) / max(len(lines), 1),
            math.log1p(len(set(w))) / math.log1p(m),
            min(1, math.log1p(n) / 8),
            min(1, (len(t) - n) / m / 12),
            min(1, (t.count(".") + t.count(",")) / m),
            sum(x[-1] in ".!?:;\"'»”)" for x in lines) / max(len(lines), 1),
            min(1, sum(map(t.count, "0123456789")) / m),
            float(n < 10),
        )
    return out


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x @ np.array(self.weights) - self.threshold) / self.spread
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def preference_weights(good: np.ndarray, bad: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method on the ridge-penalised loss of pairs: each bad row against PAIRS good ones, and each good row in some pair."""
    draw = np.random.default_rng(8)
    b = np.concatenate([np.repeat(np.arange(len(bad)), PAIRS), draw.integers(0, len(bad), len(good))])
    g = np.concatenate([draw.integers(0, len(good), len(bad) * PAIRS), np.arange(len(good))])
    d = good[g] - bad[b]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ p / len(d) - RIDGE * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step / max(1, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    shares = {r["v"]: r["n"] for r in labels.where(learn & F.col(key).isNotNull()).groupBy(F.col(label).cast("int").alias("v")).count().withColumnRenamed("count", "n").where("v in (0, 1)").collect()}
    if len(shares) < 2:
        return Model((0.0,) * len(FEATURES), 0.0, 1.0)
    picked = labelled.sample(docs, labels, label, learn, {0: MAX_BAD, 1: MAX_GOOD}, key, text)

    def run(batches):
        for batch in batches:
            for part, texts in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(list(features(texts)), pa.list_(pa.float64()))], ["key", "label", "x"])

    rows = sorted((r["key"], r["label"], r["x"]) for r in picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, label int, x array<double>").collect())
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model((0.0,) * len(FEATURES), 0.0, 1.0)
    w = preference_weights(good, bad)
    s = x @ w
    weight = np.where(y == 1, shares[1] / len(good), shares[0] / len(bad))
    order = np.argsort(s, kind="stable")
    s, y, weight = s[order], y[order], weight[order]
    # by the quantile at each gap of the sorted scores: the weight of rows on the wrong side
    wrong = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, -weight))]) + weight[y == 0].sum()
    cut = np.concatenate([[True], s[1:] > s[:-1], [True]])
    wrong[~cut] = np.inf
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    low, high = (s[i - 1] if i else s[0] - 1), (s[i] if i < len(s) else s[-1] + 1)
    return Model(tuple(w.tolist()), float((low + high) / 2), float(max(np.std(s) / 4, 1e-6)))


def rate(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted (1 from 0.5) of each whole text."""

    def work(texts: list[str]) -> dict[str, pa.Array]:
        s = model.scores(features(texts))
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return common.map_texts(docs, work, "score double, predicted int", key, text)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that are predicted bad."""

    def run(batches):
        for batch in batches:
            for part, texts in common.slices(batch, text):
                yield part.filter(pa.array(model.scores(features(texts)) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
