"""Fast similarity sketches and the near duplicates found with them, against brute force."""

import random
import re

import numpy as np
import pytest

from lumifuzz.llm import fastsketch, minhash


def word_pairs(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    """Per row of (doc_id, text): size of the set and least id reachable."""
    sets = [word_pairs(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return sorted(((k is None, k or 0, len(s), -1 if (c := least[find(i)]) is None else c, k == c) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))))


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        words = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 6, 12, 40, 200]))
        out.append(" ".join(words))
        for _ in range(draw.randint(0, 4)):
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 12))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append("\n ".join(copy).upper() if draw.random() < 0.2 else " ".join(copy))
    return out[:n]


def test_components_are_those_of_all_pairs(spark):
    rows = list(enumerate(texts(500, 7)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "one one"), (906, "é ß"), (907, "É ß"), (None, "w1"), (None, ""), (3, "w1 w2"), (3, "w1 w2"), (908, "a b " * 60_000)]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, n_shingles long, kept string").repartition(5)
    assert got(fastsketch.near_duplicates(docs)) == brute(rows)


def test_a_crowd_of_copies_and_near_copies(spark):
    base = texts(30, 3)
    crowd = [("same words again and again " * 20).strip()] * 700 + [("same words again and again " * 20) + f"tail{i}" for i in range(300)]
    rows = list(enumerate(base + crowd))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = {r["doc_id"]: r["component_id"] for r in fastsketch.near_duplicates(docs).collect()}
    assert {out[i] for i in range(len(base), len(rows))} == {len(base)}


def test_empty_tables(spark):
    assert fastsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(fastsketch.near_duplicates(only)) == brute([(1, None), (2, "")])


def test_every_coordinate_is_filled_and_stopping_early_changes_nothing():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 5, 60, 700, 5000)]
    together = fastsketch.sketches(sets)
    assert not (together == fastsketch._EMPTY).any()
    for s, row in zip(sets, together, strict=True):
        assert (fastsketch.sketches([s])[0] == row).all()
        # the definition: all rounds, each shingle by itself
        whole = np.full(fastsketch.BINS, fastsketch._EMPTY)
        for i in range(2 * fastsketch.BINS) if len(s) < 100 else range(4):
            for h in fastsketch._hashed(s, i).tolist():
                b = (h >> 40) * fastsketch.BINS >> 24 if i < fastsketch.BINS else i - fastsketch.BINS
                whole[b] = min(whole[b], np.uint64((i << 40) | (h & ((1 << 40) - 1))))
        if len(s) < 100:
            assert (whole == row).all()
        else:
            assert (whole[whole != fastsketch._EMPTY] == row[whole != fastsketch._EMPTY]).all()


def test_agreement_estimates_similarity():
    draw = np.random.default_rng(2)
    for n, shared in ((10, 8), (50, 40), (1000, 800), (1000, 300)):
        errors = []
        for _ in range(40):
            every = draw.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            a, b = fastsketch.sketches([np.unique(every[:n]), np.unique(every[n - shared :])])
            errors.append((a == b).mean() - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03
        assert np.std(errors) < 1.6 * (0.25 / fastsketch.BINS) ** 0.5


@pytest.mark.parametrize("shingle", [2, 5])
def test_schemes_share_the_exact_comparison(spark, shingle):
    rows = list(enumerate(texts(120, 11)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    marked = minhash.marked(docs.selectExpr("doc_id as _key", "text as _text"), "_text", ("_key",), scheme=minhash.Scheme(shingle, fastsketch.cells))
    pairs = {frozenset(p) for p in minhash.links(marked, made, shingle).collect()}
    sets = {minhash.shingles(t, shingle)[0] - (1 << 64 if minhash.shingles(t, shingle)[0] >> 63 else 0): set(minhash.shingles(t, shingle)[1].tolist()) for _, t in rows}
    assert pairs and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in pairs)
