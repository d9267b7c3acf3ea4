import pathlib
import random

import pytest

from lumifuzz.llm import common, minhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = common.documents(spark, sf)
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = common.cut(stage(spark, docs, sf), "test")
        assert made.columns == docs.columns, name
        left = made.count()
        assert 0 < left <= seen, name
        docs, seen = made, left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, last.collect()))


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (1, text.upper()), (2, "something else entirely " * 4), (2, "something else entirely " * 4), (None, "one more text of its own here")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]


def test_near_copies_are_dropped_by_exact_similarity(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(4000)]
    rows, sets = [], []

    def add(text):
        rows.append((len(rows), " ".join(text)))
        sets.append({tuple(text[i : i + 5]) for i in range(len(text) - 4)})

    def edited(text, n):
        out = list(text)
        for at in draw.sample(range(len(text)), n):
            out[at] = draw.choice(words)
        return out

    for _ in range(30):
        text = draw.choices(words, k=100)
        add(text)
        for n in (1, 2, 3, 5):
            add(edited(text, n))
    # a crowd whose members are like the first but mostly not like each other
    text = draw.choices(words, k=300)
    add(text)
    for _ in range(60):
        add(edited(text, 5))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == {i for i in range(len(rows)) if top(i) == i} and 60 < len(kept) < 150
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {i: top(i) for i in range(len(rows))}


def similar_components(texts, words=5, similar=0.8):
    """The definition: component number of each text."""
    cut = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in cut]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if cut[i] == cut[j] or (cut[i] and cut[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def test_no_text_is_lost(spark):
    """Ids that stand on several texts, null ids, empty texts and clashing column names: each component keeps exactly one row."""
    a, b, c, d = ("".join(f"{x}{i} " for i in range(30)) for x in "abcd")
    near = b.replace("b29", "z")
    rows = [(2, a), (3, b), (3, a), (7, b), (5, c), (5, d), (None, d), (None, None), (9, ""), (None, "alone here"), (None, near), (3, b), (4, " ".join(b.split()).upper())]
    docs = spark.createDataFrame([(*r, i, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, node long, _row long, words string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    kept = kept.collect()
    group = similar_components([t or "" for _, t in rows])
    assert sorted(group[r["node"]] for r in kept) == sorted(set(group))
    for r in kept:
        own = [rows[i][0] for i in range(len(rows)) if group[i] == group[r["node"]]]
        assert r["doc_id"] == min((x for x in own if x is not None), default=None)


def test_crowds_of_several_blocks(spark, monkeypatch):
    """The same components whatever the size of a block, with crowds, a chain and members that are like a few others only."""
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(4):
        first = draw.choices(words, k=80)
        texts.append(" ".join(first))
        step = first
        for i in range(25):
            out = list(first)
            for at in draw.sample(range(80), draw.choice((1, 1, 2, 3))):
                out[at] = draw.choice(words)
            texts.append(" ".join(out))
            step = [*step[1:], draw.choice(words)] if i % 2 else step  # drifts away
            texts.append(" ".join(step))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = dict(enumerate(similar_components(texts)))
    assert 4 < len(set(wanted.values())) < 0.3 * len(texts)

    def found():
        return {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}

    assert found() == wanted
    monkeypatch.setattr(minhash, "BLOCK", 300)
    monkeypatch.setattr(minhash, "MEMBERS", 2)
    assert found() == wanted


def test_folders_are_given_back(spark):
    """What a stage wrote goes when its result has been written."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other words " * 6)], "doc_id long, text string")
    top = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(top.iterdir()) if top.exists() else set()
    kept = common.cut(corpus_pipeline.keep_one_of_each_group(spark, docs, ""), "kept", last=True)
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert left == {"kept"}


def test_empty_tables(spark, sf):
    docs = common.documents(spark, sf).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_candidates_come_from_fingerprints_too(spark, monkeypatch):
    """Near copies within 2 bits are found by SimHash alone, and only if they are similar by the exact count."""
    from lumifuzz.llm import simhash

    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(4000)]
    text = draw.choices(words, k=3000)
    near = [*text[:-1], "other"]
    texts = [" ".join(x) for x in (text, near, draw.choices(words, k=200))]
    a, b = (simhash.fingerprint_of(x) for x in texts[:2])
    assert (a ^ b).bit_count() <= 2
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # no MinHash cell is shared
    scheme = minhash.Scheme(cells=lambda sets: minhash.np.array([[int(x[0] >> minhash.np.uint64(1)) + i for i in range(minhash.BANDS)] for x in map(lambda s: minhash.np.sort(s * minhash.np.uint64(len(s) * 2 + int(s[-1] & minhash.np.uint64(0xFFFE)) + 1)), sets)], minhash.np.uint64))
    monkeypatch.setattr(minhash.marked, "__defaults__", ("text", (), True, scheme, False))
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 2]
    # candidates that are not similar enough stay
    monkeypatch.setattr(minhash, "SIMILAR", (9999, 10_000))
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 1, 2]
