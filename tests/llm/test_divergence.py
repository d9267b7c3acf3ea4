"""The source divergence audit against a plain count of everything."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumifuzz.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(rows, least, top=50):
    counts, groups, found = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lowered(text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        found[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = {t for t, n in found[lang].items() if n >= least}
        own = {s: {t: counts[x, s][t] for t in kept} for x, s in groups if x == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in own.items()}
        for s in own.keys() - {None}:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o not in (None, s))
            above = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > p[None][t])[:top]
            out |= {(lang, s, part, item, -v, i) for part, ranked in (("pair", pairs), ("term", above)) for i, (v, _, item) in enumerate(ranked, 1)}
    return out


def rows(n, seed):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["Éa", "éa", "日本", "İx", "x\x7fy", "a1b", "[z]"]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = [(" ".join(draw.choices(words, weights, k=draw.randint(0, 30))), draw.choice(["en", "de", "fr", None]), draw.choice(["s0"] * 6 + ["s1", "s2", "é", "", None])) for _ in range(n)]
    return out + [("rare alone", "xx", "s1"), ("", "xx", "s2"), (None, "yy", "s1"), ("ONE " * 100_000, "en", "s9"), ("1 2 3", None, "only")] + [("same row", "zz", "s")] * 12


@pytest.mark.parametrize("width", [None, 1 << 12])
def test_equals_a_plain_count(spark, width, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 200)
    monkeypatch.setattr(divergence, "PIECE", 1000)
    made = rows(600, 5)
    docs = spark.createDataFrame([(t, x, s, 1, "n") for t, x, s in made], "text string, lang string, source string, rank int, item string").repartition(5)
    got = [tuple(r) for r in divergence.audit(docs, least=8, width=width).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(made, 8)


def test_counts_beyond_a_byte(spark):
    made = [("a b", "en", "s1")] * 400 + [("b c", "en", "s2")] * 299
    docs = spark.createDataFrame(made, "text string, lang string, source string").repartition(3)
    assert {tuple(r) for r in divergence.audit(docs, least=300).collect()} == brute(made, 300)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_one_language_for_each_row(spark):
    made = [("same words", f"l{i}", f"s{i % 3}") for i in range(50)]
    assert divergence.audit(spark.createDataFrame(made, "text string, lang string, source string")).count() == 0


def test_terms_of_long_texts_in_pieces(monkeypatch):
    text = "ab CD é " * 50 + "x" * 300 + " tail"
    whole = [t.encode() for t in TERM.findall(lowered(text))]
    for piece in (1, 7, 64, 10_000):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert [t for some in divergence.terms(text.encode()) for t in some] == whole


def test_the_sketch_never_underestimates(spark):
    draw = random.Random(3)
    made = [(" ".join(f"t{chr(97 + draw.randrange(26))}{chr(97 + int(draw.expovariate(0.2)) % 26)}" for _ in range(8)), "en", "s") for _ in range(900)]
    docs = spark.createDataFrame(made, "text string, lang string, source string").selectExpr("cast(text as binary) text", "cast(lang as binary) lang", "cast(source as binary) source").repartition(7)
    found = Counter(t for text, _, _ in made for t in set(text.split()))
    for width in (1 << 12, 1 << 16):
        bits = divergence.possible(docs, width, 30)
        names = list(found)
        may = divergence._may(bits, divergence._hashes(b"en", [t.encode() for t in names]), width)
        assert all(m for t, m in zip(names, may, strict=True) if found[t] >= 30)
        assert any(found[t] < 30 for t in names)
    assert not may[[i for i, t in enumerate(names) if found[t] < 25]].any()


def test_blocks_are_packed_without_loss():
    draw = np.random.default_rng(0)
    for kind in (np.uint8, np.uint32):
        for n in (0, 1, 100, 2000, divergence.BLOCK):
            cells = np.zeros(divergence.BLOCK, kind)
            cells[draw.permutation(divergence.BLOCK)[:n]] = draw.integers(1, 200, n)
            assert (divergence._unpack(divergence._pack(cells), kind) == cells).all()
