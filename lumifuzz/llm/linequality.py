"""Line-first quality rules.

Each line is judged by itself: punctuation, navigation, boilerplate, symbols, shouting and repetition. Lines that fail
are removed, and a document that loses more than MAX_LOST of its non-space characters, or is left with fewer than MIN_WORDS words, is
rejected. Beside that, counts over the whole text reject very short and very repetitive documents (base_failed).

Words are runs of characters other than space and U+0009..U+000D. A null text has no words; an empty table gives an empty
result; equal texts give equal rows, one for one; the input's other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumifuzz.llm import common

MIN_WORDS = 10
MAX_LOST = 0.5
#: A text fails if more than this percentage of its words lie in repeated 5-word windows.
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NAVIGATION = re.compile(r"(?:[|»›•>]\s*\S[^|»›•>]*){3,}|^\W*(?:home|menu|log ?in|sign ?(?:in|up)|next|previous|back to top|share|search|contact(?: us)?|about(?: us)?|sitemap)\W*$", re.I)
#: Fixed phrases, and marks of a template that was not filled in; other braces may be code or mathematics.
BOILERPLATE = re.compile(r"lorem ipsum|enable javascript|uses? cookies|cookie policy|privacy policy|terms (?:of use|and conditions)|all rights reserved|click here|subscribe to our|page not found|\{\{[^{}\n]*\}\}", re.I)
#: Characters of a line up to which one such phrase is enough.
SHORT = 100
_ODD = np.random.default_rng(20240301).integers(1 << 61, 1 << 62, WINDOW + 1, dtype=np.int64) | 1


def line_fails(line: str) -> str:
    """The first rule that a line with a word fails, or nothing."""
    text = line.strip(BLANK)
    n = len(text)
    marks = sum(map(text.count, SYMBOLS))
    words = text.count(" ") + 1
    if marks >= 3 and marks * 3 >= words:
        return "symbols" if "|" not in text and ">" not in text else "navigation"
    if n < 200 and NAVIGATION.search(text):
        return "navigation"
    # a paragraph may speak of a privacy policy; a line that is little else is one
    said = sum(len(m[0]) for m in BOILERPLATE.finditer(text))
    if said and (n <= SHORT or 2 * said >= n):
        return "boilerplate"
    if "!!" in text and 4 * text.count("!!") >= words:
        return "punctuation"
    if n >= 20 and text.isupper() and 2 * sum(map(str.isupper, text)) >= _solid(text):
        return "punctuation"
    if words > 60 and not any(c in text for c in ".,;:!?…。"):
        return "punctuation"
    if words >= 8:
        cut = text.lower().split()
        if 3 * sum(a == b for a, b in zip(cut, cut[1:], strict=False)) > len(cut):
            return "repetition"
    return ""


def clean(text: str) -> str:
    """The lines that pass, each line of several equal ones once."""
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        if line.strip(BLANK) and line not in seen and not line_fails(line):
            out.append(line)
        seen.add(line)
    return "\n".join(out)


def _solid(text: str) -> int:
    """Characters in words."""
    return len(text) - sum(map(text.count, BLANK))


def repeated_words(words: list[np.ndarray]) -> np.ndarray:
    """For each array of word hashes: the words inside WINDOW-word windows that the array holds twice or more."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    full = np.flatnonzero(sizes >= WINDOW)
    if not len(full):
        return out
    h = np.concatenate([words[i] for i in full])
    ends = np.cumsum(sizes[full])
    starts = ends - sizes[full]
    doc = np.repeat(np.arange(len(full)), sizes[full])
    n = len(h) - WINDOW + 1
    with np.errstate(over="ignore"):
        gram = doc[:n] * _ODD[WINDOW]
        for k in range(WINDOW):
            gram = gram + h[k : k + n] * _ODD[k]
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    gram = gram[at]
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(ordered), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    out[full] = np.add.reduceat((np.cumsum(cover[:-1]) > 0).astype(np.int64), starts)
    return out


def measures(texts: list[str]) -> dict[str, list]:
    """The counts over whole texts."""
    common.release()
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    hashed = [np.array(list(map(hash, w)), np.int64) for w in words]
    duplicated = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(BLANK)]
        duplicated.append(len(lines) - len(set(lines)))
    return {
        "n_words": [len(w) for w in words],
        "word_chars": list(map(_solid, texts)),
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": duplicated,
        "n_repeat_words": repeated_words(hashed).tolist(),
    }


def verdicts(texts: list[str], counts: dict[str, list]) -> tuple[list[bool], list[bool], list[str]]:
    failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(counts["n_words"], counts["n_repeat_words"], strict=True)]
    cleaned = [clean(t) for t in texts]
    kept = [not f and _solid(c) >= (1 - MAX_LOST) * solid and len(c.split()) >= MIN_WORDS for f, c, solid in zip(failed, cleaned, counts["word_chars"], strict=True)]
    return failed, kept, cleaned


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, the counts, base_failed, kept and kept_chars (characters in words after cleaning); with_text: cleaned, too."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(texts: list[str]) -> dict[str, pa.Array]:
        counts = measures(texts)
        failed, kept, cleaned = verdicts(texts, counts)
        out = {k: pa.array(counts[k], pa.int64()) for k in names} | {"base_failed": pa.array(failed, pa.bool_()), "kept": pa.array(kept, pa.bool_()), "kept_chars": pa.array(list(map(_solid, cleaned)), pa.int64())}
        return out | ({"cleaned": pa.array(cleaned, pa.string())} if with_text else {})

    schema = ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, kept_chars long" + ", cleaned string" * with_text
    return common.map_texts(docs, work, schema, key, text)
