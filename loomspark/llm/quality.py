"""Quality rules from the repeated substrings that a suffix array shows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_text

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: The shortest repeat, in words, that counts against a text.
MIN_REPEAT = 10
#: The largest share of words inside such repeats (Rae et al. 2021, "Gopher", allow 0.10 inside repeated 10-grams), and the
#: longest single repeat as a share of the text: under half of that share, as a passage and its copy cover twice its length.
MAX_COVERED, MAX_LONGEST = 0.1, 0.04


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For every position the length of the longest substring from there that also starts elsewhere.

    Prefix doubling ranks all suffixes; neighbours in the suffix array give the
    common prefixes, read off the kept ranks from the longest stride down.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, stride = [rank.astype(np.int32)], 1  # half the memory, as a periodic text keeps some twenty of them
    while rank.max() < n - 1:
        later = np.zeros(n, np.int64)
        if stride < n:
            later[:-stride] = rank[stride:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        stride *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        step = 1 << k
        common[same] += step
        a[same] += step
        b[same] += step
    longest = np.zeros(n, np.int64)
    longest[order[1:]] = common
    longest[order[:-1]] = np.maximum(longest[order[:-1]], common)
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> int:
    """Words inside the union of repeats of at least `least` words (each cut to `width`, if given)."""
    at = np.flatnonzero(longest >= least)
    if not len(at):
        return 0
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (longest[at] if width is None else width), -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple:
    words = text.split()  # of bytes: at ASCII white space only
    codes: dict[bytes, int] = {}
    longest = longest_repeats(np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    n = len(words)
    repeat = covered(longest, 3, 3)
    share = covered(longest, MIN_REPEAT) / n if n else 0.0
    top = int(longest.max()) if n else 0
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and share <= MAX_COVERED and (top < MIN_REPEAT or top <= MAX_LONGEST * n)
    chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat, top, share, failed, kept


MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "longest_repeat": "long", "covered_share": "double", "base_failed": "boolean", "kept": "boolean",
}


def quality(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text.

    A text fails the base rules with under 50 words or more than half of them
    in repeated three-word windows. The method's verdict then limits the share
    of words inside maximal repeats of MIN_REPEAT words or more and the longest
    repeat. Null and empty texts have no words and fail. Every row gives a row,
    repeated or not; an empty table gives none; columns other than doc_id and
    text are not read. The suffix array of a text takes some 200 bytes a word in
    one task, so 3 GB hold texts of about 15 million words.
    """
    return per_text(docs, ["doc_id"], MEASURES, measure)


def good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, all columns unchanged."""
    kept = fresh(docs.columns, "_kept")
    return per_text(docs, docs.columns, {kept: "boolean"}, lambda text: measure(text)[-1:]).where(F.col(kept)).drop(kept)
