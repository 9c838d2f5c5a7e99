"""Licence scans with a generalised suffix automaton of licence templates."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from .common import ALNUM, per_text
from .licence_texts import TEMPLATES

_WORD = re.compile(ALNUM.encode())
# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Shortest match in words that counts, the share of a template that must be covered for its label, and templates that must be whole.
MIN_MATCH, MIN_COVER, SHORT = 3, 0.8, 10


class SuffixAutomaton:
    """All substrings of several word sequences; each state knows all places where they, and their suffixes, end in every sequence."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].add((number, place))
        # an occurrence of a state's strings is one of its suffixes' too
        by_length = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for state in by_length:
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        # what ends where one of its strings does: (sequence, place, the word after it, how much of it at most)
        self.ends: list[list[tuple[int, int, str | None, int]]] = [[]]
        self.ends += [[] for _ in by_length]
        for state in reversed(by_length):
            above = [e for e in self.ends[self.link[state]] if (e[0], e[1]) not in ends[state]]
            words = lambda number, place: sequences[number][place + 1] if place + 1 < len(sequences[number]) else None
            self.ends[state] = sorted((number, place, words(number, place), self.length[state]) for number, place in ends[state]) + above

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int, ends: list) -> int:
        copy = self._state(self.length[p] + 1, ends)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: str, ends: list) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q, ends)
        new, p = self._state(self.length[last] + 1, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, ends)
        return new

    def statistics(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end in words, length, state) of the longest match that ends after each word: the matching statistics."""
        step, link, longest = self.next, self.link, self.length
        state = size = 0
        for place, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                size = longest[state]
            onward = step[state].get(word)
            state, size = (onward, size + 1) if onward is not None else (0, 0)
            yield place + 1, size, state

    def matches(self, words: list[str], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, end in words, end in the sequence, length) of all runs of `least` words or more that can't go on in their sequence."""
        for end, size, state in self.statistics(words):
            if size >= least:
                after = words[end] if end < len(words) else ""
                for number, place, onward, most in self.ends[state]:
                    if onward != after and most >= least:
                        yield number, end, place + 1, min(size, most)


def _words(text: bytes) -> list[str]:
    return [w.decode("utf-8", "replace") for w in _WORD.findall(text.lower())]


@cache
def _templates() -> tuple[SuffixAutomaton, list[str], list[int]]:
    """Every paragraph of the licence texts is a template."""
    listed = [(label, _words(line.encode())) for label, texts in TEMPLATES.items() for line in texts.strip().split("\n")]
    return SuffixAutomaton([w for _, w in listed]), [label for label, _ in listed], [len(w) for _, w in listed]


def chain(found: list[tuple[int, int, int]], width: int) -> tuple[int, int, int]:
    """(template words, text start, text end) of the best chain of matches (text end, template end, length), in the same order in both.

    A chain may stretch over an eighth more text than the template is long, so
    short templates have to stand as they are. Ties go to the first chain.
    """
    reach = width + width // 8
    best: list[tuple[int, int, int, int]] = []  # text start of the chain, text end, template end, words
    top = (0, 0, 0)
    for end, place, size in found:
        # a match that is longer than its part of the template can hold no more than the template
        words, begin = size, end - size
        for first, e, p, w in best:
            if end - first > reach:
                continue
            gain = min(size, place - p, end - e)
            if gain > 0 and (w + gain, first) > (words, begin):
                words, begin = w + gain, first
        best.append((begin, end, place, words))
        if len(best) > 64:  # those that begin too early can't grow any more
            best = [b for b in best if end - b[0] <= reach]
        if words > top[0]:
            top = (words, begin, end)
    return top


def scan(text: bytes) -> tuple:
    """The measures of license_scan() for one text."""
    words = _words(text)
    line = " ".join(words)
    starts: list[int] = []
    base: set[str] = set()
    for phrase, label in BASE.items():
        if phrase in line:
            parts = phrase.split()
            here = [i for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts]
            starts += here
            if here:
                base.add(label)
    automaton, labels, widths = _templates()
    by_template: dict[int, list] = defaultdict(list)
    for number, end, place, size in automaton.matches(words, MIN_MATCH):
        by_template[number].append((end, place, size))
    score, spans = 0.0, []
    for number, found in by_template.items():
        covered, begin, end = chain(found, widths[number])
        share = covered / widths[number]
        score = max(score, share)
        if share >= (1 if widths[number] < SHORT else MIN_COVER):
            spans.append({"label": labels[number], "first_word": begin, "last_word": end - 1, "share": share})
    spans.sort(key=lambda s: (s["first_word"], s["label"], s["last_word"]))
    more = base | {s["label"] for s in spans}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score if not base else 1.0, spans


SPANS = "array<struct<label: string, first_word: long, last_word: long, share: double>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every text.

    Base labels stand for exact phrases. The method streams a text through the
    automaton, keeps the matches of MIN_MATCH words or more that can't go on,
    chains them per template in text and template order, and adds a template's
    label when the chain covers MIN_COVER of its words (all of a template under
    SHORT words); spans has the best chain
    of each such template. score is the best cover (1 with a base phrase). Null
    text is empty: no words, no labels, score 0. Rows with a null doc_id and
    repeated rows each give one row; very long texts stream through the
    automaton word by word; an empty table gives none; other columns are not
    read, whatever their names.
    """
    adds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    return per_text(docs, ["doc_id"], adds | {"spans": SPANS}, scan)
