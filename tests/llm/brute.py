"""Plain single-process versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2):
    """Target of each source from the sizes {source: words}."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and left * weight[s] / shares >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else left * weight[s] / shares for s in names}
        full |= more


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    """Smallest node of each component; linked(a, b) says whether two are linked."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def removed_words(texts):
    """doc_id -> (words, removed, sha256 of what is kept)."""
    first, split = {}, {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for j in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][j : j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality(text):
    w = words(text)
    windows, covered, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for j in range(len(w) - 2):
        if windows[tuple(w[j : j + 3])] > 1:
            covered.update((j, j + 1, j + 2))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def longest_repeats(items):
    """For every position the longest substring from there that also starts elsewhere."""
    out = []
    for i in range(len(items)):
        best = 0
        for j in range(len(items)):
            if i != j:
                k = 0
                while max(i, j) + k < len(items) and items[i + k] == items[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def licences(text):
    w, starts, labels = ALNUM.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        for j in range(len(w) - len(p) + 1):
            if w[j : j + len(p)] == p:
                starts.append(j)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def contained(docs, items, k=5, share=0.8):
    """doc_id -> (best item, containment, number of items)."""
    def grams(text, n):
        w = ALNUM.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    classes = {}
    for i in sorted(items):
        n = min(k, len(ALNUM.findall((items[i] or "").translate(LOWER))))
        if n:
            classes.setdefault((n, frozenset(grams(items[i], n))), i)
    out = defaultdict(list)
    for d, text in docs.items():
        for (n, g), i in classes.items():
            common = len(g & grams(text, n))
            if common >= share * len(g) - 1e-9:
                out[d].append((-common / len(g), i))
    return {d: (min(v)[1], round(-min(v)[0], 6), len(v)) for d, v in out.items()}
