"""Main text of HTML pages with gradient-boosted trees over DOM nodes."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import per_batch

# Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = RAW | frozenset("noscript template head svg object canvas math select audio video".split())
IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
BLOCK = frozenset(
    "html body main article section div header footer nav aside form fieldset table thead tbody tfoot tr td th ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 "
    "pre blockquote figure figcaption address details summary dialog menu hr".split()
)
INPUTS = frozenset("input button select textarea label".split())
_CLOSES_P = BLOCK - frozenset("html body".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset("ul ol dl table menu".split())
_SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form td th blockquote".split())
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "li", "table", "h1", "h2", "blockquote", "pre", "tr")
#: Attribute tokens are hashed to so many slots, whose evidence is learned with the trees.
SLOTS = 4096
#: Block nodes whose features are computed together, whatever page they belong to.
GATHERED = 20_000
_WORDS = re.compile(r"[a-z]+")
_SAID = re.compile(r"""\b(?:class|id|role|itemprop|rel)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# a comment, a declaration, or a tag; one that the page's end cuts off counts too, and so leaves no markup behind
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>=]++|=)*+)(?:>|\Z)""",
    re.S,
)


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


class Page:
    """The visible blocks of a page, parents first, and its texts.

    End tags that are left out are implied and stray ones ignored, so any text
    is read to its end at any depth. Inline elements belong to their block.
    """

    __slots__ = ("tag", "said", "up", "chars", "links", "tags", "marks", "inputs", "marked", "runs")

    def __init__(self) -> None:
        self.tag, self.said, self.up = ["html"], [()], [0]
        self.chars, self.links, self.tags, self.marks, self.inputs = [0], [0], [0], [0], [0]
        self.marked: list[str] = [""]  # the data-part attribute, which only pages to learn from have
        self.runs: list[tuple[int, list[str]]] = []  # (block, its text up to where the next block begins or ends)


def parse(html: str, marked: bool = False) -> Page:
    page = Page()
    tag_of, said_of, up, runs = page.tag, page.said, page.up, page.runs
    chars, links, tags, marks, inputs = page.chars, page.links, page.tags, page.marks, page.inputs
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block
    held = Counter(html=1)
    unseen = linked = block = 0
    run: list[str] = []

    def text(data: str) -> None:
        if unseen or not data:
            return
        if "&" in data:
            data = entities.unescape(data)
        run.append(data)
        size = len(data.strip())
        chars[block] += size
        if linked:
            links[block] += size
        marks[block] += data.count(".") + data.count(",")

    def flush() -> None:
        nonlocal run
        if run:
            runs.append((block, run))
            run = []

    def pop() -> None:
        nonlocal unseen, linked, block
        name, own = stack.pop()
        held[name] -= 1
        unseen -= name in UNSEEN
        linked -= name == "a"
        if own != stack[-1][1]:
            flush()
            block = stack[-1][1]

    def close(names, within) -> None:
        """Close the nearest open element of these names, if no element of `within` is nearer."""
        if not any(held[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            name = stack[i][0]
            if name in names:
                while len(stack) > i:
                    pop()
                return
            if name in within:
                return

    at, n = 0, len(html)
    while at < n:
        found = _MARKUP.search(html, at)
        if found is None:
            data, found_at = html[at:], n
        else:
            data, found_at = html[at : found.start()], found.end()
        if data:
            if held["head"] and not data.isspace() and stack[-1][0] == "head":
                pop()
            text(data)
        at = found_at
        if found is None or (name := found[2]) is None:
            continue
        name = name.lower()
        if found[1]:
            if name not in VOID:
                close((name,), () if name in BLOCK or name in UNSEEN else BLOCK)
            continue
        if held["head"] and name not in IN_HEAD:  # head ends where the page's content begins
            close(("head",), ())
        if name in _CLOSES_P and held["p"]:
            close(("p",), _SCOPE)
        if name in _SIBLINGS:
            close(_SIBLINGS[name], _LISTS)
        elif name == "option":
            close(("option",), ("select",))
        said = found[3]
        if name in BLOCK and not unseen:
            flush()
            up.append(block)
            own = len(up) - 1
            tag_of.append(name)
            words = tuple(w for a in _SAID.findall(said) for w in _WORDS.findall(a.lower())) if "=" in said else ()
            said_of.append(words)
            for counts in (chars, links, marks, inputs):
                counts.append(0)
            tags.append(1)
            if marked:
                part = re.search(r"data-part=(\w+)", said)
                page.marked.append(part[1] if part else "")
        else:
            own = block
            tags[block] += 1
            inputs[block] += name in INPUTS
        if name in RAW:
            end = _end_of(name).search(html, at)
            at = end.end() if end else n
        elif name in VOID or (said.endswith("/") and name not in BLOCK):
            if name == "br" and not unseen:
                run.append(" ")
            if own != block:  # a rule between blocks
                flush()
        else:
            stack.append((name, own))
            held[name] += 1
            unseen += name in UNSEEN
            linked += name == "a"
            if name in BLOCK and not unseen:
                block = own
    flush()
    return page


NUMBERS = 29
N_FEATURES = NUMBERS + len(TAGS)
_ABOVE = {name: i for i, names in enumerate((("article", "main"), ("nav",), ("footer", "header"), ("aside",), ("form",), ("li", "ul", "ol"))) for name in names}
_TAG_PLACE = {name: i for i, name in enumerate(TAGS)}


@cache
def _slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


def features(pages: list[Page], evidence: np.ndarray) -> np.ndarray:
    """A row per block node of all pages: subtree density, attribute tokens, depth, ancestors and siblings.

    evidence gives the log odds of every slot of attribute tokens.
    """
    rows: list[tuple] = []
    lasts: list[int] = []
    for page in pages:
        up, n = page.up, len(page.up)
        chars, links, tags, marks, inputs = (list(c) for c in (page.chars, page.links, page.tags, page.marks, page.inputs))
        blocks = [1] * n
        for i in range(n - 1, 0, -1):
            u = up[i]
            chars[u] += chars[i]
            links[u] += links[i]
            tags[u] += tags[i]
            marks[u] += marks[i]
            inputs[u] += inputs[i]
            blocks[u] += blocks[i]
        kin = [0] * n
        alike: Counter = Counter()
        index = [0] * n
        before = [0] * n  # characters of the page before the node
        seen = 0
        for i in range(1, n):
            u = up[i]
            index[i] = kin[u]
            kin[u] += 1
            alike[u, page.tag[i], page.said[i]] += 1
            before[i] = seen
            seen += page.chars[i]
        total = max(1, chars[0])
        depth, best, worst = [0] * n, [0.0] * n, [0.0] * n
        above: list[tuple] = [(0,) * 6] * n
        for i in range(n):
            u = up[i]
            own = [float(evidence[_slot(w)]) for w in page.said[i]]
            high, low = max(own, default=0.0), min(own, default=0.0)
            if i:
                depth[i], best[i], worst[i], above[i] = depth[u] + 1, max(best[u], high), min(worst[u], low), above[u]
            if (k := _ABOVE.get(page.tag[i])) is not None:
                above[i] = (*above[i][:k], above[i][k] + 1, *above[i][k + 1 :])
            c, kind = chars[i], (u, page.tag[i], page.said[i])
            rows.append(
                (
                    c, c / total, links[i] / max(1, c), c / tags[i] if tags[i] else 0, marks[i] / max(1, c), page.chars[i], high, low, best[i], worst[i],
                    depth[i], index[i], kin[u] if i else 1, inputs[i], alike[kind], alike[kind] / max(1, kin[u]), len(own), before[i] / total,
                    chars[u], links[u] / max(1, chars[u]), blocks[i], c / blocks[i], kin[i], *above[i],
                )
            )
            lasts.append(_TAG_PLACE.get(page.tag[i], -1))
    x = np.zeros((len(rows), N_FEATURES))
    x[:, :NUMBERS] = rows
    at = np.array(lasts)
    known = np.flatnonzero(at >= 0)
    x[known, NUMBERS + at[known]] = 1
    return x


class BoostedTrees:
    """Gradient boosting of small full binary trees on the logistic loss, with binned features."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 64):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """A row per feature, so that a split reads one run of bytes."""
        return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(self.edges, x.T)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes, margin = self._codes(x), np.zeros(len(y))
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._apply(tree, codes)
        return self

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
        """(feature and largest code that goes left of every inner node in heap order, value of every leaf)."""
        inner = 2**self.depth - 1
        feature, cut, value = [0] * inner, [255] * inner, np.zeros(2 * inner + 1)
        todo = [(0, np.arange(len(g)))]
        while todo:
            at, rows = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            value[at] = -self.rate * sg / (sh + 1.0)
            if at >= inner:
                continue
            best, split = 1e-3, None
            for f in range(len(codes)) if len(rows) >= 20 else ():
                gs = np.bincount(codes[f, rows], g[rows], self.bins).cumsum()[:-1]
                hs = np.bincount(codes[f, rows], h[rows], self.bins).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (sg - gs) ** 2 / (sh - hs + 1) - sg**2 / (sh + 1)
                gain[(hs <= 0.5) | (sh - hs <= 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, split = gain[k], (f, k)
            if split:
                feature[at], cut[at] = split
                left = codes[split[0], rows] <= split[1]
                todo += [(2 * at + 1, rows[left]), (2 * at + 2, rows[~left])]
            else:  # all rows go on to the left
                todo.append((2 * at + 1, rows))
        return feature, cut, value[inner:]

    def _apply(self, tree: tuple[list[int], list[int], np.ndarray], codes: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        goes = [codes[f] > c for f, c in zip(feature, cut)]
        place = np.zeros(codes.shape[1], np.uint8)
        for level in range(self.depth):
            first = 2**level - 1
            here = goes[first] if level == 0 else np.choose(place, goes[first : first + 2**level])
            place = place * 2 + here
        return value[place]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return sum(self._apply(t, codes) for t in self.trees)


# --- pages to learn from -------------------------------------------------------------------------------------------

# Names that page authors commonly give to parts of a page; the trees learn what each is worth.
MAIN_NAMES = (
    "article post entry content story main body text prose blog-post article-body post-content entry-content story-body main-content article__text td-post "
    "page-content hentry single-post richtext markdown-body post-text news-text column-main articlebody lead copy reading readable document longform"
).split()
PARTS = {
    "menu": "nav navbar menu breadcrumb breadcrumbs topnav main-menu site-nav navigation tabs pagination pager mobile-menu toc skip-links dropdown",
    "head": "header site-header masthead topbar branding logo banner-top page-head",
    "side": "sidebar side rail widget widget-area aside secondary right-col left-col column-side most-read trending popular latest tag-cloud archives",
    "note": "cookie cookie-notice consent gdpr notice alert message newsletter subscribe signup paywall popup modal overlay toast disclaimer announcement",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner dfp partner outbrain taboola affiliate",
    "form": "form search searchbox login contact-form register feedback-form poll survey",
    "talk": "comments comment discussion responses respond replies reply disqus thread talkback reader-comments feedback guestbook opinions commentlist reviews",
    "more": "related recommended read-more more-stories see-also share social sharing share-buttons follow author-box byline-box tags meta-links",
    "foot": "footer site-footer colophon copyright legal bottom imprint credits sitemap",
}
PARTS = {kind: names.split() for kind, names in PARTS.items()}


class PageMaker:
    """Random pages in which every part is marked as main text or not: varied layouts, tags, names and omissions.

    A part has a telling name, one that says nothing, or none, so that density
    and siblings have to tell it where its name doesn't.
    """

    def __init__(self, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.terse = False

    def _pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def _chance(self, p: float) -> bool:
        return self.rng.random() < p

    def _words(self, low: int, high: int) -> str:
        sizes = self.rng.integers(2, 11, self.rng.integers(low, high))
        return " ".join("abcdefghijklm"[: int(s)] for s in sizes)

    def _sentence(self, low: int = 3, high: int = 25) -> str:
        return self._words(low, 11 if self.terse else high).capitalize() + self._pick(".", ".", ".", "!", ", " + self._words(2, 9) + ".")

    def _prose(self, low: int = 1, high: int = 7) -> str:
        high = low + 2 if self.terse else high
        return " ".join(self._sentence() for _ in range(self.rng.integers(low, high)))

    def _links(self, tag: str, low: int = 2, high: int = 9) -> str:
        return "".join(f"<{tag}><a href='/x'>{self._words(1, 5)}</a></{tag}>" for _ in range(self.rng.integers(low, high)))

    def _named(self, names: list[str] | tuple[str, ...], told: float = 0.65) -> str:
        """A class or id attribute, perhaps with a name that tells nothing."""
        if self._chance(told):
            name = self._pick(*names)
            name = self._pick(name, name, f"js-{name}", f"{name}-wrap", f"{name}__inner", f"c-{name}", f"{name} {self._pick('clearfix', 'container', 'row', 'grid')}")
        elif self._chance(0.5):
            name = self._pick("box", "block", "col", "inner", "wrap", "row", "module", "panel", "unit", "group", "x1", "css-1k2j", "item", "section")
        else:
            return ""
        quote = self._pick("'", '"')
        return f" {self._pick('class', 'class', 'id')}={quote}{name}{quote}"

    def _open(self, tag: str, names=(), part: str = "", told: float = 0.65) -> str:
        said = self._named(names, told) if names else ""
        return f"<{tag}{said}{f' data-part={part}' if part else ''}>"

    def _piece(self, rich: float) -> str:
        kind = self.rng.random()
        if kind < rich:
            return f"<p>{self._prose()}</p>"
        return self._pick(
            f"<p><b>{self._words(2, 12)}.<br>",
            f"<h2>{self._words(1, 8)}</h2>",
            f"<h3>{self._words(1, 8)}</h3>",
            "<ul>" + "".join(f"<li>{self._sentence()}" + self._pick("</li>", "") for _ in range(self.rng.integers(2, 7))) + "</ul>",
            f"<blockquote><p>{self._prose(1, 4)}</p></blockquote>",
            f"<p>{self._sentence()} <a href='/y'>{self._words(1, 5)}</a> {self._sentence()}</p>",
            f"<pre>{self._words(5, 30)}</pre>",
            f"<figure><img src=x><figcaption>{self._sentence()}</figcaption></figure>",
            "<table>" + "".join(f"<tr><td>{self._words(1, 4)}<td>{self._words(1, 4)}" for _ in range(self.rng.integers(2, 5))) + "</table>",
            f"<p>{self._sentence(1, 5)}</p>",
            f"{self._prose(1, 3)}<br><br>{self._prose(1, 3)}",
        )

    def _article(self) -> str:
        parts = []
        if self._chance(0.8):
            title = f"<h1>{self._words(2, 13)}</h1>"
            parts.append(self._pick(title, title, f"<header>{title}</header>") if self._chance(0.9) else f"<div>{title}<p>{self._sentence()}</p></div>")
        rich = self._pick("0.5", "0.7", "0.9")
        for _ in range(self.rng.integers(1, (3, 8, 20)[self.rng.integers(3)])):
            parts.append(self._piece(float(rich)))
            if self._chance(0.05):
                parts.append(self._boilerplate(self._pick("ad", "more", "note", "form", "talk", "side")))
        inside = "".join(parts)
        if self._chance(0.25):
            inside = f"<div>{inside}</div>"
        shell = self._pick("article", "article", "main", "section", "div", "div", "div", "td")
        told = 0.4 if shell in ("article", "main") else 0.8
        made = f"{self._open(shell, MAIN_NAMES, 'main', told)}{inside}</{shell}>"
        return f"<table><tr>{made}</table>" if shell == "td" else made

    def _boilerplate(self, kind: str = "") -> str:
        kind = kind or self._pick(*PARTS)
        own = {"menu": "nav", "head": "header", "side": "aside", "form": "form", "foot": "footer"}.get(kind, "div")
        tag = own if self._chance(0.5) else self._pick("div", "div", "section")
        short, prose = self._pick(self._sentence(), self._words(1, 8)), self._prose(1, 5)
        if kind == "menu":
            inside = self._pick(f"<ul>{self._links('li')}</ul>", self._links("span"), self._links("div"), f"<ul>{self._links('li', 1, 3)}</ul>")
        elif kind in ("head", "foot"):
            inside = self._pick(f"<a href='/'>{self._words(1, 3)}</a> ", "&copy; ", "") + self._pick(f"<p>{short}</p>", short, prose) + self._pick("", self._links("span"))
        elif kind == "side":
            inside = "".join(f"<h3>{self._words(1, 4)}</h3>" + self._pick(f"<p>{short}</p>", f"<ul>{self._links('li')}</ul>", f"<p>{prose}</p>") for _ in range(self.rng.integers(1, 4)))
        elif kind == "form":
            inside = f"<label>{self._words(1, 5)}</label><input name=q>" + self._pick("", f"<p>{short}</p>") + f"<button>{self._words(1, 3)}</button>"
        elif kind == "talk":
            item = self._pick("div", "li", "article", "section")
            said = self._named(["comment", "reply", "post", "message", "comment-body"])
            who = self._pick("", f"<b>{self._words(1, 3)}</b> ", f"<span>{self._words(1, 3)}</span> <a href=x>{self._words(1, 2)}</a>")
            inside = self._pick("", f"<h2>{self._words(1, 4)}</h2>", f"<h3>{self._words(1, 3)}</h3>") + "".join(f"<{item}{said}>{who}<p>{self._prose(1, 4)}</p></{item}>" for _ in range(self.rng.integers(1, 8)))
        elif kind == "more":
            inside = self._pick(f"<h3>{self._words(1, 4)}</h3><ul>{self._links('li')}</ul>", self._links("span"), "".join(f"<div><a href=x>{self._words(3, 9)}</a><p>{short}</p></div>" for _ in range(self.rng.integers(2, 5))))
        else:
            inside = self._pick(short, f"<p>{short}</p>", f"<p>{prose}</p>", f"<a href=x>{short}</a>") + self._pick("", "", f"<button>{self._words(1, 3)}</button>")
        return f"{self._open(tag, PARTS[kind], 'off', 0.3 if tag == own != 'div' else 0.75)}{inside}</{tag}>"

    def page(self) -> str:
        self.terse = self._chance(0.4)
        if self._chance(0.08):  # nothing but main text
            inside = self._prose() if self._chance(0.2) else "".join(self._piece(0.6) for _ in range(self.rng.integers(1, 6)))
            return self._pick("", "<head><title>x</title>", "<body>", "<div>") + inside
        before = [self._boilerplate(self._pick("menu", "head", "ad", "note", "side", "form")) for _ in range(self.rng.integers(0, 5))]
        after = [self._boilerplate(self._pick("talk", "more", "foot", "ad", "side", "note", "form")) for _ in range(self.rng.integers(0, 5))]
        if self._chance(0.6):
            after.append(self._boilerplate("foot"))
        if self._chance(0.25):
            after.insert(0, self._boilerplate("talk"))
        body = "".join(before) + self._article() + "".join(after)
        for _ in range(self.rng.integers(0, 3)):
            body = f"{self._open('div', ('page', 'wrapper', 'container', 'site', 'layout', 'root', 'app'))}{body}</div>"
        return f"<html><head><title>{self._words(2, 9)}</title></head><body>{body}</body></html>"


def labels(page: Page) -> list[int]:
    """1 for the blocks of main text on a page to learn from: those whose nearest marked ancestor is main, all where nothing is marked."""
    out = [int(not any(page.marked))] * len(page.up)
    for i in range(1, len(out)):
        part = page.marked[i]
        out[i] = int(part == "main") if part else out[page.up[i]]
    return out


@cache
def model(pages: int = 700) -> tuple[np.ndarray, BoostedTrees]:
    """The evidence of attribute tokens, and trees, fitted on `pages` made-up pages.

    Half of the pages give the tokens' log odds, and the trees are fitted on
    the other half, so they learn what such evidence is worth on pages that it
    doesn't come from.
    """
    maker = PageMaker()
    made = [parse(maker.page(), marked=True) for _ in range(pages)]
    counts = np.zeros((2, SLOTS))
    for page in made[::2]:
        label = labels(page)
        for i in range(1, len(label)):
            if page.marked[i] or label[i] != label[page.up[i]]:
                for word in set(page.said[i]):
                    counts[label[i], _slot(word)] += 1
    evidence = np.log((counts[1] + 0.5) / (counts[0] + 0.5)) * (counts.sum(axis=0) > 0)
    y = np.array([v for page in made[1::2] for v in labels(page)], dtype=float)
    return evidence, BoostedTrees().fit(features(made[1::2], evidence), y)


def decode(up: list[int], direct: list[int], odds: list[float], change: float = 1.0) -> list[int]:
    """The most likely labelling of a page's nodes, where a node that differs from its parent costs `change`.

    Every node counts with its log odds, those with text of their own most. From
    the leaves up each node learns its best subtree as main and as boilerplate;
    from the root down the choice is read off, so a node contradicts its
    ancestors only where its own evidence pays for it.
    """
    n = len(up)
    off = [0.0] * n
    on = [max(-6.0, min(6.0, o)) * (0.2 + np.log1p(d) / 4) for o, d in zip(odds, direct)]
    for i in range(n - 1, 0, -1):
        u = up[i]
        off[u] += max(off[i], on[i] - change)
        on[u] += max(on[i], off[i] - change)
    label = [0] * n
    label[0] = int(on[0] > off[0])
    for i in range(1, n):
        above = label[up[i]]
        same, other = (on[i], off[i]) if above else (off[i], on[i])
        label[i] = above if same >= other - change else 1 - above
    return label


def _text(page: Page, label: list[int]) -> str:
    blocks = (" ".join("".join(run).split()) for block, run in page.runs if label[block])
    return "\n".join(b for b in blocks if b)


def main_texts(htmls: Iterable[str], evidence: np.ndarray, trees: BoostedTrees) -> Iterator[str]:
    """The main text of every page; the nodes of several pages go through the trees together."""
    waiting: list[Page] = []
    nodes = 0

    def settle() -> Iterator[str]:
        odds = trees.log_odds(features(waiting, evidence)).tolist()
        at = 0
        for page in waiting:
            n = len(page.up)
            yield _text(page, decode(page.up, page.chars, odds[at : at + n]))
            at += n

    for html in htmls:
        waiting.append(parse(html))
        nodes += len(waiting[-1].up)
        if nodes >= GATHERED:
            yield from settle()
            waiting, nodes = [], 0
    if waiting:
        yield from settle()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Trees fitted on made-up pages give every block element of the DOM its log
    odds; decoding along the tree settles which blocks are main text. White
    space in a block becomes one space and blocks are joined by a line feed.
    Null and empty pages have no text; broken, deep or very long markup is read
    to its end; rows with a null page_id and repeated rows each come back; an
    empty table gives none; columns other than page_id, url and html are not
    read, whatever their names.
    """
    evidence, trees = model()

    def measure(htmls: list[bytes]) -> list[tuple[str, int]]:
        return [(t, len(t)) for t in main_texts((h.decode("utf-8", "replace") for h in htmls), evidence, trees)]

    return per_batch(pages, ["page_id", "url"], {"text": "string", "n_chars": "long"}, measure, text="html")
