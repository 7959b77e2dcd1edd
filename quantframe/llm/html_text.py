"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements (and of inline elements whose class names a role).
Each node has a hidden label, content or not. A node's potential comes from what it is (a role
named by its class or tag, else its tag), how much text it holds itself and how much of that is
links; an edge's potential couples child and parent. Elements that are never part of an
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of
readers) are observed as not content, and so is all below them. Sum-product messages run
from the leaves to the root and back and give each node's exact marginal; the text of nodes
above one half is the main text.

Potentials are log ratios of counts over labelled pages, added to fixed prior counts that
decide what the labels have never shown. A page is labelled when it marks its article
(``article``, ``main`` or ``itemprop=articleBody``): nodes inside are content, others are not.
Counting covers all labelled pages; what reaches the driver is one row a feature, of which
there are at most ``len(KINDS) + LENGTHS + SHARES + 4`` for each label.

Blocks of main text have character references decoded and white space runs turned into one
space, are trimmed, and joined by newlines in page order. Defined results: a null or empty page
gives an empty text; broken markup closes as browsers close it, in outline; text outside all
elements belongs to the root.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.common import free_name

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|itemprop|aria-label|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I
)
_RAW = ("script", "style", "textarea", "title", "iframe", "noframes", "xmp")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img br picture source svg path".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SAME = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

#: What an element is by its tag, where that says more than "box".
_BY_TAG = {
    "article": "article", "main": "article", "p": "paragraph", "blockquote": "paragraph",
    "pre": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading",
    "h5": "heading", "h6": "heading", "li": "item", "dt": "item", "dd": "item", "td": "item",
    "th": "item", "figcaption": "item", "html": "page", "body": "page", "nav": "menu",
    "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
    "button": "form", "select": "form", "option": "form", "fieldset": "form", "textarea": "form",
    "head": "unseen", "script": "unseen", "style": "unseen", "noscript": "unseen",
    "template": "unseen", "title": "unseen", "iframe": "unseen", "svg": "unseen",
    "object": "unseen", "dialog": "notice", "noframes": "unseen", "xmp": "unseen",
}
#: Words of a class, id or role that name a role.
_BY_WORD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar banner hero",
    "footer": "footer copyright colophon legal imprint contentinfo",
    "sidebar": "sidebar aside related recommended recommendations widget widgets rail "
    "complementary teaser trending popular",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter "
    "subscribe subscription paywall toast disclaimer",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "promoted adsense",
    "form": "form search login signin signup register contact-form searchbox",
    "comments": "comment comments disqus reply replies respond responses discussion",
    "sharing": "share sharing social follow",
    "unseen": "hidden invisible sr-only visually-hidden screen-reader-text",
    "article": "content article articlebody post entry story main maincontent body text prose",
}
_WORDS = {w: kind for kind, words in _BY_WORD.items() for w in words.split()}
_BARRED = frozenset(
    "menu header footer sidebar notice advert form comments sharing unseen".split()
)

#: First words of compounds that name what an element has or lacks, not what it is.
_OTHERS = frozenset("no not non has have with without".split())

#: Prior counts (content, not content) of a kind.
_PRIOR = {
    "article": (20.0, 0.5), "paragraph": (8.0, 2.0), "heading": (4.0, 2.0), "item": (1.0, 1.0),
    "box": (1.0, 1.5), "page": (0.2, 20.0),
}
KINDS = (*_PRIOR, *sorted(_BARRED))
LENGTHS, SHARES = 5, 4
_PRIOR_LENGTH = ((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (4.0, 1.0), (6.0, 1.0))
_PRIOR_SHARE = ((4.0, 2.0), (2.0, 2.0), (1.0, 2.0), (0.5, 6.0))
#: Prior counts of (parent label, child label).
_PRIOR_EDGE = {(0, 0): 20.0, (0, 1): 5.0, (1, 0): 2.0, (1, 1): 40.0}


@dataclass
class Tree:
    """Nodes in page order; every parent stands before its children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[str] = field(default_factory=lambda: ["page"])
    barred: list[bool] = field(default_factory=lambda: [False])
    marked: list[bool] = field(default_factory=lambda: [False])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    #: (node, text) of each block, in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def features(self, n: int) -> tuple[str, str, str]:
        chars = self.chars[n]
        length = 0 if not chars else 1 if chars <= 20 else 2 if chars <= 80 else 3 if chars <= 300 else 4
        share = self.linked[n] / chars if chars else 0.0
        linked = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3
        return f"kind:{self.kind[n]}", f"length:{length}", f"links:{linked}"


def _named(token: str) -> str:
    """The role that a class token names, or nothing.

    ``no-sidebar`` and ``has-sidebar`` speak of another element; ``entry-header`` is the title
    and lead of an article. In other compounds a word for what is no article decides.
    """
    if token in _WORDS:
        return _WORDS[token]
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    if len(words) > 1 and words[0] in _OTHERS:
        return ""
    kinds = [_WORDS[w] for w in words if w in _WORDS]
    barred = [k for k in kinds if k in _BARRED]
    if barred and set(barred) == {"header"} and words[0] in _WORDS and kinds[0] == "article":
        return ""
    return (barred or kinds or [""])[0]


def _role(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(kind, whether a class names it, whether it marks an article)."""
    kind = _BY_TAG.get(tag, "box")
    marks = tag in ("article", "main")
    if not attributes:
        return kind, False, marks
    named = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden":
            return "unseen", True, False
        if name == "aria-label":
            continue
        if name == "itemprop":
            marks |= value == "articlebody"
            continue
        for token in value.split():
            found = _named(token)
            wins = _WORDS.get(token) == "article"
            if found and (wins or named != "article" and (not named or found in _BARRED)):
                named = found
    if named and kind not in _BARRED and tag not in ("html", "body", "article", "main"):
        return named, True, marks
    return kind, bool(named), marks


def parse(page: str) -> Tree:
    tree, stack, parts = Tree(), [(0, "")], []
    #: Places in the stack of each open tag, so that closing need not search it.
    places: defaultdict[str, list[int]] = defaultdict(list)
    at, in_link = 0, False

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            tree.blocks.append((stack[-1][0], text))

    def add(text: str) -> None:
        text = html.unescape(text)
        n, size = stack[-1][0], len(text.strip())
        tree.chars[n] += size
        tree.linked[n] += size * in_link
        parts.append(text)

    def open_(tag: str, kind: str, marks: bool) -> None:
        above = stack[-1][0]
        tree.parent.append(above)
        tree.kind.append(kind)
        tree.barred.append(tree.barred[above] or kind in _BARRED)
        tree.marked.append(tree.marked[above] or marks)
        tree.chars.append(0)
        tree.linked.append(0)
        places[tag].append(len(stack))
        stack.append((len(tree.parent) - 1, tag))

    def close(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Close up to the innermost of ``names``, unless one of ``within`` is nearer."""
        innermost = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
        k = innermost(names)
        if k > innermost(within):
            for _, tag in stack[k:]:
                places[tag].pop()
            del stack[k:]

    position = 0
    while m := _TAG.search(page, position):
        position = m.end()
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            in_link = not closing
        inline = tag in _INLINE
        if closing:
            if not inline:
                flush()
                close((tag,))
                in_link = False
            elif places[tag]:
                flush()
                close((tag,))
            continue
        kind, named, marks = _role(tag, m[3] or "")
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = position = end.end() if end else len(page)
            continue
        if inline and not (named and kind in _BARRED):
            continue
        flush()
        if tag in _CLOSES_P:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in _SAME:
            close(*_SAME[tag])
        if tag in _VOID:
            continue
        if not m[0].endswith("/>") or not inline:
            open_(tag, kind, marks)
            in_link = tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return tree


def count_labels(page: str | None) -> Counter:
    """(feature, label) counts of a labelled page; nothing of one that marks no article."""
    tree, seen = parse(page or ""), Counter()
    if not any(tree.marked):
        return seen
    label = [int(m and not b) for m, b in zip(tree.marked, tree.barred)]
    for n in range(1, len(label)):
        if tree.barred[n]:
            continue
        seen.update((f, label[n]) for f in tree.features(n))
        seen[f"edge:{label[tree.parent[n]]}", label[n]] += 1
    return seen


@dataclass(frozen=True)
class Model:
    """Log potentials: of features as (not content, content), of edges as [parent][child]."""

    of: dict[str, tuple[float, float]]
    edge: tuple[tuple[float, float], tuple[float, float]]


def fit(counts: dict[tuple[str, int], int]) -> Model:
    """Potentials from counts. An article's mark is what labels are made of, so the kind that
    it gives keeps its prior alone."""
    prior = {f"kind:{k}": v for k, v in _PRIOR.items()}
    prior |= {f"length:{i}": v for i, v in enumerate(_PRIOR_LENGTH)}
    prior |= {f"links:{i}": v for i, v in enumerate(_PRIOR_SHARE)}
    total = [sum(n for (f, y), n in counts.items() if f.startswith("kind:") and y == z) for z in (0, 1)]
    of = {}
    for f, (yes, no) in prior.items():
        n1, n0 = (0, 0) if f == "kind:article" else (counts.get((f, 1), 0), counts.get((f, 0), 0))
        # Rates among nodes of either label; the prior counts stand for twenty nodes of each.
        of[f] = (
            float(np.log((n0 + no) / (total[0] + 20.0))),
            float(np.log((n1 + yes) / (total[1] + 20.0))),
        )
    edge = []
    for above in (0, 1):
        n = [counts.get((f"edge:{above}", y), 0) + _PRIOR_EDGE[above, y] for y in (0, 1)]
        edge.append(tuple(float(np.log(x / sum(n))) for x in n))
    return Model(of, tuple(edge))


def train(pages: DataFrame, page: str = "html") -> Model:
    """Counts over all labelled pages, added up per task, then by feature and label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for p in batch["page"]:
                seen.update(count_labels(p))
        rows = [(f, y, n) for (f, y), n in seen.items()]
        yield pd.DataFrame(rows, columns=["feature", "label", "n"])

    rows = (
        pages.select(F.col(page).alias("page"))
        .mapInPandas(count, "feature string, label int, n bigint")
        .groupBy("feature", "label")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return fit({(r["feature"], r["label"]): r["n"] for r in rows})


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    hi, lo = (a, b) if a > b else (b, a)
    return hi + float(np.log1p(np.exp(lo - hi))) if lo > hi - 40 else hi


def marginals(tree: Tree, model: Model) -> list[float]:
    """P(content) of each node, by one pass of messages up and one down."""
    n = len(tree.parent)
    own = [[0.0, 0.0] for _ in range(n)]
    for k in range(n):
        if not tree.barred[k]:
            for f in tree.features(k):
                no, yes = model.of[f]
                own[k][0] += no
                own[k][1] += yes
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    edge = model.edge
    for k in range(n - 1, 0, -1):
        a, b = own[k]
        if tree.barred[k]:
            # Observed as not content: what it sends is how well a parent explains that.
            up[k] = (0.0, 0.0) if tree.barred[tree.parent[k]] else (edge[0][0], edge[0][0])
        else:
            up[k] = tuple(_plus(edge[p][0] + a, edge[p][1] + b) for p in (0, 1))
        above = own[tree.parent[k]]
        above[0] += up[k][0]
        above[1] += up[k][1]
    out = [0.0] * n
    down: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for k in range(n):
        if tree.barred[k]:
            continue
        if k:
            p = tree.parent[k]
            rest = [own[p][y] + down[p][y] - up[k][y] for y in (0, 1)]
            down[k] = tuple(_plus(rest[0] + edge[0][y], rest[1] + edge[1][y]) for y in (0, 1))
        gap = own[k][1] + down[k][1] - own[k][0] - down[k][0]
        out[k] = 1.0 / (1.0 + float(np.exp(min(700.0, -gap))))
    return out


def main_text(page: str | None, model: Model) -> str:
    tree = parse(page or "")
    shares = marginals(tree, model)
    return "\n".join(text for n, text in tree.blocks if shares[n] > 0.5)


def with_main_text(
    pages: DataFrame, model: Model, page: str = "html", out: str = "main_text"
) -> DataFrame:
    """``pages`` with the main text; ``out`` gets underscores where the name is taken."""

    def each(rows: pd.Series) -> pd.Series:
        return rows.map(lambda p: main_text(p, model))

    return pages.withColumn(free_name(pages, out), F.pandas_udf(each, "string")(F.col(page)))
