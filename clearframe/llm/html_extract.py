"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each element is a binary variable, content or not.  It has a potential from its own features (names
in its attributes, text length, share of links) and one with its parent, which depends on its tag.
Messages go up the tree and down again (sum-product), which gives every node's exact marginal.  Both
kinds of potentials are counted on labelled pages; ``labelled_pages`` makes them from templates, and
any other (html, labels) pairs serve as well.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Elements without an end tag, elements whose content is not text, and those never shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button option datalist noembed noframes object math canvas audio video".split())
HIDDEN = frozenset(["head"])
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = BLOCK - frozenset("br body html head td th tr tbody thead tfoot caption legend summary".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_BARRIER = frozenset("article aside body details dialog div fieldset figure footer form header html main nav section table td th ul ol dl blockquote".split())
_GROUPS = (
    "article main", "nav", "footer", "header", "aside", "form fieldset dialog search legend label", "p", "h1 h2 h3 h4 h5 h6 hgroup", "li dt dd", "a", "ul ol menu dl dir",
    "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption details summary", "body html",
)
_GROUP = {tag: i for i, tags in enumerate(_GROUPS) for tag in tags.split()}
_OTHER = len(_GROUPS)
#: Words in class, id and role names that speak for and against content.
GOOD = frozenset("article content post entry story main text prose articlebody body".split())
BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar aside rail "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup share sharing social comment comments commentlist reply replies respond discussion disqus "
    "related recommended recirc toolbar login search form widget copyright legal pagination pager toc skip tags meta byline complementary contentinfo".split()
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
#: Upper ends of the bins of text length; shares of link text.
_LENGTHS, _LINKS = (1, 25, 80, 200, 600), (0.2, 0.5)


@lru_cache(maxsize=4096)
def _cues(attributes: str) -> tuple[bool, bool]:
    words = {w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(m[1] or m[2] or m[3] or "")}
    return bool(words & GOOD), bool(words & BAD)


class Page:
    """Elements in page order (parent before child) and text pieces with their owners."""

    __slots__ = ("tags", "cues", "parents", "shown", "pieces", "inside")

    def __init__(self) -> None:
        self.tags: list[str] = ["html"]
        self.cues: list[tuple[bool, bool]] = [(False, False)]
        self.parents: list[int] = [-1]
        self.shown: list[bool] = [True]
        self.inside: list[bool] = [False]  # below an article or main element
        self.pieces: list[tuple[int, str | None]] = []  # (owner, text), or (-1, None) where a block ends


def parse(source: str) -> Page:
    """Lenient parser: unclosed and misnested tags are closed where HTML would close them."""
    page, stack, names = Page(), [0], ["html"]
    tags, cues, parents, shown, inside, pieces = page.tags, page.cues, page.parents, page.shown, page.inside, page.pieces
    at, search, lower = 0, _TOKEN.search, None
    while True:
        m = search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            pieces.append((stack[-1], text))
        if not m:
            return page
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            pieces.append((-1, None))
        if m[1] or m[4]:
            if name in names:
                for depth in range(len(names) - 1, 0, -1):
                    if names[depth] == name:
                        del stack[depth:], names[depth:]
                        break
                    if name not in _BARRIER and names[depth] in _BARRIER:
                        break
            continue
        attributes = m[3] if m[2] else m[6]
        if name in RAW:
            if attributes[-1:] == "/" and name not in ("script", "style", "title", "textarea"):
                continue
            if lower is None:
                lower = source.lower()
            end = lower.find(f"</{name}", at)
            at = len(source) if end < 0 and name in ("script", "style", "textarea", "title") else at if end < 0 else end
            continue
        if name == "html":
            continue
        if name in VOID or not (name in BLOCK or name == "a" or attributes and _cues(attributes) != (False, False)):
            continue
        if name in _CLOSES_P and "p" in names:
            depth = len(names) - 1
            while depth and names[depth] != "p" and names[depth] not in _BARRIER:
                depth -= 1
            if names[depth] == "p":
                del stack[depth:], names[depth:]
        if name in _SIBLINGS:
            while names[-1] in _SIBLINGS[name] or names[-1] == "p":
                stack.pop(), names.pop()
        parent = stack[-1]
        tags.append(name)
        cues.append(_cues(attributes) if attributes else (False, False))
        parents.append(parent)
        shown.append(shown[parent] and name not in HIDDEN)
        inside.append(inside[parent] or tags[parent] in ("article", "main"))
        stack.append(len(tags) - 1)
        names.append(name)


def node_features(page: Page) -> list[tuple[int, ...]]:
    """Of every node: its tag group, and the values of its other features."""
    n = len(page.tags)
    length, linked = [0] * n, [0] * n
    for owner, text in page.pieces:
        if text is not None and not text.isspace():
            length[owner] += len(text)
    for i in range(n - 1, -1, -1):
        if page.tags[i] == "a":
            linked[i] = length[i]
        p = page.parents[i]
        if p >= 0:
            length[p] += length[i]
            linked[p] += linked[i]
    out = []
    for i, tag in enumerate(page.tags):
        good, bad = page.cues[i]
        size, share = length[i], linked[i] / (length[i] or 1)
        links = 0 if tag == "a" else sum([share >= x for x in _LINKS])
        out.append((_GROUP.get(tag, _OTHER), sum([size >= x for x in _LENGTHS]), links, int(good), int(bad), int(page.inside[i])))
    return out


#: Values of each feature after the tag group.
_VALUES = (len(_LENGTHS) + 1, len(_LINKS) + 1, 2, 2, 2)


def marginals(own: list[float], parents: list[int], given: list[tuple[float, float]]) -> list[float]:
    """Exact marginals of a tree of binary variables, by messages up and down.

    ``own`` are the likelihood ratios of each node's features, 1 over 0; ``given[i]`` are the chances
    that node i is 1 when its parent is 0 and when it is 1 (the root's parent counts as 0).
    Parents come before children.
    """
    n = len(own)
    up, below = [1.0] * n, own[:]  # ratios
    for i in range(n - 1, 0, -1):
        b = below[i] = min(max(below[i], 1e-30), 1e30)
        t0, t1 = given[i]
        up[i] = (1 - t1 + t1 * b) / (1 - t0 + t0 * b)
        below[parents[i]] *= up[i]
    t0 = given[0][0]
    odds = [min(max(below[0], 1e-30), 1e30) * t0 / (1 - t0)] + [0.0] * (n - 1)
    for i in range(1, n):
        from_parent = odds[parents[i]] / up[i]  # the parent's odds without this child
        t0, t1 = given[i]
        o = below[i] * (t0 + t1 * from_parent) / (1 - t0 + (1 - t1) * from_parent)
        odds[i] = min(max(o, 1e-30), 1e30)
    return [o / (1 + o) for o in odds]


class Model:
    """Log likelihood ratios of features by tag group, and chances of a label given the parent's."""

    def __init__(self, ratios: list[np.ndarray], given: np.ndarray):
        self.ratios = [r.tolist() for r in ratios]
        self.given = [tuple(x) for x in given.tolist()]

    def content(self, page: Page) -> list[bool]:
        exp, (sizes, links, good, bad, inside) = math.exp, self.ratios
        features = node_features(page)
        own = [exp(sizes[g][a] + links[g][b] + good[g][c] + bad[g][d] + inside[g][e]) for g, a, b, c, d, e in features]
        odds = marginals(own, page.parents, [self.given[f[0]] for f in features])
        return [o > 0.5 and s for o, s in zip(odds, page.shown)]

    def text(self, source: str | None) -> str:
        page = parse(source or "")
        keep = self.content(page)
        blocks, part = [], []
        for owner, text in page.pieces:
            if text is None:
                if part:
                    blocks.append("".join(part))
                    part = []
            elif keep[owner]:
                part.append(entities.unescape(text) if "&" in text else text)
        if part:
            blocks.append("".join(part))
        return " ".join(" ".join(blocks).split())


def fit(pages: list[tuple[str, list[bool]]], smooth: float = 1.0) -> Model:
    """Counts the potentials on (html, label of every element in page order, the root included)."""
    groups = _OTHER + 1
    seen = [np.zeros((groups, 2, k)) for k in _VALUES]
    pairs = np.zeros((groups, 2, 2))
    for source, labels in pages:
        page = parse(source)
        if len(page.tags) != len(labels):
            raise ValueError("one label is needed for each element")
        for i, (group, *values) in enumerate(node_features(page)):
            y = int(labels[i])
            above = int(labels[page.parents[i]]) if page.parents[i] >= 0 else 0
            pairs[group, above, y] += 1
            for counts, v in zip(seen, values):
                counts[group, y, v] += 1
    ratios = []
    for counts in seen:
        # a tag group leans on all groups together where it is rare
        pooled = counts.sum(0, keepdims=True) + smooth
        own = counts + 10 * smooth * pooled / pooled.sum(2, keepdims=True)
        own = own / own.sum(2, keepdims=True)
        ratios.append(np.log(own[:, 1] / own[:, 0]))
    every = pairs.sum(0) + smooth
    chance = pairs + 4 * smooth * every / every.sum(1, keepdims=True)
    return Model(ratios, (chance / chance.sum(2, keepdims=True))[:, :, 1])


def labelled_pages(n: int = 400, seed: int = 3) -> list[tuple[str, list[bool]]]:
    """Labelled pages from templates: varied containers for the article and for what surrounds it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiounrstl") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    out = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[bool] = [False]

        def add(tag: str, label: bool, inner, attrs: str = "", close: bool = True) -> None:
            parts.append(f"<{tag}{attrs}>")
            if tag in BLOCK or tag == "a" or _cues(attrs) != (False, False):
                labels.append(label)
            inner() if callable(inner) else parts.append(inner)
            if close:
                parts.append(f"</{tag}>")

        def links(label: bool, k: int) -> None:
            for _ in range(k):
                add("li", label, lambda: add("a", label, words(1, 3), ' href="/x"'))

        def named(options: list[tuple[str, str]], label: bool, inner) -> None:
            tag, attrs = r.choice(options)
            add(tag, label, inner, attrs)

        def cls(*names: str) -> list[tuple[str, str]]:
            return [(t, f' {a}="{n_}"') for n_ in names for t in ("div", "section") for a in ("class", "id")]

        def menu() -> None:
            named([("nav", ""), ("nav", ' class="menu"'), *cls("menu", "main-nav", "navbar")], False, lambda: add("ul", False, lambda: links(False, r.randint(3, 8))))

        def advert() -> None:
            named([("aside", ""), ("aside", ' class="ad"'), *cls("ad", "ads", "advert", "banner-ad", "sponsored", "promo")], False, words(4, 40) if r.random() < 0.5 else lambda: add("p", False, words(4, 60)))

        def notice() -> None:
            named(cls("cookie-notice", "notice", "consent", "alert", "popup", "newsletter"), False, lambda: add("p", False, words(6, 50)))

        def form() -> None:
            add("form", False, lambda: (add("p", False, words(2, 30)), add("label", False, words(1, 3))))

        def sidebar() -> None:
            named([("aside", ""), *cls("sidebar", "related", "widget")], False, lambda: (add("h3", False, words(1, 4)), add("ul", False, lambda: links(False, 4)), add("p", False, words(8, 50))))

        def comments() -> None:
            def one() -> None:
                named([("div", ' class="comment"'), ("li", ' class="comment"'), ("div", ""), ("article", ' class="comment"')], False, lambda: add("p", False, words(8, 150)))

            named([*cls("comments", "comment-list", "replies", "discussion")], False, lambda: (add("h2", False, words(1, 2)), [one() for _ in range(r.randint(1, 4))]))

        def paragraph() -> None:
            def inner() -> None:
                parts.append(words(3, 140))
                if r.random() < 0.2:
                    add("a", True, words(1, 4), ' href="/y"')
                    parts.append(" " + words(2, 30))

            add("p", True, inner)

        def article(bare: bool = False) -> None:
            def inner() -> None:
                if r.random() < 0.8:
                    add("header", True, lambda: add("h1", True, words(2, 10))) if r.random() < 0.15 else add("h1", True, words(2, 10))
                for _ in range(1 if r.random() < 0.15 else r.randint(1, 9)):
                    kind = r.random()
                    if kind < 0.72:
                        paragraph()
                    elif kind < 0.78:
                        add("h2", True, words(1, 7))
                    elif kind < 0.84:
                        add(r.choice(["ul", "ol"]), True, lambda: [add("li", True, words(2, 25)) for _ in range(r.randint(2, 5))])
                    elif kind < 0.88:
                        add("blockquote", True, lambda: add("p", True, words(5, 50)))
                    elif kind < 0.91:
                        add("figure", True, lambda: add("figcaption", True, words(3, 15)))
                    elif kind < 0.93:
                        add("table", True, lambda: add("tr", True, lambda: (add("td", True, words(1, 6)), add("td", True, words(1, 6)))))
                    elif kind < 0.95:
                        add("div", True, paragraph)
                    else:
                        r.choice([advert, sidebar, form, notice])()
                if r.random() < 0.06:
                    named([("footer", ""), *cls("share", "tags", "byline")], False, words(2, 12))
                if r.random() < 0.08:
                    comments()

            if bare:
                inner()
                return
            named([("article", "")] * 6 + [("article", ' class="post"'), ("main", "")] + cls("content", "post-content", "entry", "article-body", "story") + [("div", "")] * 2, True, inner)

        def body() -> None:
            if r.random() < 0.6:
                named([("header", ""), *cls("header", "masthead")], False, lambda: (add("h1", False, words(1, 4)) if r.random() < 0.5 else parts.append(words(1, 5)), menu() if r.random() < 0.4 else None))
            for piece, chance in ((menu, 0.8), (advert, 0.5), (notice, 0.3), (sidebar, 0.2)):
                if r.random() < chance:
                    piece()
            article(bare)
            for piece, chance in ((comments, 0.4), (sidebar, 0.3), (form, 0.3), (advert, 0.3)):
                if r.random() < chance:
                    piece()
            if r.random() < 0.85:
                named([("footer", "")] * 3 + cls("footer", "copyright"), False, words(3, 25) if r.random() < 0.6 else lambda: add("p", False, words(3, 25)))

        bare = labels[0] = r.random() < 0.05
        add("body", bare, body)
        out.append(("<html>" + "".join(parts) + "</html>", labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without content nodes, give an empty text.  Repeated rows each
    give a row; nulls in page_id and url stay.
    """
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(_extract(model or default_model()), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
