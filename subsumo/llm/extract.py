"""Operator 7: main text of web pages from flat text blocks.

A page is read once into a flat list of text blocks. A block has its word count and link density and those of its two
neighbours, and what its open elements say: inside an article or main element, inside a boilerplate element (by element
name, role or the words of class and id), inside a form, a heading, a page with an article at all. A decision tree, grown
on the small table of labelled pages below, keeps or drops each block: where a page has no article, words and link
densities decide. Blocks that stay are joined in page order by one space, with character references decoded and white
space folded; no block is shortened.

An article is no boilerplate for its wrapper's sake: a form or a compound name (site-with-sidebar) around it says nothing
about it, a whole name (class="sidebar") only if the page has another article or more plain text outside.

A null or empty page has the empty text. Unclosed comments, scripts and styles run to the page's end, unclosed elements
to their parent's. Rows are independent: repeated rows, ties and extra columns do no harm; an empty table gives an
empty table; a very long page is read whole, in time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# Names of HTML elements and roles, and the words that name boilerplate in class and id.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNREAD = {"head", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "map", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
MAIN = {"article", "main"}
BOILERPLATE = {"nav", "aside", "footer", "dialog", "menu", "button", "select"}
FORMS = {"form", "fieldset"}
ROLES = {"navigation", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "sponsors", "promo", "promos", "promoted", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "toast",
    "nav", "navbar", "navigation", "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "masthead", "skip",
    "footer", "foot", "sidebar", "sidebars", "aside", "rail", "widget", "widgets", "copyright", "disclaimer",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion",
    "share", "sharing", "social", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search",
}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
LAYOUT_WORDS = {"with", "without", "has", "no", "layout"}
HEADER_WORDS = {"header", "head"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "body", "text"}
MAIN_NAMES = {"article", "article-body", "articlebody", "main", "main-content", "content", "post", "post-content", "post-body", "entry", "entry-content", "story", "story-body"}
OWN_NAMES = {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related", "teaser"}

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s>=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>"""
    r"""|<[!?/][^>]*>?""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s>=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=50_000)
def marks(name: str, attributes: str) -> tuple[int, int, int, int, int, int]:
    """(boilerplate, boilerplate by its whole name, boilerplate by a part of its name, header, main, unread) of an element."""
    given = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(attributes)} if attributes else {}
    unread = name in UNREAD or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))
    if name in ("html", "body"):
        return 0, 0, 0, 0, 0, int(unread)
    role = given.get("role", "").lower()
    main = name in MAIN or role in MAIN or given.get("itemprop", "").lower() == "articlebody"
    named = [x for x in f"{given.get('class', '')} {given.get('id', '')}".split()]
    own = {x.lower() for x in named}
    parts = set()
    for x in named:
        words = {w.lower() for w in NAME_PART.findall(x)}
        if not words & LAYOUT_WORDS:
            parts |= words
    if main or own & MAIN_NAMES:
        other = name in BOILERPLATE or role in ROLES or bool(own & OWN_NAMES)
        return int(other), 0, 0, 0, int(not other), int(unread)
    fixed = name in BOILERPLATE or role in ROLES or bool(own & COMMENT_WORDS)
    header = name == "header" or role == "banner" or bool(parts & HEADER_WORDS) and not parts & MAIN_WORDS
    return int(fixed), int(bool(own & WORDS)), int(bool(parts & WORDS)), int(header), 0, int(unread)


def blocks(page: str | None) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(text, words, linked words, in main, in boilerplate, main in named boilerplate, in form, heading) of each text block of a page."""
    found: list[tuple[str, int, int, int, int, int, int, int]] = []
    if not page:
        return found
    stack: list[tuple] = []
    text: list[str] = []
    linked = link_words = main = unread = heading = at = 0
    fixed = whole = part = form = around = 0  # open boilerplate; all but the fixed counted since the innermost main opened
    state = (0, 0, 0, 0, 0)

    def flush() -> None:
        nonlocal link_words
        if text:
            words = "".join(text).split()
            if words:
                found.append((" ".join(words), len(words), min(link_words, len(words)), *state))
            text.clear()
        link_words = 0

    def close(depth: int) -> None:
        nonlocal fixed, whole, part, form, around, main, unread, linked, heading
        while len(stack) > depth:
            name, f, m, u, before = stack.pop()
            fixed, main, unread = fixed - f, main - m, unread - u
            whole, part, form, around = before
            linked -= name == "a"
            heading -= name in HEADINGS

    search, size = TOKEN.search, len(page)
    while at < size:
        token = search(page, at)
        start = token.start() if token else size
        if start > at and not unread:
            piece = page[at:start]
            if "&" in piece:
                piece = html.unescape(piece)
            if not text:
                state = (int(main > 0), int(fixed + whole + part > 0), int(around > 0), int(form > 0), int(heading > 0))
            text.append(piece)
            if linked:
                link_words += len(piece.split())
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        name = token[2].lower()
        if token[1]:
            if name not in INLINE:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if name not in ("textarea", "iframe"):
                continue
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][0] in INLINE:
                depth -= 1
            if depth >= 0 and stack[depth][0] == "p":
                close(depth)
        elif name == "br" or name == "img":
            text.append(" ") if text else None
        if name in VOID:
            continue
        if name in ENDED_BY_SAME:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ENDED_BY_SAME[name]:
                    break
        f, w, p, h, m, u = marks(name, token[3].strip())
        if name in INLINE and (f or w or p or u):
            flush()  # a marked stretch is a block of its own
        stack.append((name, f, m, u, (whole, part, form, around)))
        if m:
            around, whole, part, form = around + whole, 0, 0, 0
        fixed, main, unread = fixed + f, main + m, unread + u
        whole, part, form = whole + w, part + (p or (h and not main)), form + (name in FORMS)
        linked += name == "a"
        heading += name in HEADINGS
    flush()
    return found


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in main", "in form", "heading", "in boilerplate", "page has main")


def features(found: list[tuple]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    if found:
        words, links, main, boilerplate, around, form, heading = np.array([f[1:] for f in found], float).T
        density = links / np.maximum(words, 1)
        out[:, 0], out[:, 1] = words, density
        out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
        enclosed = (main > 0) & (around > 0)
        clean = (main > 0) & (around == 0) & (boilerplate == 0)
        plain = (main == 0) & (boilerplate == 0) & (density < 0.5)
        if clean.any() or words[enclosed].sum() <= words[plain].sum():  # not the page's own article
            boilerplate = np.maximum(boilerplate, enclosed)
        out[:, 6], out[:, 7], out[:, 8], out[:, 9] = main, form, heading, boilerplate
        out[:, 10] = float(((main > 0) & (boilerplate == 0)).any())
    return out


# The labelled table, own invented pages as html. [n] stands for n words to keep, [-n] for n words to drop.
LABELLED = (
    "<nav><li><a>[-1]</a><li><a>[-1]</a><li><a>[-2]</a></nav><header><p>[-4]<p>[-7]</header><article><h1>[6]</h1><p>[60]<p>[3]<p>[25]<p>[1]<div class=ad>[-18]</div></article><aside><a>[-12]</a><p>[-30]</aside><footer><p>[-9]<p>[-14]</footer>",
    "<header><h1>[-3]</h1></header><div id=menu><a>[-1]</a><p><a>[-1]</a></div><main><h1>[8]</h1><p>[44]<p>[2]<p><a>[9]</a><p>[71]<form>[-6]</form></main><section id=comments><p>[-22]<p>[-40]<p>[-3]</section><footer>[-20]</footer>",
    "<nav><a>[-2]</a><p><a>[-2]</a></nav><div class=advert>[-33]</div><article><p>[1]<p>[5]<p>[120]<p>[12]<div class=comments><p>[-30]<p>[-4]</div></article><div class=site-footer>[-55]</div>",
    "<nav><a>[-1]</a></nav><article><h1>[1]</h1><p>[2]</article><footer><p>[-16]<p>[-31]</footer><aside>[-60]</aside>",
    "<article><h1>[9]</h1><p>[9]<p>[80]<aside>[-35]</aside><p>[7]<nav><a>[-6]</a></nav><p><a>[22]</a><p>[90]<form>[-12]</form><footer>[-11]</footer></article>",
    "<div class=cookie-notice><p>[-26]<p>[-3]</div><main><h2>[4]</h2><p>[33]<p><a>[2]</a><h2>[2]</h2><p>[18]<p>[6]<div class=ad>[-45]</div></main><aside><h2>[-2]</h2><p>[-28]<p><a>[-5]</a></aside>",
    "<article><h1>[5]</h1><p>[40]<p>[1]</article>",
    "<main>[2]</main>",
    "<article><p>[300]<p><a>[9]</a><p>[2]<p><a>[35]</a><p>[64]<p>[18]</article>",
    "<p>[-30]<p>[-90]<p>[-4]<article><p>[1]<p>[24]<p>[48]<p>[120]<p>[6]<p>[52]</article><p>[-50]<p>[-14]<p>[-95]",
    "<p><a>[-5]</a><p>[-47]<main><h1>[4]</h1><p>[3]<p>[28]<p><a>[11]</a><p>[61]<p>[1]<p>[46]</main><p>[-110]<p>[-21]<p>[-2]",
    "<article><h1>[7]</h1><p>[150]<p>[1]</article><p><a>[-2]</a><p>[-6]<p>[-45]<p><a>[-4]</a><p>[-120]<p>[-3]",
    # an article in a wrapper that names boilerplate, or in a form
    "<div class='layout-with-sidebar'><article><h1>[5]</h1><p>[40]<p>[3]<form>[-5]</form></article><div class=sidebar>[-20]</div></div>",
    "<div class='page sidebar'><article><h1>[5]</h1><p>[40]<p>[3]</article></div><nav><a>[-2]</a></nav>",
    "<form id=page><nav><a>[-1]</a><p><a>[-1]</a></nav><div id=content><h1>[4]</h1><p>[40]<p>[2]<p>[70]</div><div id=foot>[-8]</div></form>",
    "<form><p>[41]<p>[64]<p>[28]<p>[90]</form>",
    "<form><h1>[6]</h1><p>[55]<p>[38]<p>[72]</form><footer>[-9]</footer>",
    "<main><form><p>[45]<p>[70]<p>[33]</form></main>",
    "<h1>[6]</h1><p>[60]<p>[45]<form><label>[-2]</label><p>[-5]<p>[-9]</form>",
    "<h1>[5]</h1><p>[80]<form><p>[-3]<p>[-1]<p>[-12]</form><p>[51]<p>[36]",
    "<form><p>[-1]<p>[-2]</form><h1>[7]</h1><p>[62]<p>[4]<p>[44]<form>[-14]</form>",
    # pages without an article: words and link densities decide
    "<div><a>[-1]</a></div><div><a>[-1]</a></div><div><a>[-2]</a></div><h1>[7]</h1><p>[62]<p>[40]<p>[4]<p>[55]<p>[22]<div><a>[-3]</a></div><div><a>[-4]</a></div><div><a>[-2]</a></div><div>[-8]</div>",
    "<nav><a>[-2]</a><p><a>[-1]</a></nav><h2>[5]</h2><p>[70]<p>[38]<p>[3]<p>[90]<p>[41]<div><a>[-5]</a></div><div><a>[-6]</a></div><footer>[-12]</footer>",
    "<div><a>[-1]</a></div><div><a>[-1]</a></div><h1>[9]</h1><p>[31]<p>[24]<p>[110]<p>[12]<p>[47]<h3>[-2]</h3><div><a>[-7]</a></div><div><a>[-6]</a></div><div><a>[-9]</a></div><div>[-5]</div>",
    "<div><a>[-3]</a></div><p>[62]<p>[40]<p>[33]<div><a>[-11]</a></div>",
    "<div><a>[-12]</a></div><div><a>[-1]</a></div><p>[90]<p>[44]<p>[5]<p>[61]<div><a>[-25]</a></div><div><a>[-6]</a></div>",
    "<div><a>[-7]</a></div><h1>[3]</h1><p>[41]<div><a>[-8]</a></div><p>[77]<p>[28]<div><a>[-2]</a></div>",
    "<div><a>[-1]</a></div><h1>[4]</h1><p>[60]<p>[1]<p>[40]<div class=comments>[-30]</div>",
    "<div><a>[-4]</a></div><h1>[6]</h1><p>[80]<p>[2]<p>[3]<p>[52]<p>[1]<footer>[-9]</footer>",
    "<div class=advert>[-40]</div><p>[85]<p>[66]<p>[2]<p>[58]<div class=comments>[-35]</div><form>[-8]</form><div><a>[-2]</a></div>",
    "<aside><p>[-50]<p>[-42]</aside><h1>[6]</h1><p>[29]<p>[35]<p>[17]<p>[64]<footer>[-25]</footer>",
    "<div><a>[-2]</a> <a>[-1]</a></div><div>[-4]<a>[-6]</a></div><p>[30]<p>[54]<div><a>[-3]</a></div><div>[-6]</div><div><a>[-1]</a></div>",
    "<div><a>[-1]</a></div><div>[-2]</div><div><a>[-2]</a></div><h1>[8]</h1><p>[48]<p>[26]<div><a>[-1]</a></div><div>[-3]</div><div><a>[-2]</a></div>",
    "<div><a>[-2]</a></div><p>[25]<p>[3]",
    "<div><a>[-3]</a></div><div><a>[-1]</a></div><p>[22]<div><a>[-2]</a></div>",
    "<div><a>[-1]</a></div><p>[33]<p>[2]<p>[1]<p>[27]<div><a>[-4]</a></div><div>[-5]</div>",
    "<nav><a>[-2]</a></nav><h1>[4]</h1><p>[24]<p>[5]<p>[21]<footer>[-6]</footer>",
    "<div><a>[-1]</a></div><div><a>[-1]</a></div><h2>[6]</h2><p>[21]<div><a>[-1]</a></div>",
    "<h1>[5]</h1><p>[23]<ul><li>[2]<li>[4]<li>[3]</ul><p>[26]<div><a>[-2]</a></div>",
    "<p>[30]<p>[31]<p>[32]",
    "<p>[2]",
    "<p>[12]",
    "<p>[45]",
    "<h1>[3]</h1><p>[8]",
    "<h1>[4]</h1><p>[34]<p>[2]",
    "<p>[3]<p>[40]<p>[9]<p>[66]<p>[5]",
    "<p>[14]<p>[7]<p>[18]<p>[1]<p>[11]",
    "<p>[50]<p>[12]<a>[4]</a><p>[61]<p>[28]",
    "<header>[-5]</header><p>[36]<p>[2]<p>[49]<p>[6]<footer>[-7]</footer>",
    "<nav><a>[-3]</a></nav><p>[16]<p>[29]<div class=related-posts><a>[-9]</a><p>[-14]</div>",
)
STRETCH = re.compile(r"\[(-?)(\d+)\]")
SCALES = (0.6, 1.0, 1.8)  # every page of the table is also taken with shorter and longer paragraphs


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED, read as any page is."""
    xs, ys = [], []
    for scale in SCALES:
        for page in LABELLED:
            found = blocks(STRETCH.sub(lambda m: " ".join(["drop" if m[1] else "keep"] * (round(int(m[2]) * scale) if int(m[2]) > 19 else int(m[2]))), page))
            xs.append(features(found))
            ys += [f[0].startswith("keep") for f in found]
    return np.vstack(xs), np.array(ys)


class Tree:
    """A binary classification tree in flat arrays, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature, self.limit, self.left, self.right, self.value = [], [], [], [], []
        self.grow(x, y, depth)
        self.feature, self.limit, self.left, self.right, self.value = map(np.array, (self.feature, self.limit, self.left, self.right, self.value))

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.value)
        for column, empty in ((self.feature, 0), (self.limit, np.inf), (self.left, node), (self.right, node), (self.value, y.mean() >= 0.5)):
            column.append(empty)
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, 0, 0.0)
        if depth and 0 < y.mean() < 1:
            for k in reversed(range(x.shape[1])):  # of equal splits the one on structure wins
                order = np.argsort(x[:, k], kind="stable")
                v, up = x[order, k], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                if len(cut):
                    a, b, p, q = cut, len(y) - cut, up[cut - 1], up[-1] - up[cut - 1]
                    gini = 2 * (p * (a - p) / a + q * (b - q) / b)
                    i = int(np.argmin(gini))
                    best = min(best, (float(gini[i]), k, float((v[cut[i]] + v[cut[i] - 1]) / 2)), key=lambda t: t[0])
            if best[2] or best[1]:
                low = x[:, best[1]] <= best[2]
                if 0 < low.sum() < len(y):
                    self.feature[node], self.limit[node] = best[1], best[2]
                    self.left[node] = self.grow(x[low], y[low], depth - 1)
                    self.right[node] = self.grow(x[~low], y[~low], depth - 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while True:
            low = x[np.arange(len(x)), self.feature[node]] <= self.limit[node]
            following = np.where(low, self.left[node], self.right[node])
            if (following == node).all():
                return self.value[node]
            node = following


@lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree(*labelled())


def main_texts(pages: list[str | None]) -> list[str]:
    found = [blocks(p) for p in pages]
    kept = tree().predict(np.vstack([np.zeros((0, len(FEATURES))), *map(features, found)]))
    out, at = [], 0
    for f in found:
        out.append(" ".join(b[0] for b, k in zip(f, kept[at : at + len(f)], strict=True) if k))
        at += len(f)
    return out


def main_text(page: Column) -> Column:
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([text for part in slices(pages) for text in main_texts(part)], pa.string())

    return extract(page)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
