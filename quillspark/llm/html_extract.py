"""Main-text extraction from web pages with gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements. Every block gets features (density of its subtree, tokens
of its attributes and its ancestors', depth, statistics of its siblings), boosted trees give the
probability that it is main text, and a decoding over the tree picks the most likely consistent choice:
below a block that is out, everything is out; a block that is in, and all that lead to it, may have parts out.

The trees are fitted on the driver to a bounded sample: SAMPLE_PAGES pages of the table, labelled by their own
markup (what an article or main element holds, without what its marked-up insets hold), each once as it
is and once with its telling tags and attributes blanked, and MADE_PAGES pages made up here, labelled as they are
made: articles of paragraphs, lists, tables, definition lists, figures, headings in a block of their own, and
sidebars, notices, forms and comments around and within them, which hold tables and lists, too.

Defined results: a null or empty page has an empty text; repeated rows each get theirs; in an empty table
only made-up pages are learned from; other columns are carried along by ``extract``, where one of the name of the
result is replaced, and left out by ``digest``. Whole pages are read, whatever their length; a worker holds the trees of
some pages at once, of at most CHARS_AT_ONCE characters or of one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The bound of the sample that the trees are fitted on.
SAMPLE_PAGES, MADE_PAGES = 300, 300
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 4, 0.25, 32, 5
PAGES_AT_ONCE, CHARS_AT_ONCE = 256, 2_000_000

# Elements of HTML by how they are laid out.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object select option textarea button datalist canvas audio video map".split())
#: What a head can hold: a start of anything else, or text, ends it where its end tag is left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title script style noscript noframes template".split())
IN_TABLE = frozenset("caption tbody td tfoot th thead tr".split())
#: A start of one of these ends an open one of those, unless the barrier is in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
GOOD_TOKENS = frozenset("article content main post entry story text body blog page prose maincontent articlebody".split())
BAD_TOKENS = frozenset(
    "ad ads advert advertisement adbox banner breadcrumb breadcrumbs comment comments cookie consent disqus footer foot form header masthead hidden legal login menu modal "
    "nav navbar navigation newsletter notice alert pagination pager popup promo promoted recommended related reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
BAD_TAGS = frozenset("nav aside footer header form menu dialog".split())
TELLING = BAD_TAGS | {"article", "main"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The attribute by which made-up pages are labelled; no feature sees it.
LABEL = "data-made-label"
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<(?:[a-zA-Z]|/[a-zA-Z]|!)[^<>]*\Z")


class Block:
    """A block element: its own text comes in runs between its child blocks."""

    __slots__ = ("tag", "tokens", "parent", "children", "items", "depth", "link", "tags", "label")

    def __init__(self, tag: str, tokens: frozenset, parent: "Block | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Block] = []
        self.items: list = []  # str: a piece of text; Block: a child, in page order
        self.depth = parent.depth + 1 if parent else 0
        self.link = 0
        self.tags = 1
        self.label: bool | None = None  # of made-up pages: whether this and what it holds is main text


class _Tree(HTMLParser):
    """Builds blocks; inline elements leave their text in the block around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Block("html", frozenset(), None)
        self.links = 0
        self.unseen: list[str] = []  # the open unseen element, and what is open in it, outermost first

    def _leave(self, tag):
        """Close the innermost open element of that tag among the unseen ones, with all that is in it."""
        del self.unseen[len(self.unseen) - 1 - self.unseen[::-1].index(tag) :]

    def _is_open(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        return node.parent is not None

    def _ends_unseen(self, tag):
        """Whether a start tag shows that the unseen elements were over, their end tags left out."""
        if self.unseen[0] == "head":
            return tag == "body" or self.unseen == ["head"] and tag not in IN_HEAD
        return tag in IN_TABLE and "table" not in self.unseen and "template" not in self.unseen and self._is_open("table")

    def _in_plain(self):
        """Whether what looks like tags is text, up to the end tag."""
        return bool(self.unseen) and (self.unseen[-1] == "textarea" or self.unseen[-1] == "title" and "svg" not in self.unseen)

    def _end_for(self, tag):
        """End what a start tag ends among the unseen elements; whether the tag is used up by that."""
        if self.unseen and self._ends_unseen(tag):
            self.unseen.clear()
        if "select" in self.unseen and tag in ("select", "input", "textarea"):
            self._leave("select")
            return tag == "select"
        return False

    def handle_starttag(self, tag, attrs):
        if self._in_plain() or self._end_for(tag):
            return
        if tag in ("option", "button") and tag in self.unseen:
            self._leave(tag)
        if tag in UNSEEN or self.unseen:
            if tag in UNSEEN or tag in BLOCKS and tag not in ("html", "hr"):
                self.unseen.append(tag)
            return
        if tag == "html":
            return
        if tag not in BLOCKS:
            self.at.tags += 1
            if tag == "br":
                self.at.items.append(" ")
            elif tag == "a":
                self.links = 1
            return
        self.links = 0
        if tag in CLOSES:
            ends, barrier = CLOSES[tag]
            node = self.at
            while node.parent and node.tag not in barrier:
                if node.tag in ends:
                    self.at = node.parent
                    if tag != "tr":
                        break
                node = node.parent
        elif self.at.tag == "p" or self.at.tag in HEADINGS and tag in HEADINGS:
            self.at = self.at.parent
        if tag == "hr":
            return
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        node = Block(tag, frozenset(_TOKEN.findall(said.lower())) if said else frozenset(), self.at)
        for k, v in attrs:
            if k == LABEL:
                node.label = v == "in"
        self.at.children.append(node)
        self.at.items.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        if not self._in_plain():
            self._end_for(tag)
        if tag == "br" and not self.unseen:
            self.at.items.append(" ")

    def handle_endtag(self, tag):
        if self._in_plain() and tag != self.unseen[-1]:
            return
        if tag in self.unseen:
            self._leave(tag)
            return
        if self.unseen:
            # The end of a block around the unseen elements ends them; what a template holds, and a paragraph around a button, is apart.
            if tag not in BLOCKS or "template" in self.unseen or tag == "p" and "button" in self.unseen or not self._is_open(tag):
                return
            self.unseen.clear()
        if tag == "a":
            self.links = 0
        elif tag in BLOCKS and tag not in ("html", "body"):
            node = self.at
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                self.at, self.links = node.parent, 0

    def handle_data(self, data):
        if self.unseen == ["head"] and data.strip():
            self.unseen.clear()
        if not self.unseen:
            self.at.items.append(data)
            if self.links:
                self.at.link += len(data.strip())


def parse(html: str | None) -> Block:
    tree = _Tree()
    tree.feed(_CUT_TAG.sub("", html or ""))
    tree.close()
    return tree.root


def runs(node: Block) -> list[str | Block]:
    """A block's own text, joined between child blocks, in page order with these."""
    out, piece = [], []
    for item in [*node.items, None]:
        if isinstance(item, str):
            piece.append(item)
            continue
        if piece and (text := _SPACE.sub(" ", "".join(piece)).strip()):
            out.append(text)
        piece = []
        if item is not None:
            out.append(item)
    return out


def in_order(root: Block) -> list[Block]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


FEATURES = 33


def features(nodes: list[Block], blank: bool = False) -> np.ndarray:
    """A row for every block, which come parents first. blank: without what tags and attributes tell."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    own = np.zeros((n, 5))  # characters, of links, words, commas and stops, tags
    for i, x in enumerate(nodes):
        text = " ".join(t for t in x.items if isinstance(t, str))
        own[i] = len(text.strip()), x.link, text.count(" ") if text.strip() else 0, text.count(",") + text.count("."), x.tags
    total = own.copy()
    height = np.zeros(n)
    for i in range(n - 1, 0, -1):
        j = place[id(nodes[i].parent)]
        total[j] += total[i]
        height[j] = max(height[j], height[i] + 1)
    page = max(1.0, total[0, 0])
    kinds: dict[tuple[int, str], int] = {}  # of siblings: those of a tag under a parent
    kind = np.array([kinds.setdefault((id(x.parent), x.tag), len(kinds)) for x in nodes])
    alike = np.bincount(kind)
    mean_alike = np.bincount(kind, total[:, 0]) / alike
    out = np.zeros((n, FEATURES))
    bad_above, good_above = np.zeros(n), np.zeros(n)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    for i, x in enumerate(nodes):
        tokens, tag = (frozenset(), "div" if x.tag in TELLING else x.tag) if blank else (x.tokens, x.tag)
        good = len(tokens & GOOD_TOKENS) + (tag in ("article", "main"))
        bad = len(tokens & BAD_TOKENS) + (tag in BAD_TAGS)
        j = place[id(x.parent)] if x.parent else i
        bad_above[i], good_above[i] = (bad_above[j] + bad, good_above[j] + good) if x.parent else (bad, good)
        siblings = x.parent.children if x.parent else [x]
        t, o, up = total[i], own[i], total[j]
        out[i] = (
            t[0], o[0], t[0] / page, t[0] / t[4], t[1] / max(1.0, t[0]), t[2], o[2], t[3] / max(1.0, t[2]), t[4], x.depth,
            height[i], len(x.children), len(siblings), alike[kind[i]], mean_alike[kind[i]], before[i] / page, i / n, up[0] / page, up[1] / max(1.0, up[0]), up[0] / up[4],
            tag == "p", tag in HEADINGS, tag in ("li", "ul", "ol"), tag == "div", tag in ("td", "tr", "table"), good, bad, good_above[i], bad_above[i], tag == "blockquote",
            tag in ("dl", "dt", "dd"), tag in ("figure", "figcaption", "caption"), tag in ("pre", "section", "tbody", "thead"),
        )
    return out


def weak_labels(nodes: list[Block]) -> np.ndarray | None:
    """Whether a block is main text, by the page's own markup; None if it has no article or main element. Labels of made-up pages go before."""
    made = any(x.label is not None for x in nodes)
    if not made and not any(x.tag in ("article", "main") for x in nodes):
        return None
    state: dict[int, bool] = {}
    for x in nodes:
        above = state.get(id(x.parent), False) if x.parent else False
        if made:
            state[id(x)] = above if x.label is None else x.label
        else:
            state[id(x)] = not _is_inset(x, above) and (above or x.tag in ("article", "main") and not _in_inset(x))
    return np.array([state[id(x)] for x in nodes])


def _is_inset(x: Block, inside: bool = False) -> bool:
    """Whether a block is marked as something apart; the block around an article's title isn't, though it may be called a header."""
    bad = x.tokens & BAD_TOKENS
    return x.tag in BAD_TAGS or bool(bad) and not (inside and bad == {"header"} and any(c.tag in HEADINGS for c in x.children))


def _in_inset(x: Block) -> bool:
    while x := x.parent:
        if _is_inset(x):
            return True
    return False


def made_page(seed: int) -> str:
    """A page with an article and, around and within it, what doesn't belong to it; labelled."""
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    said = lambda a, b: (" ".join(word() for _ in range(r.randint(a, b))) + r.choice(".....?!")).capitalize()
    title = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    prose = lambda: " ".join(said(3, 18) for _ in range(r.randint(1, 6)))
    links = lambda k: "".join(f'<li><a href="/{word()}">{title(1, 3)}</a></li>' for _ in range(k))
    rows = lambda k, cell: "".join(f"<tr>{''.join(f'<{t}>{cell()}</{t}>' for t in r.choice(['td td', 'td td td', 'th td']).split())}</tr>" for _ in range(k))
    value = lambda: r.choice([word, lambda: str(r.randint(0, 10**6)), lambda: title(1, 4), lambda: said(2, 9)])()
    terms = lambda k, say: "".join(f"<dt>{title(1, 3)}</dt><dd>{say()}</dd>" for _ in range(k))
    many = lambda a, b: r.randint(a, b) if r.random() < 0.97 else r.randint(60, 250)
    named = lambda *names: f' class="{r.choice(names)}"' if r.random() < 0.8 else ""
    extra = [
        f"<div{named('sidebar', 'widget', 'related', 'right-col')}><h3>{title(1, 3)}</h3><ul>{links(r.randint(2, 8))}</ul></div>",
        f"<aside><h3>{title(1, 4)}</h3><p>{said(4, 20)}</p></aside>",
        f"<aside{named('infobox', 'hours')}><dl>{terms(r.randint(2, 5), lambda: title(1, 3))}</dl></aside>",
        f'<div class="{r.choice(["notice", "cookie-banner", "alert", "consent"])}"><p>{said(5, 25)}</p></div>',
        f'<div class="{r.choice(["notice", "cookie-banner", "alert", "consent"])}">{said(5, 25)}</div>',
        f'<div class="{r.choice(["ad", "ads", "advert", "sponsored"])}">{said(3, 15)}</div>',
        f'<div class="{r.choice(["ad", "advert", "promo"])}"><figure><img src="/x"><figcaption>{title(2, 8)}</figcaption></figure></div>',
        f'<form action="/x"><label>{word()}</label><input name="q"><p>{said(3, 9)}</p></form>',
        f'<form action="/x"><table>{rows(r.randint(1, 4), lambda: title(1, 2))}</table></form>',
        f'<div class="{r.choice(["newsletter", "share", "promo", "social", "subscribe"])}"><p>{said(3, 12)}</p></div>',
        f'<div class="{r.choice(["widget calendar", "sidebar", "related-table"])}"><table>{rows(r.randint(2, 6), lambda: str(r.randint(1, 31)))}</table></div>',
    ]
    out = lambda html: html.replace(">", f' {LABEL}="out">', 1)
    comment = lambda: r.choice([f"<p>{prose()}</p>", f"<h4>{title(1, 2)}</h4><p>{prose()}</p>", f"<blockquote>{said(4, 12)}</blockquote><p>{prose()}</p>"])
    holder = r.choice(["div", "li", "article"])
    comments = f'<{(tag := r.choice(["section", "div"]))} class="{r.choice(["comments", "comment-list", "responses comments"])}"><h3>{title(1, 2)}</h3>' + "".join(f'<{holder} class="{r.choice(["comment", "reply"])}">{comment()}</{holder}>' for _ in range(r.randint(1, 5))) + f"</{tag}>"
    r.shuffle(extra)
    plain = r.random() < 0.1
    body = [f"<div>{said(5, 20)}</div>" if plain else f"<p>{prose()}</p>" for _ in range(many(2, 9))]

    def put(chance: float, html: str) -> None:
        if r.random() < chance:
            body.insert(r.randint(min(1, len(body)), len(body)), html)

    put(0.35, f"<{(tag := r.choice(['ul', 'ol']))}>{''.join(f'<li>{said(2, 14)}</li>' for _ in range(many(2, 6)))}</{tag}>")
    put(0.15, f"<ul>{''.join(f'<li><p>{prose()}</p></li>' for _ in range(r.randint(2, 5)))}</ul>")
    put(0.4, f"<{(tag := r.choice(['h2', 'h3', 'h4']))}>{title(1, 6)}</{tag}>")
    put(0.2, f"<h2>{title(1, 6)}</h2>")
    put(0.3, f"<blockquote>{r.choice([prose(), f'<p>{prose()}</p>'])}</blockquote>")
    head = f"<thead><tr><th>{title(1, 2)}</th><th>{title(1, 2)}</th></tr></thead>" if r.random() < 0.5 else ""
    caption = f"<caption>{title(2, 7)}</caption>" if r.random() < 0.4 else ""
    table = f"<table>{caption}{head}{r.choice(['<tbody>', ''])}{rows(many(1, 9), value)}</table>"
    put(0.45, r.choice([table, f"<div{named('table-wrap', 'scroll', 'table')}>{table}</div>"]))
    put(0.35, f"<dl>{terms(many(1, 6), r.choice([lambda: title(1, 3), lambda: said(4, 16), prose]))}</dl>")
    put(0.3, f'<figure{named("image", "wide")}><img src="/{word()}"><figcaption>{r.choice([title(2, 9), said(5, 20)])}</figcaption></figure>')
    put(0.15, f"<pre>{prose()}</pre>")
    put(0.2, f"<section{named('part', 'chapter')}><h3>{title(1, 5)}</h3><p>{prose()}</p><p>{prose()}</p></section>")
    put(0.2, f"<div{named('lead', 'summary', 'intro', 'text')}>{r.choice([prose(), f'<p>{prose()}</p><p>{prose()}</p>'])}</div>")
    for html in extra[:2]:
        put(0.25, out(html))
    # An article can be little but a table or list.
    if r.random() < 0.08:
        body = [r.choice([table, f"<dl>{terms(many(3, 9), prose)}</dl>", f"<ul>{''.join(f'<li>{said(3, 14)}</li>' for _ in range(many(4, 20)))}</ul>"])]
    top = r.choice(["h1", "h1", "h1", "h2"])
    heading = f"<{top}>{title(2, 9)}</{top}>"
    heading = r.choice([heading, heading, f"<div{named('post-header', 'entry-header', 'article-head', 'title-block', 'header')}>{heading}</div>", f"<div{named('post-header', 'entry-title')}>{heading}<p>{said(3, 12)}</p></div>"])
    tag, name = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="story-body"'), ("div", "")])
    inner = f"{heading}{''.join(body)}"
    if r.random() < 0.2:
        inner = f"<div{named('entry-content', 'body', 'text')}>{inner}</div>"
    main = f'<{tag}{name} {LABEL}="in">{inner}{out(comments) if r.random() < 0.3 else ""}</{tag}>'
    if r.random() < 0.12:  # nothing around the article
        main = "".join(x if LABEL in x else x.replace(">", f' {LABEL}="in">', 1) for x in [heading, *body])
    if r.random() < 0.25:
        main = f"<div{named('wrapper', 'container', 'page', 'layout')}>{main}{''.join(extra[6:8])}</div>"
    foot = r.choice([f"&copy; {said(2, 12)}", f"<p>{said(2, 12)}</p><ul>{links(3)}</ul>", f"<dl>{terms(2, lambda: title(1, 3))}</dl>", f"<table>{rows(2, lambda: title(1, 2))}</table>"])
    top_bar = r.choice([f"<header><div class=\"logo\">{word()}</div></header>", f"<header><h1>{title(1, 2)}</h1><p>{title(2, 6)}</p></header>", f"<div class=\"header\"><h1>{title(1, 2)}</h1></div>", ""])
    return (
        f'<html><body>{top_bar}<nav><ul>{links(r.randint(3, 9))}</ul></nav>{"".join(extra[2 : 2 + r.randint(0, 3)])}'
        f"{main}{''.join(extra[8 : 8 + r.randint(0, 3)])}{comments if r.random() < 0.4 else ''}{r.choice(['<footer>', '<div class=footer>'])}{foot}</footer></div></body></html>"
    )


class Boosted:
    """Boosted trees of a fixed depth for the logistic loss, on binned features."""

    def __init__(self, edges: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: float):
        self.edges, self.trees, self.start = edges, trees, start

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, f = x.shape
        edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T  # per feature
        binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(f)], 1)
        start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score, trees = np.full(n, start), []
        flat = binned + np.arange(f)[None, :] * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, split = np.zeros(2**DEPTH, int), np.full(2**DEPTH, BINS)  # all go left where nothing is gained
            node = np.ones(n, int)
            for level in range(DEPTH):
                lo = 2**level
                cells = ((node - lo)[:, None] * (f * BINS) + flat).ravel()
                shape = (lo, f, BINS)
                g, h = (np.bincount(cells, np.repeat(w, f), lo * f * BINS).reshape(shape).cumsum(2) for w in (grad, hess))
                c = np.bincount(cells, minlength=lo * f * BINS).reshape(shape).cumsum(2)
                gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(c < MIN_LEAF) | (ct - c < MIN_LEAF)] = 0
                best = gain.reshape(lo, -1).argmax(1)
                useful = gain.reshape(lo, -1).max(1) > 1e-6
                feature[lo : 2 * lo], split[lo : 2 * lo] = np.where(useful, best // BINS, 0), np.where(useful, best % BINS, BINS)
                node = 2 * node + (binned[np.arange(n), feature[node]] > split[node])
            leaf = node - 2**DEPTH
            value = -RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
            score += value[leaf]
            trees.append((feature, split, value))
        return Boosted(edges, trees, start)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability for every row."""
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, FEATURES), int)
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, split, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + (binned[rows, feature[node]] > split[node])
            score += value[node - 2**DEPTH]
        return 1 / (1 + np.exp(-score))


OUT, MIXED, IN = range(3)
#: What a container pays for being neither in nor out.
MIXED_COST = float(np.log(0.5))


def decode(nodes: list[Block], p: np.ndarray) -> np.ndarray:
    """The most likely states under the rules: below OUT only OUT, below IN only IN or OUT; MIXED is for blocks without text of their own taken."""
    place = {id(x): i for i, x in enumerate(nodes)}
    yes, no = np.log(np.clip(p, 1e-4, 1)), np.log(np.clip(1 - p, 1e-4, 1))
    best = np.zeros((len(nodes), 3))
    best[:, OUT], best[:, IN] = no, yes
    best[:, MIXED] = [MIXED_COST if x.children else -np.inf for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        j = place[id(nodes[i].parent)]
        best[j, OUT] += best[i, OUT]
        best[j, IN] += max(best[i, OUT], best[i, IN])
        best[j, MIXED] += max(best[i])
    state = np.zeros(len(nodes), int)
    for i, x in enumerate(nodes):
        if not x.parent:
            state[i] = best[i].argmax()
        elif (above := state[place[id(x.parent)]]) != OUT:
            state[i] = best[i].argmax() if above == MIXED else IN if best[i, IN] >= best[i, OUT] else OUT
    return state


def text_of(nodes: list[Block], state: np.ndarray) -> str:
    """The texts of the blocks that are in, a line each, in page order."""
    chosen = {id(x) for x, s in zip(nodes, state) if s == IN}
    lines: list[str] = []
    stack: list[tuple[Block, Iterator]] = [(nodes[0], iter(runs(nodes[0])))]
    while stack:
        node, items = stack[-1]
        for item in items:
            if isinstance(item, Block):
                stack.append((item, iter(runs(item))))
                break
            if id(node) in chosen:
                lines.append(item)
        else:
            stack.pop()
    return "\n".join(lines)


def extract_all(pages: list[str | None], model: Boosted) -> list[str]:
    """The main texts of some pages."""
    found = [in_order(parse(h)) for h in pages]
    sizes = np.cumsum([0, *map(len, found)])
    p = model.predict(np.concatenate([features(x) for x in found])) if found else np.zeros(0)
    return [text_of(x, decode(x, p[i:j])) for x, i, j in zip(found, sizes, sizes[1:])]


def learn(pages: DataFrame, id_col: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Boosted:
    """Fit the trees to the ``sample`` pages with the smallest hash of their id, and to made-up ones."""
    ids = [r[0] for r in pages.where(F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    rows = pages.where(F.col(id_col).isin(ids) & F.col(html).isNotNull()).select(id_col, html).dropDuplicates([id_col]).orderBy(id_col).limit(sample).collect() if ids else []
    xs, ys = [], []
    for h in [*(r[1] for r in rows), *map(made_page, range(MADE_PAGES))]:
        nodes = in_order(parse(h))
        y = weak_labels(nodes)
        if y is not None:
            xs += [features(nodes), features(nodes, blank=True)]
            ys += [y, y]
    return Boosted.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(pages: DataFrame, model: Boosted, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text. The model is some thousand numbers."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            out: list[str] = []
            some: list[str | None] = []
            chars = 0
            for page in h:
                if some and (len(some) == PAGES_AT_ONCE or chars + len(page or "") > CHARS_AT_ONCE):
                    out += extract_all(some, model)
                    some, chars = [], 0
                some.append(page)
                chars += len(page or "")
            yield pd.Series(out + extract_all(some, model) if some else out, dtype=object)

    return pages.withColumn(text, run(F.col(f"`{html}`")))


def digest(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"), learn(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
