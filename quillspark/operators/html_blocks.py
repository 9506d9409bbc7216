"""HTML to Markdown: pages become rows of blocks, and blocks become documents.

The walk over a page's tags carries state from tag to tag, so it is a Python stage over Arrow batches; what comes out
is relational: (key, pos, kind, level, text), a row a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators import grid_kernel as gk
from quillspark.operators.lines import assemble

SKIP = frozenset("head title script style noscript template svg object select textarea button xml ix:header ix:hidden".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("p div section article main header footer nav aside blockquote center address figure figcaption form fieldset dl dt dd ul ol table caption thead tbody tfoot tr body html details summary".split())
EMPHASIS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
POINTS = {"pt": 1.0, "px": 0.75, "in": 72.0, "em": 12.0, "rem": 12.0, "cm": 28.35, "mm": 2.835, "%": 6.12}
INDENT = "&nbsp;" * 4
_LENGTH = re.compile(r"(-?\d*\.?\d+)\s*(pt|px|in|rem|em|cm|mm|%)?")
_MARKER = re.compile(r"(?:[•●○◦▪·–—-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivx]{1,5}[.)])")


def points(length: str) -> float:
    m = _LENGTH.match(length.strip())
    return float(m[1]) * POINTS.get(m[2] or "px", 0.75) if m else 0.0


def style_of(attrs: dict[str, str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in (attrs.get("style") or "").split(";")) if v}


def indent_of(style: dict[str, str]) -> float:
    """Points by which a block is moved to the right, by its left margin, padding and first-line indent."""
    total = 0.0
    for kind in ("margin", "padding"):
        sides = style.get(kind, "").split()
        short = sides[[0, 1, 1, 3][len(sides) - 1]] if 1 <= len(sides) <= 4 else "0"
        total += points(style.get(f"{kind}-left", short))
    return max(0.0, total + points(style.get("text-indent", "0")))


class Walker(HTMLParser):
    def __init__(self, base: str = "", to_mmd: bool = False):
        super().__init__(convert_charrefs=True)
        self.base, self.to_mmd = base, to_mmd
        self.blocks: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.open: list[tuple[str, list[str]]] = []  # inline marks to close, by tag
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.tables: list[dict] = []
        self.kind, self.level, self.indent, self.own = "p", 0, [0.0], 0.0  # own: the indent of the open paragraph
        self.pre = 0
        self.last_heading = ""

    # -- text --------------------------------------------------------------------------------------------

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data if self.pre else re.sub(r"\s+", " ", data))

    def taken(self) -> str:
        text, self.text = "".join(self.text), []
        if self.pre:
            return text.strip("\n")
        text = re.sub(r"[​-‏⁠﻿\xad]", "", text.replace("\xa0", " "))
        text = re.sub(r"(?<!\*)\*\*(\s*)\*\*(?!\*)", r"\1", text)  # emphasis around nothing
        text = re.sub(r"(?<!\*)\*(\s+)\*(?!\*)", r"\1", text)
        return re.sub(r"[ \t]+", " ", text).strip()

    def flush(self):
        if self.tables and self.tables[-1]["cell"] is not None:
            if (text := self.taken()) :
                self.tables[-1]["cell"].append(text)
            return
        if not (text := self.taken()):
            return
        kind, level = self.kind, self.level
        if kind == "p" and re.fullmatch(r"\*\*[^*]+\*\*", text) and len(text.split()) < 25 and (text.upper() == text or re.match(r"\*\*(?:PART|Item|ITEM)\b", text)):
            kind, level, text = "h", 3 if re.match(r"\*\*(?:PART|ITEM|Item)\b", text) else 4, text.strip("*")
        if kind == "h" and text == self.last_heading:
            return  # the same heading twice in a row
        self.last_heading = text if kind == "h" else ""
        if kind == "p":
            level = round((sum(self.indent) + self.own) / 14.4)
        self.blocks.append((kind, level, text))

    # -- tags --------------------------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        style = style_of(a)
        if self.skip or tag in SKIP or style.get("display") == "none" and tag not in VOID:
            if tag not in VOID and (not self.skip or tag == self.skip[0]):
                self.skip.append(tag)
            return
        if tag == "br":
            self.text.append("<br>" if self.tables and self.tables[-1]["cell"] is not None else " ")
        elif tag == "hr" or style.get("page-break-before") == "always" or style.get("page-break-after") == "always":
            self.flush()
            if not self.tables:
                self.blocks.append(("hr", 0, "------"))
        elif tag == "img":
            said = " ".join(f'{k}="{a[k]}"' for k in ("src", "alt", "title", "width", "height") if a.get(k))
            self.text.append(f"[IMAGE PLACEHOLDER: {said}]")
        elif tag == "table":
            self.flush()
            self.tables.append({"rows": [], "row": None, "cell": None})
        elif tag in ("tr", "td", "th") and self.tables:
            self.flush()
            self.close_cell(tag)
            t = self.tables[-1]
            if tag == "tr":
                t["row"] = []
                t["rows"].append(t["row"])
            else:
                if t["row"] is None:
                    t["row"] = []
                    t["rows"].append(t["row"])
                span = lambda k: min(int(m[0]), 500) if (m := re.match(r"\d+", a.get(k, ""))) and 1 <= int(m[0]) <= 500 else 1
                t["cell"] = []
                t["row"].append([t["cell"], span("colspan"), span("rowspan"), tag, style])
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "h", int(tag[1])
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            self.kind, self.level = "li", max(0, len(self.lists) - 1)
            self.text.append(f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- ")
        elif tag == "pre":
            self.flush()
            self.pre, self.kind = 1, "pre"
        elif tag in PARTS:
            self.flush()
            if self.kind == "h":
                self.kind = "p"
            self.own = indent_of(style) if tag == "p" else 0.0
            if tag in ("div", "blockquote"):
                self.indent.append(indent_of(style))
        marks = []
        if tag in EMPHASIS:
            marks.append((EMPHASIS[tag],) * 2)
        elif tag in ("u", "sup", "sub"):
            marks.append((f"<{tag}>", f"</{tag}>"))
        elif tag == "a" and (href := a.get("href", "")) and not href.startswith("#") and not href.lower().startswith("javascript:"):
            marks.append(("[", f"]({urljoin(self.base, href)})"))
        elif tag in ("span", "font", "td", "th", "p", "div") and tag not in ("td", "th", "p", "div"):
            weight = style.get("font-weight", "")
            if weight == "bold" or weight.isdigit() and int(weight) >= 600:
                marks.append(("**", "**"))
            if style.get("font-style") == "italic":
                marks.append(("*", "*"))
            if "underline" in style.get("text-decoration", ""):
                marks.append(("<u>", "</u>"))
            if style.get("vertical-align") == "super":
                marks.append(("<sup>", "</sup>"))
        if tag not in VOID and (marks or tag in ("span", "font", "a", "b", "i", "u", "em", "strong", "sup", "sub")):
            self.text += [m[0] for m in marks]
            self.open.append((tag, [m[1] for m in reversed(marks)]))

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if any(t == tag for t, _ in self.open):
            while self.open:
                name, marks = self.open.pop()
                for m in marks:
                    spaces = 0
                    while self.text and self.text[-1].isspace():
                        self.text.pop()
                        spaces = 1
                    if self.text and self.text[-1].endswith(" "):
                        self.text[-1], spaces = self.text[-1].rstrip(), 1
                    self.text += [m, *[" "] * spaces]
                if name == tag:
                    break
        elif tag == "table" and self.tables:
            self.flush()
            self.close_cell("tr")
            self.finish_table(self.tables.pop())
        elif tag in ("td", "th", "tr") and self.tables:
            self.flush()
            self.close_cell(tag)
        elif re.fullmatch("h[1-6]|li|pre", tag):
            self.flush()
            self.kind, self.level, self.pre = "p", 0, 0 if tag == "pre" else self.pre
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            self.kind = "p"
        elif tag in PARTS:
            self.flush()
            self.own = 0.0
            if tag in ("div", "blockquote") and len(self.indent) > 1:
                self.indent.pop()

    def close_cell(self, tag):
        t = self.tables[-1]
        t["cell"] = None
        if tag == "tr":
            t["row"] = None

    # -- tables ------------------------------------------------------------------------------------------

    def finish_table(self, t):
        grid = expand(t["rows"])
        grid = [row for row in grid if not all(c.strip() == "" for c in row)]
        if not grid:
            return
        if self.tables:  # a table within a cell stays there as text
            if self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append("<br>".join(" ".join(c for c in row if c.strip()) for row in grid))
            return
        filled = [[c for c in row if c.strip()] for row in grid]
        if all(len(r) == 1 for r in filled) and len(grid) <= 3:
            for r in filled:  # layout: one text a row
                self.blocks.append(("p", 0, r[0].replace("<br>", " ")))
        elif all(len(set(r)) == 2 and _MARKER.fullmatch(r[0].strip("* ")) for r in filled):
            for r in filled:
                self.blocks.append(("li", 0, f"{r[0]} {r[-1]}" if r[0] not in "•●○◦▪·" else f"- {r[-1]}"))
        else:
            if gk.is_financial(grid):
                grid = gk.clean(grid)
            else:
                grid = gk.drop_repeats([r for r in gk.squared(grid)])
                cols = gk.columns(grid)
                grid = gk.keep(grid, [c for c in range(len(cols)) if any(x.strip() for x in cols[c])])
            heads = max(1, gk.header_rows(grid))
            self.blocks.append(("table", 0, gk.mmd(grid, heads) if self.to_mmd else gk.gfm(grid)))


def expand(rows: list) -> gk.Grid:
    """Cells with spans to a full grid: a spanning cell's text stands in every place that it covers, but a figure only in the last one across, where the other rows have theirs."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for parts, across, down, _, _ in row:
            while c in grid[r]:
                c += 1
            text = re.sub(r"(?:\s*<br>\s*)+$|^(?:\s*<br>\s*)+", "", " ".join(parts)).strip()
            figure = across > 1 and c > 0 and gk.is_figure(text)
            for i in range(r, min(r + down, len(rows))):
                for j in range(c, c + across):
                    grid[i].setdefault(j, text if not figure or j == c + across - 1 else "")
            c += across
    width = max((max(g) + 1 for g in grid if g), default=0)
    return [[g.get(c, "") for c in range(width)] for g in grid]


def walk(html: str | None, base: str = "", to_mmd: bool = False) -> list[tuple[str, int, str]]:
    """The blocks of a page in order: (kind, level, text)."""
    w = Walker(base, to_mmd)
    w.feed(html or "")
    w.close()
    while w.tables:
        w.handle_endtag("table")
    w.flush()
    return w.blocks


def first_heading(html: Column) -> Column:
    """The markup within a page's first h1, its white space made one space; null if there is none or it holds nothing. References stay as they stand."""
    inner = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(inner != "", F.trim(F.regexp_replace(inner, r"[\t\n\f\r ]+", " ")))


def html_blocks(df: DataFrame, key: str, html: str, base: str | None = None, to_mmd: bool = False) -> DataFrame:
    """(key, pos, kind, level, text), a row a block."""
    rows = df.select(F.col(key).alias("key"), F.col(html).alias("html"), (F.col(base) if base else F.lit("")).alias("base"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, *block) for k, h, u in zip(b["key"], b["html"], b["base"]) for i, block in enumerate(walk(h, u or "", to_mmd))]
            yield pd.DataFrame(out, columns=["key", "pos", "kind", "level", "text"])

    return rows.mapInPandas(run, f"key {kind}, pos int, kind string, level int, text string")


def block_markdown(blocks: DataFrame) -> DataFrame:
    """The blocks as Markdown: a column expression, no shuffle."""
    text = (
        F.when(F.col("kind") == "h", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
        .when(F.col("kind").isin("li", "p"), F.concat(F.repeat(F.lit(INDENT), F.col("level")), "text"))
        .when(F.col("kind") == "pre", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("kind") == "table", F.concat(F.lit("---\n\n"), "text", F.lit("\n\n---")))
        .otherwise(F.col("text"))
    )
    return blocks.withColumn("markdown", text)


def page_markdown(html: str | None, base: str = "", to_mmd: bool = False) -> str:
    """A page as one Markdown text: its blocks as ``block_markdown`` shows them, an empty line between two."""
    shown = {"pre": "```\n{}\n```", "table": "---\n\n{}\n\n---"}
    lead = {"h": "#", "li": INDENT, "p": INDENT}
    return "\n\n".join(lead.get(kind, "") * level + " " * (kind == "h") + shown.get(kind, "{}").replace("{}", text) for kind, level, text in walk(html, base, to_mmd))


def to_markdown(df: DataFrame, key: str, html: str, base: str | None = None, to_mmd: bool = False) -> DataFrame:
    """(key, text): every page as one Markdown text; no exchange, as a page is a row."""
    rows = df.select(F.col(key).alias("key"), F.col(html).alias("html"), (F.col(base) if base else F.lit("")).alias("base"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "text": [page_markdown(h, u or "", to_mmd) for h, u in zip(b["html"], b["base"])]})

    return rows.mapInPandas(run, f"key {kind}, text string").where("text <> ''").withColumnRenamed("key", key)
