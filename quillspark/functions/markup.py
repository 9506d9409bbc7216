"""Repairs of raw HTML before it is read, and of Markdown phrases after, as Catalyst expressions.

Rules that have to run until nothing changes run as often as markup is nested in practice (DEPTH); each pass is one
expression, so all stay in one projection.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from quillspark.functions.text import is_numeric_like

#: Passes of a rule that works from the inside out.
DEPTH = 4
_SIGNS = "$£€¥"


def _again(text: Column, pattern: str, put: str, times: int = DEPTH) -> Column:
    for _ in range(times):
        text = F.regexp_replace(text, pattern, put)
    return text


# -- raw HTML ----------------------------------------------------------------------------------------------


def prepared_html(html: Column) -> Column:
    """Without comments, declarations, revision marks and the tags of inline tagging, whose content stays; superscripts and subscripts as tokens."""
    html = F.regexp_replace(html, r"(?s)<!--.*?-->|<\?.*?\?>|(?i)<!doctype[^>]*>", "")
    html = F.regexp_replace(html, r"(?is)<ix:header\b.*?</ix:header>|<ix:hidden\b.*?</ix:hidden>", "")
    html = F.regexp_replace(html, r"(?i)</?ix:[a-z]+\b[^>]*>|</?R>", "")
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<(sup|sub)\b[^>]*>", "##$1##"), r"(?i)</(sup|sub)>", "##/$1##")


def blocks_outside_emphasis(html: Column) -> Column:
    """A paragraph within bold, italic or underlined text as such text within a paragraph."""
    return _again(html, r"(?is)<(b|i|u|strong|em)>\s*<p\b([^>]*)>((?:(?!</?p\b).)*?)</p>\s*</\1>", "<p$2><$1>$3</$1></p>")


def inline_blocks_as_spans(html: Column) -> Column:
    """A block whose style says inline, and that holds no block, as a span."""
    return _again(html, r"(?is)<div\b([^>]*display\s*:\s*inline\b(?!-)[^>]*)>((?:(?!</?div\b).)*?)</div>", "<span$1>$2</span>")


def joined_tags(html: Column) -> Column:
    """Emphasis that ends only to begin again goes on; emphasis of blanks only is blanks."""
    html = F.regexp_replace(html, r"(?i)<(b|i|u|strong|em)>((?:\s|&nbsp;)*)</\1>", "$2")
    return F.regexp_replace(html, r"(?i)</(b|i|u|strong|em)>(\s*)<\1>", "$2")


def escaped_font_repaired(html: Column) -> Column:
    """A font tag whose brackets came out as references."""
    return F.regexp_replace(html, r"(?i)&lt;(/?font\b[^&<>]*)&gt;", "<$1>")


def leading_indent(text: Column) -> Column:
    """How far a text is set in by the blanks that it begins with: half a unit for a blank, two for a wide one."""
    lead = F.regexp_extract(F.regexp_replace(text, "(?i)&nbsp;", " "), "^[ \\u00a0\\u2003]*", 0)
    wide = F.length(F.regexp_replace(lead, "[ \\u00a0]", ""))
    return (F.length(lead) - wide) * 0.5 + wide * 2.0


# -- Markdown ----------------------------------------------------------------------------------------------


def joined_links(text: Column) -> Column:
    """Neighbouring links to one place as one link."""
    return _again(text, r"\[([^\]\[]*)\]\(([^()\s]+)\)([ \t]*)\[([^\]\[]*)\]\(\2\)", "[$1$3$4]($2)")


def joined_italics(text: Column) -> Column:
    """Italics that close and open again around blanks go on."""
    return _again(text, r"(?<![*\\])\*([^*\n|]+)\*([ \t]+)\*([^*\n|]+)\*(?!\*)", "*$1$2$3*")


def bullet_rows_as_items(text: Column) -> Column:
    """Rows of a bullet and a text, without a ruler of their own, as list items."""
    return F.regexp_replace(text, r"(?m)^\|\s*[•●○▪·◦]\s*\|\s*([^|\n]*[^|\s])\s*\|[ \t]*$", "- $1")


def footnote_lines(text: Column) -> Column:
    """The number that a footnote's line begins with, as a superscript."""
    return F.regexp_replace(text, r"(?m)^(\(\d{1,2}\)|\*{1,2}(?=\s))[ \t]+(?=\S)", "<sup>$1</sup> ")


def joined_currency_cells(line: Column) -> Column:
    """In a table row a sign in a cell of its own goes to the number behind it, a closing one to the number before; the cells that they leave are empty."""
    line = F.regexp_replace(line, rf"\|\s*([{_SIGNS}])\s*\|\s*(?=[(\d.])", "|  | $1")
    return F.regexp_replace(line, r"(?<=[\d.])\s*\|\s*(\)%|%|\))\s*(?=\|)", "$1 |  ")


def inlined_tables(text: Column, tables: Column) -> Column:
    """A page's text with its tables, an array of (id, content), where their placeholders [id](id) stand."""
    return F.aggregate(tables, text, lambda out, x: F.call_function("replace", out, F.concat(F.lit("["), x["id"], F.lit("]("), x["id"], F.lit(")")), x["content"]))


def dot_leader(line: Column) -> Column:
    """(label, figure) of a line whose label and figure are joined by dots; null if it isn't one."""
    label = F.regexp_extract(line, r"^\s*(\S.*?)\s*(?:\.\s?){3,}\s*([$£€¥]?\s*\(?[\d,]+(?:\.\d+)?\)?%?)\s*$", 1)
    figure = F.regexp_extract(line, r"^\s*(\S.*?)\s*(?:\.\s?){3,}\s*([$£€¥]?\s*\(?[\d,]+(?:\.\d+)?\)?%?)\s*$", 2)
    return F.when(label != "", F.struct(label.alias("label"), F.regexp_replace(figure, r"\s", "").alias("figure")))


def cut_at_ruler(line: Column, ruler: Column) -> Column:
    """The cells of a line of fixed width, cut where the runs of dashes of a ruler begin; the first begins with the line."""
    runs = F.regexp_extract_all(ruler, F.lit("-+[^-]*"), F.lit(0))
    lead = F.length(F.regexp_extract(ruler, "^[^-]*", 0))
    ends = F.transform(runs, lambda _, i: lead + F.aggregate(F.slice(runs, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
    return F.transform(ends, lambda e, i: F.trim(F.substr(line, begin(i) + 1, F.when(i == F.size(ends) - 1, F.length(line)).otherwise(e) - begin(i))))


# -- services ----------------------------------------------------------------------------------------------


def ascii_text(text: Column) -> Column:
    """Letters without their marks, other characters beyond ASCII dropped, blanks made one. The letters are those that decompose, up to the Latin extensions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xA0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    plain = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"\s+", " "))


def is_ascii_numeric(text: Column) -> Column:
    return is_numeric_like(ascii_text(text))


def data_uri(image: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))


def reading_request(document_url: Column, model: str, tables: str = "html") -> Column:
    """The body of a request to a reading service, as JSON."""
    if tables not in ("html", "markdown"):
        raise ValueError("tables are read as html or markdown")
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.lit("document_url").alias("type"), document_url.alias("document_url")).alias("document"), F.lit(tables).alias("table_format"), F.lit(False).alias("include_image_base64")))


def is_over_time(began: Column, now: Column, seconds: float) -> Column:
    """Whether a document has had its time."""
    return (F.unix_micros(now) - F.unix_micros(began)) / 1e6 > seconds
