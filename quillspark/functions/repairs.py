"""Repairs of finished Markdown, line by line and phrase by phrase, as expressions that stay in the JVM.

A line is taken apart into padding, marker and rest, and what goes between marker and rest is decided by the kinds of
both. Whether a line is only a page label is decided by the kinds of its parts. What is left are phrases: emphasis that
closes and opens again within a word, and blanks around links and punctuation.
"""

from pyspark.sql import Column, functions as F

#: Bullets, and the gap that sets a parenthesised marker off.
BULLETS = "○•●·◦➢▪"
GAP = "&nbsp;" * 4


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_marker(line: Column) -> Column:
    """(padding, marker, rest): the marker is a bullet, or up to six letters or digits closed by a dot or parenthesis; '' if there is none."""
    padding = F.regexp_extract(line, r"^(?:&nbsp;|[ \t])*", 0)
    return _bound(F.struct(padding.alias("padding"), F.substr(line, F.length(padding) + 1).alias("body")), _with_marker)


def _with_marker(x: Column) -> Column:
    marker = F.regexp_extract(x["body"], rf"^(?:[{BULLETS}]|\(?[A-Za-z0-9]{{1,6}}[.)])", 0)
    return F.struct(x["padding"].alias("padding"), marker.alias("marker"), F.substr(x["body"], F.length(marker) + 1).alias("rest"))


def marker_kind(marker: Column) -> Column:
    """bullet, enclosed as in (a) or (12), number as in 3), capital as in B., roman as in iv., or null."""
    inner = F.regexp_replace(marker, "[().]", "")
    enclosed = marker.startswith("(") & marker.endswith(")")
    return (
        F.when(marker == "", None)
        .when(F.length(marker) == 1, "bullet")
        .when(enclosed & (inner.rlike("^[A-Za-z]{1,4}$") | inner.rlike("^[1-9][0-9]?$")), "enclosed")
        .when(~marker.startswith("(") & marker.endswith(")") & inner.rlike("^[0-9]+$"), "number")
        .when(marker.endswith(".") & inner.rlike("^[A-Z]$"), "capital")
        .when(marker.endswith(".") & (F.translate(inner, "ivx", "") == ""), "roman")
    )


def spaced_marker(line: Column) -> Column:
    """A line with the gap that its marker asks for. Markers that run into a number, as decimals do, stay."""

    def put(x: Column) -> Column:
        kind, rest = marker_kind(x["marker"]), x["rest"]
        text = F.regexp_replace(rest, r"^(?:<br>)?[ \t]*", "")
        first, second = F.substr(rest, F.lit(1), F.lit(1)), F.substr(rest, F.lit(2), F.lit(1))
        upper, lower = first.rlike("[A-Z]"), second.rlike("[a-z]")
        close = ((kind == "number") & first.rlike("[A-Za-z]")) | ((kind == "capital") & upper & lower) | ((kind == "roman") & upper) | ((kind == "bullet") & (F.trim(first) != ""))
        words = (kind == "enclosed") & (text != "") & ((rest != text) | first.rlike(r'[A-Za-z0-9*"“]') | rest.startswith("<u>"))
        return F.concat(x["padding"], x["marker"], F.when(words, F.concat(F.lit(GAP), text)).when(close, F.concat(F.lit(" "), rest)).otherwise(rest))

    return F.coalesce(_bound(split_marker(line), put), line)


def is_page_label(line: Column) -> Column:
    """Only a page's label: a number, a roman number, either behind a few capitals and a dash, or behind the word Page."""
    bare = F.regexp_replace(line, r"&nbsp;|<br\s*/?>|\s", "")
    named = F.regexp_replace(F.replace(bare, F.lit("*"), F.lit("")), "(?i)^page", "")
    is_number = lambda x, most: (F.length(x) <= most) & x.rlike("^[0-9]+$")
    is_roman = lambda x: (F.length(x) <= 6) & (x != "") & (F.translate(F.lower(x), "ivxlcdm", "") == "")
    parts = F.split(bare, "-", -1)
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    sections = (F.size(parts) == 2) & head.rlike("^[A-Za-z]{1,4}$") & (F.length(tail) <= 6) & (tail != "") & (F.translate(F.lower(tail), "ivxlcdm0123456789", "") == "")
    return is_number(bare, 3) | is_roman(bare) | sections | ((named != bare) & is_number(named, 4))


def without_page_labels(text: Column) -> Column:
    """Lines that are but a page's label, or a break, are emptied; a break in front of a line's text goes."""
    empty = lambda x: is_page_label(x) | F.regexp_replace(x, "&nbsp;", "").rlike(r"^\s*<br\s*/?>\s*$")
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(empty(x), F.lit("")).otherwise(F.regexp_replace(x, r"^<br\s*/?>\s*", ""))), "\n")


def joined_emphasis(text: Column) -> Column:
    """Emphasis that closes only to open again goes on: within a word, at its percent sign, around a stop of its own."""
    text = F.regexp_replace(text, r"(?<=[A-Za-z])(\*{1,3})(['’])\1(?=[A-Za-z])", "$2")
    text = F.regexp_replace(text, r"(?<=[0-9)])(\*{1,3})\s*(?:<br\s*/?>\s*)?\1%\1", "%$1")
    text = F.regexp_replace(text, r"(?<![*\\])(\*{1,3})([.,;:!?])\1(?!\*)", "$2")
    return F.regexp_replace(text, r"([—―-]\*\*)(?=[A-Z])", "$1 ")


def spaced_phrases(text: Column) -> Column:
    """One blank behind a link and none before the stop after it; a blank behind a full stop and between a magnitude and its noun, none within the number of a rule; no two empty lines."""
    text = F.regexp_replace(text, r"(?<=\S\))[ \t]+(?=[,.;:!?])", "")
    text = F.regexp_replace(text, r"(?<=\S\))[ \t]{2,}(?=\S)", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<u>[ \t]+(?=\[)", "<u>"), r"(?<=\))[ \t]+</u>", "</u>")
    text = F.regexp_replace(text, r"(?i)\b(rule \d\S*) +(?=\(\w+\))", "$1")
    text = F.regexp_replace(text, r"([a-z])[ \t]+:(?=\s)", "$1:")
    text = F.regexp_replace(text, r"([a-z]\.)(?=[A-Z][a-z])", "$1 ")
    text = F.regexp_replace(text, r"(?i)\b((?:th|m|b|tr)(?:ousand|illion))(?=(?:aggregate|principal|amount|share|stock|par)s?\b)", "$1 ")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def repaired_markdown(text: Column) -> Column:
    """All repairs: markers and page labels line by line, then emphasis and spacing."""
    lines = F.transform(F.split(text, "\n", -1), spaced_marker)
    return spaced_phrases(joined_emphasis(without_page_labels(F.array_join(lines, "\n"))))
