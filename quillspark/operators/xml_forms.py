"""XML forms: any filing's XML as rows of leaves, typed tables of its repeating groups, and Markdown.

There is one generic projector instead of a function for every form. A form is a line of FORMS: the prefix of its
submission type (or its root element) and its title; the order of the lines is the order of the tests. Labels come
from tag names, values from formatters chosen by what a tag's name ends in, codes from the code tables.
Names are taken without name space and case. A file that is not well-formed gives no rows and says so in ``error``.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import STATE_CODES
from quillspark.operators import grid_kernel as gk

MISSING = "—"
#: Fixed values: (root element, prefix of the submission type, title), in the order in which they are tried.
FORMS = (
    ("ownershipdocument", "3", "Form 3: Initial Statement of Beneficial Ownership"),
    ("ownershipdocument", "", "Form 4/5: Changes in Beneficial Ownership"),
    ("notificationofremoval", "", "Form 25: Removal from Listing"),
    ("assetdata", "", "ABS-EE: Asset Data"),
    ("", "SBSEF", "Form SBSEF"),
    ("", "ATS-N", "Form ATS-N"),
    ("", "SBSE", "Form SBSE-A"),
    ("", "X-17A-5", "Form X-17A-5"),
    ("", "24F-2NT", "Form 24F-2"),
    ("", "CFPORTAL", "Form CFPORTAL"),
    ("", "TA-1", "Form TA-1"),
    ("", "TA-W", "Form TA-W"),
    ("", "TA-2", "Form TA-2"),
    ("", "MA-I", "Form MA-I"),
    ("", "MA-W", "Form MA-W"),
    ("", "MA", "Form MA"),
    ("", "1-A", "Form 1-A"),
    ("", "DOS", "Form 1-A"),
    ("", "1-K", "Form 1-K"),
    ("", "1-Z", "Form 1-Z"),
    ("", "SCHEDULE 13G", "Schedule 13G"),
    ("", "SCHEDULE 13D", "Schedule 13D"),
    ("", "13F", "Form 13F"),
    ("", "N-PX", "Form N-PX"),
    ("", "N-MFP", "Form N-MFP"),
    ("", "NPORT", "Form N-PORT"),
    ("", "N-CEN", "Form N-CEN"),
    ("", "144", "Form 144"),
    ("", "EFFECT", "Notice of Effectiveness"),
    ("", "QUALIF", "Notice of Qualification"),
    ("", "D", "Form D"),
    ("", "C", "Form C"),
)
#: Answers.
ANSWERS = {"y": "Yes", "n": "No", "true": "Yes", "false": "No"}

def form_title(root: Column, form: Column) -> Column:
    """The title by the first line of FORMS that fits, null if none does."""
    out = None
    for tag, prefix, title in FORMS:
        fits = (F.lower(root) == tag) & F.upper(F.coalesce(form, F.lit(""))).startswith(prefix) if tag else F.upper(F.coalesce(form, F.lit(""))).startswith(prefix)
        out = F.when(fits, title) if out is None else out.when(fits, title)
    return out


def repaired(xml: Column) -> Column:
    """No line break before a tag's name; bare ampersands escaped."""
    return F.regexp_replace(F.regexp_replace(F.trim(xml), r"<\s*\n\s*", "<"), r"&(?!(?:[a-zA-Z]+|#\d+|#x[0-9a-fA-F]+);)", "&amp;")


def bare(xml: Column) -> Column:
    """Tags without prefix, in lower case, so that from_xml can read them with one schema."""
    return F.regexp_replace(F.regexp_replace(xml, r"(</?)[A-Za-z0-9_]+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")


def records(df: DataFrame, key: str, xml: str, row_tag: str, schema: str) -> DataFrame:
    """A repeating element as a typed table: (key, seq, fields of the schema), within the JVM. Malformed elements give nulls."""
    blobs = F.regexp_extract_all(bare(F.col(xml)), F.lit(rf"(?s)<{row_tag}\b[^>]*>.*?</{row_tag}>"), F.lit(0))
    d = df.select(key, F.posexplode(blobs).alias("seq", "x"))
    return d.select(key, "seq", F.from_xml("x", schema, {"mode": "PERMISSIVE", "rowTag": row_tag}).alias("r")).select(key, "seq", "r.*")


def labelled(tag: str) -> str:
    words = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", r"\1\3 \2\4", re.sub(r"[_-]+", " ", tag))
    return words[:1].upper() + words[1:]


def shown(tag: str, value: str) -> str:
    """A value for reading: answers, country codes, dates and amounts by the tag's name."""
    v, low = " ".join(value.split()), tag.lower()
    if not v:
        return MISSING
    if v.lower() in ANSWERS and len(v) in (1, 4, 5) and not low.endswith(("name", "code", "type")):
        return ANSWERS[v.lower()]
    if low.endswith(("country", "stateorcountrycode", "statecountry", "stateorcountry")) and v in STATE_CODES:
        return STATE_CODES[v].title()
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", v):
        if 1 <= int(m[2]) <= 12:
            return f"{'January February March April May June July August September October November December'.split()[int(m[2]) - 1]} {int(m[3])}, {m[1]}"
    if re.search(r"(amount|value|price|fee|proceeds|nav|assets)$", low) and re.fullmatch(r"-?\d+(\.\d+)?", v):
        whole, dot, rest = v.partition(".")
        return f"${int(whole):,}{dot}{rest}" if whole not in ("", "-", "-0") else f"${v}"
    return v


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def leaves(xml: str) -> list[tuple[str, int, str, str]]:
    """(path, ordinal among its like, tag, text) of every element without children, in order; attributes as tag@name."""
    out: list[tuple[str, int, str, str]] = []
    seen: dict[str, int] = {}

    def visit(e, path):
        tag = _name(e.tag)
        path = f"{path}/{tag}"
        seen[path] = seen.get(path, -1) + 1
        for k, v in e.attrib.items():
            out.append((f"{path}@{_name(k)}", seen[path], f"{tag}@{_name(k)}", v))
        if len(e):
            for x in e:
                if isinstance(x.tag, str):
                    visit(x, path)
        else:
            out.append((path, seen[path], tag, (e.text or "").strip()))

    visit(ET.fromstring(xml), "")
    return out


def markdown(xml: str, shown_elsewhere: frozenset[str] = frozenset()) -> str:
    """Single fields as a list, repeating groups as tables, nested parts under headings; elements of some names are left out, with the headings above them alone."""
    parts: list[str] = []

    def record(e) -> dict[str, str]:
        out: dict[str, str] = {}
        for x in e.iter():
            if isinstance(x.tag, str) and not len(x) and x is not e:
                name = labelled(_name(x.tag))
                text = shown(_name(x.tag), x.text or "")
                out[name] = f"{out[name]}; {text}" if name in out and text != MISSING else out.get(name, text)
        return out or {labelled(_name(e.tag)): shown(_name(e.tag), e.text or "")}

    def visit(e, depth):
        kids = [x for x in e if isinstance(x.tag, str) and _name(x.tag).lower() not in shown_elsewhere]
        counts: dict[str, int] = {}
        for x in kids:
            counts[x.tag] = counts.get(x.tag, 0) + 1
        fields = [f"- **{labelled(_name(x.tag))}:** {shown(_name(x.tag), x.text or '')}" for x in kids if not len(x) and counts[x.tag] == 1]
        if fields:
            parts.append("\n".join(fields))
        done = set()
        for x in kids:
            if counts[x.tag] > 1:
                if x.tag in done:
                    continue
                done.add(x.tag)
                rows = [record(y) for y in kids if y.tag == x.tag]
                names = list(dict.fromkeys(k for r in rows for k in r))
                parts.append(f"{'#' * min(6, depth + 1)} {labelled(_name(x.tag))}")
                parts.append("---\n\n" + gk.gfm([names, *[[r.get(k, MISSING) for k in names] for r in rows]]) + "\n\n---")
            elif len(x):
                parts.append(f"{'#' * min(6, depth + 1)} {labelled(_name(x.tag))}")
                before = len(parts)
                visit(x, depth + 1)
                if len(parts) == before:
                    parts.pop()

    root = ET.fromstring(xml)
    visit(root, 2)
    if not len(root) and (root.text or "").strip():
        parts.append(f"- **{labelled(_name(root.tag))}:** {shown(_name(root.tag), root.text)}")
    return "\n\n".join(parts)


def read_xml(xml: str | None, names_shown=lambda root: frozenset()) -> tuple[str | None, str | None, str | None]:
    """(root, Markdown, error) of one repaired XML text; without an error the first two are there, else only the error."""
    try:
        root = _name(ET.fromstring(xml).tag)
        return root, markdown(xml, names_shown(root)), None
    except (ET.ParseError, TypeError, RecursionError) as e:
        return None, None, str(e)[:200]


def parse_xml(df: DataFrame, key: str, xml: str, form: str) -> DataFrame:
    """(key, root, title, text, error): every XML file as Markdown."""
    rows = df.select(F.col(key).alias("key"), repaired(F.col(xml)).alias("xml"), F.col(form).alias("form"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, f, *read_xml(x)) for k, x, f in zip(b["key"], b["xml"], b["form"])]
            yield pd.DataFrame(out, columns=["key", "form", "root", "text", "error"])

    d = rows.mapInPandas(run, f"key {kind}, form string, root string, text string, error string")
    title = form_title(F.col("root"), F.col("form"))
    return d.select(F.col("key").alias(key), "root", title.alias("title"), F.when(title.isNotNull(), F.concat(F.lit("## "), title, F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"), "error")


def xml_leaves(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, path, ordinal, tag, value), a row a leaf."""
    rows = df.select(F.col(key).alias("key"), repaired(F.col(xml)).alias("xml"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, x in zip(b["key"], b["xml"]):
                try:
                    out += [(k, *leaf) for leaf in leaves(x)]
                except (ET.ParseError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["key", "path", "ordinal", "tag", "value"])

    return rows.mapInPandas(run, f"key {kind}, path string, ordinal int, tag string, value string")


def once(value: Column, shown: Callable[[Column], Column]) -> Column:
    """What is made of a value, which is computed once, however often it is used; within a lambda Spark would compute it for every use."""
    return F.get(F.transform(F.array(value), shown), F.lit(0))


def footnotes(value: Column, ids: Column, order: Column) -> Column:
    """A value with the ordinals of its footnotes: v<sup>(1)(3)</sup>."""
    marks = F.array_join(F.transform(F.filter(ids, lambda i: F.array_position(order, i) > 0), lambda i: F.concat(F.lit("("), F.array_position(order, i).cast("string"), F.lit(")"))), "")
    return once(marks, lambda m: F.when(m != "", F.concat(value, F.lit("<sup>"), m, F.lit("</sup>"))).otherwise(value))
