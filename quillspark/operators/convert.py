"""From submissions to Markdown: split, route, read, assemble."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.repairs import repaired_markdown
from quillspark.functions.tokens import token_count
from quillspark.operators import form_tables as ft, html_blocks as hb, xml_forms
from quillspark.operators.legacy import paper_markdown
from quillspark.operators.lines import assemble, tidy_tables
from quillspark.operators.ocr import SKIPPED
from quillspark.sources import submissions as sub
from quillspark.functions.text import is_skipped_type, section_title, until_uuencode, without_indentation

#: Where a part stands in a document: header and series first, then documents in order, PDF parts, XML parts.
HEADER, DOCUMENTS, PDFS, XMLS = range(4)


PARTS = "grp int, seq int, n int, kind string, bucket string, label string, form string, title string, content string"


def items_of(body, form) -> Column:
    """All that a submission is put together from, as one array of PARTS: header, documents, PDF notes, XML parts. Types without text are left out before their content is looked at."""
    head = sub.header_of(body)
    header = F.when(head != "", sub.header_markdown(head)).otherwise(F.lit("<No SEC-HEADER or IMS-HEADER found>"))

    def item(grp, seq, n, kind, bucket, label, title, content):
        given = [grp, seq, n, kind, bucket, label, form, title, content]
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast(d.split()[1]).alias(d.split()[0]) for x, d in zip(given, PARTS.split(", "))])

    def of(block: Column, seq: Column) -> Column:
        kind, description, content = sub.block_type(block), sub.block_description(block), sub.block_content(block)
        routed = F.struct(sub.route(content, kind, form).alias("route"), content.alias("content"))
        title = F.when((seq > 0) & (kind != form), F.concat(section_title(kind, F.nullif(description, F.lit(""))), F.lit("\n\n"))).otherwise(F.lit(""))

        def put(r: Column) -> Column:
            way, content = r["route"], r["content"]
            html = F.when(way == "xml", sub.without_xml(content)).otherwise(content)
            pages = F.array(item(DOCUMENTS, seq, 0, "html", "html", kind, title, html))
            forms = F.transform(sub.xml_blobs(content), lambda x, i: item(XMLS, seq, i, "xml", "xml", "", ft.form_tables(x, ft.root_of(x), form), xml_forms.repaired(x)))
            note = F.array(item(PDFS, seq, 0, "plain", "pdf", kind, "", SKIPPED))
            plain = F.array(item(DOCUMENTS, seq, 0, "plain", "text", kind, title, F.when(way == "paper", paper_markdown(body, form)).otherwise(sub.plaintext_block(content))))
            return F.when(way == "pdf", note).when(way == "html", pages).when(way == "xml", F.concat(pages, forms)).otherwise(plain)

        found = F.flatten(F.transform(F.array(routed), put))
        return F.when(is_skipped_type(kind), F.array().cast(f"array<struct<{PARTS.replace(' ', ':').replace(',:', ',')}>>")).otherwise(found)

    return F.concat(F.array(item(HEADER, 0, 0, "plain", "sgml", "header", "", header)), F.flatten(F.transform(sub.blocks_of(body), of)))


def parts(submissions: DataFrame, key: str = "path", body: str = "body", to_mmd: bool = False) -> DataFrame:
    """(key, grp, seq, n, bucket, label, text, error): what every submission is put together from, in one pass over it and without an exchange.

    An XML part that can't be read stays as it is, under a note that says why.
    """
    rows = submissions.select(F.col(key).alias("key"), F.explode(items_of(F.col(body), sub.submission_type(F.col(body)))).alias("x")).select("key", "x.*")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            root, text, error = [], [], []
            for way, content, form in zip(b["kind"], b["content"], b["form"]):
                read = (None, content, None)
                if way == "html":
                    read = (None, tidy_tables(hb.page_markdown(content, "", to_mmd)), None)
                elif way == "xml":
                    read = xml_forms.read_xml(content, lambda root, form=form: ft.record_tags(root, form))
                    if read[2] is not None:
                        read = (None, f"> XML part that can't be read: {read[2]}\n\n```xml\n{(content or '').strip()}\n```", read[2])
                for column, x in zip((root, text, error), read):
                    column.append(x)
            yield b.drop(columns="content").assign(root=root, text=text, error=error)

    d = rows.mapInPandas(run, f"key {kind}, {PARTS.rsplit(',', 1)[0]}, root string, text string, error string")
    title = xml_forms.form_title(F.col("root"), F.col("form"))
    tables = F.when(F.col("root").isNotNull(), F.nullif("title", F.lit("")))
    named = F.concat_ws("\n\n", F.when(F.col("root").isNotNull(), F.concat(F.lit("## "), title)), F.nullif("text", F.lit("")), tables)
    text = F.when(F.col("kind") == "xml", named).when(F.col("kind") == "html", repaired_markdown(F.col("text"))).otherwise(F.col("text"))
    whole = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(F.when(F.col("kind") == "xml", F.lit("")).otherwise(F.col("title")), text))
    label = F.when(F.col("kind") == "xml", F.coalesce(title, "root", F.lit("unreadable"))).otherwise(F.col("label"))
    return d.select(F.col("key").alias(key), "grp", "seq", "n", "bucket", label.alias("label"), whole.alias("text"), "error").where("text is not null")


def convert(submissions: DataFrame, key: str = "path", body: str = "body", to_mmd: bool = False, disable_indentation: bool = False) -> DataFrame:
    """(key, text, tokens): every submission as one Markdown document."""
    ordered = parts(submissions, key, body, to_mmd).withColumn("place", F.struct("grp", "seq", "n"))
    whole = assemble(ordered.select(key, "place", "text"), key, "place", "text", "\n\n")
    text = until_uuencode(F.col("text"))
    text = without_indentation(text) if disable_indentation else text
    return whole.select(key, text.alias("text")).withColumn("tokens", token_count(F.col("text")))


def part_statistics(submissions: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, bucket, tokens, chars, sections) of the parts, before assembly."""
    d = parts(submissions, key, body)
    return d.groupBy(key, "bucket").agg(F.sum(token_count(F.col("text"))).alias("tokens"), F.sum(F.length("text").cast("bigint")).alias("chars"), F.count("*").alias("sections"))
