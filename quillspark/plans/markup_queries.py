"""Queries for repairs of raw HTML and of Markdown phrases, over texts that are made of the tables."""

from pyspark.sql import functions as F

from quillspark.functions import markup as m
from quillspark.plans.registry import query, table


def _suppliers(spark, sf_dir, *parts):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(*[F.lit(p) if p != "@" else F.col("s_name") for p in parts]).alias("x"))


@query("prepared_html", "SELECT s_suppkey, '<p>' || s_name || '##sup##1##/sup## 5 new</p>' AS html FROM supplier")
def prepared_html(spark, sf_dir):
    d = _suppliers(spark, sf_dir, "<!DOCTYPE html><?xml version='1'?><!-- a\nb --><ix:header><p>gone</p></ix:header><p>", "@", "<SUP class=x>1</SUP> <ix:nonFraction name='a'>5</ix:nonFraction> <R>new</R></p>")
    return d.select("s_suppkey", F.replace(m.prepared_html(F.col("x")), F.lit("##SUP##"), F.lit("##sup##")).alias("html")).withColumn("html", F.replace("html", F.lit("##/SUP##"), F.lit("##/sup##")))


@query("emphasis_blocks", "SELECT s_suppkey, '<p class=a><b><i>' || s_name || '</i></b></p><span style=\"display: inline\">x</span><div style=\"display:inline-block\">y</div>' AS html FROM supplier")
def emphasis_blocks(spark, sf_dir):
    d = _suppliers(spark, sf_dir, "<b><i><p class=a>", "@", '</p></i></b><div style="display: inline">x</div><div style="display:inline-block">y</div>')
    return d.select("s_suppkey", m.inline_blocks_as_spans(m.blocks_outside_emphasis(F.col("x"))).alias("html"))


@query("joined_tags", "SELECT s_suppkey, '<b>' || s_name || ' more</b>&nbsp;<font size=2>z</font>' AS html FROM supplier")
def joined_tags(spark, sf_dir):
    d = _suppliers(spark, sf_dir, "<b>", "@", "</b> <b>more</b><i>&nbsp;</i>&lt;font size=2&gt;z&lt;/font&gt;")
    return d.select("s_suppkey", m.escaped_font_repaired(m.joined_tags(F.col("x"))).alias("html"))


@query("leading_indent", "SELECT s_suppkey, (s_suppkey % 5) * 0.5 + 2.5::DOUBLE AS indent FROM supplier")
def leading_indent(spark, sf_dir):
    text = F.concat(F.repeat(F.lit("&nbsp;"), (F.col("s_suppkey") % 5).cast("int")), F.lit("  "), "s_name", F.lit("&nbsp;"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", m.leading_indent(text).alias("indent"))


@query("joined_links", "SELECT s_suppkey, '[' || s_name || ' and more](u1)[x](u2) *a b c* **d**' AS text FROM supplier")
def joined_links(spark, sf_dir):
    d = _suppliers(spark, sf_dir, "[", "@", "](u1) [and](u1)[ more](u1)[x](u2) *a* *b* *c* **d**")
    return d.select("s_suppkey", m.joined_italics(m.joined_links(F.col("x"))).alias("text"))


@query("list_rows", "SELECT s_suppkey, '- ' || s_name || chr(10) || '| a | b |' || chr(10) || '<sup>(1)</sup> note' || chr(10) || '(x) none' AS text FROM supplier")
def list_rows(spark, sf_dir):
    d = _suppliers(spark, sf_dir, "| • | ", "@", " |\n| a | b |\n(1) note\n(x) none")
    return d.select("s_suppkey", m.footnote_lines(m.bullet_rows_as_items(F.col("x"))).alias("text"))


@query("currency_cells", "SELECT o_orderkey, '| x |  | $' || o_orderkey || ' |  | (5)% |  | – |' AS line FROM orders")
def currency_cells(spark, sf_dir):
    line = F.concat(F.lit("| x | $ | "), F.col("o_orderkey").cast("string"), F.lit(" |  | (5 | )% | – |"))
    return table(spark, sf_dir, "orders").select("o_orderkey", m.joined_currency_cells(line).alias("line"))


@query("inlined_tables", "SELECT s_suppkey, 'a |' || s_name || '| b |2| [t3](t3)' AS text FROM supplier")
def inlined_tables(spark, sf_dir):
    tables = F.array(F.struct(F.lit("t1").alias("id"), F.concat(F.lit("|"), "s_name", F.lit("|")).alias("content")), F.struct(F.lit("t2").alias("id"), F.lit("|2|").alias("content")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", m.inlined_tables(F.lit("a [t1](t1) b [t2](t2) [t3](t3)"), tables).alias("text"))


@query("dot_leaders", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS label, CASE WHEN p_partkey % 2 = 0 THEN '$(1,234)' END AS figure FROM part")
def dot_leaders(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), "p_name", F.lit(" ..... $ (1,234)"))).otherwise(F.concat("p_name", F.lit(". 5")))
    return table(spark, sf_dir, "part").select("p_partkey", m.dot_leader(line).alias("d")).select("p_partkey", "d.label", "d.figure")


@query("ruled_lines", "SELECT p_partkey, 'ab' AS a, p_partkey::VARCHAR AS b, 'tail of it' AS c FROM part")
def ruled_lines(spark, sf_dir):
    line = F.concat(F.lit("ab     "), F.rpad(F.col("p_partkey").cast("string"), 9, " "), F.lit("tail of it"))
    cells = m.cut_at_ruler(line, F.lit("------ -------- ---"))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate("abc")])


@query("ascii_texts", r"SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def ascii_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", m.ascii_text(F.col("text")).alias("text"))


@query("reading_requests", """SELECT page_id, '{"model":"reader","document":{"type":"document_url","document_url":"' || url || '"},"table_format":"html","include_image_base64":false}' AS request, 'data:image/png;base64,' || to_base64(encode(url)) AS uri FROM pages""")
def reading_requests(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", m.reading_request(F.col("url"), "reader").alias("request"), F.regexp_replace(m.data_uri(F.encode("url", "UTF-8")), r"[\r\n]", "").alias("uri"))
