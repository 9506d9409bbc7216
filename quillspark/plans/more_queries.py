"""Queries for the smaller rules: answers and blanks, cells by their neighbours, matches and roll-ups."""

from pyspark.sql import Window as W, functions as F

from quillspark.functions import text as t
from quillspark.operators import grid
from quillspark.plans.grid_queries import GRID_SQL, SUMMARY_SQL, _grid, _summary, _summary_of, _tables, _with_cells
from quillspark.plans.registry import query, table


@query(
    "offering_lines",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '**Total:** USD or [x] Indefinite' WHEN 1 THEN '**Total:** $' || format('{:,}', c_custkey * 1000) || ' USD' ELSE '**Total:** n.a. USD' END AS sales,
        CASE c_custkey % 3 WHEN 0 THEN '**Fee** $0 USD' WHEN 1 THEN '**Fee** $' || c_custkey || '.00 USD [x] Estimate' ELSE '**Fee** $' || c_custkey || '.00 USD' END AS fee FROM customer""",
)
def offering_lines(spark, sf_dir):
    k = (F.col("c_custkey") % 3).cast("int")
    amount = F.when(k == 0, " Indefinite").when(k == 1, (F.col("c_custkey") * 1000).cast("string")).otherwise("n.a.")
    return table(spark, sf_dir, "customer").select("c_custkey", t.sales_line("Total", amount).alias("sales"), t.fee_line("Fee", F.when(k > 0, F.col("c_custkey").cast("string")), F.when(k == 1, "Y").otherwise("false")).alias("fee"))


@query(
    "code_names",
    """SELECT c_custkey, ['ALABAMA', 'UNITED KINGDOM', 'ZZ', 'NEW YORK'][c_custkey % 4 + 1] AS state, ['NA - less than 5%', 'E - 75% or more', 'Q', 'A - 5% but less than 10%'][c_custkey % 4 + 1] AS share, ['DE (Domestic Entity)', 'np?', 'NP (Natural Person)', 'FE (Foreign Entity)'][c_custkey % 4 + 1] AS entity FROM customer""",
)
def code_names(spark, sf_dir):
    of = lambda *xs: F.get(F.array(*map(F.lit, xs)), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.decode_with(t.STATE_CODES, of("AL", "l8", "ZZ", "NY")).alias("state"), t.decode_with(t.OWNERSHIP_CODES, of("NA", "E", "Q", "A")).alias("share"), t.decode_with(t.ENTITY_CODES, of("DE", "np?", "NP", "FE")).alias("entity"))


@query(
    "fill_in_blanks",
    """SELECT s_suppkey, 'Name ____ of ' || s_name || ' ____' || chr(10) || chr(8195) || 'indented 12 Months (____), <b>' || chr(8194) || '</b>' AS text FROM supplier""",
)
def fill_in_blanks(spark, sf_dir):
    text = F.concat(F.lit("Name\u2003\u2003of "), "s_name", F.lit("  \u2002\n\u2003indented 12\u2002Months (\u2003), <b>\u2002</b>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.fill_in_blanks(text).alias("text"))


@query("unique_names", "SELECT p_partkey, p_brand AS a, p_type AS b, p_brand || '__1' AS c, p_brand || '__2' AS d, 'x' AS e FROM part WHERE p_brand <> p_type")
def unique_names(spark, sf_dir):
    names = t.unique_names(F.array("p_brand", "p_type", "p_brand", "p_brand", F.lit("x")))
    return table(spark, sf_dir, "part").where("p_brand <> p_type").select("p_partkey", *[F.get(names, F.lit(i)).alias(c) for i, c in enumerate("abcde")])


@query("positioned_pages", "SELECT page_id, page_id % 3 = 0 AS positioned FROM pages")
def positioned_pages(spark, sf_dir):
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.repeat(F.lit('<div class=a id="pf1f">x</div>'), 4), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.repeat(F.lit('<p style="position: absolute">'), 9), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.is_positioned_layout(html).alias("positioned"))


@query("empty_tables", "SELECT s_suppkey, 'a' || chr(10) || s_name || chr(10) || '---' || chr(10) || chr(10) || '| x |' || chr(10) || chr(10) || '---' || chr(10) AS text FROM supplier")
def empty_tables(spark, sf_dir):
    text = F.concat(F.lit("a\n---\n\n|  | — |\n|---|:--|\n\n---\n\n"), "s_name", F.lit("\n---\n\n| x |\n\n---\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(t.without_empty_tables(text), F.lit("\n\n"), F.lit("\n\n")).alias("text"))


@query("table_scan", "SELECT p_partkey, unnest([0, 1, 2]) AS r, unnest([' a | b ', ' ' || p_name || ' | 5 ', ' only |']) AS cells FROM part")
def table_scan(spark, sf_dir):
    markdown = F.concat(F.lit("| a | b |\n|---|:-:|\nnot a row\n| "), "p_name", F.lit(" | 5 | extra |\n| only |"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(grid.scan_table(markdown)).alias("r", "row"))
    return d.select("p_partkey", "r", F.array_join("row", "|").alias("cells"))


@query("plain_years", "SELECT o_orderkey, year(o_orderdate)::VARCHAR AS a, year(o_orderdate) || '.5' AS b FROM orders")
def plain_years(spark, sf_dir):
    year = F.year("o_orderdate").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.plain_year(F.concat(F.lit(" "), year, F.lit(".0"))).alias("a"), t.plain_year(F.concat(year, F.lit(".5"))).alias("b"))


@query("summary_lines", "SELECT doc_id, '[parse-stats] tokens=' || format('{:,}', n_chars) || ' | form=' || coalesce(source, 'unknown') || ' | formats: ' || CASE WHEN doc_id % 2 = 0 THEN 'html=75.0%, other=25.0%' ELSE 'none' END AS line FROM documents")
def summary_lines(spark, sf_dir):
    shares = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("other"), F.lit(25.0), F.lit("html"), F.lit(75.0), F.lit("pdf"), F.lit(0.0))).otherwise(F.create_map(F.lit("x"), F.lit(1.0)))
    return table(spark, sf_dir, "documents").select("doc_id", t.summary_line(F.col("n_chars"), F.col("source"), shares).alias("line"))


# -- cells by their neighbours -----------------------------------------------------------------------------


@query("border_moves", f"WITH {GRID_SQL}, k AS (SELECT table_id, r, c, text || CASE WHEN c = 2 AND lead(r) OVER (PARTITION BY table_id, c ORDER BY r) % 2 = 0 THEN '<BORDER>' ELSE '' END AS text FROM cells) {SUMMARY_SQL}")
def border_moves(spark, sf_dir):
    cells = _grid(spark, sf_dir).withColumn("text", F.when((F.col("c") == 2) & (F.col("r") % 2 == 0) & (F.col("r") > 0), F.concat(F.lit("<BORDER_TOP>"), "text")).otherwise(F.col("text")))
    return _summary(grid.borders_up(cells))


@query("left_filled", f"WITH {GRID_SQL}, w AS (SELECT table_id, r, c, last(CASE WHEN NOT regexp_matches(text, '^[\\s ]*([—–-]+[\\s ]*)?$') THEN c END IGNORE NULLS) OVER (PARTITION BY table_id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_c FROM cells) SELECT table_id, r, sum(left_c * c)::BIGINT AS s FROM w GROUP BY ALL")
def left_filled(spark, sf_dir):
    return grid.with_left_filled(_grid(spark, sf_dir)).groupBy("table_id", "r").agg(F.sum(F.col("left_c") * F.col("c")).cast("bigint").alias("s"))


HEADS_SQL = """h AS (SELECT table_id, c, max(CASE WHEN r = 0 THEN text END) AS head, count_if(r > 0 AND NOT regexp_matches(text, '^[\\s ]*([—–-]+[\\s ]*)?$')) AS filled FROM cells GROUP BY ALL)"""


@query(
    "blank_subset_headers",
    f"""WITH {GRID_SQL.replace("'Rate', 'Rate', '', '', ''", "'Rate of change', 'Rate', 'change', '', ''")}, {HEADS_SQL.replace("max(CASE", "max(CASE")},
    n AS (SELECT *, lag(head) OVER w AS ph, lag(filled) OVER w AS pf, lead(head) OVER w AS nh, lead(filled) OVER w AS nf, lag(c) OVER w AS pc, lead(c) OVER w AS nc FROM h WINDOW w AS (PARTITION BY table_id ORDER BY c)),
    k AS (SELECT cells.* FROM cells JOIN n USING (table_id, c) WHERE NOT coalesce(pc IS NOT NULL AND nc IS NOT NULL AND filled = 0 AND head <> '' AND ((pf > 0 AND contains(ph, head)) OR (nf > 0 AND contains(nh, head))), false)) {SUMMARY_SQL}""",
)
def blank_subset_headers(spark, sf_dir):
    heads = _with_cells(lambda r, v, c: F.when((r == 0) & (c == 4), "Rate of change").when((r == 0) & (c == 6), "change").otherwise(v))
    return _summary_of(_tables(spark, sf_dir), grid.drop_blank_subset_headers(heads))


@query(
    "blank_repeats",
    f"""WITH {GRID_SQL.replace("'Rate', 'Rate', '', '', ''", "'Rate', 'Rate', 'Rate', 'Other', 'Other'")}, {HEADS_SQL},
    n AS (SELECT *, count(*) OVER g AS n, max(filled) OVER g AS most, row_number() OVER (PARTITION BY table_id, head ORDER BY c) AS nth FROM h WINDOW g AS (PARTITION BY table_id, head)),
    k AS (SELECT cells.* FROM cells JOIN n USING (table_id, c) WHERE NOT (n.n > 1 AND head <> '' AND filled = 0 AND (most > 0 OR nth > 1))) {SUMMARY_SQL}""",
)
def blank_repeats(spark, sf_dir):
    heads = _with_cells(lambda r, v, c: F.when((r == 0) & (c == 6), "Rate").when((r == 0) & (c > 6), "Other").otherwise(v))
    return _summary_of(_tables(spark, sf_dir), grid.drop_blank_repeats(heads))


@query("superscript_columns", f"WITH {GRID_SQL}, k AS (SELECT table_id, r, c, text || CASE WHEN c = 5 AND r % 2 = 1 THEN '<sup>' || r || '</sup>' ELSE '' END AS text FROM cells WHERE c <> 6 OR table_id NOT IN (SELECT table_id FROM li WHERE r % 2 = 1)) {SUMMARY_SQL}")
def superscript_columns(spark, sf_dir):
    marks = F.when(F.col("c") == 6, F.when(F.col("r") % 2 == 1, F.concat(F.lit("<sup>"), F.col("r").cast("string"), F.lit("</sup>"))).when(F.col("r") > 0, "—").otherwise("")).otherwise(F.col("text"))
    return _summary(grid.superscripts_left(_grid(spark, sf_dir).withColumn("text", marks)))


@query("tag_only_cells", f"WITH {GRID_SQL}, k AS (SELECT cells.* FROM cells WHERE c NOT IN (6, 8) OR (c = 8 AND table_id IN (SELECT table_id FROM li WHERE r = 3)) OR false) {SUMMARY_SQL.replace('FROM k', 'FROM (SELECT * FROM k WHERE c <> 7 OR table_id IN (SELECT table_id FROM li WHERE r % 2 = 0))')}")
def tag_only_cells(spark, sf_dir):
    return _summary_of(_tables(spark, sf_dir), grid.drop_tag_only(F.col("rows"), 1))


@query("covered_columns", f"WITH {GRID_SQL}, k AS (SELECT table_id, r, c, text FROM cells WHERE c IN (0, 2, 4) OR (c = 7 AND table_id IN (SELECT table_id FROM li WHERE r % 2 = 0)) OR (c = 8 AND table_id IN (SELECT table_id FROM li WHERE r = 3)) OR (c = 1)) {SUMMARY_SQL}")
def covered_columns(spark, sf_dir):
    span = lambda c: F.when(c.isin(2, 3), 1).when(c.isin(4, 5), 2).otherwise(c + 10)
    return _summary_of(_tables(spark, sf_dir), grid.drop_covered(_with_cells(lambda r, v, c: F.struct(v.alias("text"), span(c).alias("span")))))


# -- matches and roll-ups ----------------------------------------------------------------------------------


@query(
    "weekly_flows",
    """WITH f AS (SELECT o_custkey AS class_id, weekofyear(o_orderdate) % 5 AS n, sum(o_totalprice) AS flow FROM orders GROUP BY ALL), v AS (SELECT c_custkey AS class_id, c_custkey % 5 AS n, c_acctbal AS nav FROM customer)
       SELECT class_id, n::INTEGER AS n, round(flow, 2) AS flow, nav FROM f LEFT JOIN v USING (class_id, n)""",
)
def weekly_flows(spark, sf_dir):
    flows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("class_id"), (F.weekofyear("o_orderdate") % 5).cast("bigint").alias("n")).agg(F.round(F.sum("o_totalprice"), 2).alias("flow"))
    values = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class_id"), (F.col("c_custkey") % 5).alias("n"), F.col("c_acctbal").alias("nav"))
    return flows.join(values, ["class_id", "n"], "left").withColumn("n", F.col("n").cast("int"))


@query("option_grid", "SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest([p_name, p_brand, NULL]) AS a, unnest([p_type, NULL, NULL]) AS b, unnest(['x', 'y', 'z']) AS c FROM part")
def option_grid(spark, sf_dir):
    zipped = F.arrays_zip(F.array("p_name", "p_brand").alias("a"), F.array("p_type").alias("b"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(zipped).alias("pos", "z")).select("p_partkey", "pos", F.col("z.a").alias("a"), F.col("z.b").alias("b"), F.col("z.c").alias("c"))


@query("any_yes", "SELECT o_custkey, bool_or(o_orderkey % 7 = 0) AS disclosed, count(*)::BIGINT AS answers FROM orders GROUP BY o_custkey")
def any_yes(spark, sf_dir):
    answer = F.when(F.col("o_orderkey") % 7 == 0, "Y").otherwise("N")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(t.is_checked(F.when(answer == "Y", "x"))).alias("disclosed"), F.count("*").alias("answers"))


@query("page_usage", "SELECT conv_id, count(*)::BIGINT AS pages_processed, sum(octet_length(encode(text)))::BIGINT AS doc_size_bytes FROM conversations GROUP BY conv_id")
def page_usage(spark, sf_dir):
    """Usage of a reading service, from responses that hold their pages as JSON."""
    page = F.to_json(F.struct(F.col("text").alias("markdown")))
    responses = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{"pages":['), F.array_join(F.collect_list(page), ","), F.lit("]}")).alias("json"))
    d = F.from_json("json", "pages array<struct<markdown:string>>")
    return responses.select("conv_id", d.alias("d")).select("conv_id", F.size("d.pages").cast("bigint").alias("pages_processed"), F.aggregate("d.pages", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p["markdown"])).alias("doc_size_bytes"))


@query("period_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS place FROM orders")
def period_order(spark, sf_dir):
    """Periods in the order of the number they end in, not of their text."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("week"), F.col("o_orderkey").cast("string")).alias("period"))
    return d.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.regexp_extract("period", r"\d+", 0).cast("bigint"))).alias("place"))


@query("legacy_codes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '04(5),10' ELSE '04(5)' END AS legacy FROM part")
def legacy_codes(spark, sf_dir):
    """Codes of an old form that the present one doesn't have."""
    named = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("06b"), F.lit("04(5)"), F.lit("10"))).otherwise(F.array(F.lit("04(5)"), F.lit("06c")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_except(named, F.array(F.lit("06b"), F.lit("06c"))), ",").alias("legacy"))
