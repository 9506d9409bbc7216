"""Queries over document lines."""

from pyspark.sql import functions as F

from quillspark.operators import lines as ln
from quillspark.plans.registry import query, table


@query(
    "suppress_repeated_lines",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest, count(*)::BIGINT AS n_lines FROM k WHERE before IS NULL OR line = '' OR line <> before GROUP BY doc_id""",
)
def suppress_repeated_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ln.lines_of(F.col("text")).alias("lines"))
    d = d.select("doc_id", ln.without_repeats(F.col("lines")).alias("kept"))
    return d.select("doc_id", F.md5(F.array_join("kept", "\n")).alias("digest"), F.size("kept").cast("bigint").alias("n_lines"))


@query(
    "page_marker_removal",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || ' 12 ' || chr(10) || 'Page 3' || chr(10) || '- 7 -' || chr(10) || 'A-1' || chr(10) || '612', chr(10))) AS line,
               generate_subscripts(string_split(text || chr(10) || ' 12 ' || chr(10) || 'Page 3' || chr(10) || '- 7 -' || chr(10) || 'A-1' || chr(10) || '612', chr(10)), 1) AS pos FROM documents)
    SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l
    WHERE NOT regexp_matches(regexp_replace(line, '&nbsp;|[ \t]', '', 'g'), '(?i)^(([A-Z]+-)?[0-4]?[0-9]{1,2}\.?|-[0-4]?[0-9]{1,2}-|page[0-4]?[0-9]{1,2}\.?)$') GROUP BY doc_id""",
)
def page_marker_removal(spark, sf_dir):
    from quillspark.functions.text import is_page_marker

    d = table(spark, sf_dir, "documents").select("doc_id", ln.lines_of(F.concat("text", F.lit("\n 12 \nPage 3\n- 7 -\nA-1\n612"))).alias("lines"))
    return d.select("doc_id", F.md5(F.array_join(ln.without_lines(F.col("lines"), is_page_marker), "\n")).alias("digest"))


@query(
    "conversation_markdown",
    """
    WITH p AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT conv_id, string_agg('**' || (turn + 1) || '. ' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn, '**' || (turn + 1) || '. ' || role || ':** ' || text) AS text FROM p GROUP BY conv_id""",
)
def conversation_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("**"), (F.col("turn") + 1).cast("string"), F.lit(". "), "role", F.lit(":** "), "text")
    return ln.assemble(c.select("conv_id", "turn", part.alias("part")), "conv_id", "turn", "part", "\n\n")


ROWS_SQL = """
    t AS (SELECT o_orderkey AS id, 0 AS pos, 'Order ' || o_orderkey AS line FROM orders UNION ALL SELECT o_orderkey, 1, '| Item | Value |' FROM orders UNION ALL SELECT o_orderkey, 2, '| --- | --- |' FROM orders
          UNION ALL SELECT l_orderkey, 2 + l_linenumber, CASE l_linenumber WHEN 1 THEN '| GAAP income | ' || l_quantity::BIGINT || ' |' WHEN 4 THEN '| **Total** | ' || l_quantity::BIGINT || ' |' WHEN 2 THEN '| &nbsp;<br> | — |'
          ELSE '| Adjustment ' || l_linenumber || ' | ' || l_quantity::BIGINT || ' |' END FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) UNION ALL SELECT o_orderkey, 90, 'End.' FROM orders UNION ALL SELECT o_orderkey, 91, '| a |  |' FROM orders)"""


def _rows(spark, sf_dir):
    """Small tables in documents, made of orders and their lines."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("bigint").cast("string")
    row = lambda label: F.concat(F.lit("| "), label, F.lit(" | "), q, F.lit(" |"))
    body = F.when(n == 1, row(F.lit("GAAP income"))).when(n == 4, row(F.lit("**Total**"))).when(n == 2, F.lit("| &nbsp;<br> | — |")).otherwise(row(F.concat(F.lit("Adjustment "), n.cast("string"))))
    fixed = [(0, F.concat(F.lit("Order "), "o_orderkey")), (1, F.lit("| Item | Value |")), (2, F.lit("| --- | --- |")), (90, F.lit("End.")), (91, F.lit("| a |  |"))]
    frame = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), x.alias("line")) for p, x in fixed])).alias("s")).select("id", "s.pos", "s.line")
    return frame.unionByName(li.select(F.col("l_orderkey").alias("id"), (2 + n).cast("int").alias("pos"), body.alias("line")))


@query(
    "empty_row_drop",
    f"""
    WITH {ROWS_SQL}, r AS (SELECT *, CASE WHEN line LIKE '|%|' THEN 1 ELSE 0 END AS isrow FROM t),
    c AS (SELECT *, CASE WHEN isrow = 1 AND coalesce(lag(isrow) OVER (PARTITION BY id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS change FROM r),
    b AS (SELECT *, CASE WHEN isrow = 1 THEN sum(change) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS block FROM c),
    d AS (SELECT *, CASE WHEN isrow = 1 THEN min(CASE WHEN line = '| --- | --- |' THEN pos END) OVER (PARTITION BY id, block) END AS divider FROM b)
    SELECT id, pos::INTEGER AS pos, line FROM d WHERE NOT coalesce(pos > divider AND line = '| &nbsp;<br> | — |', false)""",
)
def empty_row_drop(spark, sf_dir):
    return ln.drop_empty_body_rows(_rows(spark, sf_dir))


@query(
    "reconciliation_indent",
    f"""
    WITH {ROWS_SQL}, e AS (SELECT *, CASE WHEN NOT line LIKE '|%' OR line LIKE '| **%' THEN 0 WHEN line LIKE '| GAAP %' THEN 1 END AS event FROM t),
    s AS (SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM e)
    SELECT id, pos::INTEGER AS pos, CASE WHEN state = 1 AND line LIKE '| Adjustment%' THEN '| &nbsp;&nbsp;&nbsp;&nbsp;' || substr(line, 3) ELSE line END AS line FROM s""",
)
def reconciliation_indent(spark, sf_dir):
    return ln.indent_reconciliations(_rows(spark, sf_dir))


@query(
    "markdown_table_blocks",
    f"""
    WITH {ROWS_SQL}, r AS (SELECT *, line LIKE '|%|' AS isrow FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, isrow ORDER BY pos) AS island FROM r),
    g AS (SELECT id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows, count_if(line = '| --- | --- |') AS dividers FROM b WHERE isrow GROUP BY id, island)
    SELECT id, first_pos::INTEGER AS first_pos, last_pos::INTEGER AS last_pos, n_rows::BIGINT AS n_rows FROM g WHERE dividers > 0 AND n_rows > 2""",
)
def markdown_table_blocks(spark, sf_dir):
    d = ln.table_blocks(_rows(spark, sf_dir)).where("block is not null")
    return d.groupBy("id", "block").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"), F.max("divider").alias("divider")).where("divider is not null and n_rows > 2").drop("divider", "block")
