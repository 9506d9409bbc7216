"""Queries over the scalar text rules, each with its SQL twin."""

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.plans.registry import query, table

LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return d


@query(
    "form_category_map",
    """
    WITH f AS (SELECT source, CASE doc_id % 12 WHEN 0 THEN '10-K' WHEN 1 THEN ' 10-q/A' WHEN 2 THEN '8-K/A' WHEN 3 THEN 'NPORT-P' WHEN 4 THEN 'N-CEN/A' WHEN 5 THEN 'N-PX'
        WHEN 6 THEN 'N-MFP2' WHEN 7 THEN '13F-HR' WHEN 8 THEN '4' WHEN 9 THEN 'SC 13G' WHEN 10 THEN '' ELSE NULL END AS form FROM documents),
    b AS (SELECT source, form, regexp_replace(regexp_replace(upper(trim(coalesce(form, 'unknown'))), '/A$', ''), '[^A-Z0-9]', '', 'g') AS c FROM f)
    SELECT form, CASE WHEN c IN ('8K', '10K', '10Q', '3', '4', '5') THEN lower(c) WHEN c LIKE 'NPORT%' THEN 'nport' WHEN c LIKE 'NCEN%' THEN 'ncen' WHEN c LIKE 'NPX%' THEN 'npx'
        WHEN c LIKE 'NMFP%' THEN 'nmfp' WHEN c LIKE '13F%' THEN '13f' WHEN c = '' THEN 'unknown' ELSE lower(c) END AS category, count(*)::BIGINT AS n FROM b GROUP BY ALL""",
)
def form_category_map(spark, sf_dir):
    forms = ["10-K", " 10-q/A", "8-K/A", "NPORT-P", "N-CEN/A", "N-PX", "N-MFP2", "13F-HR", "4", "SC 13G", ""]
    d = table(spark, sf_dir, "documents").select(F.get(F.array(*map(F.lit, forms)), (F.col("doc_id") % 12).cast("int")).alias("form"))
    return d.groupBy("form", t.form_category(F.col("form")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "link_table",
    r"""
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS m FROM pages)
    SELECT page_id, regexp_extract(m, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(m, '>([^<]*)<', 1)) AS label,
           CASE WHEN regexp_extract(m, 'href="([^"]*)"', 1) LIKE '#%' THEN 'fragment' WHEN lower(regexp_extract(m, 'href="([^"]*)"', 1)) LIKE 'javascript:%' THEN 'script'
                WHEN regexp_matches(regexp_extract(m, 'href="([^"]*)"', 1), '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'absolute' ELSE 'relative' END AS kind
    FROM a WHERE trim(regexp_extract(m, '>([^<]*)<', 1)) <> ''""",
)
def link_table(spark, sf_dir):
    a = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), F.lit(0))).alias("m"))
    href, label = F.regexp_extract("m", r'href="([^"]*)"', 1), F.trim(F.regexp_extract("m", r">([^<]*)<", 1))
    kind = F.when(href.startswith("#"), "fragment").when(F.lower(href).startswith("javascript:"), "script").when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "absolute").otherwise("relative")
    return a.select("page_id", href.alias("href"), label.alias("label"), kind.alias("kind")).where("label <> ''")


@query(
    "visible_text",
    r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>', '', 'g') AS h FROM pages)
    SELECT page_id, trim(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g')) AS visible FROM a""",
)
def visible_text(spark, sf_dir):
    h = F.regexp_replace("html", r"(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), r"[\s\x{a0}]+", " ")).alias("visible"))


@query(
    "page_titles",
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading,
               regexp_extract(html, '(?is)<title>(.*?)</title>', 1) = regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS agree FROM pages""",
)
def page_titles(spark, sf_dir):
    title, heading = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), heading.alias("heading"), (title == heading).alias("agree"))


@query(
    "html_entities",
    """SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS decoded FROM pages""",
)
def html_entities(spark, sf_dir):
    h = F.col("html")
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        h = F.replace(h, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("decoded"))


@query(
    "html_predicate",
    r"""SELECT is_html, count(*)::BIGINT AS n FROM (SELECT regexp_matches(html, '(?i)<\s*(html|div|p)\b') AS is_html FROM pages
        UNION ALL SELECT regexp_matches(text, '(?i)<\s*(html|div|p)\b') FROM documents) GROUP BY is_html""",
)
def html_predicate(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select(t.is_html(F.col("html")).alias("is_html")).unionAll(table(spark, sf_dir, "documents").select(t.is_html(F.col("text"))))
    return both.groupBy("is_html").agg(F.count("*").alias("n"))


@query(
    "unsplit_numbers",
    r"""
    WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'due in March ' ELSE 'sum of ' END || l_partkey || ', ' || l_suppkey || '  ' || l_orderkey AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(t, 'March') THEN t ELSE regexp_replace(regexp_replace(t, '([0-9])[\s,]+([0-9])', '\1\2', 'g'), '([0-9])[\s,]+([0-9])', '\1\2', 'g') END AS joined FROM w""",
)
def unsplit_numbers(spark, sf_dir):
    text = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "due in March ").otherwise("sum of "), F.col("l_partkey"), F.lit(", "), F.col("l_suppkey"), F.lit("  "), F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.join_split_numbers(text).alias("joined"))


@query(
    "phone_join",
    r"""
    WITH p AS (SELECT c_custkey, 'call (' || (200 + c_custkey % 700) || ')' || chr(10) || ' ' || (100 + c_nationkey) || '-' || lpad(c_custkey::VARCHAR, 4, '0') AS t FROM customer)
    SELECT c_custkey, regexp_replace(t, '(\([0-9]{3}\))\s*\n\s*([0-9]{3}-[0-9]{4})', '\1 \2', 'g') AS phone FROM p""",
)
def phone_join(spark, sf_dir):
    split = F.concat(F.lit("call ("), 200 + F.col("c_custkey") % 700, F.lit(")\n "), 100 + F.col("c_nationkey"), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.join_phone_numbers(split).alias("phone"))


@query(
    "junk_lines",
    rf"""
    WITH {LINES_SQL}
    SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(regexp_matches(line, '(?i)^\s*(var|function)\b|^\s*//|^\s*/\*|^\s*[.#][\w-]+\s*[{{]') OR regexp_full_match(line, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
           OR regexp_full_match(line, '[0-9]{{6,10}}') OR line = 'us-' OR regexp_full_match(line, '([a-zA-Z0-9-]+:[a-zA-Z0-9.]+\s*)+'))::BIGINT AS n_junk,
           count_if(regexp_matches(regexp_replace(line, '&nbsp;|[ \t]', '', 'g'), '(?i)^(([A-Z]+-)?[0-4]?[0-9]{{1,2}}\.?|-[0-4]?[0-9]{{1,2}}-|page[0-4]?[0-9]{{1,2}}\.?)$'))::BIGINT AS n_page_markers,
           count_if(regexp_matches(line, '^[\s\x{{a0}}]*([—–-]+[\s\x{{a0}}]*)?$'))::BIGINT AS n_blank
    FROM l GROUP BY doc_id""",
)
def junk_lines(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(t.is_junk(line)).alias("n_junk"), F.count_if(t.is_page_marker(line)).alias("n_page_markers"), F.count_if(t.is_blank(line)).alias("n_blank")
    )


@query(
    "mojibake_fix",
    """
    WITH d AS (SELECT doc_id, text || ' donâ€™t â€œsayâ€\x9d 5â€“6 Â§ ’x’' AS t FROM documents)
    SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(t, 'â€™', ''''), 'â€˜', ''''), 'â€œ', '"'), 'â€\x9d', '"'), 'â€“', '–'), 'â€”', '—'), 'â€', '"'), 'Â', '')) AS fixed,
           md5(replace(replace(replace(replace(replace(replace(replace(t, '‘', ''''), '’', ''''), '“', '"'), '”', '"'), chr(160), ' '), chr(8201), ' '), chr(173), '')) AS plain FROM d""".replace("\\x9d", "\x9d"),
)
def mojibake_fix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" donâ€™t â€œsayâ€\x9d 5â€“6 Â§ ’x’")).alias("t"))
    return d.select("doc_id", F.md5(t.fix_mojibake(F.col("t"))).alias("fixed"), F.md5(t.plain_punctuation(F.col("t"))).alias("plain"))


@query(
    "asterisk_protect",
    "SELECT doc_id, replace(replace(replace(text, '***', '##TRIPLE_ASTERISK##'), '**', '##DOUBLE_ASTERISK##'), '*', '##SINGLE_ASTERISK##') AS safe FROM documents WHERE contains(text, '*')",
)
def asterisk_protect(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("*"))).select("doc_id", t.protect_asterisks(F.col("text")).alias("safe"))


CELLS = ["12,345.60", "($1,234", "—", "  ", "abc (1)(2)", "$ (4)%", "nan", "##INDENT##", "<sup>1</sup> A & B", "☒ yes ☐ no", ".5", "1e5", "12 years", "7-8", "- ", "x\n y"]
CELLS_SQL = "c AS (SELECT l_orderkey, l_linenumber, [" + ", ".join("'" + c.replace("\n", "' || chr(10) || '") + "'" for c in CELLS) + "][((l_orderkey + l_linenumber) % 16)::INTEGER + 1] AS cell FROM lineitem)"


def _cells(spark, sf_dir):
    cell = F.get(F.array(*map(F.lit, CELLS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 16).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))


@query(
    "cell_predicates",
    rf"""
    WITH {CELLS_SQL}, p AS (SELECT *, trim(regexp_replace(cell, '[$,()%\s]', '', 'g')) AS b FROM c)
    SELECT l_orderkey, l_linenumber, regexp_matches(cell, '^[\s\x{{a0}}]*([—–-]+[\s\x{{a0}}]*)?$') AS blank,
           regexp_matches(regexp_replace(cell, '##[A-Z_/]+(_[0-9]+)?##|&nbsp;|<BORDER(_TOP)?>|\x{{a0}}', '', 'g'), '^[\s\x{{a0}}]*([—–-]+[\s\x{{a0}}]*)?$') AS empty,
           b IN ('', '—', '–', '-') OR regexp_matches(b, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AS numeric_like FROM p""",
)
def cell_predicates(spark, sf_dir):
    c = F.col("cell")
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", t.is_blank(c).alias("blank"), t.is_truly_empty(c).alias("empty"), t.is_numeric_like(c).alias("numeric_like"))


@query(
    "cell_cleaners",
    rf"""
    WITH {CELLS_SQL}, p AS (SELECT *, regexp_replace(regexp_replace(cell, '<[^>]+>', '', 'g'), '[,$()\s–—-]', '', 'g') AS probe,
         regexp_replace(regexp_replace(regexp_replace(cell, '##[A-Z_/]+(_[0-9]+)?##|<BORDER(_TOP)?>|&nbsp;', '', 'g'), '(?i)\b(nan|none)\b', '', 'g'), '[\x{{a0}}\x{{200b}}-\x{{200d}}\x{{2060}}-\x{{206f}}\x{{feff}}\s]+', '', 'g') AS bare,
         regexp_replace(regexp_replace(cell, '(?i)<sup\b[^>]*>.*?</sup>', '', 'g'), '(?i)<br\s*/?>|&nbsp;|\x{{a0}}', ' ', 'g') AS k1 FROM c),
    q AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(k1, '<[^>]+>|##[A-Z_/]+(_[0-9]+)?##|[\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{206f}}\x{{feff}}]', '', 'g'), '\s*&\s*', '&', 'g'), '\s+', ' ', 'g')) AS k FROM p)
    SELECT l_orderkey, l_linenumber,
           CASE WHEN regexp_matches(probe, '^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$') THEN regexp_replace(cell, '([0-9])[,·\x{{a0}}\x{{202f}}]([0-9])', '\1\2', 'g') ELSE cell END AS ungrouped,
           CASE WHEN regexp_matches(cell, '^\s*\$?\([0-9,]+(\.[0-9]+)?\s*$') THEN rtrim(cell) || ')' ELSE cell END AS closed,
           regexp_replace(cell, '\s*\n\s*', '<br>', 'g') AS breaks, CASE WHEN bare = '' THEN '' ELSE cell END AS layout,
           CASE WHEN regexp_matches(k, '^[—–-]+$') THEN '' ELSE k END AS key,
           regexp_replace(cell, '((?:\([0-9]{{1,2}}\))+)$', '<sup>\1</sup>') AS sup, regexp_replace(cell, '(?i)<sup>(.*?)</sup>', '^\1^', 'g') AS caret,
           regexp_replace(regexp_replace(cell, '[☒☑✓✔þý]', '[x]', 'g'), '[☐□¨]', '[ ]', 'g') AS boxes,
           CASE WHEN regexp_matches(trim(cell), '^\.[0-9]+$') THEN '$0' || trim(cell) WHEN regexp_matches(trim(cell), '^[0-9][0-9,]*(\.[0-9]+)?$') THEN '$' || trim(cell) ELSE cell END AS dollars,
           trim(regexp_replace(trim(cell), '(?i)\s*years$', '')) AS without_years FROM q""",
)
def cell_cleaners(spark, sf_dir):
    c = F.col("cell")
    made = {
        "ungrouped": t.without_separators, "closed": t.close_parenthesis, "breaks": t.newlines_to_breaks, "layout": t.blank_layout_only, "key": t.comparison_key, "sup": t.footnotes_to_sup,
        "caret": t.sup_to_caret, "boxes": t.checkbox_marks, "dollars": t.dollarize, "without_years": t.without_years,
    }
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", *[f(c).alias(k) for k, f in made.items()])


@query(
    "format_money_variants",
    """
    WITH v AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_extendedprice)::DECIMAL(18,2) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN n < 0 THEN '$-' ELSE '$' END || printf('%.2f', abs(n)) AS plain,
           CASE WHEN n < 0 THEN '($' || format('{:,.2f}', abs(n)::DOUBLE) || ')' ELSE '$' || format('{:,.2f}', abs(n)::DOUBLE) END AS grouped FROM v""",
)
def format_money_variants(spark, sf_dir):
    n = (F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1) * F.col("l_extendedprice")).cast("decimal(18,2)").cast("string")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))
    return d.select("l_orderkey", "l_linenumber", t.format_dollars(F.col("n")).alias("plain"), t.format_dollars(F.col("n"), grouping=True, negative_in_parentheses=True).alias("grouped"))


@query(
    "format_answers",
    """
    WITH a AS (SELECT o_orderkey, ['Y', 'n', 'true', '0', 'x', 'maybe', NULL][(o_orderkey % 7)::INTEGER + 1] AS v FROM orders)
    SELECT o_orderkey, CASE WHEN lower(v) IN ('y', 'yes', 'true', '1', 'x') THEN 'Yes' WHEN lower(v) IN ('n', 'no', 'false', '0') THEN 'No' ELSE coalesce(v, '—') END AS answer,
           CASE WHEN upper(v) IN ('Y', 'YES', 'TRUE', '1') THEN '[x] Yes  [ ] No  [ ] N/A' WHEN upper(v) IN ('N', 'NO', 'FALSE', '0') THEN '[ ] Yes  [x] No  [ ] N/A' ELSE '[ ] Yes  [ ] No  [x] N/A' END AS box,
           coalesce(lower(v) IN ('1', 'true', 'x'), false) AS checked FROM a""",
)
def format_answers(spark, sf_dir):
    v = F.get(F.array(*map(F.lit, ["Y", "n", "true", "0", "x", "maybe", None])), (F.col("o_orderkey") % 7).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return d.select("o_orderkey", t.format_bool(F.col("v")).alias("answer"), t.format_checkbox(F.col("v")).alias("box"), t.is_checked(F.col("v")).alias("checked"))


@query(
    "format_date_long",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) END AS long_date FROM orders",
)
def format_date_long(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.format_date_long(v).alias("long_date"))


@query(
    "format_names",
    """
    WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '—' ELSE c_mktsegment END AS m, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'unit ' || c_nationkey END AS p FROM customer)
    SELECT c_custkey, concat_ws(', ', c_name, nullif(m, '—'), p) AS address, concat_ws(' ', nullif(m, '—'), c_name) AS name, left(sha256(c_name), 12) AS fingerprint FROM c""",
)
def format_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "—").otherwise(F.col("c_mktsegment")).alias("m"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("unit "), "c_nationkey")).alias("p"))
    return c.select("c_custkey", t.format_address(F.col("c_name"), F.col("m"), F.col("p")).alias("address"), t.format_name(F.col("m"), F.col("c_name")).alias("name"), t.fingerprint(F.col("c_name")).alias("fingerprint"))


@query(
    "doc_type_routes",
    r"""
    WITH d AS (SELECT doc_id, ['10-K', 'EX-10.1', 'ex-99.2A', 'GRAPHIC', 'EX-101.INS', 'zip', 'EX-101.XYZ', 'COVER letter'][(doc_id % 8)::INTEGER + 1] AS k, '/data/' || lpad(doc_id::VARCHAR, 10, '0') || '-24-000001.txt' AS path,
               CASE WHEN doc_id % 2 = 0 THEN 'consent of experts' END AS descr FROM documents)
    SELECT doc_id, upper(k) IN ('EXCEL', 'XML', 'XBRLSUMMARY', 'JSON', 'ZIP', 'PAPER', 'GRAPHIC') OR regexp_matches(upper(k), '^EX-101\.(INS|SCH|CAL|DEF|LAB|PRE)$') AS skipped,
           CASE WHEN regexp_extract(k, '(?i)^EX[-\s]?([0-9]+\.[0-9]+)', 1) <> '' THEN '## Exhibit ' || regexp_extract(k, '(?i)^EX[-\s]?([0-9]+\.[0-9]+)', 1)
                ELSE '## ' || array_to_string(list_transform(string_split(coalesce(descr, k), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS title,
           CASE WHEN doc_id % 3 = 0 THEN lpad(doc_id::VARCHAR, 10, '0') || '-24-000001' ELSE 'filing' || doc_id END AS accession FROM d""",
)
def doc_type_routes(spark, sf_dir):
    kinds = ["10-K", "EX-10.1", "ex-99.2A", "GRAPHIC", "EX-101.INS", "zip", "EX-101.XYZ", "COVER letter"]
    i = F.col("doc_id")
    k, descr = F.get(F.array(*map(F.lit, kinds)), (i % 8).cast("int")), F.when(i % 2 == 0, "consent of experts")
    path = F.when(i % 3 == 0, F.concat(F.lit("/data/"), F.lpad(i.cast("string"), 10, "0"), F.lit("-24-000001.txt"))).otherwise(F.concat(F.lit("/data/filing"), i, F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", t.is_skipped_type(k).alias("skipped"), t.section_title(k, descr).alias("title"), t.accession_number(path).alias("accession"))


@query(
    "uuencode_tail",
    "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10) END) AS digest FROM documents",
)
def uuencode_tail(spark, sf_dir):
    whole = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("\nbegin 644 a.pdf\nM1234\nend\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.until_uuencode(whole)).alias("digest"))


@query(
    "indentation_strip",
    r"""SELECT c_custkey, regexp_replace(regexp_replace(replace('##INDENT##&nbsp;&nbsp;' || c_name || '&nbsp;&nbsp;x | &nbsp;' || c_mktsegment, '##INDENT##', ''), '(?im)(^|\|\s*|<br>\s*)(?:&nbsp;|\x{a0})+[ \t]*', '\1', 'g'), '(?i)(?:&nbsp;|\x{a0})+', ' ', 'g') AS flat FROM customer""",
)
def indentation_strip(spark, sf_dir):
    raw = F.concat(F.lit("##INDENT##&nbsp;&nbsp;"), "c_name", F.lit("&nbsp;&nbsp;x | &nbsp;"), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", t.without_indentation(raw).alias("flat"))


@query(
    "link_joiners",
    r"""
    WITH s AS (SELECT c_custkey, ['see (', 'Item', 'a-', 'note'][(c_custkey % 4)::INTEGER + 1] AS a, [', b', 'c', '1A', '.'][((c_custkey // 4) % 4)::INTEGER + 1] AS b FROM customer)
    SELECT c_custkey, a || CASE WHEN regexp_matches(a, '[\s(\[/-]$') OR regexp_matches(b, '^[\s)\],.;:!?/-]') THEN '' ELSE ' ' END || b AS joined FROM s""",
)
def link_joiners(spark, sf_dir):
    a = F.get(F.array(*map(F.lit, ["see (", "Item", "a-", "note"])), (F.col("c_custkey") % 4).cast("int"))
    b = F.get(F.array(*map(F.lit, [", b", "c", "1A", "."])), (F.floor(F.col("c_custkey") / 4) % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(a, t.link_joiner(a, b), b).alias("joined"))
