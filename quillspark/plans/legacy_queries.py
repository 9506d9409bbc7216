"""Queries over text forms from before XML, made of the tables."""

from pyspark.sql import functions as F

from quillspark.operators import legacy as lg
from quillspark.plans.registry import query, table


def _reports(spark, sf_dir):
    """A semi-annual report a supplier."""
    key, balance = F.col("s_suppkey").cast("string"), F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("<PAGE>      PAGE  1\n000 B000000 06/30/1999\n001 A000000 "), "s_name", F.lit("\n001 B000000 811-"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit("\n001 C000000 2125550"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"),
        F.lit("\n003  000000 N\n007 A000000 Y\n071 A000100 1,"), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.lit("\n075 B000100 12.5\nnot a line\n074 T000200 n.a.\n008 A000001 An adviser\nSIGNATURE x"),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace(text, r"(?m)^(\d{3}) ([A-Z ])(?=\d{6})", "$1$2 ").alias("text"))


ANSWERS_SQL = """a AS (SELECT s_suppkey, unnest(['00', '00', '00', '00', '00', '01', '01', '02']) AS series, unnest(['001', '001', '001', '003', '007', '071', '075', '074']) AS item, unnest(['A', 'B', 'C', '', 'A', 'A', 'B', 'T']) AS part,
    unnest(['Registrant Name', 'SEC File Number', 'Telephone Number', 'Is Registrant a Small Business Investment Company?', 'Is Registrant a Series Company?', 'Total income ($000)', 'Net asset value per share', 'Net assets ($000)']) AS label,
    unnest([s_name, '811-00' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), '212-555-0' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), 'No', 'Yes', '$1' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0'), '$12.50', 'n.a.']) AS shown FROM supplier)"""


@query("fund_report_answers", f"WITH {ANSWERS_SQL} SELECT s_suppkey, series, 0 AS rep, item, part, label, shown FROM a")
def fund_report_answers(spark, sf_dir):
    return lg.labelled_answers(lg.answer_lines(_reports(spark, sf_dir), "s_suppkey", "text"), "s_suppkey")


@query(
    "fund_report_markdown",
    f"""WITH {ANSWERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey, series ORDER BY item, part) AS k FROM a)
    SELECT s_suppkey, '## Form NSAR-B: Semi-Annual Report for Registered Investment Companies' || chr(10) || chr(10) || string_agg(CASE WHEN k = 1 THEN CASE WHEN series = '00' THEN '### General Information' ELSE '### Series ' || series END || chr(10) || chr(10) ELSE '' END
        || '**' || label || '**: ' || shown, chr(10) || chr(10) ORDER BY series, item, part) AS text FROM n GROUP BY s_suppkey""",
)
def fund_report_markdown(spark, sf_dir):
    return lg.report_markdown(_reports(spark, sf_dir), "s_suppkey", "text")


@query(
    "free_holdings",
    """SELECT s_suppkey, unnest([0, 1, 2]) AS seq, unnest([lpad(s_suppkey::VARCHAR, 9, '0'), '12345678A9'[1:8] || '9', 'ABCDEFGH1']) AS cusip, unnest(['ACME Industries', 'Beta', 'Gamma Spon']) AS issuer, unnest(['Common Stock', 'ConvertBond', 'ADR']) AS title,
        unnest([1234, 5, NULL])::BIGINT AS value, unnest([99, 7000, NULL])::BIGINT AS shares, unnest(['SH', 'PRN', 'SH']) AS kind, unnest(['SOLE', '—', 'SOLE']) AS discretion, unnest([99, NULL, NULL])::BIGINT AS sole FROM supplier""",
)
def free_holdings(spark, sf_dir):
    text = F.concat(F.lit("COVER PAGE\nForm 13F Information Table <TABLE>\n"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(" ACME industries Common Stock 1, 234 99 x x\n123456789 beta Convert 5 7,000\nabcdefgh1 gamma Spon ADR x x"))
    return lg.free_holdings(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query("holdings_layout", "SELECT s_suppkey, ['fixed', 'free', 'fixed'][s_suppkey % 3 + 1] AS layout FROM supplier")
def holdings_layout(spark, sf_dir):
    text = F.get(F.array(F.lit("a list"), F.lit("NAME OF ISSUER a x x"), F.lit(f"NAME OF ISSUER\n{'-' * 20}\na x x")), (F.col("s_suppkey") % 3).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", lg.holdings_layout(text).alias("layout"))


@query(
    "paper_filings",
    """SELECT s_suppkey, '### UNITED STATES SECURITIES AND EXCHANGE COMMISSION' || chr(10) || '**Washington, D.C. 20549**' || chr(10) || chr(10) || '## ' || CASE WHEN s_suppkey % 2 = 0 THEN 'FORM ADV-E: Certificate of Accounting of Client Securities and Funds' ELSE 'Form MSD' END
        || chr(10) || chr(10) || '**ACCESSION NUMBER:** ' || s_suppkey || chr(10) || chr(10) || '### Company Data' || chr(10) || '**CONFORMED NAME:** ' || s_name || chr(10) || chr(10) || '### Document Note' || chr(10) || '> This is paper.' || chr(10) || '> Ask for it.' AS text FROM supplier""",
)
def paper_filings(spark, sf_dir):
    body = F.concat(F.lit("<SEC-HEADER>\nACCESSION NUMBER:\t"), F.col("s_suppkey").cast("string"), F.lit("\nODD SECTION:\n\tCOMPANY DATA:\n\t\tCONFORMED NAME:\t\t"), "s_name", F.lit("\n\t\tEMPTY:   \n</SEC-HEADER>\n<DOCUMENT><TEXT>\n <PAPER>\n  This is paper.\n\n Ask for it.\n</TEXT></DOCUMENT>"))
    form = F.when(F.col("s_suppkey") % 2 == 0, "ADV-E").otherwise("MSD")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.replace(lg.paper_markdown(body, form), F.lit("> <PAPER>\n"), F.lit("")).alias("text"))
