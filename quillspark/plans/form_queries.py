"""Queries over XML made of the tables, attachments and whole conversions."""

from pyspark.sql import functions as F

from quillspark.operators import convert as cv, ocr, xml_forms as xf
from quillspark.plans.registry import query, table
from quillspark.plans.submission_queries import _submissions


def _holdings(spark, sf_dir):
    """A holdings file an order: a line is an investment; names carry an ampersand and a name space."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("bigint").alias("q"))
    one = F.concat(F.lit("<n1:invstOrSec><n1:name>Part & Co "), F.col("p").cast("string"), F.lit("</n1:name><n1:balance>"), F.col("q").cast("string"), F.lit("</n1:balance><n1:isLong>Y</n1:isLong></n1:invstOrSec>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("x")))), lambda s: s["x"]), "")
    return li.groupBy("l_orderkey").agg(F.concat(F.lit('<filedForm xmlns:n1="urn:x"><n1:filedDate>2024-03-09</n1:filedDate>'), rows, F.lit("</filedForm>")).alias("xml")).withColumn("form", F.lit("NPORT-P"))


LI_SQL = "li AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_quantity)::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("xml_holdings", f"WITH {LI_SQL} SELECT l_orderkey, seq::INTEGER AS seq, 'Part & Co ' || p AS name, q AS balance, 'Y' AS isLong FROM li")
def xml_holdings(spark, sf_dir):
    d = _holdings(spark, sf_dir).withColumn("xml", xf.repaired(F.col("xml")))
    return xf.records(d, "l_orderkey", "xml", "invstOrSec", "name string, balance bigint, isLong string")


@query(
    "xml_leaves",
    f"""WITH {LI_SQL}, u AS (SELECT DISTINCT l_orderkey AS key, '/filedForm/filedDate' AS path, 0 AS ordinal, 'filedDate' AS tag, '2024-03-09' AS value FROM li UNION ALL SELECT l_orderkey, '/filedForm/invstOrSec/name', seq, 'name', 'Part & Co ' || p FROM li
        UNION ALL SELECT l_orderkey, '/filedForm/invstOrSec/balance', seq, 'balance', q::VARCHAR FROM li UNION ALL SELECT l_orderkey, '/filedForm/invstOrSec/isLong', seq, 'isLong', 'Y' FROM li) SELECT key, path, ordinal::INTEGER AS ordinal, tag, value FROM u""",
)
def xml_leaves(spark, sf_dir):
    return xf.xml_leaves(_holdings(spark, sf_dir), "l_orderkey", "xml")


@query(
    "xml_markdown",
    f"""WITH {LI_SQL} SELECT l_orderkey, 'filedForm' AS root, 'Form N-PORT' AS title, NULL::VARCHAR AS error, CASE WHEN count(*) > 1 THEN '## Form N-PORT' || chr(10) || chr(10) || '- **Filed Date:** March 9, 2024' || chr(10) || chr(10) || '### Invst Or Sec' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || '| Name | Balance | Is Long |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| Part & Co ' || p || ' | ' || q || ' | Yes |', chr(10) ORDER BY seq) || chr(10) || chr(10) || '---'
        ELSE '## Form N-PORT' || chr(10) || chr(10) || '- **Filed Date:** March 9, 2024' || chr(10) || chr(10) || '### Invst Or Sec' || chr(10) || chr(10) || '- **Name:** Part & Co ' || max(p) || chr(10) || '- **Balance:** ' || max(q) || chr(10) || '- **Is Long:** Yes' END AS text FROM li GROUP BY l_orderkey""",
)
def xml_markdown(spark, sf_dir):
    return xf.parse_xml(_holdings(spark, sf_dir), "l_orderkey", "xml", "form")


@query(
    "xml_footnotes",
    """WITH s AS (SELECT o_orderkey, ['F1', 'F2', 'F3'] AS ids, o_orderkey % 4 AS k FROM orders)
       SELECT o_orderkey, CASE k WHEN 0 THEN 'v' WHEN 1 THEN 'v<sup>(2)</sup>' WHEN 2 THEN 'v<sup>(3)(1)</sup>' ELSE 'v<sup>(1)</sup>' END AS shown FROM s""",
)
def xml_footnotes(spark, sf_dir):
    ids = F.get(F.array(F.array().cast("array<string>"), F.array(F.lit("F2")), F.array(F.lit("F3"), F.lit("F1")), F.array(F.lit("F9"), F.lit("F1"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", xf.footnotes(F.lit("v"), ids, F.array(F.lit("F1"), F.lit("F2"), F.lit("F3"))).alias("shown"))


TYPES = ("3", "4/A", "NPORT-P", "13F-HR", "D/A", "C-U", "CFPORTAL", "MA-I/A", "SCHEDULE 13G/A", "144", "ZZZ")


@query(
    "form_dispatch",
    """SELECT k AS form, t AS title, count(*)::BIGINT AS n FROM (SELECT (doc_id % 11)::INTEGER + 1 AS i FROM documents) d,
       (SELECT unnest(['3', '4/A', 'NPORT-P', '13F-HR', 'D/A', 'C-U', 'CFPORTAL', 'MA-I/A', 'SCHEDULE 13G/A', '144', 'ZZZ']) AS k, unnest(['Form 3: Initial Statement of Beneficial Ownership', 'Form 4/5: Changes in Beneficial Ownership', 'Form N-PORT', 'Form 13F', 'Form D', 'Form C',
        'Form CFPORTAL', 'Form MA-I', 'Schedule 13G', 'Form 144', NULL]) AS t, unnest(range(1, 12)) AS j) m WHERE d.i = m.j GROUP BY ALL""",
)
def form_dispatch(spark, sf_dir):
    form = F.get(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 11).cast("int"))
    root = F.when(form.isin("3", "4/A"), "ownershipDocument").otherwise("filedForm")
    return table(spark, sf_dir, "documents").select(form.alias("form"), xf.form_title(root, form).alias("title")).groupBy("form", "title").agg(F.count("*").alias("n"))


@query("attachment_bytes", "SELECT c_custkey, 'a.bin' AS name, md5(c_name) AS digest FROM customer")
def attachment_bytes(spark, sf_dir):
    import pandas as pd

    @F.pandas_udf("string")
    def pack(names: pd.Series) -> pd.Series:
        import binascii

        return names.map(lambda n: "x\nbegin 644 a.bin\n" + "".join(binascii.b2a_uu(n.encode()[i : i + 45]).decode() for i in range(0, len(n), 45)) + "`\nend\n")

    d = table(spark, sf_dir, "customer").select("c_custkey", pack("c_name").alias("t"))
    return ocr.decode_attachments(d, "c_custkey", "t").select("c_custkey", "name", F.md5("data").alias("digest"))


@query("ocr_skip_placeholder", f"SELECT c_custkey, 1 AS page_no, '{ocr.SKIPPED}' AS content FROM customer")
def ocr_skip_placeholder(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.lit("a.pdf").alias("name"), F.col("c_name").cast("binary").alias("data"))
    return ocr.read_pages(d, "c_custkey")


@query(
    "service_key_states",
    "SELECT l_orderkey, l_linenumber, ['ok', 'invalid', 'exhausted', 'cooldown', 'cooldown', 'exhausted'][((l_orderkey + l_linenumber) % 6)::INTEGER + 1] AS state FROM lineitem",
)
def service_key_states(spark, sf_dir):
    i = ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int")
    status = F.get(F.array(*map(F.lit, (200, 401, 402, 429, 503, 429))), i)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ocr.key_state(status, F.when(i == 5, "monthly limit reached")).alias("state"))


@query("convert_submissions")
def convert_submissions(spark, sf_dir):
    return cv.convert(_submissions(spark, sf_dir))


@query("part_statistics")
def part_statistics(spark, sf_dir):
    return cv.part_statistics(_submissions(spark, sf_dir))
