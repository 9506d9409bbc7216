"""Queries over submissions that are put together from the tables, so that their SQL twins can build the same bytes."""

from pyspark.sql import functions as F

from quillspark.operators import lines as ln
from quillspark.plans.registry import query, table
from quillspark.sources import submissions as sub

# Every submission: a header, a block with the document's text, one of a type to skip, one with XML, one with a PDF.
KINDS = ("10-K", "8-K", "NPORT-P", "SC 13G")


def _submissions(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    form = F.get(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4).cast("int"))
    head = F.concat(F.lit("<SEC-HEADER>\nACCESSION NUMBER:\t"), i, F.lit("\nCONFORMED SUBMISSION TYPE:\t"), form, F.lit("\nFILER:\n\tCOMPANY DATA:\n\t\tCONFORMED NAME:\t"), "source", F.lit("\nSIGNED\n</SEC-HEADER>\n"))
    body = F.concat(
        head, F.lit("<DOCUMENT>\n<TYPE>"), form, F.lit("\n<DESCRIPTION>main text\n<TEXT>"), "text", F.lit("</TEXT>\n</DOCUMENT>\n<document>\n<TYPE>GRAPHIC\n<TEXT>begin 644\n</TEXT></document>\n"),
        F.lit("<DOCUMENT>\n<TYPE>EX-99.1\n<DESCRIPTION>data\n<TEXT>a<XML><n>"), i, F.lit("</n></XML>b<xml><m/></xml></TEXT></DOCUMENT><DOCUMENT><TYPE>EX-10.2\n<DESCRIPTION>empty one\n<TEXT> \n</TEXT></DOCUMENT>"),
        F.lit("<DOCUMENT><TYPE>EX-98\n<TEXT><PDF>x</PDF></TEXT></DOCUMENT><DOCUMENT>never closed"),
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), body.alias("body"))


BODY_SQL = """
    s AS (SELECT doc_id AS path, text, source, ['10-K', '8-K', 'NPORT-P', 'SC 13G'][(doc_id % 4)::INTEGER + 1] AS k FROM documents),
    sub AS (SELECT path, '<SEC-HEADER>' || chr(10) || 'ACCESSION NUMBER:' || chr(9) || path || chr(10) || 'CONFORMED SUBMISSION TYPE:' || chr(9) || k || chr(10) || 'FILER:' || chr(10) || chr(9) || 'COMPANY DATA:' || chr(10)
        || chr(9) || chr(9) || 'CONFORMED NAME:' || chr(9) || source || chr(10) || 'SIGNED' || chr(10) || '</SEC-HEADER>' || chr(10) || '<DOCUMENT>' || chr(10) || '<TYPE>' || k || chr(10) || '<DESCRIPTION>main text' || chr(10)
        || '<TEXT>' || text || '</TEXT>' || chr(10) || '</DOCUMENT>' || chr(10) || '<document>' || chr(10) || '<TYPE>GRAPHIC' || chr(10) || '<TEXT>begin 644' || chr(10) || '</TEXT></document>' || chr(10)
        || '<DOCUMENT>' || chr(10) || '<TYPE>EX-99.1' || chr(10) || '<DESCRIPTION>data' || chr(10) || '<TEXT>a<XML><n>' || path || '</n></XML>b<xml><m/></xml></TEXT></DOCUMENT><DOCUMENT><TYPE>EX-10.2' || chr(10)
        || '<DESCRIPTION>empty one' || chr(10) || '<TEXT> ' || chr(10) || '</TEXT></DOCUMENT><DOCUMENT><TYPE>EX-98' || chr(10) || '<TEXT><PDF>x</PDF></TEXT></DOCUMENT><DOCUMENT>never closed' AS body FROM s),
    b AS (SELECT path, upper(regexp_extract(body, '(?i)CONFORMED SUBMISSION TYPE:\\s*(\\S+)', 1)) AS form, unnest(regexp_extract_all(body, '(?is)<DOCUMENT>(.*?)</DOCUMENT>', 1)) AS block,
                 generate_subscripts(regexp_extract_all(body, '(?is)<DOCUMENT>(.*?)</DOCUMENT>', 1), 1) - 1 AS seq FROM sub),
    x AS (SELECT path, form, seq::INTEGER AS seq, upper(regexp_extract(block, '(?i)<TYPE>\\s*([^\\s<]+)', 1)) AS doc_type, trim(regexp_extract(block, '(?i)<DESCRIPTION>\\s*([^<\\n]*)', 1)) AS description,
                 regexp_extract(block, '(?is)<TEXT>(.*?)</TEXT>', 1) AS t FROM b),
    d AS (SELECT path, form, seq, doc_type, description, CASE WHEN regexp_replace(t, '\\s', '', 'g') = '' THEN description ELSE t END AS content FROM x)"""


@query("submission_blocks", f"WITH {BODY_SQL} SELECT path, form, seq, doc_type, description, md5(content) AS content FROM d")
def submission_blocks(spark, sf_dir):
    return sub.split_documents(_submissions(spark, sf_dir)).withColumn("content", F.md5("content"))


@query("doc_skip_filter", f"WITH {BODY_SQL} SELECT doc_type, count(*)::BIGINT AS n FROM d WHERE doc_type <> 'GRAPHIC' GROUP BY doc_type")
def doc_skip_filter(spark, sf_dir):
    return sub.readable(sub.split_documents(_submissions(spark, sf_dir))).groupBy("doc_type").agg(F.count("*").alias("n"))


@query(
    "document_routes",
    f"""WITH {BODY_SQL} SELECT path, seq, CASE WHEN contains(lower(content), '<pdf>') THEN 'pdf' WHEN regexp_matches(content, '(?is)<XML>.*?</XML>') THEN 'xml'
        WHEN regexp_matches(content, '(?i)<\\s*(html|div|p)\\b') THEN 'html' ELSE 'text' END AS route FROM d WHERE doc_type <> 'GRAPHIC'""",
)
def document_routes(spark, sf_dir):
    d = sub.readable(sub.split_documents(_submissions(spark, sf_dir)))
    return d.select("path", "seq", sub.route(F.col("content"), F.col("doc_type"), F.col("form")).alias("route"))


@query(
    "xml_blobs",
    f"""WITH {BODY_SQL}, e AS (SELECT * FROM d WHERE doc_type = 'EX-99.1')
        SELECT path, array_to_string(regexp_extract_all(content, '(?is)<XML>(.*?)</XML>', 1), '|') AS blobs, regexp_replace(content, '(?is)<XML>.*?</XML>', '', 'g') AS rest FROM e""",
)
def xml_blobs(spark, sf_dir):
    d = sub.split_documents(_submissions(spark, sf_dir)).where("doc_type = 'EX-99.1'")
    return d.select("path", F.array_join(sub.xml_blobs(F.col("content")), "|").alias("blobs"), sub.without_xml(F.col("content")).alias("rest"))


@query("first_document", f"WITH {BODY_SQL} SELECT path, md5(content) AS content FROM d WHERE seq = 0")
def first_document(spark, sf_dir):
    block = sub.first_block(F.col("body"))
    return _submissions(spark, sf_dir).select("path", F.md5(sub.between(block, "TEXT")).alias("content"))


@query(
    "header_fields",
    """
    WITH s AS (SELECT doc_id AS path, source, ['10-K', '8-K', 'NPORT-P', 'SC 13G'][(doc_id % 4)::INTEGER + 1] AS k FROM documents),
    f AS (SELECT path, 0 AS pos, 'field' AS kind, 'ACCESSION NUMBER' AS key, path::VARCHAR AS value FROM s UNION ALL SELECT path, 1, 'field', 'CONFORMED SUBMISSION TYPE', k FROM s
          UNION ALL SELECT path, 2, 'field', 'FILER', '' FROM s UNION ALL SELECT path, 3, 'group', 'COMPANY DATA', '' FROM s UNION ALL SELECT path, 4, 'nested', 'CONFORMED NAME', source FROM s UNION ALL SELECT path, 5, 'section', 'SIGNED', '' FROM s)
    SELECT path, pos::INTEGER AS pos, kind, key, value FROM f""",
)
def header_fields(spark, sf_dir):
    d = _submissions(spark, sf_dir).select("path", F.posexplode(sub.header_fields(sub.header_of(F.col("body")))).alias("pos", "f"))
    return d.select("path", "pos", "f.*")


@query(
    "header_markdown",
    """
    WITH s AS (SELECT doc_id AS path, source, ['10-K', '8-K', 'NPORT-P', 'SC 13G'][(doc_id % 4)::INTEGER + 1] AS k FROM documents)
    SELECT path, '## Filing Summary' || chr(10) || '**ACCESSION NUMBER**: ' || path || chr(10) || chr(10) || '**CONFORMED SUBMISSION TYPE**: ' || k || chr(10) || chr(10) || '**FILER**: ' || chr(10) || chr(10)
           || chr(10) || '**COMPANY DATA:**' || chr(10) || '- **CONFORMED NAME:** ' || source || chr(10) || chr(10) || '### Signed' AS markdown FROM s""",
)
def header_markdown(spark, sf_dir):
    return _submissions(spark, sf_dir).select("path", sub.header_markdown(sub.header_of(F.col("body"))).alias("markdown"))


@query(
    "class_lookup",
    """
    WITH c AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0)
    SELECT l.l_orderkey, l.l_linenumber, coalesce(c.p_name, 'Unknown Class (' || l.l_partkey || ')') AS class_name, count(*)::BIGINT AS n FROM lineitem l LEFT JOIN c ON c.p_partkey = l.l_partkey GROUP BY ALL""",
)
def class_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    name = F.coalesce("p_name", F.concat(F.lit("Unknown Class ("), F.col("l_partkey").cast("string"), F.lit(")")))
    return table(spark, sf_dir, "lineitem").join(c, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber", name.alias("class_name")).agg(F.count("*").alias("n"))


@query(
    "series_classes",
    """SELECT n_regionkey, 'S' || lpad(n_regionkey::VARCHAR, 3, '0') AS series_id, 'C' || lpad(n_nationkey::VARCHAR, 3, '0') AS class_id, n_name AS class_name, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name[1:3]) ELSE '—' END AS ticker FROM nation""",
)
def series_classes(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ticker = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<CLASS-CONTRACT-TICKER-SYMBOL>"), F.upper(F.substring("n_name", 1, 3)), F.lit("\n"))).otherwise("")
    one = F.concat(F.lit("<CLASS-CONTRACT>\n<CLASS-CONTRACT-ID>C"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit("\n<CLASS-CONTRACT-NAME>"), "n_name", F.lit("\n"), ticker, F.lit("</CLASS-CONTRACT>"))
    classes = F.array_join(F.sort_array(F.collect_list(one)), "\n")
    d = n.groupBy("n_regionkey").agg(classes.alias("c")).select("n_regionkey", F.concat(F.lit("<SERIES-AND-CLASSES-CONTRACTS-DATA><SERIES>\n<SERIES-ID>S"), F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lit("\n"), "c", F.lit("</SERIES></SERIES-AND-CLASSES-CONTRACTS-DATA>")).alias("h"))
    return d.select("n_regionkey", F.explode(sub.series_classes(F.col("h"))).alias("s")).select("n_regionkey", "s.series_id", "s.class_id", "s.class_name", "s.ticker")


@query(
    "plaintext_blocks",
    r"""SELECT doc_id, md5(chr(10) || '```' || chr(10) || replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || chr(10) || 'end', '\n{3,}', chr(10) || chr(10), 'g'), '</TEXT>', '') || chr(10) || '```' || chr(10)) AS block FROM documents""",
)
def plaintext_blocks(spark, sf_dir):
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n-----BEGIN PRIVACY-ENHANCED MESSAGE-----<IMS-HEADER>a\nb</IMS-HEADER>"), "text", F.lit("\n\n\n\nend-----END PRIVACY-ENHANCED MESSAGE-----"))).otherwise(F.concat("text", F.lit("\n\n\n\nend</TEXT>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(sub.plaintext_block(wrapped)).alias("block"))


@query(
    "document_assembly",
    f"WITH {BODY_SQL} SELECT path, md5(string_agg(content, chr(10) || chr(10) ORDER BY seq)) AS digest FROM d WHERE doc_type <> 'GRAPHIC' GROUP BY path",
)
def document_assembly(spark, sf_dir):
    d = sub.readable(sub.split_documents(_submissions(spark, sf_dir)))
    return ln.assemble(d.select("path", "seq", "content"), "path", "seq", "content", "\n\n").select("path", F.md5("text").alias("digest"))
