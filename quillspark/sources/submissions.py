"""Submission files: reading them, splitting them into documents, and routing these.

A submission is a header and blocks between <DOCUMENT> tags. All of it is expressions over the file's text: a
scan projects what a query needs, and an exploded block is filtered by type before anything looks into it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import text as t

#: Submission types of the paper era whose header is all there is.
PAPER_FORMS = ("MSDW", "MSD", "MSDCO")


def read_submissions(spark: SparkSession, path: str, glob: str = "*.{txt,htm,html}") -> DataFrame:
    """(path, length, body): decoded by ``decoded``. Files are read whole, one a row; a filter on the path prunes files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", decoded(F.col("content")).alias("body"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, else Latin-1 with the control codes as the characters that Windows-1252 has there."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(t.control_codes_to_characters(F.decode(content, "ISO-8859-1")))


def stream_submissions(spark: SparkSession, path: str, glob: str = "*.txt", files_per_batch: int = 1_000) -> DataFrame:
    """The same rows as they arrive, with the time of the file, for Structured Streaming."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select("path", F.col("modificationTime").alias("ts"), "length", decoded(F.col("content")).alias("body"))


def between(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1)


def header_of(body: Column) -> Column:
    """What the SEC or IMS header holds, '' without one."""
    return F.regexp_extract(body, r"(?is)<(?:SEC|IMS)-HEADER>(.*?)</(?:SEC|IMS)-HEADER>", 1)


def submission_type(body: Column) -> Column:
    said = F.regexp_extract(body, r"(?i)CONFORMED SUBMISSION TYPE:\s*(\S+)", 1)
    return F.upper(F.when(said != "", said).otherwise(F.regexp_extract(body, r"(?i)<TYPE>\s*([^\s<]+)", 1)))


def blocks_of(body: Column) -> Column:
    """The contents of all document blocks; one that isn't closed is none."""
    return F.regexp_extract_all(body, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))


def first_block(body: Column) -> Column:
    return F.regexp_extract(body, r"(?is)<DOCUMENT>(.*?)</DOCUMENT>", 1)


def contains_ignoring_case(body: Column, needle: str) -> Column:
    return F.contains(F.lower(body), F.lit(needle.lower()))


def block_type(block: Column) -> Column:
    return F.upper(F.regexp_extract(block, r"(?i)<TYPE>\s*([^\s<]+)", 1))


def block_description(block: Column) -> Column:
    return F.trim(F.regexp_extract(block, r"(?i)<DESCRIPTION>\s*([^<\n]*)", 1))


def block_content(block: Column) -> Column:
    """The text of a block, its description if that is empty."""
    text = F.when(block.rlike(r"(?is)<TEXT>.*?</TEXT>"), between(block, "TEXT")).otherwise(block)
    return F.when(F.regexp_replace(text, r"\s", "") == "", block_description(block)).otherwise(text)


def split_documents(submissions: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, form, seq, doc_type, description, content): a row for each block; content falls back to the description if empty."""
    d = submissions.select(F.col(key), submission_type(F.col(body)).alias("form"), F.posexplode(blocks_of(F.col(body))).alias("seq", "block"))
    b = F.col("block")
    return d.select(key, "form", "seq", block_type(b).alias("doc_type"), block_description(b).alias("description"), block_content(b).alias("content"))


def readable(documents: DataFrame) -> DataFrame:
    """Without types that hold no text; the filter is on the type alone and stands below whatever reads the content."""
    return documents.where(~t.is_skipped_type(F.col("doc_type")))


def xml_blobs(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?is)<XML>(.*?)</XML>"), F.lit(1))


def without_xml(content: Column) -> Column:
    return F.regexp_replace(content, r"(?is)<XML>.*?</XML>", "")


def route(content: Column, doc_type: Column, form: Column) -> Column:
    """How a document is to be read."""
    xml = content.rlike(r"(?is)<XML>.*?</XML>")
    return (
        F.when((form.startswith("ADV") | form.isin(*PAPER_FORMS)) & contains_ignoring_case(content, "<PAPER>"), "paper")
        .when(contains_ignoring_case(content, "<PDF>"), "pdf")
        .when(xml, "xml")
        .when(form.startswith("13F-") & ~t.is_html(content), "13f_text")
        .when(doc_type.startswith("NSAR-B") & ~t.is_html(content), "nsar")
        .when(t.is_html(content), "html")
        .otherwise("text")
    )


def pre_blocks(content: Column) -> Column:
    """Preformatted blocks, in order."""
    return F.regexp_extract_all(content, F.lit(r"(?is)<pre\b[^>]*>(.*?)</pre>"), F.lit(1))


def plaintext_block(text: Column) -> Column:
    """Plain text as a fenced block, without mail wrappers, with runs of empty lines made one."""
    inner = F.regexp_extract(text, r"(?s)-----BEGIN PRIVACY-ENHANCED MESSAGE-----(.*?)-----END PRIVACY-ENHANCED MESSAGE-----", 1)
    bare = F.when(inner != "", F.regexp_replace(F.regexp_replace(inner, r"(?s)<IMS-HEADER>.*?</IMS-HEADER>", ""), r"(?s)<IMS-DOCUMENT>.*?\n|</IMS-DOCUMENT>", "")).otherwise(
        F.regexp_replace(text, r"(?s)<IMS-HEADER>.*?</IMS-HEADER>|<IMS-DOCUMENT>.*?</IMS-DOCUMENT>", "")
    )
    return F.concat(F.lit("\n```\n"), F.replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), F.lit("</TEXT>"), F.lit("")), F.lit("\n```\n"))


# -- headers -----------------------------------------------------------------------------------------------


def header_fields(header: Column) -> Column:
    """The header's lines as array of (kind, key, value): field, nested field, nested group, section. An indented line without a colon is a section."""
    lines = F.filter(F.split(F.replace(header, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: (F.trim(F.regexp_replace(x, r"\s", "")) != "") & ~F.trim(F.regexp_replace(x, r"^\s+", "")).startswith("<"))

    def field(x: Column) -> Column:
        key, value = F.trim(F.regexp_replace(F.substring_index(x, ":", 1), r"^\s+|\s+$", "")), F.regexp_replace(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
        nested, colon = x.rlike(r"^(\t| {4})"), F.contains(x, F.lit(":"))
        kind = F.when(~colon, "section").when(nested & (value == ""), "group").when(nested, "nested").otherwise("field")
        return F.struct(kind.alias("kind"), key.alias("key"), F.when(colon, value).otherwise(F.lit("")).alias("value"))

    return F.transform(lines, field)


def header_markdown(header: Column) -> Column:
    def shown(f: Column) -> Column:
        k, v = f["key"], f["value"]
        return (
            F.when(f["kind"] == "field", F.concat(F.lit("**"), k, F.lit("**: "), v, F.lit("\n")))
            .when(f["kind"] == "nested", F.concat(F.lit("- **"), k, F.lit(":** "), v))
            .when(f["kind"] == "group", F.concat(F.lit("\n**"), k, F.lit(":**")))
            .otherwise(F.concat(F.lit("\n### "), F.initcap(k)))
        )

    return F.array_join(F.concat(F.array(F.lit("## Filing Summary")), F.transform(header_fields(header), shown)), "\n")


def series_classes(header: Column) -> Column:
    """array of (series_id, series_name, class_id, class_name, ticker) from the series-and-classes block."""
    one = lambda b, tag: F.coalesce(F.nullif(F.trim(F.regexp_extract(b, rf"(?i)<{tag}>\s*([^\n<]+)", 1)), F.lit("")), F.lit(t.MISSING))
    behind_first = lambda xs: F.filter(xs, lambda _, i: i > 0)
    series = behind_first(F.split(between(header, "SERIES-AND-CLASSES-CONTRACTS-DATA"), r"(?i)<SERIES>", -1))

    def classes(s: Column) -> Column:
        return F.transform(
            behind_first(F.split(s, r"(?i)<CLASS-CONTRACT>", -1)),
            lambda c: F.struct(one(s, "SERIES-ID").alias("series_id"), one(s, "SERIES-NAME").alias("series_name"), one(c, "CLASS-CONTRACT-ID").alias("class_id"), one(c, "CLASS-CONTRACT-NAME").alias("class_name"), one(c, "CLASS-CONTRACT-TICKER-SYMBOL").alias("ticker")),
        )

    return F.flatten(F.transform(series, classes))
