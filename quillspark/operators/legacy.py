"""Text forms from before XML: answer lines of semi-annual fund reports, holdings lists of institutional managers, paper filings.

An answer line is a row: its fixed key says item, part, series and repetition. A free-form holdings list is cut
into records at the CUSIP numbers. All of it is expressions; what spans lines is a window or an array within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.sources.submissions import between, header_of

MISSING = "—"
#: Items of the semi-annual report and their labels.
ITEM_LABELS = {
    "001A": "Registrant Name", "001B": "SEC File Number", "001C": "Telephone Number", "002A": "Street", "002B": "City", "002C": "State", "002D01": "Zip Code",
    "003": "Is Registrant a Small Business Investment Company?", "004": "Is Registrant a Unit Investment Trust?", "005": "Is Registrant a Separate Account?",
    "006": "Is Registrant a Non-diversified Company?", "007A": "Is Registrant a Series Company?", "019A": "Is registrant a series company?", "019B": "Number of series",
    "019C": "Family of investment companies name", "021": "Total Broker Commissions Paid ($000)", "024": "Is registrant a diversified investment company?", "071A": "Total income ($000)",
    "071B": "Total expenses ($000)", "071C": "Net investment income ($000)", "071D": "Net gains or (losses) ($000)", "074F": "Total Investments ($000)", "074N": "Total liabilities ($000)",
    "074T": "Net assets ($000)", "075A": "Number of shares outstanding", "075B": "Net asset value per share", "080C": "Fidelity Bond Coverage Amount ($)", "081A": "Fidelity bond in effect?",
    "081B": "Fidelity bond coverage amount ($000)", "082A": "Were any claims filed under fidelity bond?", "082B": "Amount of claims ($)", "083A": "Any uncollectible advisory fees?",
    "084A": "Any uncollectible underwriting commissions?", "085A": "Has registrant acquired another investment company?", "085B": "Has registrant been acquired by another?",
}
#: Titles of securities that a free-form list can name.
CLASS_TITLES = ("Common Stock", "Common", "ADR", "SPON ADR", "Spon ADR", "Spons ADR", "Preferred", "PRFD", "Convertible", "Convert", "Convert Bond", "ConvertBond", "Debenture", "Notes")
#: Titles of paper filings.
PAPER_TITLES = {
    "ADV": "FORM ADV: Uniform Application for Investment Adviser Registration", "ADV/A": "FORM ADV/A: Amendment to Form ADV", "ADV-E": "FORM ADV-E: Certificate of Accounting of Client Securities and Funds",
    "ADV-H-T": "FORM ADV-H-T: Application for a Temporary Hardship Exemption", "ADV-H-C": "FORM ADV-H-C: Application for a Continuing Hardship Exemption",
    "ADV-NR": "FORM ADV-NR: Appointment of Agent for Service of Process by Non-Resident Adviser", "ADVW": "FORM ADVW: Notice of Withdrawal from Registration as Investment Adviser",
    "ADVCO": "FORM ADVCO: Correction to an ADV Filing", "MSDW": "FORM MSDW: Notice of Withdrawal from Registration as a Municipal Securities Dealer",
}
PAPER_SECTIONS = ("FILER", "COMPANY DATA", "FILING VALUES", "BUSINESS ADDRESS", "MAIL ADDRESS", "FORMER COMPANY")


def _lookup(values: dict[str, str], key: Column) -> Column:
    """A small table of fixed values as a map literal."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


# -- answer lines ------------------------------------------------------------------------------------------


def answer_value(label: Column, value: Column) -> Column:
    """An answer for reading, by what its label asks for."""
    clean = F.replace(F.trim(value), F.lit(","), F.lit(""))
    number = clean.try_cast("decimal(28,6)")
    whole = F.concat(F.lit("$"), number.cast("decimal(28,0)").cast("string"))
    truncated = F.when(number.isNotNull(), F.concat(F.lit("$"), F.regexp_replace(number.cast("string"), r"\..*$", ""))).otherwise(clean)
    area = F.right(clean, F.lit(10))
    return (
        F.when(value.isNull() | F.trim(value).isin("N/A", "", MISSING, "nan") | (clean == ""), MISSING)
        .when(F.contains(label, F.lit("Telephone Number")) & clean.rlike(r"^\d{10,11}$"), F.concat_ws("-", F.substr(area, F.lit(1), F.lit(3)), F.substr(area, F.lit(4), F.lit(3)), F.substr(area, F.lit(7))))
        .when(F.contains(label, F.lit("SEC File Number")) & clean.rlike(r"^811-\d{1,5}$"), F.concat(F.lit("811-"), F.lpad(F.substring_index(clean, "-", -1), 5, "0")))
        .when(F.contains(label, F.lit("Net asset value per share")), F.when(number.isNotNull(), F.concat(F.lit("$"), F.replace(F.format_number(number, 2), F.lit(","), F.lit("")))).otherwise(clean))
        .when(F.contains(label, F.lit("($000)")) | F.contains(label, F.lit("($)")), F.when(whole.isNotNull(), truncated).otherwise(clean))
        .when(F.upper(clean).isin("Y", "X"), "Yes")
        .when(F.upper(clean) == "N", "No")
        .when(number.isNotNull() & clean.rlike(r"^-?[\d.]+$"), F.regexp_replace(number.cast("string"), r"\..*$", ""))
        .otherwise(F.trim(value))
    )


def answer_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, item, part, series, rep, value): a row for every line whose key is well-formed; sections and page marks are none."""
    line = F.col("line")
    d = df.select(key, F.posexplode(F.split(F.col(text), r"\r?\n", -1)).alias("pos", "line"))
    d = d.where(line.rlike(r"^\d{3}[A-Z ]{2}\d{6}\s+\S?.*$"))
    at = lambda begin, n: F.substr(line, F.lit(begin), F.lit(n))
    sub = at(6, 2)
    part = F.concat(F.trim(at(4, 2)), F.when(sub == "00", "").otherwise(sub))
    return d.select(key, "pos", at(1, 3).alias("item"), part.alias("part"), at(8, 2).alias("series"), at(10, 2).cast("int").alias("rep"), F.nullif(F.trim(F.substr(line, F.lit(12))), F.lit("")).alias("value"))


def labelled_answers(lines: DataFrame, key: str) -> DataFrame:
    """(key, series, rep, item, part, label, shown): answers that have a label, by their item and part or by their item alone, in the order of series, item, repetition and part."""
    code = F.concat("item", "part")
    label = F.coalesce(_lookup(ITEM_LABELS, code), F.when(F.col("part") == "", _lookup(ITEM_LABELS, F.col("item"))))
    d = lines.withColumn("label", label).where(F.col("label").isNotNull())
    return d.select(key, "series", "rep", "item", "part", "label", answer_value(F.col("label"), F.col("value")).alias("shown"))


def report_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): a report's labelled answers, the registrant's first, then each series under its heading: one exchange, by report."""
    d = labelled_answers(answer_lines(df, key, text), key)
    line = F.struct("series", "item", "rep", "part", F.concat(F.lit("**"), "label", F.lit("**: "), "shown").alias("line"))
    every = F.array_sort(F.collect_list(line))

    def heading(x: Column, i: Column, xs: Column) -> Column:
        first = (i == 0) | (F.get(xs, i - 1)["series"] != x["series"])
        title = F.when(x["series"] == "00", "### General Information").otherwise(F.concat(F.lit("### Series "), x["series"]))
        return F.when(first, F.concat(title, F.lit("\n\n"), x["line"])).otherwise(x["line"])

    shown = F.transform(F.col("xs"), lambda x, i: heading(x, i, F.col("xs")))
    return d.groupBy(key).agg(every.alias("xs")).select(key, F.concat(F.lit("## Form NSAR-B: Semi-Annual Report for Registered Investment Companies\n\n"), F.array_join(shown, "\n\n")).alias("text"))


# -- holdings lists ----------------------------------------------------------------------------------------


def holdings_layout(text: Column) -> Column:
    """fixed for ruled or unmarked lists, free for those whose marks are spread over the line."""
    ruled = F.contains(text, F.lit("-" * 16)) & F.contains(text, F.lit("NAME OF ISSUER"))
    return F.when(ruled | ~F.contains(text, F.lit("x x")), "fixed").otherwise("free")


def class_title(text: Column) -> Column:
    """Of the titles that a text names the one that comes last; Common if it names none. Of titles that begin at one place the first listed counts."""
    up = F.upper(text)
    last = lambda t: F.length(up) - F.length(F.substring_index(up, t.upper(), -1)) - len(t)
    found = F.filter(F.array(*[F.struct(F.when(F.contains(up, F.lit(t.upper())), last(t)).alias("at"), F.lit(-i).alias("order"), F.lit(t).alias("title")) for i, t in enumerate(CLASS_TITLES)]), lambda x: x["at"].isNotNull())
    return F.coalesce(F.array_max(found)["title"], F.lit("Common"))


def free_holdings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, cusip, issuer, title, value, shares, kind, discretion, sole): a row a record; a record goes from one CUSIP to the next."""
    table = F.element_at(F.split(F.col(text), "(?i)Form 13F Information Table", 2), 2)
    blob = F.trim(F.regexp_replace(F.regexp_replace(table, "(?i)</?TABLE>|</?C>", " "), r"\s+", " "))
    blob = F.regexp_replace(blob, r"(\d),\s+(\d{3})", "$1,$2")
    cusip = r"\b[0-9A-Za-z]{8}[0-9]\b"
    records = F.regexp_extract_all(blob, F.lit(rf"{cusip}.*?(?={cusip}|$)"), F.lit(0))
    d = df.where(F.contains(F.lower(F.col(text)), F.lit("form 13f information table"))).select(key, F.posexplode(records).alias("seq", "rec"))
    rest = F.trim(F.substr("rec", F.lit(10)))
    numbers = F.regexp_extract_all(rest, F.lit(r"\d{1,3}(?:,\d{3})*"), F.lit(0))
    d = d.withColumns({"rest": rest, "n": numbers, "marks": F.regexp_count("rec", F.lit(r"(?i)\bx\b"))})
    named = F.trim(F.when(F.size("n") > 0, F.call_function("substring_index", F.col("rest"), F.get("n", F.lit(0)), F.lit(1))).otherwise(F.regexp_replace("rest", r"(?i) x.*$", "")))
    d = d.withColumn("named", named).withColumn("title", class_title(F.col("named")))
    without = F.when(F.endswith(F.upper("named"), F.upper("title")), F.trim(F.substr("named", F.lit(1), F.length("named") - F.length("title")))).otherwise(F.col("named"))
    issuer = F.regexp_replace(F.trim(F.regexp_replace(without, r"(?i)\bSpons?\b\s*A(?:DR)?\b$", "")), r"\s{2,}", " ")
    cased = F.array_join(F.transform(F.split(issuer, " "), lambda w: F.when((w == F.upper(w)) & (F.length(w) > 1), w).otherwise(F.initcap(w))), " ")
    number = lambda i: F.nullif(F.coalesce(F.replace(F.get("n", F.lit(i)), F.lit(","), F.lit("")).cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    loan = F.upper("title").rlike("CONVERT|DEBENT|NOTES")
    return d.select(
        key, "seq", F.upper(F.substr("rec", F.lit(1), F.lit(9))).alias("cusip"), F.coalesce(F.nullif(cased, F.lit("")), F.lit(MISSING)).alias("issuer"), F.when(F.upper("title").contains("CONVERT"), "ConvertBond").otherwise(F.col("title")).alias("title"),
        number(0).alias("value"), number(1).alias("shares"), F.when(loan, "PRN").otherwise("SH").alias("kind"), F.when(F.col("marks") > 0, "SOLE").otherwise(MISSING).alias("discretion"), F.when(F.col("marks") > 0, number(1)).alias("sole"),
    )


# -- paper filings -----------------------------------------------------------------------------------------


def paper_markdown(body: Column, form: Column) -> Column:
    """A paper filing: its title, the header's sections and fields, and the document's text as a quotation."""
    lines = F.filter(F.transform(F.split(header_of(body), r"\r?\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def say(x: Column) -> Column:
        name, key, value = F.regexp_replace(x, ":+$", ""), F.regexp_replace(F.substring_index(x, ":", 1), r"\s+$", ""), F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1)
        return F.when(x.endswith(":"), F.when(name.isin(*PAPER_SECTIONS), F.concat(F.lit("\n### "), F.initcap(name)))).when((key != "") & (value != ""), F.concat(F.lit("**"), key, F.lit(":** "), value))

    said = F.filter(F.transform(lines, say), lambda x: x.isNotNull())
    quoted = F.transform(F.filter(F.transform(F.split(between(between(body, "DOCUMENT"), "TEXT"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), lambda x: F.concat(F.lit("> "), x))
    title = F.coalesce(_lookup(PAPER_TITLES, form), F.concat(F.lit("Form "), form))
    head = F.concat(F.lit("### UNITED STATES SECURITIES AND EXCHANGE COMMISSION\n**Washington, D.C. 20549**\n\n## "), title, F.lit("\n"))
    none = F.when(header_of(body) == "", F.concat(F.lit("<!-- HEADER for "), form, F.lit(" not found -->")))
    note = F.when(F.size(quoted) > 0, F.concat(F.lit("\n### Document Note\n"), F.array_join(quoted, "\n")))
    return F.concat_ws("\n", head, none, F.when(F.size(said) > 0, F.array_join(said, "\n")), note)
