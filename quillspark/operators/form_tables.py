"""The repeating groups of XML forms as typed rows and as tables with the columns that a form prints.

A table is a line of TABLES: which form, which element repeats, and for every column its heading, the element that it is
read from (a path of names, looked for anywhere below, without name space or case) and how it is shown. All of it
is expressions over the XML text: records are cut out, fields read, lines put together within the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import dollarize, format_bool, format_dollars, format_percent, join_split_numbers
from quillspark.operators.xml_forms import footnotes, once

MISSING = "—"


@dataclass(frozen=True)
class Field:
    """A column: its heading (main and, below it, sub), where its value is, what is done to it. Of several paths the first with a value counts."""

    heading: str
    paths: tuple[str, ...]
    show: str = ""
    sub: str = ""


@dataclass(frozen=True)
class FormTable:
    name: str
    form: str
    root: str
    title: str
    record: str
    fields: tuple[Field, ...]
    missing: str = MISSING
    notes: bool = False


def _f(heading: str, *paths: str, show: str = "", sub: str = "") -> Field:
    return Field(heading, paths, show, sub)


_OWNED = ("postTransactionAmounts/sharesOwnedFollowingTransaction",)
_FORM, _NATURE = "ownershipNature/directOrIndirectOwnership", "ownershipNature/natureOfOwnership"

#: Headings of the printed forms and the elements under them. A form is known by its root element or the beginning of its type.
TABLES = (
    FormTable("initial_holdings", "3", "ownershipdocument", "Table I - Non-Derivative Securities Beneficially Owned", "nonDerivativeHolding|nonDerivativeSecurity", (
        _f("1. Title of Security", "securityTitle"), _f("2. Amount of Securities Beneficially Owned", *_OWNED), _f("3. Ownership Form", _FORM), _f("4. Nature of Indirect Beneficial Ownership", _NATURE),
    ), "", True),
    FormTable("initial_derivatives", "3", "ownershipdocument", "Table II - Derivative Securities Beneficially Owned", "derivativeHolding|derivativeSecurity", (
        _f("1. Title of Derivative Security", "securityTitle"), _f("2. Date Exercisable and Expiration Date (Month/Day/Year)", "exerciseDate", sub="Date Exercisable"),
        _f("2. Date Exercisable and Expiration Date (Month/Day/Year)", "expirationDate", sub="Expiration Date"), _f("3. Title and Amount of Underlying Securities", "underlyingSecurity/underlyingSecurityTitle", sub="Title"),
        _f("3. Title and Amount of Underlying Securities", "underlyingSecurity/underlyingSecurityShares", sub="Amount or Number of Shares"), _f("4. Conversion or Exercise Price", "conversionOrExercisePrice", show="price"),
        _f("5. Ownership Form", _FORM), _f("6. Nature of Indirect Beneficial Ownership", _NATURE),
    ), "", True),
    FormTable("ownership_changes", "", "ownershipdocument", "Table I - Non-Derivative Securities", "nonDerivativeTransaction|nonDerivativeHolding|nonDerivativeSecurity", (
        _f("1. Title of Security", "securityTitle"), _f("2. Transaction Date", "transactionDate"), _f("2A. Deemed Execution Date", "deemedExecutionDate"), _f("3. Transaction Code (V)", "transactionCoding/transactionCode", sub="Code"),
        _f("3. Transaction Code (V)", "transactionCoding/transactionCode", "transactionTimeliness", show="voluntary", sub="V"), _f("4. Securities Acquired (A) or Disposed of (D)", "transactionAmounts/transactionShares", sub="Amount"),
        _f("4. Securities Acquired (A) or Disposed of (D)", "transactionAmounts/transactionAcquiredDisposedCode", sub="(A) or (D)"), _f("4. Securities Acquired (A) or Disposed of (D)", "transactionAmounts/transactionPricePerShare", show="price", sub="Price"),
        _f("5. Amount of Securities Beneficially Owned", *_OWNED), _f("6. Ownership Form", _FORM), _f("7. Nature of Indirect Beneficial Ownership", _NATURE),
    ), "", True),
    FormTable("derivative_changes", "", "ownershipdocument", "Table II - Derivative Securities", "derivativeTransaction|derivativeHolding|derivativeSecurity", (
        _f("1. Title of Derivative Security", "securityTitle"), _f("2. Conversion or Exercise Price", "conversionOrExercisePrice", show="price"), _f("3. Transaction Date", "transactionDate"), _f("3A. Deemed Execution Date", "deemedExecutionDate"),
        _f("4. Transaction Code (V)", "transactionCoding/transactionCode", sub="Code"), _f("4. Transaction Code (V)", "transactionCoding/transactionCode", "transactionTimeliness", show="voluntary", sub="V"),
        _f("5. Number of Derivative Securities Acquired (A) or Disposed of (D)", "transactionAmounts/transactionShares", "transactionAmounts/transactionAcquiredDisposedCode", show="if A", sub="(A)"),
        _f("5. Number of Derivative Securities Acquired (A) or Disposed of (D)", "transactionAmounts/transactionShares", "transactionAmounts/transactionAcquiredDisposedCode", show="if D", sub="(D)"),
        _f("6. Date Exercisable and Expiration Date", "exerciseDate", sub="Date Exercisable"), _f("6. Date Exercisable and Expiration Date", "expirationDate", sub="Expiration Date"),
        _f("7. Title and Amount of Underlying Securities", "underlyingSecurity/underlyingSecurityTitle", sub="Title"), _f("7. Title and Amount of Underlying Securities", "underlyingSecurity/underlyingSecurityShares", sub="Amount or Number of Shares"),
        _f("8. Price of Derivative Security", "derivativeSecurityPrice", "transactionAmounts/transactionPricePerShare", "transactionAmounts/transactionValue", show="price"), _f("9. Number of Derivative Securities Beneficially Owned", *_OWNED),
        _f("10. Ownership Form", _FORM), _f("11. Nature of Indirect Beneficial Ownership", _NATURE),
    ), "", True),
    FormTable("information_table", "13F", "informationtable", "FORM 13F INFORMATION TABLE", "infoTable", (
        _f("NAME OF ISSUER", "nameOfIssuer", show="plain"), _f("TITLE OF CLASS", "titleOfClass", show="plain"), _f("CUSIP", "cusip"), _f("FIGI", "figi"), _f("VALUE (x$1000)", "value", show="count"), _f("SHRS OR PRN AMT", "shrsOrPrnAmt/sshPrnamt", show="count"),
        _f("SH/PRN", "shrsOrPrnAmt/sshPrnamtType"), _f("PUT/CALL", "putCall"), _f("INVESTMENT DISCRETION", "investmentDiscretion"), _f("OTHER MANAGER", "otherManager", show="plain"),
        _f("VOTING AUTHORITY", "votingAuthority/Sole", show="count", sub="SOLE"), _f("VOTING AUTHORITY", "votingAuthority/Shared", show="count", sub="SHARED"), _f("VOTING AUTHORITY", "votingAuthority/None", show="count", sub="NONE"),
    )),
    FormTable("proxy_votes", "N-PX", "", "FORM N-PX PROXY VOTING RECORD", "proxyTable", (
        _f("NAME OF ISSUER", "issuerName"), _f("CUSIP", "cusip"), _f("MEETING DATE", "meetingDate"), _f("VOTE DESCRIPTION", "voteDescription"), _f("VOTE CATEGORY", "categoryType", show="all"), _f("SHARES VOTED", "sharesVoted"),
        _f("SHARES ON LOAN", "sharesOnLoan"), _f("HOW VOTED", "voteRecord/howVoted"), _f("SHARES VOTED FOR OR AGAINST MANAGEMENT", "voteRecord/sharesVoted"), _f("FOR OR AGAINST MANAGEMENT", "voteRecord/managementRecommendation"), _f("OTHER INFO", "voteOtherInfo"),
    ), ""),
    FormTable("acquired_securities", "144", "", "Securities To Be Sold", "securitiesToBeSold", (
        _f("Title of the Class", "securitiesClassTitle"), _f("Date you Acquired", "acquiredDate"), _f("Nature of Acquisition Transaction", "natureOfAcquisitionTransaction"), _f("Name of Person from Whom Acquired", "nameOfPersonfromWhomAcquired"),
        _f("Is this a Gift?", "isGiftTransaction", show="yes or no"), _f("Date Donor Acquired", "donarAcquiredDate"), _f("Amount of Securities Acquired", "amountOfSecuritiesAcquired"), _f("Date of Payment", "paymentDate"), _f("Nature of Payment *", "natureOfPayment"),
    )),
    FormTable("recent_sales", "144", "", "Securities Sold During The Past 3 Months", "securitiesSoldInPast3Months", (
        _f("Name and Address of Seller", "sellerDetails", show="lines"), _f("Title of Securities Sold", "securitiesClassTitle"), _f("Date of Sale", "saleDate"), _f("Amount of Securities Sold", "amountOfSecuritiesSold"), _f("Gross Proceeds", "grossProceeds"),
    )),
    FormTable("loan_assets", "", "assetdata", "Exhibit 102: Asset Data File", "assets", (
        _f("Asset Number", "assetNumber", show="needed"), _f("Originator", "originatorName"), _f("Origination Date", "originationDate"), _f("Original Loan Amount", "originalLoanAmount", show="dollars"), _f("Maturity Date", "maturityDate"),
        _f("Interest Rate (%)", "originalInterestRatePercentage"), _f("Property Name", "property/propertyName"), _f("Property Type", "property/propertyTypeCode"), _f("City", "property/propertyCity"), _f("State", "property/propertyState"),
    )),
    FormTable("portfolio", "NPORT-P", "", "Schedule of Portfolio Investments", "invstOrSec", (
        _f("Name", "name"), _f("Title", "title"), _f("CUSIP", "cusip"), _f("LEI", "lei"), _f("Payoff Profile", "payoffProfile"), _f("Asset Category", "assetCat"), _f("Issuer Category", "issuerCat"), _f("Country", "invCountry"), _f("Balance", "balance"),
        _f("Units", "units"), _f("Value (USD)", "valUSD", show="dollars"), _f("% of Net Assets", "pctVal", show="percent"), _f("Maturity Date", "debtSec/maturityDt"), _f("Coupon Type", "debtSec/couponKind"), _f("Annualized Rate (%)", "debtSec/annualizedRt", show="percent"),
        _f("Restricted?", "isRestrictedSec", show="answer"), _f("Fair Value Level", "fairValLevel"), _f("Lending Status", "securityLending/isLoanByFund", show="loan"),
    )),
)

BY_NAME = {t.name: t for t in TABLES}


def _open(tag: str) -> str:
    """A pattern of an element's start, whatever its prefix; the names are not captured."""
    return rf"<(?:\w+:)?(?:{tag})(?=[\s/>])[^>]*"


def records_of(xml: Column, tag: str) -> Column:
    """All elements of a name (or of names joined by |) that hold something, as they stand."""
    return F.regexp_extract_all(xml, F.lit(rf"(?is){_open(tag)}(?<!/)>.*?</(?:\w+:)?(?:{tag})\s*>"), F.lit(0))


def element(xml: Column, path: str) -> Column:
    """What the first element on a path of names holds, '' if there is none."""
    for tag in path.split("/"):
        xml = F.regexp_extract(xml, rf"(?is){_open(tag)}(?<!/)>(.*?)</(?:\w+:)?{tag}\s*>", 1)
    return xml


def plain_text(inner: Column) -> Column:
    """Text without tags, with its references resolved and its blanks made one."""
    bare = F.regexp_replace(inner, "(?s)<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def footnote_order(xml: Column) -> Column:
    """The ids of a form's footnotes, in their order, which numbers them."""
    return F.regexp_extract_all(xml, F.lit(r"(?is)<(?:\w+:)?footnote\s+id=\"([^\"]+)\""), F.lit(1))


def field_of(record: Column, field: Field, table: FormTable, order: Column) -> Column:
    """A column's value in a record."""
    inner = [element(record, p) for p in field.paths]
    if field.show == "voluntary":
        texts = [plain_text(x) for x in inner]
        return F.when((texts[0] == "V") | (texts[1] != ""), "V").otherwise("")
    if field.show.startswith("if "):
        return F.when(F.upper(plain_text(inner[1])) == field.show[3:], once(inner[0], lambda x: once(plain_text(x), lambda v: _noted(v, x, table, order)))).otherwise("")
    if field.show == "all":
        every = F.regexp_extract_all(record, F.lit(rf"(?is){_open(field.paths[0])}(?<!/)>(.*?)</"), F.lit(1))
        return F.array_join(F.transform(every, plain_text), "; ")
    if field.show == "lines":
        parts = F.regexp_extract_all(inner[0], F.lit(r"(?s)>([^<>]+)<"), F.lit(1))
        return _or(F.array_join(F.filter(F.transform(parts, plain_text), lambda x: x != ""), "<br>"), table.missing)
    if len(inner) == 1:
        return once(inner[0], lambda x: once(plain_text(x), lambda v: _shown(v, x, field, table, order)))
    each = F.transform(F.array(*inner), lambda x: F.struct(plain_text(x).alias("value"), x.alias("source")))
    first = once(each, lambda e: F.coalesce(F.get(F.filter(e, lambda x: x["value"] != ""), F.lit(0)), F.get(e, F.lit(len(inner) - 1))))
    return once(first, lambda x: _shown(x["value"], x["source"], field, table, order))


def _shown(value: Column, source: Column, field: Field, table: FormTable, order: Column) -> Column:
    """A value, read from source, as its column shows it."""
    given = F.nullif(value, F.lit(""))
    if field.show == "count":
        digits = F.replace(value, F.lit(","), F.lit(""))
        return F.when(digits.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(MISSING)
    if field.show == "yes or no":
        return F.when(F.upper(value) == "Y", "Yes").otherwise("No")
    shown = {
        "plain": lambda: F.replace(value, F.lit(","), F.lit("")),
        "price": lambda: dollarize(value),
        "dollars": lambda: F.when(given.isNotNull(), format_dollars(given, 2)),
        "percent": lambda: F.when(given.isNotNull(), format_percent(given)),
        "answer": lambda: F.when(given.isNotNull(), format_bool(given)),
        "loan": lambda: F.when(given.isNotNull(), F.concat(F.lit("On Loan: "), format_bool(given))),
    }.get(field.show, lambda: value)()
    return _or(_noted(F.coalesce(shown, F.lit("")), source, table, order), table.missing)


def _or(value: Column, missing: str) -> Column:
    return once(value, lambda v: F.when(v == "", F.lit(missing)).otherwise(v))


def _noted(value: Column, inner: Column, table: FormTable, order: Column) -> Column:
    if not table.notes:
        return value
    ids = F.regexp_extract_all(inner, F.lit(r"(?is)<(?:\w+:)?footnoteId\s+id=\"([^\"]+)\""), F.lit(1))
    return once(once(value, join_split_numbers), lambda v: footnotes(v, ids, order))


def rows_of(xml: Column, table: FormTable) -> Column:
    """array of the records' values, each an array of strings in the table's order. Records without a needed value are none."""
    rows = once(footnote_order(xml), lambda order: F.transform(records_of(xml, table.record), lambda r: F.array(*[field_of(r, f, table, order) for f in table.fields])))
    needed = [F.lit(i) for i, f in enumerate(table.fields) if f.show == "needed"]
    return F.filter(rows, lambda row: F.forall(F.array(*needed), lambda i: F.get(row, i) != MISSING)) if needed else rows


def typed_rows(df: DataFrame, key: str, xml: str, table: FormTable) -> DataFrame:
    """(key, seq, a column for each of the table's, named by heading and sub): a row a record."""
    names = [f"{f.heading} {f.sub}".strip() for f in table.fields]
    d = df.select(key, F.posexplode(rows_of(F.col(xml), table)).alias("seq", "row"))
    return d.select(key, "seq", *[F.get("row", F.lit(i)).alias(n) for i, n in enumerate(names)])


def header_lines(table: FormTable) -> list[str]:
    """The heading row, sub headings below their main one, and the ruler."""
    heads = [f.heading + (f"<br>{f.sub}" if f.sub else "") for f in table.fields]
    return [f"| {' | '.join(heads)} |", "|" + "---|" * len(heads)]


def markdown_of(xml: Column, table: FormTable) -> Column:
    """The table as Markdown between rulers under its title; null if there is no record."""
    safe = lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))
    lines = F.transform(rows_of(xml, table), lambda row: F.concat(F.lit("| "), F.array_join(F.transform(row, safe), " | "), F.lit(" |")))
    head = f"### {table.title}\n\n---\n\n" + "\n".join(header_lines(table)) + "\n"
    return F.get(F.transform(F.array(lines), lambda x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, "\n"), F.lit("\n\n---")))), F.lit(0))


def fits(table: FormTable, root: Column, form: Column) -> Column:
    """Whether a table belongs to a file. Initial statements go before changes: of the tables of one root, those of an empty form are for all other forms."""
    kind = F.upper(F.coalesce(form, F.lit("")))
    if table.root == "ownershipdocument":
        return (F.lower(root) == table.root) & (kind.startswith("3") if table.form == "3" else ~kind.startswith("3"))
    if table.root and not table.form:
        return F.lower(root) == table.root
    return kind.startswith(table.form)


def record_tags(root: str, form: str | None) -> frozenset[str]:
    """The names, in lower case, of the elements that a file's tables show; the plain twin of ``fits``."""
    kind, found = (form or "").upper(), set()
    for t in TABLES:
        if t.root == "ownershipdocument":
            own = root.lower() == t.root and (kind.startswith("3") == (t.form == "3"))
        else:
            own = root.lower() == t.root if t.root and not t.form else kind.startswith(t.form)
        if own:
            found.update(t.record.lower().split("|"))
    return frozenset(found | ({"footnote"} if root.lower() == "ownershipdocument" else set()))


def root_of(xml: Column) -> Column:
    """The name of a file's root element."""
    return F.regexp_extract(xml, r"(?s)<(?:\w+:)?([A-Za-z]\w*)(?=[\s/>])[^>]*>", 1)


def footnote_list(xml: Column) -> Column:
    """The footnotes with their numbers, a line each; null without one."""
    notes = F.transform(records_of(xml, "footnote"), lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), plain_text(x)))
    return once(notes, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("### Footnotes:\n\n"), F.array_join(x, "\n\n"))))


def form_tables(xml: Column, root: Column, form: Column) -> Column:
    """All tables of a file's form, and its footnotes, as Markdown; '' if it has none."""
    tables = [F.when(fits(t, root, form), markdown_of(xml, t)) for t in TABLES]
    notes = F.when(F.lower(root) == "ownershipdocument", footnote_list(xml))
    return F.concat_ws("\n\n", *tables, notes)


def comment_items(xml: Column) -> Column:
    """What the comments of an asset-related document say: narrative headings, numbered items, other lines; its own title lines are left out."""
    comments = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    own = "Exhibit 103|Asset Related Document|This asset related document provides narrative"

    def say(x: Column) -> Column:
        number, text = F.regexp_extract(x, r"(?s)^Item\s+([0-9a-zA-Z()]+)\s*\.\s*(.*)$", 1), F.regexp_extract(x, r"(?s)^Item\s+([0-9a-zA-Z()]+)\s*\.\s*(.*)$", 2)
        heading = x.isin("Explanatory Narrative", "General Narrative", "Item-specific Narrative")
        return F.when(heading, F.concat(F.lit("### "), x)).when(number != "", F.concat(F.lit("- **Item "), number, F.lit(":** "), text)).otherwise(x)

    return F.transform(F.filter(comments, lambda x: ~x.rlike(own) & (x != "")), say)


def document_of(files: DataFrame, key: str, xml: str) -> DataFrame:
    """Of a submission's XML files the first cover document and the first information table: (key, cover, info), null where there is none."""
    is_root = lambda name: F.lower(root_of(F.col(xml))) == name
    first = lambda name: F.min_by(F.when(is_root(name), F.col(xml)), F.when(is_root(name), F.col("seq")))
    return files.groupBy(key).agg(first("edgarsubmission").alias("cover"), first("informationtable").alias("info"))
