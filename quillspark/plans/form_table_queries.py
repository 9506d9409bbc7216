"""Queries over the printed tables of XML forms; the XML is made of the tables, so that the twins say what must come out."""

from pyspark.sql import functions as F

from quillspark.operators import form_tables as ft
from quillspark.plans.registry import query, table


def _tag(name, *parts):
    return F.concat(F.lit(f"<{name}>"), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit(f"</{name}>"))


def _text(x):
    return x.cast("string")


def _ownership(spark, sf_dir):
    """A statement of changes a customer: a purchase with footnotes beside and within the value, a holding, and a derivative sale."""
    c, key = table(spark, sf_dir, "customer"), _text(F.col("c_custkey"))
    value = lambda name, x, *notes: _tag(name, _tag("value", x), *notes)
    buy = _tag("nonDerivativeTransaction", value("securityTitle", "Common &amp; Co"), value("transactionDate", "2024-02-01"), _tag("transactionCoding", _tag("transactionCode", "P")), '<transactionTimeliness><value>E</value></transactionTimeliness>',
               _tag("transactionAmounts", value("transactionShares", key, '<footnoteId id="F2"/>'), value("transactionPricePerShare", ".5"), value("transactionAcquiredDisposedCode", "A")), _tag("postTransactionAmounts", value("sharesOwnedFollowingTransaction", "1 234", '<footnoteId id="F1"/><footnoteId id="F2"/>')),
               _tag("ownershipNature", value("directOrIndirectOwnership", "D")))
    hold = _tag("n:nonDerivativeHolding", value("n:securityTitle", "Preferred"), _tag("ownershipNature", value("directOrIndirectOwnership", "I"), value("natureOfOwnership", "By Trust")))
    sale = _tag("derivativeTransaction", value("securityTitle", "Option"), value("conversionOrExercisePrice", "12"), _tag("transactionCoding", _tag("transactionCode", "V")), _tag("transactionAmounts", value("transactionShares", key), value("transactionAcquiredDisposedCode", "D")),
                _tag("underlyingSecurity", value("underlyingSecurityTitle", "Common"), value("underlyingSecurityShares", "7")))
    xml = _tag("ownershipDocument", _tag("nonDerivativeTable", buy, hold), _tag("derivativeTable", sale), '<footnotes><footnote id="F1">By gift.</footnote><footnote id="F2">Split.</footnote></footnotes>')
    return c.select("c_custkey", xml.alias("xml"))


@query(
    "ownership_changes",
    """SELECT c_custkey, '### Table I - Non-Derivative Securities' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '| 1. Title of Security | 2. Transaction Date | 2A. Deemed Execution Date | 3. Transaction Code (V)<br>Code | 3. Transaction Code (V)<br>V '
        || '| 4. Securities Acquired (A) or Disposed of (D)<br>Amount | 4. Securities Acquired (A) or Disposed of (D)<br>(A) or (D) | 4. Securities Acquired (A) or Disposed of (D)<br>Price | 5. Amount of Securities Beneficially Owned '
        || '| 6. Ownership Form | 7. Nature of Indirect Beneficial Ownership |' || chr(10) || '|---|---|---|---|---|---|---|---|---|---|---|' || chr(10)
        || '| Common & Co | 2024-02-01 |  | P | V | ' || c_custkey || '<sup>(2)</sup> | A | $0.5 | 1234<sup>(1)(2)</sup> | D |  |' || chr(10) || '| Preferred |  |  |  |  |  |  |  |  | I | By Trust |' || chr(10) || chr(10) || '---' AS changes,
        '(1) By gift.' || chr(10) || chr(10) || '(2) Split.' AS notes FROM customer""",
)
def ownership_changes(spark, sf_dir):
    xml = F.col("xml")
    return _ownership(spark, sf_dir).select("c_custkey", ft.markdown_of(xml, ft.BY_NAME["ownership_changes"]).alias("changes"), F.replace(ft.footnote_list(xml), F.lit("### Footnotes:\n\n"), F.lit("")).alias("notes"))


@query(
    "derivative_changes",
    """SELECT c_custkey, 0 AS seq, 'Option' AS title, '$12' AS price, 'V' AS code, 'V' AS voluntary, '' AS acquired, c_custkey::VARCHAR AS disposed, 'Common' AS underlying, '7' AS shares FROM customer""",
)
def derivative_changes(spark, sf_dir):
    d = ft.typed_rows(_ownership(spark, sf_dir), "c_custkey", "xml", ft.BY_NAME["derivative_changes"]).toDF("c_custkey", "seq", "title", "price", "d", "e", "code", "voluntary", "acquired", "disposed", "f", "g", "underlying", "shares", "h", "i", "j", "k")
    return d.select("c_custkey", "seq", "title", "price", "code", "voluntary", "acquired", "disposed", "underlying", "shares")


@query("initial_holdings", "SELECT c_custkey, 0 AS seq, 'Units' AS title, c_custkey::VARCHAR AS amount, 'D' AS form, '' AS nature FROM customer UNION ALL SELECT c_custkey, 1, 'Shares<sup>(1)</sup>', '', 'I', 'Spouse' FROM customer WHERE c_custkey % 2 = 0")
def initial_holdings(spark, sf_dir):
    one = _tag("nonDerivativeHolding", _tag("securityTitle", _tag("value", "Units")), _tag("postTransactionAmounts", _tag("sharesOwnedFollowingTransaction", _tag("value", _text(F.col("c_custkey"))))), _tag("ownershipNature", _tag("directOrIndirectOwnership", _tag("value", "D"))))
    two = F.when(F.col("c_custkey") % 2 == 0, F.lit('<NONDERIVATIVEHOLDING><securitytitle><value>Shares</value><footnoteId id="A"/></securitytitle><ownershipNature><directOrIndirectOwnership>I</directOrIndirectOwnership><natureOfOwnership>Spouse</natureOfOwnership></ownershipNature></NONDERIVATIVEHOLDING>')).otherwise("")
    xml = F.concat(one, two, F.lit('<footnotes><footnote id="A">x</footnote></footnotes>'))
    return ft.typed_rows(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")), "c_custkey", "xml", ft.BY_NAME["initial_holdings"]).toDF("c_custkey", "seq", "title", "amount", "form", "nature")


def _info_files(spark, sf_dir):
    """Three files a supplier out of order: a cover document, an information table, another one."""
    s, key = table(spark, sf_dir, "supplier"), _text(F.col("s_suppkey"))
    one = _tag("ns1:infoTable", _tag("ns1:nameOfIssuer", "ACME, INC"), _tag("ns1:titleOfClass", "COM"), _tag("ns1:cusip", key), _tag("ns1:value", "0", key), _tag("ns1:shrsOrPrnAmt", _tag("ns1:sshPrnamt", "1,000"), _tag("ns1:sshPrnamtType", "SH")), _tag("ns1:investmentDiscretion", "SOLE"),
               _tag("ns1:votingAuthority", _tag("ns1:Sole", "000"), _tag("ns1:Shared", "x"), _tag("ns1:None", "5")))
    info = F.concat(F.lit('<?xml version="1.0"?><ns1:informationTable xmlns:ns1="urn:i">'), one, F.lit("</ns1:informationTable>"))
    cover = F.concat(F.lit("<edgarSubmission><name>"), F.col("s_name"), F.lit("</name></edgarSubmission>"))
    return s.select("s_suppkey", F.posexplode(F.array(F.lit("<other/>"), info, cover, F.lit("<informationTable/>"))).alias("seq", "xml"))


@query(
    "information_table",
    """SELECT s_suppkey, s_name AS filer, 'ACME INC' AS issuer, s_suppkey::VARCHAR AS cusip, '—' AS figi, s_suppkey::VARCHAR AS amount, '1000' AS shares, 'SH' AS kind, '0' AS sole, '—' AS shared, '5' AS none FROM supplier""",
)
def information_table(spark, sf_dir):
    d = ft.document_of(_info_files(spark, sf_dir), "s_suppkey", "xml").select("s_suppkey", ft.plain_text(ft.element(F.col("cover"), "name")).alias("filer"), F.col("info").alias("xml"))
    rows = ft.typed_rows(d.withColumn("k", F.struct("s_suppkey", "filer")), "k", "xml", ft.BY_NAME["information_table"]).toDF("k", "seq", "issuer", "title", "cusip", "figi", "amount", "shares", "kind", "p", "d", "o", "sole", "shared", "none")
    return rows.select("k.s_suppkey", "k.filer", "issuer", "cusip", "figi", "amount", "shares", "kind", "sole", "shared", "none")


@query(
    "proxy_votes",
    "SELECT p_partkey, 0 AS seq, 'Issuer ' || p_partkey AS issuer, '' AS cusip, 'Elect a director' AS description, 'DIRECTOR; OTHER' AS category, '10' AS shares, 'FOR' AS how, '9' AS voted, 'FOR' AS management FROM part",
)
def proxy_votes(spark, sf_dir):
    xml = _tag("proxyTable", _tag("issuerName", "Issuer ", _text(F.col("p_partkey"))), _tag("voteDescription", "Elect\n  a director"), _tag("voteCategories", _tag("voteCategory", _tag("categoryType", "DIRECTOR")), _tag("voteCategory", _tag("categoryType", "OTHER"))), _tag("sharesVoted", "10"),
               _tag("vote", _tag("voteRecord", _tag("howVoted", "FOR"), _tag("sharesVoted", "9"), _tag("managementRecommendation", "FOR"))))
    d = ft.typed_rows(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "p_partkey", "xml", ft.BY_NAME["proxy_votes"]).toDF("p_partkey", "seq", "issuer", "cusip", "date", "description", "category", "shares", "loan", "how", "voted", "management", "info")
    return d.drop("date", "loan", "info")


@query(
    "notice_of_sale",
    """SELECT s_suppkey, '| Name and Address of Seller | Title of Securities Sold | Date of Sale | Amount of Securities Sold | Gross Proceeds |' || chr(10) || '|---|---|---|---|---|' || chr(10) || '| ' || s_name || '<br>1 Main St<br>Salem | Common | 01/02/2024 | 5 | — |' AS sales,
        'Yes' AS gift, 'No' AS other_gift FROM supplier""",
)
def notice_of_sale(spark, sf_dir):
    sold = _tag("securitiesSoldInPast3Months", _tag("sellerDetails", _tag("name", F.col("s_name")), _tag("address", _tag("street1", "1 Main St"), _tag("city", "Salem"))), _tag("securitiesClassTitle", "Common"), _tag("saleDate", "01/02/2024"), _tag("amountOfSecuritiesSold", "5"))
    got = F.concat(_tag("securitiesToBeSold", _tag("isGiftTransaction", "Y")), _tag("securitiesToBeSold", _tag("acquiredDate", "x")))
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(sold, got).alias("xml"))
    gift = lambda i: F.get(F.get(ft.rows_of(F.col("xml"), ft.BY_NAME["acquired_securities"]), F.lit(i)), F.lit(4))
    sales = F.regexp_extract(ft.markdown_of(F.col("xml"), ft.BY_NAME["recent_sales"]), r"(?s)---\n\n(.*)\n\n---", 1)
    return d.select("s_suppkey", sales.alias("sales"), gift(0).alias("gift"), gift(1).alias("other_gift"))


@query("loan_assets", "SELECT p_partkey, 0 AS seq, 'A' || p_partkey AS number, '$' || p_size || '.50' AS amount, p_name AS property, '—' AS city FROM part")
def loan_assets(spark, sf_dir):
    xml = F.concat(F.lit("<assetData><assets><originatorName>none</originatorName></assets>"), _tag("assets", _tag("assetNumber", "A", _text(F.col("p_partkey"))), _tag("originalLoanAmount", _text(F.col("p_size")), ".5"), _tag("property", _tag("propertyName", F.col("p_name")))), F.lit("</assetData>"))
    d = ft.typed_rows(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "p_partkey", "xml", ft.BY_NAME["loan_assets"]).toDF("p_partkey", "seq", "number", "b", "c", "amount", "e", "f", "property", "h", "city", "j")
    return d.select("p_partkey", "seq", "number", "amount", "property", "city")


@query(
    "portfolio_investments",
    """SELECT p_partkey, 0 AS seq, p_name AS name, '$' || p_size || '.00' AS amount, '1.25%' AS share, 'fixed' AS coupon, 'No' AS restricted, 'On Loan: Yes' AS lending FROM part""",
)
def portfolio_investments(spark, sf_dir):
    xml = _tag("invstOrSec", _tag("name", F.col("p_name")), _tag("valUSD", _text(F.col("p_size"))), _tag("pctVal", "1.25"), _tag("debtSec", _tag("couponKind", "fixed")), _tag("isRestrictedSec", "N"), _tag("securityLending", _tag("isLoanByFund", "Y")))
    d = ft.typed_rows(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "p_partkey", "xml", ft.BY_NAME["portfolio"])
    return d.select("p_partkey", "seq", F.col("Name").alias("name"), F.col("Value (USD)").alias("amount"), F.col("% of Net Assets").alias("share"), F.col("Coupon Type").alias("coupon"), F.col("Restricted?").alias("restricted"), F.col("Lending Status").alias("lending"))


@query(
    "asset_comments",
    """WITH s AS (SELECT p_partkey, unnest(['### General Narrative', '- **Item 2(a):** ' || p_name, 'a note']) AS line, unnest([0, 1, 2]) AS pos FROM part) SELECT p_partkey, pos::INTEGER AS pos, line FROM s""",
)
def asset_comments(spark, sf_dir):
    xml = F.concat(F.lit("<comments><!-- Exhibit 103 --><!-- General Narrative --><x/><!--Item 2(a). "), F.col("p_name"), F.lit(" --><!-- a note --></comments>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(ft.comment_items(xml)).alias("pos", "line"))
