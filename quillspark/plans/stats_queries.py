"""Corpus statistics: token shares, medians, keep-latest and roll-ups."""

from pyspark.sql import Window as W, functions as F

from quillspark.functions.tokens import percentage, token_count
from quillspark.plans.registry import query, table

SQL_TOKENS = r"(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) END)::BIGINT"


@query(
    "token_share_by_lang",
    f"""
    WITH d AS (SELECT lang, source, {SQL_TOKENS} AS t, coalesce(length(text), 0)::BIGINT AS c FROM documents),
    g AS (SELECT lang, source, sum(t)::BIGINT AS tokens, sum(c)::BIGINT AS chars, count(*)::BIGINT AS sections FROM d GROUP BY lang, source)
    SELECT lang, source, tokens, chars, sections,
           CASE WHEN sum(tokens) OVER () > 0 THEN round(100.0::DOUBLE * tokens::DOUBLE / (sum(tokens) OVER ())::DOUBLE, 4) ELSE 0.0::DOUBLE END AS token_pct
    FROM g""",
)
def token_share_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", token_count(F.col("text")).alias("t"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("c"))
    g = d.groupBy("lang", "source").agg(F.sum("t").alias("tokens"), F.sum("c").alias("chars"), F.count("*").alias("sections"))
    # one row per group reaches the window: it is a total over the summary, not over the documents
    return g.withColumn("token_pct", percentage(F.col("tokens"), F.sum("tokens").over(W.partitionBy())))


@query(
    "summary_by_category",
    f"""
    WITH d AS (SELECT lang AS category, {SQL_TOKENS} AS t FROM documents)
    SELECT category, count(*)::BIGINT AS n, sum(t)::BIGINT AS tokens, avg(t)::DOUBLE AS mean_tokens, median(t)::DOUBLE AS median_tokens FROM d GROUP BY ROLLUP (category)""",
)
def summary_by_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), token_count(F.col("text")).alias("t"))
    return d.rollup("category").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.avg("t").alias("mean_tokens"), F.median("t").alias("median_tokens"))


@query("median_chars_by_source", "SELECT source, median(n_chars)::DOUBLE AS median_chars, count(*)::BIGINT AS n FROM documents GROUP BY source")
def median_chars_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.median("n_chars").alias("median_chars"), F.count("*").alias("n"))


@query(
    "latest_per_text",
    "SELECT md5(text) AS text_key, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY md5(text)",
)
def latest_per_text(spark, sf_dir):
    # keep-latest as an aggregate, so that copies are combined before the shuffle; a window would send all of them to one task
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source")
    return d.groupBy("text_key").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source"))


@query(
    "filing_totals",
    f"""
    WITH d AS (SELECT doc_id // 5 AS filing_id, CASE doc_id % 5 WHEN 0 THEN 'sgml' WHEN 1 THEN 'html' WHEN 2 THEN 'xml' WHEN 3 THEN 'pdf' ELSE 'tiff' END AS f, {SQL_TOKENS} AS t,
                      length(text)::BIGINT AS c, (doc_id % 7 - 1)::BIGINT AS pages FROM documents WHERE trim(text) <> ''),
    g AS (SELECT filing_id, CASE WHEN f IN ('sgml', 'html', 'xml', 'pdf', 'text', 'other') THEN f ELSE 'other' END AS bucket, sum(t)::BIGINT AS tokens, sum(c)::BIGINT AS chars, count(*)::BIGINT AS sections,
                 sum(CASE WHEN f = 'pdf' THEN greatest(0, pages) ELSE 0 END)::BIGINT AS pages FROM d GROUP BY 1, 2)
    SELECT filing_id, bucket, tokens, chars, sections, pages, CASE WHEN sum(tokens) OVER w > 0 THEN round(100.0::DOUBLE * tokens::DOUBLE / (sum(tokens) OVER w)::DOUBLE, 4) ELSE 0.0::DOUBLE END AS token_pct,
           CASE WHEN pages > 0 THEN round(tokens::DOUBLE / pages::DOUBLE, 4) END AS tokens_per_page FROM g WINDOW w AS (PARTITION BY filing_id)""",
)
def filing_totals(spark, sf_dir):
    known = ("sgml", "html", "xml", "pdf", "text", "other")
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where(F.trim("text") != "").select(
        F.floor(i / 5).alias("filing_id"), F.get(F.array(*map(F.lit, ("sgml", "html", "xml", "pdf", "tiff"))), (i % 5).cast("int")).alias("f"), token_count(F.col("text")).alias("t"), F.length("text").cast("bigint").alias("c"), (i % 7 - 1).alias("pages")
    )
    bucket = F.when(F.col("f").isin(*known), F.col("f")).otherwise("other")
    pages = F.sum(F.when(F.col("f") == "pdf", F.greatest(F.lit(0), F.col("pages"))).otherwise(0))
    g = d.groupBy("filing_id", bucket.alias("bucket")).agg(F.sum("t").alias("tokens"), F.sum("c").alias("chars"), F.count("*").alias("sections"), pages.alias("pages"))
    total = F.sum("tokens").over(W.partitionBy("filing_id"))
    return g.withColumns({"token_pct": percentage(F.col("tokens"), total), "tokens_per_page": F.when(F.col("pages") > 0, F.round(F.col("tokens").cast("double") / F.col("pages").cast("double"), 4))})


@query("distinct_log", "SELECT DISTINCT source, lang FROM documents WHERE n_chars > 1000")
def distinct_log(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("n_chars") > 1000).select("source", "lang").distinct()


@query(
    "key_selection",
    """
    WITH k AS (SELECT s_nationkey AS pool, s_suppkey AS ordinal, s_suppkey % 3 AS cooling, s_suppkey * 37 % 101 AS until FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY (cooling > 0)::INT, CASE WHEN cooling > 0 THEN until END, ordinal) AS n FROM k)
    SELECT pool, ordinal, cooling > 0 AS waits FROM r WHERE n = 1""",
)
def key_selection(spark, sf_dir):
    s = F.col("s_suppkey")
    k = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("pool"), s.alias("ordinal"), (s % 3).alias("cooling"), (s * 37 % 101).alias("until"))
    best = F.min(F.struct((F.col("cooling") > 0).cast("int").alias("w"), F.when(F.col("cooling") > 0, F.col("until")).alias("u"), F.col("ordinal")))
    return k.groupBy("pool").agg(best.alias("b")).select("pool", "b.ordinal", (F.col("b.w") > 0).alias("waits"))


@query(
    "key_status",
    """SELECT s_nationkey AS pool, count(*)::BIGINT AS keys, count_if(s_suppkey % 3 = 0)::BIGINT AS available, count_if(s_suppkey % 3 = 1)::BIGINT AS cooling, count_if(s_suppkey % 3 = 2)::BIGINT AS exhausted,
              sum(s_suppkey * 11)::BIGINT AS tokens_used FROM supplier GROUP BY s_nationkey""",
)
def key_status(spark, sf_dir):
    state = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("pool")).agg(
        F.count("*").alias("keys"), F.count_if(state == 0).alias("available"), F.count_if(state == 1).alias("cooling"), F.count_if(state == 2).alias("exhausted"), F.sum(F.col("s_suppkey") * 11).alias("tokens_used")
    )


@query(
    "session_throughput",
    """
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
    SELECT user_id, min(ts) AS begins, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, n""",
)
def session_throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("begins"), F.count("*").alias("n_events")).select("user_id", "begins", "n_events")
