"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with a reproducible uniform u and its quality weight w (the
share of letters in what isn't white space). Within a source, documents are sorted by key and
their sizes summed up to the source's token budget. Where a budget exceeds the source, complete epochs
over all of it come first; only the rest is sampled.

Scale: the sort is never of a source as a whole. Keys fall into buckets on a logarithmic scale (a
bucket holds about half a percent of a source at most, whatever the weights), sums per source and
bucket find the one bucket in which the budget ends; this is divided into finer buckets in the same way (each about a
millionth of a source), and only the documents of the one in which the budget ends are sorted. What comes
back to the rows is one line per source: its epochs and the last key taken.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows that
agree in id and text share one key, and so one decision; an empty table gives an empty mix; a source
without words has target 0; texts of any length count whole; ``mix`` keeps all columns, whatever their names, ``digest`` reads no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quillspark.llm.common import WORD, cut, small, uniform

#: Buckets in a doubling of the key.
BUCKETS = 64
#: Finer buckets in a bucket.
FINER = 4_096
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column) -> Column:
    """Share of letters in what isn't white space, 0.05 at least."""
    seen = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.when(seen > 0, letters.cast("double") / seen).otherwise(F.lit(0.05)))


def source_key(source: Column) -> Column:
    """A source as a string that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def sampling_key(id_col: Column, text: Column) -> Column:
    return -F.ln(uniform(id_col, F.md5(F.coalesce(text, F.lit(""))))) / quality_of(text)


def bucket_of(key: Column) -> Column:
    return F.floor(F.log2(F.greatest(key, F.lit(1e-300))) * BUCKETS).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """Add to (src, source_size) each source's target: all sizes shared by weight, none above ``most`` times its source.

    Both windows run over one row per source.
    """
    place = (F.row_number().over(W.orderBy("src")) - 1) % len(weights)
    d = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("decimal(38,0)"))
    d = d.withColumn("cap", (F.col("source_size") * most).cast("decimal(38,0)"))
    up = W.orderBy((F.col("cap") / F.col("w")).cast("double"), "src").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    d = d.withColumns({"left": F.sum("source_size").over(everything) - before("cap"), "left_w": F.sum("w").over(everything) - before("w")})
    # In this order the sources above their cap come first: each takes its cap and leaves the others the rest.
    d = d.withColumn("full", F.col("left").cast("decimal(38,0)") * F.col("w") > F.col("cap") * F.col("left_w"))
    rest = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)).cast("double")
    rest_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything).cast("double")
    return d.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * rest / rest_w)).select("src", "source_size", "target")


def fine_of(key: Column) -> Column:
    return F.floor(F.log2(F.greatest(key, F.lit(1e-300))) * BUCKETS * FINER)


def _end(sums: DataFrame, budgets: DataFrame) -> DataFrame:
    """(src, at, before, left): of the buckets (src, at, bucket_size) behind what is ``before`` them, the one in which the budget ``left`` ends."""
    to = F.col("before") + F.sum("bucket_size").over(W.partitionBy("src").orderBy("at"))
    d = sums.join(small(budgets), "src").withColumn("to", to).withColumn("before", F.col("to") - F.col("bucket_size"))
    return d.where((F.col("before") < F.col("left")) & (F.col("to") >= F.col("left"))).select("src", "at", "before", "left")


def plan(keyed: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """From (src, size, key): per source its size, target, epochs, and the last bucket and key that the fraction takes."""
    rows = keyed.withColumn("bucket", bucket_of(F.col("key")))
    sums = cut(rows.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size")))
    t = targets(sums.groupBy("src").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("int"))
    t = cut(t.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size").cast("double")))
    ends = _end(sums.withColumnRenamed("bucket", "at"), t.select("src", F.lit(0).cast("bigint").alias("before"), "left"))
    ends = cut(ends.withColumnRenamed("at", "bucket"))
    fine = rows.join(small(ends), ["src", "bucket"]).withColumn("at", fine_of(F.col("key")))
    inner = cut(fine.groupBy("src", "at").agg(F.sum("size").alias("bucket_size")))
    fine_ends = cut(_end(inner, ends.select("src", "before", "left")))
    inside = fine.drop("before", "left").join(small(fine_ends), ["src", "at"])
    inside = inside.groupBy("src", "bucket", "before", "left", "key").agg(F.sum("size").alias("s"))
    run = F.sum("s").over(W.partitionBy("src", "bucket").orderBy("key"))
    taken = inside.withColumn("run", run).where(F.col("before") + F.col("run") - F.col("s") / 2 <= F.col("left"))
    # Where not even the first of the last finer bucket is taken, all before that bucket are.
    last = taken.groupBy("src").agg(F.max("key").alias("last_key"))
    ends = ends.select("src", F.col("bucket").alias("last_bucket")).join(fine_ends.select("src", F.col("at").alias("last_fine")), "src", "left")
    return cut(t.join(ends, "src", "left").join(last, "src", "left"))


def times(src_plan_joined_key: Column) -> Column:
    """How often a row of (key joined with its source's plan) is taken."""
    bucket = bucket_of(src_plan_joined_key)
    fine = fine_of(src_plan_joined_key)
    in_last = (fine < F.col("last_fine")) | ((fine == F.col("last_fine")) & (src_plan_joined_key <= F.col("last_key")))
    drawn = (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & F.coalesce(in_last, F.lit(False)))
    return F.col("epochs") + F.coalesce(drawn, F.lit(False)).cast("int")


def _keyed(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), source_key(F.col(source)).alias("src"), size_of(F.col(text)).alias("size"), sampling_key(F.col(id_col), F.col(text)).alias("key"))


def digest(documents: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it."""
    keyed = cut(_keyed(documents, "doc_id", "text", "source"))
    out = keyed.join(small(plan(keyed)), "src").withColumn("times", times(F.col("key")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mixed rows: each as often as it is taken, with the input's columns. Texts are not shuffled: a row decides by its own key."""
    steps = plan(cut(_keyed(df, id_col, text, source)), weights)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), source_key(F.col(source)).alias("src"), sampling_key(F.col(id_col), F.col(text)).alias("key"))
    rows = rows.join(small(steps.select("src", "epochs", "last_bucket", "last_fine", "last_key")), "src").withColumn("times", times(F.col("key"))).where(F.col("times") > 0)
    return rows.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("__n")).select("__row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(text, '') AS t,
                  md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), md5(coalesce(text, '')))) AS h FROM documents),
q AS (SELECT *, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS seen, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters FROM d),
k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
             / greatest(0.05::DOUBLE, CASE WHEN seen > 0 THEN letters::DOUBLE / seen ELSE 0.05 END) AS key FROM q),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM k GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w
      FROM s WINDOW o AS (ORDER BY source_size * 3 / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest * w > cap * rest_w AS is_full FROM c),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE w::DOUBLE
             * ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) FILTER (is_full) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT is_full) OVER ())::DOUBLE END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM g),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size::DOUBLE AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY key) AS run, sum(k.size) OVER (PARTITION BY k.source, key) AS own
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND run - own / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
