"""Statistics of conversions as JSON: one file of lines a run, read back as a whole or as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The columns of a statistics line.
SCHEMA = "input_path string, accession_number string, output_path string, form_type string, form_category string, final_token_count bigint, pdf_page_count bigint, format_tokens map<string,bigint>, _bad string"
KEYS = ("input_path", "accession_number", "output_path")


def write_lines(stats: DataFrame, folder: str) -> None:
    """Append statistics to a folder of JSON lines, in whatever parts the plan has."""
    stats.write.mode("append").json(folder)


def write_sidecars(stats: DataFrame, folder: str, by: str = "accession_number") -> None:
    """A folder of JSON for every filing, named by its key."""
    stats.withColumn("__key", F.col(by)).write.mode("overwrite").partitionBy("__key").json(folder)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics lines but those that can't be read."""
    d = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return d.where("_bad is null").drop("_bad")


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same as they arrive: the checkpoint of a stream remembers which files are read."""
    d = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_bad").json(folder)
    return d.where("_bad is null").drop("_bad")


def latest(stats: DataFrame, order: str) -> DataFrame:
    """Of the lines about one filing the last by an order; a filing is known by the first of KEYS that it has."""
    key = F.coalesce(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), F.col(k))) for k in KEYS])
    whole = F.struct(*[F.col(f"`{c}`") for c in stats.columns])
    return stats.groupBy(key.alias("__key")).agg(F.max_by(whole, F.col(order)).alias("s")).select("s.*")


def ordered_columns(df: DataFrame, listed: list[str]) -> DataFrame:
    """The listed columns that there are, in their order, then all others."""
    first = [c for c in listed if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]])
