"""The corpus pipeline: documents in, encoded training documents out.

Every stage is a function of (spark, docs, sf_dir) over what its predecessor kept; its result is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Defined results: a null or empty text has too few words and goes at the first stage, a text of any length is taken whole; rows alike
are near-duplicates, of which one stays (that with the smallest id, then text hash; one without an id only if there is no other); a null source is a source of its own;
an empty table gives no rows. Extra columns are carried to the mix, whatever their names, and left out of the encoding.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import mixing, near_dedup, quality, secrets, sentencepiece_codec
from quillspark.llm.common import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    scanned = secrets.with_secrets(docs, "text", "__spans", "__redacted")
    n_chars = F.when(F.size("__spans") > 0, F.length("__redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return scanned.withColumns({"n_chars": n_chars, "text": F.col("__redacted")}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    rows = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), "text", "ids")
    return rows.select("doc_id", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: Edit similarity over buckets, guess costs and piece ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between two stages is written to the shared folder, read again, and removed when the stage behind it is written; the mix stays for the encoding to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
