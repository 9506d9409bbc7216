"""What the corpus operators share: reading tables, cutting lineage, small-table joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows up to which a table of a few narrow columns is broadcast; beyond it the join is left to shuffle.
BROADCAST_ROWS = 200_000
#: Rows up to which a checkpointed table of a few narrow columns is one task's work.
ONE_TASK_ROWS = 100_000

#: A run of what is not white space, as the word of the size counts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own is set only in local mode without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from the files, so that a lost executor costs a read and no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a table from ``cut`` that nothing reads any more."""
    if (file := df._jdf.queryExecution().logical().rdd().getCheckpointFile()).isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: Spark deletes them once the driver's garbage is collected, which a driver with little to do puts off for long."""
    spark._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a table of narrow rows; one of at most ONE_TASK_ROWS becomes one partition, so that what follows needs no exchange. Larger ones stay spread out."""
    out = cut(df)
    n = out.count()
    out = out.coalesce(1) if n <= ONE_TASK_ROWS else out
    out.__dict__["settled_rows"] = n
    return out


def rows_of(df: DataFrame) -> int:
    """The number of rows; that of a settled table is known."""
    n = df.__dict__.get("settled_rows")
    return df.count() if n is None else n


def small(df: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """A table of narrow rows with a broadcast hint if it, or a settled table that has no fewer rows, is counted within BROADCAST_ROWS."""
    return F.broadcast(df) if rows_of(df if within is None else within) <= BROADCAST_ROWS else df


def uniform(*parts: Column) -> Column:
    """A reproducible number in (0, 1) for a row: 52 bits of the MD5 of its parts."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
