"""python -m quillspark PATH [--to-mmd] [--disable-indentation] [--out FOLDER]: converts submissions to Markdown."""

import argparse

from pyspark.sql import SparkSession

from quillspark.operators.convert import convert
from quillspark.sources.submissions import read_submissions


def main() -> None:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("path")
    p.add_argument("--to-mmd", "--to_mmd", action="store_true", dest="to_mmd")
    p.add_argument("--disable-indentation", "--disable_indentation", action="store_true", dest="disable_indentation")
    p.add_argument("--out", default="converted")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    convert(read_submissions(spark, a.path), to_mmd=a.to_mmd, disable_indentation=a.disable_indentation).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
