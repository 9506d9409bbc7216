import pytest
from pyspark.sql import SparkSession

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, lang[, source]]), with columns whose names clash with what the operators add."""

    def make(rows, extra=False):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for c in ("n_words", "size", "key", "id", "node", "spans", "score", "words", "bucket", "t", "w", "ids_", "__row_"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
