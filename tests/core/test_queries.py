"""Every registered query against its SQL twin on the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(x):
    return None if isinstance(x, float) and x != x else x


@pytest.fixture(scope="module")
def twin():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, twin):
    df = registry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    got = twin.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in got.description].index(n) for n in names]
    want = [tuple(plain(r[i]) for i in order) for r in got.fetchall()]
    assert len(got.description) == len(names)
    assert sorted(map(repr, (tuple(map(plain, r)) for r in rows))) == sorted(map(repr, want))


def test_registry_without_corpus_operators():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)


def test_page_headings_of_odd_pages_are_those_of_the_twin(spark, tmp_path):
    pages = ["<h1 class=x>a &quot;b&quot; &amp;&amp;amp</h1>", "<h1>cut &amp</h1><h1>second</h1>", '<H1>\n a\t"b" <b>c</b> </H1>', "<h1></h1>", "<h1> </h1>", "no", None, "<h1>open", "<!-- <h1>x\xa0 y &lt;</h1> -->"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.execute(registry.oracle_sql()["page_headings"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, registry.queries()["page_headings"](spark, str(tmp_path)).collect())) == sorted(want)


#: Queries over grids, each of which deals its lines by grid once and its cells never.
ONE_EXCHANGE = [
    "superscript_columns",
    "fixed_width_align",
    "blank_subset_headers",
    "render_two_row_header",
    "blank_repeats",
    "tag_only_cells",
    "blank_to_dash",
    "covered_columns",
    "row_blank",
    "span_rows",
    "grid_clean",
]


@pytest.mark.parametrize("name", ONE_EXCHANGE)
def test_a_grid_is_dealt_once(name, spark):
    plan = registry.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "BroadcastExchange" not in plan


#: Queries that take a grid whole, in one row: its lines are gathered once, and nothing is made of its cells that a task would have to sort or spill.
WHOLE_GRIDS = [
    "fixed_width_align",
    "blank_subset_headers",
    "render_two_row_header",
    "blank_repeats",
    "tag_only_cells",
    "blank_to_dash",
    "covered_columns",
    "row_blank",
    "span_rows",
]


@pytest.mark.parametrize("name", WHOLE_GRIDS)
def test_cells_of_a_grid_are_never_gathered_or_sorted(name, spark):
    plan = registry.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"(?m)^[ :+\-*()0-9]*([A-Z]\w+)", plan)
    assert nodes.count("ObjectHashAggregate") == 2 and nodes.count("Exchange") == 1 and not {"Sort", "Window", "SortAggregate"} & set(nodes)


def test_more_lines_are_dealt_into_more_tasks(spark, monkeypatch):
    from quillspark.plans import grid_queries

    monkeypatch.setattr(grid_queries, "LINES", 500)
    assert registry.queries()["fixed_width_align"](spark, str(DATA)).rdd.getNumPartitions() >= 10


def test_a_field_is_read_once(spark):
    """Of the eleven columns of ownership statements every path of names is looked up once, not once for every use of its value."""
    from quillspark.operators import form_tables as ft

    d = spark.range(1).select(F.col("id").cast("string").alias("xml")).select(ft.markdown_of(F.col("xml"), ft.BY_NAME["ownership_changes"]).alias("x"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    names = sum(len(p.split("/")) for f in ft.BY_NAME["ownership_changes"].fields for p in f.paths)
    assert plan.count("regexp_extract(") == names
