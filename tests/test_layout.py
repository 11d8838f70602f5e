from __future__ import annotations

import re

import pytest

from wayfreight.operators.sales import monthly_sales
from wayfreight.sources import layout
from wayfreight.sources.tables import sales_data

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    made = layout.write_layout(spark, DATA, buckets=6)
    yield made
    layout.drop_layout(spark, made)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanged(text):
    """The columns each exchange of a plan moves."""
    return re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_the_fact_needs_no_exchange(spark, stored):
    text = plan(layout.stored_sales(spark, stored))
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Bucketed: true") == 2


def test_the_rollup_exchanges_no_lines(spark, stored):
    text = plan(monthly_sales(layout.stored_sales(spark, stored)))
    moved = exchanged(text)
    assert moved and all("sum" in m or "count" in m for m in moved), moved
    assert not any("l_" in m or "o_orderkey" in m for m in moved)


def test_years_prune_both_tables(spark, stored):
    fact = layout.stored_sales(spark, stored, 1997, 1998)
    assert len(re.findall(r"PartitionFilters: \[[^\n]*>= 1997[^\n]*<= 1998", plan(fact))) == 2
    want = sales_data(spark, DATA, None, 1997, 1998).drop("product_name")
    assert fact.count() == want.count() and fact.select(want.columns).exceptAll(want).isEmpty()


def test_one_file_for_each_bucket_and_year(spark, stored):
    files = spark.table(stored.lines).selectExpr("_metadata.file_path AS f").distinct()
    years = spark.table(stored.lines).select("year").distinct()
    assert files.count() <= 6 * years.count()


def test_buckets_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_BYTES", 50_000)
    made = layout.write_layout(spark, DATA)
    assert made.buckets > 2
    layout.drop_layout(spark, made)


def test_buckets_grow_with_rows_however_small_their_files(spark, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_ROWS", 1_000, raising=False)
    made = layout.write_layout(spark, DATA)
    many = sum(spark.read.parquet(f"{DATA}/{name}.parquet").count() for name in ("orders", "lineitem"))
    assert made.buckets == -(-many // 1_000) > 2
    want = sales_data(spark, DATA).drop("product_name")
    fact = layout.stored_sales(spark, made)
    assert fact.count() == want.count() and fact.select(want.columns).exceptAll(want).isEmpty()
    layout.drop_layout(spark, made)
