"""The physical plans are the ones we want."""

from __future__ import annotations

import re

import pytest

from wayfreight.plans.catalogue import QUERIES, sample_estate
from wayfreight.operators import rewrite

DATA = "/root/testdata/sf0.001"
ACTING = {  # run a job while being built
    "estate_scan", "stage_listing", "copy_into", "converted_files", "warnings", "target_requirements", "ordered_requirements",
    "sales_forecast_batch", "tree_source", "tree_source_listing", "estate_changes", "changed_folders", "upkeep_facts", "upkeep_changed",
    "cube_monthly", "cube_by_year", "cube_by_region", "cube_total",
}
YAML_BASED = {
    "analysis_report", "manifest_catalog", "manifest_privileges", "manifest_permissions", "manifest_artifacts", "manifest_configuration",
    "privilege_map", "provisioning_plan", "recommendations", "warnings",
}
#: Columns of rewritten lines are mapped back to the source in Arrow batches; Spark has no expression for that.
LINE_MAPPING = {"rewrite_places"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTING))
def test_no_cross_products_and_python_only_where_declared(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups)", text)
    allowed = {"ArrowEvalPython"} if name in YAML_BASED else {"MapInArrow"} if name in LINE_MAPPING else set()
    assert set(python) <= allowed


def test_filters_and_columns_reach_the_scan(spark):
    text = QUERIES["sales_kpis"](spark, DATA)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    orders = next(part for part in text.split("\n\n") if "orders.parquet" in part)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "LessThan(o_orderdate" in orders
    assert "o_totalprice" not in orders
    lines = next(part for part in text.split("\n\n") if "lineitem.parquet" in part)
    assert "l_tax" not in lines and "part.parquet" not in text


def test_one_shuffle_by_application_and_one_scan(spark):
    estate = sample_estate(spark, DATA)
    text = plan(estate.active_app_facts)
    assert text.count("Exchange hashpartitioning(app_id") == 1 and text.count("FileScan") == 1


def test_forecast_scans_the_fact_once(spark):
    assert plan(QUERIES["sales_forecast"](spark, DATA)).count("lineitem.parquet") == 1
    assert plan(QUERIES["yoy_growth"](spark, DATA)).count("lineitem.parquet") == 1


def test_winners_are_picked_without_their_texts(spark):
    estate = sample_estate(spark, DATA)
    text = plan(rewrite.converted_files(estate.facts, estate.files))
    assert text.count(", @sproc)") == 1
    for line in re.findall(r"(?:SortAggregate|Sort) ?\(?.*|ShuffledHashJoin.*", text):
        assert "content" not in line
    assert "ShuffledHashJoin" in text


def test_texts_are_not_shuffled_before_they_are_classified(spark):
    text = plan(sample_estate(spark, DATA).facts)
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["warnings", "target_requirements"])
def test_saved_facts_spare_the_texts(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    for scan in re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*documents.parquet", plan(df).split("Initial Plan")[0]):
        assert "text" not in scan


def test_forecasts_in_bulk_have_no_single_task(spark):
    df = QUERIES["sales_forecast_batch"](spark, DATA)
    df.collect()
    text = plan(df).split("Initial Plan")[0]
    assert "SinglePartition" not in text and text.count("BroadcastHashJoin") >= 2


def test_targets_scan_the_texts_once(spark):
    targets = sample_estate(spark, DATA).targets
    targets.collect()
    final = plan(targets).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
