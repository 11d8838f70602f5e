from __future__ import annotations

import pytest

from odd_rows import documents, nothing, tricky  # noqa: F401

from wayfreight.llm import common


@pytest.mark.parametrize("most", [common.MOST_BROADCAST_IDS, 0])
def test_rows_with_other_ids_stay(spark, tricky, nothing, monkeypatch, most):
    """The same rows stay, clashing columns as they are, whether ids are broadcast or their filter is."""
    monkeypatch.setattr(common, "MOST_BROADCAST_IDS", most)
    ids = spark.createDataFrame([(3,), (11,), (11,), (None,), (99,)], "doc_id long")
    rows = tricky.withColumns({"value": tricky.doc_id, "row": tricky.text, "word0": tricky.doc_id, "slot1": tricky.doc_id, "bits0": tricky.doc_id})
    left = common.without(rows, ids, "doc_id")
    assert left.columns == rows.columns
    wanted = rows.filter("doc_id IS NULL OR doc_id NOT IN (3, 11)")
    assert left.exceptAll(wanted).isEmpty() and wanted.exceptAll(left).isEmpty()
    assert common.without(nothing, ids, "doc_id").count() == 0
    assert common.without(tricky, ids.limit(0), "doc_id").count() == tricky.count()


def test_only_rows_that_may_go_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST_IDS", 0)
    docs = common.stored(spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), "test-docs")
    ids = common.stored(spark.range(0, 20_000, 97).toDF("doc_id"), "test-ids")
    left = common.without(docs, ids, "doc_id")
    assert left.count() == 20_000 - ids.count()
    unsure, certain = common.split_among(docs, "doc_id", ids, "doc_id")
    assert unsure.count() + certain.count() == 20_000
    assert ids.count() <= unsure.count() < 2 * ids.count() + 400
    plan = left._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    certain_part = plan.split("SortMergeJoin")[0]
    assert certain_part.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in certain_part
