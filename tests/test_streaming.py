from __future__ import annotations

import pytest

from wayfreight.streaming.load import copy_into


def test_reruns_add_nothing_and_new_files_are_added_once(spark, tmp_path):
    drop, target, checkpoint = (str(tmp_path / n) for n in ("drop", "target", "checkpoint"))
    schema = "id bigint, text string"

    def load():
        copy_into(spark, drop, target, checkpoint, schema, file_format="json", name_pattern="*.json", files_per_batch=2)
        return sorted(r.id for r in spark.read.schema(schema).parquet(target).collect())

    def deliver(start, n):
        spark.range(start, start + n).selectExpr("id", "'x' AS text").repartition(3).write.mode("append").json(drop)

    deliver(0, 9)
    assert load() == list(range(9))
    assert load() == list(range(9))
    deliver(9, 3)
    (tmp_path / "drop" / "ignored.csv").write_text("1,2")
    assert load() == list(range(12))


def test_a_table_of_several_files_loads_whole(spark, tmp_path):
    table, target, checkpoint = (str(tmp_path / n) for n in ("events.parquet", "target", "checkpoint"))
    spark.range(90).repartition(3).write.parquet(table)
    copy_into(spark, table, target, checkpoint, "id bigint")
    assert spark.read.parquet(target).count() == 90


def test_a_source_without_files_is_an_error(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        copy_into(spark, str(tmp_path / "empty"), str(tmp_path / "t"), str(tmp_path / "c"), "id bigint")
