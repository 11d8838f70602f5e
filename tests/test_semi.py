from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from wayfreight.operators import semi


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, props string")


def test_extract_is_typed_and_forgiving(spark):
    df = frame(spark, '{"k": 1}', '{"k": "7"}', '{"k": "x"}', "not json", None, '{"j": 1}')
    got = df.select(semi.variant_extract(F.col("props"), "$.k", "int")).collect()
    assert [r[0] for r in got] == [1, 7, None, None, None, None]


def test_flatten_inner_and_outer(spark):
    df = frame(spark, '{"a": 1, "b": "x"}', "[10, 20]", "{}", None, "oops")
    assert rows(semi.flatten(df, "props", ["id"])) == [
        (0, 0, "a", "1"), (0, 1, "b", "x"), (1, 0, None, "10"), (1, 1, None, "20"),
    ]
    outer = rows(semi.flatten(df, "props", ["id"], outer=True))
    assert [r[0] for r in outer] == [0, 0, 1, 1, 2, 3, 4]


def test_lateral_flatten_totals(spark):
    df = frame(spark, '{"a": 1, "b": 2}', '{"a": 5}', '{"a": "word"}').withColumn("g", F.lit("x"))
    assert rows(semi.lateral_flatten(df, "props", "g")) == [("x", "a", 3, 6), ("x", "b", 1, 2)]


def test_array_positions(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],), ([],), (None,), ([None, 4.0],)], "e array<float>")
    assert rows(semi.array_flatten_agg(df, "e")) == [(0, 2, 2.0, 1.0, 3.0), (1, 2, 3.0, 2.0, 4.0)]
