from __future__ import annotations

from conftest import rows

from wayfreight.operators import variants

TEXTS = ['{"a":{"b":[1,2],"c.d":1.5}}', '{"a":{"b":[1,"x"],"c.d":null}}', '{"a":[]}', "[1]", "3", "null", "{", "", None, '{"a":{"b":[1,2],"c.d":1.5}}']


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")


def test_types_of_paths(spark):
    assert rows(variants.path_types(frame(spark, TEXTS), "t")) == sorted(
        [
            ("$", "OBJECT", 4), ("$", "ARRAY<BIGINT>", 1), ("$", "BIGINT", 1), ("$", "VOID", 1), ("$", "UNREADABLE", 2), ("$", "MISSING", 1),
            ("$.a", "OBJECT", 3), ("$.a", "ARRAY<VOID>", 1), ("$.a.b", "ARRAY<BIGINT>", 2), ("$.a.b", "ARRAY<VARIANT>", 1),
            ("$.a['c.d']", "DECIMAL(2,1)", 2), ("$.a['c.d']", "VOID", 1),
        ],
        key=str,
    )


def test_typed_rows_and_misfits(spark):
    fields = {"n": ("$.n", "int"), "d": ("$.o.d", "date")}
    texts = ['{"n":1,"o":{"d":"2020-02-03"}}', '{"n":"2","o":{"d":"soon"}}', '{"n":[1],"o":7}', '{"n":null}', "{", None]
    found = variants.typed(frame(spark, texts), "t", fields, ["k"]).orderBy("k").collect()
    assert [(r.n, str(r.d), r.misfits) for r in found] == [
        (1, "2020-02-03", []), (2, "None", ["d"]), (None, "None", ["n"]), (None, "None", []), (None, "None", ["$"]), (None, "None", []),
    ]
    report = variants.drift(frame(spark, texts), "t", fields)
    assert rows(report, "path", "present", "misfits", "declared") == [("$.n", 3, 1, True), ("$.o", 1, None, False), ("$.o.d", 2, 1, True)]


def test_empty_table(spark):
    nothing = frame(spark, [])
    assert variants.path_types(nothing, "t").count() == 0
    assert variants.variant_schema(nothing, "t").first().texts == 0
    assert rows(variants.drift(nothing, "t", {"n": ("$.n", "int")})) == [("$.n", 0, 0, True)]


def test_examples_are_counted_by_shape_before_they_are_taken_apart(spark):
    many = spark.range(2000).selectExpr("id", "concat('{\"a\":', id, ',\"b\":{\"c\":\"', id, '\"}}') AS t")
    assert rows(variants.path_types(many, "t")) == [("$", "OBJECT", 2000), ("$.a", "BIGINT", 2000), ("$.b", "OBJECT", 2000), ("$.b.c", "STRING", 2000)]
