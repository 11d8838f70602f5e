"""Schemas of variant columns: which types each path has, a typed projection, and where rows drift from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight.session import shared_dir

#: What stands for the type of a row whose text is null, and of one whose text is no JSON.
MISSING, UNREADABLE = "MISSING", "UNREADABLE"

#: Column name -> (path, type).
Fields = Mapping[str, tuple[str, str]]


def variant_schema(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """The one schema that all JSON texts of a group fit, merged map-side; the whole table is one group by default."""
    merged = F.schema_of_variant_agg(F.try_parse_json(F.col(text))).alias("schema")
    return df.groupBy(*(by or [])).agg(F.count(text).alias("texts"), merged)


def path_types(df: DataFrame, text: str) -> DataFrame:
    """(path, type, rows) of everything in the JSON of a column; ``$`` is the whole value.

    Rows are first counted by shape, with one example of each. Shapes repeat, so what is left is small beside the rows
    (if keys are data it is not, and stays a distributed table). The examples are then taken apart one depth after another.
    An object has the type OBJECT and its keys follow; an array has the merged type of its elements, which have no
    path of their own. JSON's null is VOID. Keys that are no plain words are written ``['key']``.
    """
    spark = df.sparkSession
    value = F.try_parse_json(F.col(text))
    shape = F.when(F.col(text).isNull(), MISSING).when(value.isNull(), UNREADABLE).otherwise(F.schema_of_variant(value))
    shapes = df.select(shape.alias("shape"), value.alias("value")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.any_value("value").alias("value"))
    at = shared_dir(spark, "shapes")
    shapes.write.parquet(at)
    level = spark.read.schema(shapes.schema).parquet(at).select(F.lit("$").alias("path"), "shape", "n", "value")
    depths = []
    while not level.isEmpty():
        depths.append(level.select("path", F.when(F.col("shape").startswith("OBJECT<"), "OBJECT").otherwise(F.col("shape")).alias("type"), "n"))
        level = spark.sql(
            r"""
            SELECT concat(l.path, CASE WHEN e.key RLIKE '^[A-Za-z_][A-Za-z_0-9]*$' THEN concat('.', e.key) ELSE concat('[\'', e.key, '\']') END) AS path,
                   schema_of_variant(e.value) AS shape, l.n, e.value
            FROM {level} l, LATERAL variant_explode(l.value) e
            WHERE startswith(l.shape, 'OBJECT<')
            """,
            level=level,
        )
    if not depths:
        return spark.createDataFrame([], "path string, type string, rows bigint")
    found = depths[0]
    for depth in depths[1:]:
        found = found.unionByName(depth)
    return found.groupBy("path", "type").agg(F.sum("n").alias("rows"))


def _value(path: str) -> Column:
    return F.try_variant_get("__value", path, "variant")


def _present(path: str) -> Column:
    return _value(path).isNotNull() & ~F.is_variant_null(_value(path))


def _misfit(path: str, data_type: str) -> Column:
    return _present(path) & F.try_variant_get("__value", path, data_type).isNull()


def typed(df: DataFrame, text: str, fields: Fields, keep: list[str]) -> DataFrame:
    """The kept columns, a column for each field, and ``misfits``: the fields whose value cannot be cast to their type.

    A path that is absent, or JSON's null, is NULL and no misfit. Text that is no JSON has the misfit ``$``.
    """
    parsed = df.select(*keep, F.col(text).alias("__text"), F.try_parse_json(F.col(text)).alias("__value"))
    broken = F.when(F.col("__text").isNotNull() & F.col("__value").isNull(), "$")
    misfits = [F.when(_misfit(path, data_type), name) for name, (path, data_type) in fields.items()]
    columns = [F.try_variant_get("__value", path, data_type).alias(name) for name, (path, data_type) in fields.items()]
    return parsed.select(*keep, *columns, F.array_compact(F.array(broken, *misfits)).alias("misfits"))


def drift(df: DataFrame, text: str, fields: Fields) -> DataFrame:
    """One row a path: ``declared`` ones with the rows that have a value, that fit and that do not; others with their rows.

    Objects are no paths of their own here. The declared ones are counted in one aggregation over the rows.
    """
    parsed = df.select(F.try_parse_json(F.col(text)).alias("__value"))
    counts = [
        F.struct(
            F.lit(path).alias("path"),
            F.count_if(_present(path)).alias("present"),
            F.count_if(_misfit(path, data_type)).alias("misfits"),
        )
        for path, data_type in fields.values()
    ]
    declared = parsed.agg(F.array(*counts).alias("found")).select(F.inline("found")).withColumn("declared", F.lit(True))
    wanted = [path for path, _ in fields.values()]
    leaf = ~F.col("type").isin("OBJECT", "VOID", MISSING, UNREADABLE) & ~F.col("path").isin(wanted)
    others = path_types(df, text).filter(leaf).groupBy("path").agg(F.sum("rows").alias("present"))
    return declared.unionByName(others.select("path", "present", F.lit(None).cast("bigint").alias("misfits"), F.lit(False).alias("declared")))
