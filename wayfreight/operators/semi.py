"""Replacements for the semi-structured constructs the classifier flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_extract(text: Column, path: str, data_type: str) -> Column:
    """Typed value at a path of JSON text; NULL for text that is not JSON or does not fit the type."""
    return F.try_variant_get(F.try_parse_json(text), path, data_type)


def flatten(df: DataFrame, text: str, keep: list[str], outer: bool = False) -> DataFrame:
    """Rows (position, key, value) of a JSON object or array; empty or NULL gives none unless ``outer``."""
    how = "variant_explode_outer" if outer else "variant_explode"
    columns = ", ".join(f"d.`{c}`" for c in keep)
    return df.sparkSession.sql(
        f"""
        SELECT {columns}, CAST(f.pos AS INT) AS position, f.key, CAST(f.value AS STRING) AS value
        FROM {{d}} d, LATERAL {how}(try_parse_json(d.`{text}`)) f
        """,
        d=df,
    )


def lateral_flatten(df: DataFrame, text: str, by: str) -> DataFrame:
    """Flatten next to the row it came from, then total the numeric values per group and key."""
    return (
        flatten(df, text, [by])
        .groupBy(by, "key")
        .agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(value AS BIGINT)")).alias("total"))
    )


def array_flatten_agg(df: DataFrame, array: str) -> DataFrame:
    """Aggregate a numeric array column by position. The partial aggregate runs before the shuffle."""
    return (
        df.select(F.posexplode(array).alias("position", "value"))
        .groupBy("position")
        .agg(
            F.count("value").alias("n"),
            F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"),
            F.min(F.col("value").cast("double")).alias("low"),
            F.max(F.col("value").cast("double")).alias("high"),
        )
    )
