"""Application-level facts: one aggregation of the file facts by application, then arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.operators.classify import USAGE_COLUMNS


def _plus(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def app_facts(facts: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """Counts, flags, usage, score and level of every application.

    One shuffle on ``app_id`` of partially aggregated rows: every aggregate here combines map-side, so
    an application that owns a third of all files sends one row per map task, not a third of them.
    ``apps`` lists all application folders; those without files then appear with zeros.
    """
    component = F.col("is_component")
    kind = F.col("kind")
    summary = facts.groupBy("app_id").agg(
        F.count_if(kind == "python").alias("python_files"),
        F.count_if(kind == "sql").alias("sql_files"),
        F.count_if(component).alias("components"),
        F.count_if("is_ui").alias("ui_pages"),
        F.count_if(~F.col("readable") & kind.isin("python", "sql")).alias("unreadable_files"),
        F.count_if(~F.col("readable") & (kind == "requirements")).alias("unreadable_requirements"),
        _any(F.col("is_ui")).alias("has_streamlit"),
        _any(F.col("is_api")).alias("has_api"),
        _any(F.col("is_procedure")).alias("has_stored_procedures"),
        _any(F.col("is_udf")).alias("has_udfs"),
        _any(F.col("needs_connector")).alias("needs_connector"),
        _any(F.col("needs_snowpark")).alias("needs_snowpark"),
        *[F.sum(c).alias(c) for c in USAGE_COLUMNS],
    )
    if apps is not None:
        zeros = {
            f.name: (False if f.dataType.typeName() == "boolean" else 0)
            for f in summary.schema
            if f.name != "app_id"
        }
        summary = apps.join(summary, "app_id", "left").fillna(zeros)
    return with_score(summary)


def with_score(summary: DataFrame) -> DataFrame:
    """Usage total, score, level and application type from the counts and flags."""
    total = _plus([F.col(c) for c in USAGE_COLUMNS])
    features = _plus([(F.col(c) > 0).cast("int") for c in USAGE_COLUMNS])

    def points(flag: str, n: int) -> Column:
        return F.when(F.col(flag), n).otherwise(0)

    score = (
        points("has_streamlit", rules.SCORE_UI)
        + points("has_api", rules.SCORE_API)
        + points("has_stored_procedures", rules.SCORE_PROCEDURES)
        + points("has_udfs", rules.SCORE_UDFS)
        + F.least(F.col("features"), F.lit(rules.SCORE_FEATURE_CAP))
        + F.least(F.col("sql_files"), F.lit(rules.SCORE_SQL_CAP))
    )
    level = (
        F.when(F.col("score") <= rules.LOW_UP_TO, "low")
        .when(F.col("score") <= rules.MEDIUM_UP_TO, "medium")
        .otherwise("high")
    )
    return (
        summary.withColumns({"api_usage_total": total, "features": features})
        .withColumn("score", score.cast("int"))
        .withColumns(
            {
                "migration_complexity": level,
                "app_type": app_type(),
                "has_api_usage": F.col("api_usage_total") > 0,
            }
        )
    )


def app_type() -> Column:
    """A UI outranks an API here, the other way round than for single files."""
    return F.when(F.col("has_streamlit"), "Streamlit").when(F.col("has_api"), "API").otherwise("Generic")


def app_summary(app_facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Counts and flags per application, with the number of distinct dependencies.

    The packages themselves stay in the long ``dependency_set`` table, whose size per application
    has no bound.
    """
    counted = dependencies.groupBy("app_id").agg(F.count("*").alias("dependencies"))
    return app_facts.join(counted, "app_id", "left").select(
        "app_id",
        "python_files",
        "sql_files",
        "ui_pages",
        "components",
        "has_streamlit",
        "has_api",
        "has_stored_procedures",
        "has_udfs",
        F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
    )


def api_usage(app_facts: DataFrame) -> DataFrame:
    """Uses per application and feature, long; features never used give no row."""
    counts = F.array(
        *[
            F.struct(F.lit(label).alias("feature"), F.col(column).alias("uses"))
            for label, _, column in rules.API_FEATURES
        ]
    )
    return app_facts.select("app_id", F.inline(counts)).filter(F.col("uses") > 0)


def usage_total(app_facts: DataFrame) -> DataFrame:
    """Total uses per application that has any, and whether that is heavy use."""
    return app_facts.filter("has_api_usage").select(
        "app_id", "api_usage_total", (F.col("api_usage_total") > rules.HEAVY_USAGE_ABOVE).alias("heavy")
    )


def complexity_score(app_facts: DataFrame) -> DataFrame:
    return app_facts.select("app_id", "features", "sql_files", "score", "migration_complexity")


def app_names(apps: DataFrame) -> DataFrame:
    """Target identifiers: slug with underscores, catalog name with its blanks kept."""
    lower = F.lower("app_id")
    return apps.select(
        "app_id",
        F.replace(lower, F.lit(" "), F.lit("_")).alias("slug"),
        F.concat(lower, F.lit("_catalog")).alias("catalog"),
    )


def estate_rollup(app_facts: DataFrame) -> DataFrame:
    """Applications by level and type."""
    return app_facts.groupBy("migration_complexity", "app_type").agg(
        F.count("*").alias("apps"),
        F.sum("components").alias("components"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


def warnings(facts: DataFrame, app_facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per warning: manifest missing or invalid, unreadable file, heavy usage."""
    no_path = F.lit(None).cast("string")
    manifest = catalog.filter(F.col("status") != "ok").select(
        "app_id",
        F.concat(F.lit("manifest_"), F.col("status")).alias("code"),
        F.col("file_name").alias("path"),
        F.col("error").alias("detail"),
    )
    unreadable = facts.filter(~F.col("readable") & F.col("kind").isin("python", "sql", "requirements")).select(
        "app_id",
        F.when(F.col("kind") == "requirements", "requirements_unreadable").otherwise("file_unreadable").alias("code"),
        "path",
        F.lit("not UTF-8").alias("detail"),
    )
    heavy = app_facts.filter(F.col("api_usage_total") > rules.HEAVY_USAGE_ABOVE).select(
        "app_id",
        F.lit("heavy_usage").alias("code"),
        no_path.alias("path"),
        F.col("api_usage_total").cast("string").alias("detail"),
    )
    return manifest.unionByName(unreadable).unionByName(heavy)


def advice() -> Column:
    """Ordered recommendation structs of one application (at most one per rule)."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(guard),
                    F.struct(F.lit(seq).alias("seq"), F.lit(code).alias("code"), F.lit(text).alias("text")),
                )
                for seq, (code, guard, text) in enumerate(rules.ADVICE, start=1)
            ]
        )
    )


def with_advice_guards(app_facts: DataFrame, catalog: DataFrame) -> DataFrame:
    return (
        app_facts.join(catalog.select("app_id", "status", "has_privileges"), "app_id", "left")
        .withColumn("has_privileges", F.coalesce("has_privileges", F.lit(False)))
        .withColumn("is_high", F.col("migration_complexity") == "high")
    )


def recommendations(app_facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Recommendation rows per application, in a fixed order."""
    return with_advice_guards(app_facts, catalog).select("app_id", F.inline(advice()))
