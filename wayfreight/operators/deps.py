"""Dependency lists: parse requirement files, keep what survives the move, list what is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions.text import strip
from wayfreight.session import shared_dir


def requirement_lines(content: Column) -> Column:
    """The lines that name a package: stripped, not blank, not a comment (array<string>)."""
    # Comments that start the line need no stripping, and files full of them are common.
    lines = F.filter(F.split(content, "\n"), lambda line: (line != "") & ~line.startswith("#"))
    return F.filter(F.transform(lines, strip), lambda line: (line != "") & ~line.startswith("#"))


def package_name(line: Column) -> Column:
    """What stands before ``==``, ``>=`` and ``<=``, cut in that order; other operators stay in."""
    for operator in ("==", ">=", "<="):
        line = F.substring_index(line, operator, 1)
    return strip(line)


def packages(content: Column) -> Column:
    return F.array_distinct(F.transform(requirement_lines(content), package_name))


def line_filter(files: DataFrame) -> DataFrame:
    """Requirement lines that survive the comment and blank filter, with their 1-based line number."""
    lines = F.posexplode(F.split("content", "\n")).alias("pos", "raw_line")
    line = strip(F.col("raw_line"))
    return (
        files.filter((F.col("kind") == "requirements") & F.col("readable"))
        .select("app_id", "path", lines)
        .select("app_id", "path", (F.col("pos") + 1).alias("line_no"), line.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    )


def requirements_parse(files: DataFrame) -> DataFrame:
    """One row per named package and requirement file line."""
    return line_filter(files).select("app_id", "path", "line_no", package_name(F.col("line")).alias("package"))


def dependency_set(files: DataFrame) -> DataFrame:
    """Distinct packages per application, one row each.

    Kept long on purpose: the partial distinct runs before the shuffle on (app_id, package), so no
    task ever holds all packages of one application.
    """
    lists = files.filter((F.col("kind") == "requirements") & F.col("readable"))
    return lists.select("app_id", F.explode(packages(F.col("content"))).alias("package")).distinct()


def dependency_drop(dependencies: DataFrame) -> DataFrame:
    """Dependencies that are carried over: not the source platform's, not ones the target re-adds."""
    package = F.col("package")
    dropped = package.isin(*rules.DROP_EXACT)
    for part in rules.DROP_CONTAINING:
        dropped = dropped | package.contains(part)
    return dependencies.filter(~dropped)


def target_requirements(app_facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Requirement lines of the migrated application, one row each.

    The lines added here all hold ``>=`` and a carried package name never does (it was cut there), so
    the two sets cannot overlap and the union of two distinct sets needs no further distinct.
    """
    added = app_facts.select(
        "app_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit(rules.REQ_ALWAYS),
                    F.when(F.col("has_streamlit"), rules.REQ_UI),
                    F.when(F.col("has_api"), rules.REQ_API),
                    F.when(F.col("has_api_usage"), rules.REQ_USAGE),
                )
            )
        ).alias("requirement"),
    )
    carried = dependency_drop(dependencies).select("app_id", F.col("package").alias("requirement"))
    return added.unionByName(carried)


def ordered_requirements(requirements: DataFrame) -> DataFrame:
    """The requirement lines of each application with their place in its sorted list, from 1.

    All rows are sorted once, by application and line, so an application with a third of all lines is
    spread over as many tasks as it fills. Places then follow from row numbers inside the sorted
    partitions and from how many rows of the application the partitions before hold: one narrow row
    for each partition and application, which is combined before it is shuffled.
    """
    placed = requirements.orderBy("app_id", "requirement").select(
        "app_id", "requirement", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    )
    placed = _kept(placed)
    parts = placed.groupBy("app_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row for each partition that an application reaches: many only for an application that fills many.
    before = Window.partitionBy("app_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("app_id").alias("start_app"), F.col("part").alias("start_part"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    same = F.col("app_id").eqNullSafe(F.col("start_app")) & (F.col("part") == F.col("start_part"))
    return placed.join(starts, same).select(
        "app_id", (F.col("earlier") + F.col("at") - F.col("first") + 1).alias("line_no"), "requirement"
    )


def _kept(df: DataFrame) -> DataFrame:
    at = shared_dir(df.sparkSession, "requirements")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
