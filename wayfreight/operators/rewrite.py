"""Bulk rewriting of source text and the layout it is written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions.rows import keep_if
from wayfreight.functions.text import contains_any, count_literal, first_lines, swap
from wayfreight.operators.classify import file_facts

PYTHON_TYPES = ("python", "api")
WRITTEN_TYPES = ("streamlit", "python", "api", "sql")


def rewrite_ui(content: Column) -> Column:
    """The six ordered replacements of a UI file, without the helper."""
    for old, new in rules.UI_REWRITES:
        content = swap(content, old, new)
    return content


def with_helper(rewritten: Column) -> Column:
    """Prepend the connection helper where the rewritten text connects and has none yet."""
    wanted = rewritten.contains(rules.HELPER_CALL) & ~rewritten.contains(rules.HELPER_NAME)
    return F.when(wanted, F.concat(F.lit(rules.CONNECTION_HELPER), rewritten)).otherwise(rewritten)


def rewrite_py(content: Column) -> Column:
    """Replacements of an ordinary Python file; text that never says ``snowpark`` is left alone."""
    changed = F.regexp_replace(content, rules.PY_IMPORT_PATTERN, rules.PY_IMPORT_TARGET)
    for old, new in rules.PY_REWRITES:
        changed = swap(changed, old, new)
    return F.when(content.contains(rules.PY_REWRITE_GUARD), changed).otherwise(content)


def stamp_sql(path: Column, content: Column) -> Column:
    """A header that names the source path; the body is unchanged."""
    return F.concat(F.lit("-- Source file: "), path, F.lit("\n" + rules.SQL_STAMP_TAIL), content)


def target_path() -> Column:
    """Where a component is written; NULL for types that are never written and for empty files."""
    path, name = F.col("path"), F.col("name")
    placed = (
        F.when(
            F.col("type") == "streamlit",
            F.when(path.contains(rules.PAGES_PART), F.concat(F.lit("src/"), path)).otherwise(rules.UI_TARGET),
        )
        .when(F.col("type").isin(*PYTHON_TYPES), F.concat(F.lit("src/"), name))
        .when(F.col("type") == "sql", F.concat(F.lit("databricks/"), name))
    )
    return F.when(~F.col("is_empty"), placed)


def with_target(facts: DataFrame, *through: str) -> DataFrame:
    """Components that have a target, with type and target; other files give no row."""
    target = target_path()
    return keep_if(
        facts,
        target.isNotNull(),
        derived=[F.col("type"), target.alias("target_path")],
        through=["app_id", "path", *through],
    )


def target_collisions(facts: DataFrame) -> DataFrame:
    """One row per target: how many sources claim it and which one wins (the highest path).

    ``max`` and ``count`` combine map-side, so a target claimed by millions of files of one
    application still shuffles one row per map task.
    """
    return (
        with_target(facts)
        .groupBy("app_id", "target_path")
        .agg(F.max("path").alias("path"), F.count("*").alias("sources"))
    )


def target_paths(facts: DataFrame) -> DataFrame:
    """Target and status of every component.

    The winners are joined back on (app_id, path), which is unique, instead of ranking inside
    (app_id, target_path), where one target may attract most of an application's files.

    Both sides of that join come from one shuffle of the narrow rows, so the texts are scanned and
    classified once. For Spark to reuse that exchange, both sides must ask the same of it: that is why
    the winner carries the whole row and empty targets are dropped after the aggregation.
    """
    row = ["path", "type", "complexity", "is_empty"]
    placed = (
        facts.filter("is_component AND app_id IS NOT NULL AND path IS NOT NULL")
        .select("app_id", *row, target_path().alias("target_path"))
        .repartition("app_id", "path")
    )
    winners = (
        placed.groupBy("app_id", "target_path")
        .agg(F.max(F.struct(*row)).alias("winner"), F.count("target_path").alias("sources"))
        .filter(F.col("sources") > 0)
        .select("app_id", F.col("winner.path").alias("path"), "sources")
    )
    status = (
        F.when(~F.col("type").isin(*WRITTEN_TYPES), "skipped_type")
        .when(F.col("is_empty"), "skipped_empty")
        .when(F.col("sources").isNull(), "lost_to_collision")
        .otherwise("written")
    )
    return placed.join(winners, ["app_id", "path"], "left").select(
        "app_id", "path", "type", "complexity", "target_path", status.alias("status"), "sources"
    )


def skip_empty(facts: DataFrame) -> DataFrame:
    """Components of a written type, marked by whether they have any text to convert."""
    status = F.when(F.col("is_empty"), "skipped_empty").otherwise("converted")
    return keep_if(
        facts,
        F.col("type").isin(*WRITTEN_TYPES),
        derived=[F.col("type"), status.alias("status")],
        through=["app_id", "path"],
    )


def conversion_coverage(targets: DataFrame, by: str = "app_id") -> DataFrame:
    """Components claimed, written and lost, per application or per any other target column."""
    status = F.col("status")
    return targets.groupBy(by).agg(
        F.count("*").alias("components"),
        F.count_if(status == "written").alias("written"),
        F.count_if(status == "skipped_type").alias("skipped_type"),
        F.count_if(status == "skipped_empty").alias("skipped_empty"),
        F.count_if(status == "lost_to_collision").alias("lost_to_collision"),
    )


def rewrite_targets(targets: DataFrame) -> DataFrame:
    """Rewritten text of rows ``app_id, path, type, target_path, content``. No shuffle."""
    kind, content = F.col("type"), F.col("content")
    # Two projections: the helper test reads the rewritten text twice and must not rewrite it twice.
    return (
        targets.withColumn(
            "content",
            F.when(kind == "streamlit", rewrite_ui(content))
            .when(kind.isin(*PYTHON_TYPES), rewrite_py(content))
            .otherwise(stamp_sql(F.col("path"), content)),
        )
        .withColumn("content", F.when(kind == "streamlit", with_helper(content)).otherwise(content))
        .select("app_id", "path", "type", "target_path", "content")
    )


def convert_each(facts_with_content: DataFrame) -> DataFrame:
    """Every convertible file rewritten, before collisions are resolved."""
    return rewrite_targets(with_target(facts_with_content, "content"))


def converted_files(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The files that are really written: one winner per target, rewritten.

    Winners are picked on narrow rows; their texts are then fetched by the unique (app_id, path), with
    the winners as the side that is built. Texts are neither classified a second time nor sorted, and
    those that lost or are not written are not rewritten.
    """
    winners = (
        with_target(facts)
        .groupBy("app_id", "target_path")
        .agg(F.max(F.struct("path", "type")).alias("winner"))
        .select(F.col("app_id").alias("won_app"), "target_path", F.col("winner.path").alias("won_path"), F.col("winner.type").alias("type"))
    )
    texts = files.select("app_id", "path", "content")
    same = (F.col("app_id") == F.col("won_app")) & (F.col("path") == F.col("won_path"))
    met = texts.join(winners.hint("shuffle_hash"), same)
    return rewrite_targets(met.select("app_id", "path", "type", "target_path", "content"))


def write_converted(converted: DataFrame, path: str) -> None:
    """Converted files as Parquet rows.

    They come out of an aggregation on unique keys, so the partitions are even and AQE has sized
    them already; clustering by application would shuffle all texts once more, and one folder per
    application would give applications times tasks many small files.
    """
    converted.write.mode("overwrite").parquet(path)


def rewrite_hits(files: DataFrame) -> DataFrame:
    """Replacements per application and rule, each counted on the text its rule gets to see."""
    # Every rule needs one of these parts in the untouched text; other files cannot have a hit, so
    # they leave the plan before anything is classified.
    candidates = files.filter(contains_any(F.col("content"), rules.REWRITE_PARTS))
    content = F.col("content")
    ui = F.col("type") == "streamlit"
    py = F.col("type").isin(*PYTHON_TYPES) & content.contains(rules.PY_REWRITE_GUARD)
    step = file_facts(candidates, keep_content=True).filter("is_component").select(
        "app_id", F.when(ui, "streamlit").when(py, "python").alias("type"), "content"
    )
    counted: list[tuple[str, str]] = []
    for n, (old, new) in enumerate(rules.UI_REWRITES, start=1):
        column = f"ui_{n}"
        is_ui = F.col("type") == "streamlit"
        step = step.withColumn(column, F.when(is_ui, count_literal(content, old)))
        step = step.withColumn("content", F.when(is_ui, swap(content, old, new)).otherwise(content))
        counted.append((f"ui: {old}", column))
    is_py = F.col("type") == "python"
    step = step.withColumn("py_1", F.when(is_py, F.regexp_count(content, F.lit(rules.PY_IMPORT_PATTERN))))
    step = step.withColumn(
        "content",
        F.when(is_py, F.regexp_replace(content, rules.PY_IMPORT_PATTERN, rules.PY_IMPORT_TARGET)).otherwise(content),
    )
    counted.append(("py: from snowflake.snowpark import", "py_1"))
    for n, (old, new) in enumerate(rules.PY_REWRITES, start=2):
        column = f"py_{n}"
        step = step.withColumn(column, F.when(is_py, count_literal(content, old)))
        step = step.withColumn("content", F.when(is_py, swap(content, old, new)).otherwise(content))
        counted.append((f"py: {old}", column))
    sums = step.groupBy("app_id").agg(*[F.sum(column).alias(column) for _, column in counted])
    long = F.array(
        *[F.struct(F.lit(label).alias("rule"), F.col(column).cast("bigint").alias("hits")) for label, column in counted]
    )
    return sums.select("app_id", F.inline(long)).filter(F.col("hits") > 0)


def file_preview(converted: DataFrame, lines: int = 10) -> DataFrame:
    """The first lines of every converted file."""
    return converted.select("app_id", "target_path", first_lines(F.col("content"), lines).alias("preview"))
