"""From raw bytes to the decoded file table every estate operator reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions.text import base_name, unix_lines


def kind_of(path: Column) -> Column:
    """python, sql, requirements, manifest (application root only) or other; case-sensitive."""
    return (
        F.when(path.endswith(rules.PYTHON_SUFFIX), "python")
        .when(path.endswith(rules.SQL_SUFFIX), "sql")
        .when(base_name(path) == rules.REQUIREMENTS_NAME, "requirements")
        .when(path.isin(*rules.MANIFEST_NAMES), "manifest")
        .otherwise("other")
    )


def select_sources(listing: DataFrame) -> DataFrame:
    """Keep what the estate reads. Works on a listing (before any file is opened) or on file rows."""
    return listing.withColumn("kind", kind_of(F.col("path"))).filter(F.col("kind") != "other")


def decode_files(raw: DataFrame) -> DataFrame:
    """Strict UTF-8 decode: ``app_id, path, kind, readable, content``.

    A file that is not UTF-8 keeps its row with ``readable = false`` and NULL content; one bad file
    never fails the job, and it is still counted as a Python or SQL file.
    """
    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    kept = raw if "kind" in raw.columns else select_sources(raw)
    return kept.select(
        "app_id",
        "path",
        "kind",
        F.coalesce(readable, F.lit(False)).alias("readable"),
        F.when(readable, unix_lines(text)).alias("content"),
    )


def read_errors(files: DataFrame) -> DataFrame:
    """Quarantine: one row per file that could not be decoded."""
    return files.filter(~F.col("readable")).select("app_id", "path", "kind")
