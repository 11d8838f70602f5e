"""Whole-estate plans: analysis report and its sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.operators import appfacts, classify, deps, manifest, rewrite

Source = DataFrame | Callable[[], DataFrame]


class Estate:
    """One estate: decoded files, decoded manifest files and application folders.

    The inputs may be DataFrames or functions that make them; every derived table is built on first
    use. All of it stays lazy, nothing here runs a job.
    """

    def __init__(self, files: Source, manifest_files: Source, apps: Source, unlisted: DataFrame | None = None, strict: bool = False):
        """``unlisted`` has warnings of folders that could not be read, if the files come from a tree.
        ``strict`` asks for a word boundary before UI markers.
        """
        self._sources = {"files": files, "manifest_files": manifest_files, "apps": apps}
        self.unlisted = unlisted
        self.strict = strict

    def _source(self, name: str) -> DataFrame:
        source = self._sources[name]
        return source() if callable(source) else source

    @cached_property
    def files(self) -> DataFrame:
        return self._source("files")

    @cached_property
    def manifest_files(self) -> DataFrame:
        return self._source("manifest_files")

    @cached_property
    def apps(self) -> DataFrame:
        return self._source("apps")

    @cached_property
    def facts_with_content(self) -> DataFrame:
        return classify.file_facts(self.files, strict=self.strict, keep_content=True)

    @cached_property
    def facts(self) -> DataFrame:
        return self.facts_with_content.drop("content")

    @cached_property
    def app_facts(self) -> DataFrame:
        """Facts of every application, also of those without files."""
        return appfacts.app_facts(self.facts, self.apps)

    @cached_property
    def active_app_facts(self) -> DataFrame:
        """Facts of applications that have files; no join with the application list."""
        return appfacts.app_facts(self.facts)

    @cached_property
    def dependencies(self) -> DataFrame:
        """From the facts where they are saved and hold packages, so that no text is read again."""
        if "packages" in self.facts.columns:
            return self.facts.select("app_id", F.explode("packages").alias("package")).distinct()
        return deps.dependency_set(self.files)

    @cached_property
    def manifests(self) -> DataFrame:
        return manifest.parse_manifests(self.manifest_files)

    @cached_property
    def catalog(self) -> DataFrame:
        return manifest.manifest_catalog(self.apps, self.manifests)

    @cached_property
    def privileges(self) -> DataFrame:
        return manifest.manifest_privileges(self.manifests)

    @cached_property
    def warnings(self) -> DataFrame:
        found = appfacts.warnings(self.facts, self.app_facts, self.catalog)
        return found if self.unlisted is None else found.unionByName(self.unlisted)

    @cached_property
    def targets(self) -> DataFrame:
        return rewrite.target_paths(self.facts)


def analysis_report(estate: Estate) -> DataFrame:
    """One row per application with the twelve report fields.

    The corpus is scanned once and shuffled once, as partial aggregates by application. All nested
    fields are bounded by the number of rules: ``warnings`` holds how often each warning code
    applies, and the individual warnings (one per unreadable file, so without bound) are the long
    :func:`wayfreight.operators.appfacts.warnings` table.
    """
    guarded = appfacts.with_advice_guards(estate.app_facts, estate.catalog)
    used = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(F.lit(label).alias("feature"), F.col(column).alias("uses"))
                    for label, _, column in rules.API_FEATURES
                ]
            ),
            lambda e: e["uses"] > 0,
        )
    )

    def warning(code: str, n) -> F.Column:
        return F.when(n > 0, F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n")))

    def flag(test) -> F.Column:
        return F.when(test, 1).otherwise(0)

    warned = F.array_compact(
        F.array(
            warning("manifest_missing", flag(F.col("status") == "missing")),
            warning("manifest_invalid", flag(F.col("status") == "invalid")),
            warning("file_unreadable", F.col("unreadable_files")),
            warning("requirements_unreadable", F.col("unreadable_requirements")),
            warning("heavy_usage", flag(F.col("api_usage_total") > rules.HEAVY_USAGE_ABOVE)),
        )
    )
    return guarded.select(
        F.col("app_id").alias("app_name"),
        "migration_complexity",
        "components",
        "python_files",
        "sql_files",
        "has_streamlit",
        "has_api",
        "has_stored_procedures",
        "has_udfs",
        used.alias("api_usage"),
        warned.alias("warnings"),
        F.transform(appfacts.advice(), lambda a: a["text"]).alias("recommendations"),
    )


def report_as_text(report: DataFrame) -> DataFrame:
    """The report with its nested fields as sorted, joined text, for flat sinks."""
    usage = F.transform(F.map_entries("api_usage"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    warned = F.transform("warnings", lambda w: F.concat(w["code"], F.lit("="), w["n"]))
    return report.withColumns(
        {
            "api_usage": F.array_join(F.array_sort(usage), "; "),
            "warnings": F.array_join(F.array_sort(warned), "; "),
            "recommendations": F.array_join("recommendations", "; "),
        }
    )
