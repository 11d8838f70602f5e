"""The whole journey: scan a tree of applications, analyse it, convert it, and write every result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.operators import appfacts, classify, deps, manifest, rewrite
from wayfreight.plans.estate import Estate, analysis_report
from wayfreight.session import qualified, shared_dir
from wayfreight.sources import tree
from wayfreight.sources.files import decode_files


def estate_of_tree(spark: SparkSession, root: str, strict: bool = False) -> Estate:
    """An estate read from ``root/<application>/...``.

    The many small files are opened once; the corpus is kept as a table in the shared folder and
    everything later reads that.
    """
    if "://" not in root and not root.startswith("file:"):
        root = qualified(spark, root)
    listing = tree.list_tree(spark, root)
    at = shared_dir(spark, "corpus")
    decode_files(tree.read_tree(spark, root, listing)).write.parquet(at)
    files = spark.read.parquet(at)
    return Estate(
        files=files.filter(F.col("kind") != "manifest"),
        manifest_files=files.filter(F.col("kind") == "manifest"),
        apps=tree.apps_of(listing),
        unlisted=tree.unlisted(listing),
        strict=strict,
    )


def with_saved_facts(estate: Estate, *names: str) -> Estate:
    """The same estate with derived tables, all or the named, read back from the shared folder.

    Several results are made from them. Facts and manifests are narrow, the texts are not, so the
    corpus is read and classified once for all of them, and a lost executor costs no re-scan. Saved
    facts also hold the packages of requirement files, from which the dependencies follow.
    """
    spark = estate.files.sparkSession
    saved = Estate(estate.files, estate.manifest_files, estate.apps, estate.unlisted, estate.strict)
    for name in names or ("facts", "manifests", "dependencies"):
        at = shared_dir(spark, name)
        if name == "facts":
            lists = (F.col("kind") == "requirements") & F.col("readable")
            packages = F.when(lists, deps.packages(F.col("content"))).alias("packages")
            estate.facts_with_content.select("*", packages).drop("content").write.parquet(at)
        else:
            getattr(saved, name).write.parquet(at)
        saved.__dict__[name] = spark.read.parquet(at)
    return saved


def results(estate: Estate, convert: bool = True) -> dict[str, DataFrame]:
    """Every result table by name; analysis only when ``convert`` is off."""
    analysed = {
        "report": analysis_report(estate),
        "warnings": estate.warnings,
        "recommendations": appfacts.recommendations(estate.app_facts, estate.catalog),
        "components": classify.components(estate.facts),
        "dependencies": estate.dependencies,
        "summary": appfacts.app_summary(estate.app_facts, estate.dependencies),
        "rollup": appfacts.estate_rollup(estate.app_facts),
    }
    if not convert:
        return analysed
    return analysed | {
        "converted": rewrite.converted_files(estate.facts, estate.files),
        "targets": estate.targets,
        "coverage": rewrite.conversion_coverage(estate.targets),
        "rewrite_hits": rewrite.rewrite_hits(estate.files),
        "requirements": deps.target_requirements(estate.app_facts, estate.dependencies),
        "provisioning": manifest.provisioning_plan(estate.apps, estate.privileges),
        "permissions": manifest.manifest_permissions(estate.privileges),
        "artifacts": manifest.manifest_artifacts(estate.manifests),
        "names": appfacts.app_names(estate.apps),
    }


def migrate(estate: Estate, out: str, convert: bool = True) -> None:
    """Write every result below ``out``: the report as JSON, the rest as Parquet."""
    for name, table in results(with_saved_facts(estate), convert).items():
        if name == "converted":
            rewrite.write_converted(table, f"{out}/{name}")
        elif name == "report":
            table.write.mode("overwrite").json(f"{out}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{out}/{name}")


def export_converted(spark: SparkSession, out: str, root: str) -> int:
    """Lay the converted files of a finished migration out as files below ``root/<application>/``."""
    converted = spark.read.parquet(f"{out}/converted")
    return tree.write_tree(converted.select("app_id", F.col("target_path").alias("path"), "content"), root)
