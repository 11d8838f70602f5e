"""Application facts that follow the files: what left is taken off, what came is added.

Everything in the application facts is a sum over files once flags are kept as numbers of files that have them.
So facts of old and new files, with a sign, are all that has to be added up when files change, and a stored table of such
sums is kept up by appending: one row for each application that changed, nothing else is read or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.operators.appfacts import with_score
from wayfreight.operators.classify import USAGE_COLUMNS

#: Flags of an application, and the numbers of files they come from.
FLAGS = {
    "has_streamlit": "ui_pages",
    "has_api": "api_files",
    "has_stored_procedures": "procedure_files",
    "has_udfs": "udf_files",
    "needs_connector": "connector_files",
    "needs_snowpark": "snowpark_files",
}
COUNTS = (
    "files", "python_files", "sql_files", "components", "unreadable_files", "unreadable_requirements", *FLAGS.values(), *USAGE_COLUMNS,
)
TOTALS = "app_id string, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _per_file() -> dict[str, Column]:
    kind, readable = F.col("kind"), F.col("readable")
    tests = {
        "files": F.lit(True),
        "python_files": kind == "python",
        "sql_files": kind == "sql",
        "components": F.col("is_component"),
        "unreadable_files": ~readable & kind.isin("python", "sql"),
        "unreadable_requirements": ~readable & (kind == "requirements"),
        "ui_pages": F.col("is_ui"),
        "api_files": F.col("is_api"),
        "procedure_files": F.col("is_procedure"),
        "udf_files": F.col("is_udf"),
        "connector_files": F.col("needs_connector"),
        "snowpark_files": F.col("needs_snowpark"),
    }
    one = {name: F.when(test, 1).otherwise(0) for name, test in tests.items()}
    return one | {c: F.coalesce(F.col(c), F.lit(0)) for c in USAGE_COLUMNS}


def signed_totals(come: DataFrame | None, gone: DataFrame | None = None) -> DataFrame:
    """One row for each application that is touched: its sums over the files that came less those that went.

    Takes file facts; combines map-side, so a task sends one row for each application.
    """
    parts = [facts.withColumn("sign", F.lit(sign)) for facts, sign in ((come, 1), (gone, -1)) if facts is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    sums = rows.groupBy("app_id").agg(*[F.sum(F.col("sign") * c).cast("bigint").alias(name) for name, c in _per_file().items()])
    changed = F.lit(False)
    for name in COUNTS:
        changed = changed | (F.col(name) != 0)
    return sums.filter(changed).select("app_id", *COUNTS)


def start_upkeep(facts: DataFrame, at: str) -> None:
    """Store the sums of a whole estate as batch 0."""
    signed_totals(facts).write.mode("overwrite").parquet(f"{at}/batch=0")


def keep_up(at: str, batch: int, come: DataFrame | None, gone: DataFrame | None) -> None:
    """Append what some changes come to. The same batch again replaces itself, so a retry counts once.

    ``come`` has the facts of new files and of changed ones as they are now, ``gone`` those of removed files
    and of changed ones as they were. A moved file is in both.
    """
    if batch < 1:
        raise ValueError("batches after the first are numbered from 1")
    signed_totals(come, gone).write.mode("overwrite").parquet(f"{at}/batch={batch}")


def totals(spark: SparkSession, at: str, up_to: int | None = None) -> DataFrame:
    """The sums as of a batch, or of the last. Applications without files any more are left out."""
    rows = spark.read.schema(f"{TOTALS}, batch int").option("basePath", at).parquet(at)
    if up_to is not None:
        rows = rows.filter(F.col("batch") <= up_to)
    return rows.groupBy("app_id").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter("files > 0")


def facts_of_totals(sums: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """The application facts, as :func:`wayfreight.operators.appfacts.app_facts` gives them from all files.

    ``apps`` lists all application folders; those without files then appear with zeros.
    """
    if apps is not None:
        sums = apps.join(sums, "app_id", "left").fillna(dict.fromkeys(COUNTS, 0))
    flagged = sums.withColumns({flag: F.col(count) > 0 for flag, count in FLAGS.items()})
    return with_score(flagged.drop("files", *[c for c in FLAGS.values() if c != "ui_pages"]))


def changed_facts(spark: SparkSession, at: str, batch: int) -> DataFrame:
    """The facts, as of a batch, of just the applications that it touched; with zeros where no file is left.

    What a table of facts elsewhere has to take over.
    """
    rows = spark.read.schema(f"{TOTALS}, batch int").option("basePath", at).parquet(at)
    touched = rows.filter(F.col("batch") == batch).select("app_id").distinct()
    return facts_of_totals(totals(spark, at, batch), touched)


def compact(spark: SparkSession, at: str, to: str) -> None:
    """Add all batches up into batch 0 of a new place, from which upkeep goes on."""
    totals(spark, at).write.mode("overwrite").parquet(f"{to}/batch=0")
