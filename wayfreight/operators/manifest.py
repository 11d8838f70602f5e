"""Manifests: YAML text to typed columns and exploded privilege and artifact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfreight import rules


def yaml_to_json():
    """Arrow UDF ``text -> struct<json, error>``; a bad document is a value, not a failed task.

    Self-contained so that it ships to executors by value. YAML parsing is the one thing here that
    Spark has no expression for; everything after it is native.
    """

    @F.pandas_udf("json string, error string")
    def parse(texts):
        import json
        import math

        import pandas as pd
        import yaml  # without it no manifest can be judged: the job stops

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def plain(value):
            """Only what JSON has: keys as text, and numbers that are not finite as text."""
            if isinstance(value, dict):
                return {str(k): plain(v) for k, v in value.items()}
            if isinstance(value, (list, tuple, set)):
                return [plain(v) for v in value]
            if isinstance(value, float) and not math.isfinite(value):
                return str(value)
            return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)

        def one(text):
            if text is None:
                return None, "not UTF-8"
            try:
                root = yaml.load(text, Loader=loader)
                if not isinstance(root, dict):
                    return None, "root is not a mapping"
                if not isinstance(root.get("version", {}), dict):
                    return None, "version is not a mapping"
                return json.dumps(plain(root), allow_nan=False), None
            except Exception as problem:  # any parse problem becomes a row, as the contract asks
                mark = getattr(problem, "problem_mark", None)
                said = str(problem).split("\n", 1)[0]
                place = f" (line {mark.line + 1}, column {mark.column + 1})" if mark else ""
                return None, f"{type(problem).__name__}: {said}{place}"

        return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])

    return parse


def _scalar(path: str, default: str | None) -> Column:
    """Text of a scalar; the default stands in for a missing key only, not for an explicit null."""
    explicit_null = F.is_variant_null(F.try_variant_get("raw", path, "variant"))
    text = F.get_json_object("json", path)
    return F.when(explicit_null, F.lit(None)).otherwise(F.coalesce(text, F.lit(default)))


def preferred_manifest(files: DataFrame) -> DataFrame:
    """One manifest file per application: root only, ``.yml`` before ``.yaml``.

    At most two rows share an application (root names are unique), so the group is bounded.
    """
    rank = F.when(F.col("path") == rules.MANIFEST_NAMES[0], 0).otherwise(1)
    return (
        files.filter(F.col("kind") == "manifest")
        .groupBy("app_id")
        .agg(F.min_by(F.struct("path", "content"), rank).alias("m"))
        .select("app_id", F.col("m.path").alias("file_name"), F.col("m.content").alias("yaml"))
    )


def parse_manifests(files: DataFrame) -> DataFrame:
    """Manifest per application that has one: status, scalars, and the dynamic parts as variant."""
    parsed = (
        preferred_manifest(files)
        .withColumn("parsed", yaml_to_json()("yaml"))
        .select("app_id", "file_name", "parsed.json", "parsed.error")
        .withColumn("raw", F.try_parse_json("json"))
        .withColumn("error", F.when(F.col("json").isNotNull() & F.col("raw").isNull(), "not representable").otherwise(F.col("error")))
    )
    ok = F.col("error").isNull()
    privileges = F.get_json_object("json", "$.privileges")
    return parsed.select(
        "app_id",
        "file_name",
        F.when(ok, "ok").otherwise("invalid").alias("status"),
        "error",
        F.when(ok, _scalar("$.manifest_version", "unknown")).alias("manifest_version"),
        F.when(ok, _scalar("$.version.name", "1.0")).alias("version"),
        F.when(ok, _scalar("$.version.label", None)).alias("label"),
        F.coalesce(ok & privileges.isNotNull() & ~privileges.isin("[]", "{}", "", "0", "false"), F.lit(False)).alias(
            "has_privileges"
        ),
        F.try_variant_get("raw", "$.privileges", "variant").alias("privileges"),
        F.try_variant_get("raw", "$.artifacts", "variant").alias("artifacts"),
        F.try_variant_get("raw", "$.configuration", "variant").alias("configuration"),
        "raw",
    )


def manifest_catalog(apps: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per application; ``status`` is ok, invalid or missing."""
    return apps.join(manifests, "app_id", "left").select(
        "app_id",
        "file_name",
        F.coalesce("status", F.lit("missing")).alias("status"),
        "error",
        "manifest_version",
        "version",
        "label",
        F.coalesce("has_privileges", F.lit(False)).alias("has_privileges"),
    )


def manifest_privileges(manifests: DataFrame) -> DataFrame:
    """One row per privilege entry, key and object: ``USAGE on SCHEMA: [a]`` -> USAGE, SCHEMA, a.

    An entry may have several keys; (entry_no, key_no, object_no) tells its rows apart.
    """
    spark = manifests.sparkSession

    def scalar(value: str) -> str:
        """SQL text of a scalar; NULL for a list or mapping, which would otherwise print as JSON."""
        return (
            f"CASE WHEN schema_of_variant({value}) RLIKE '^(ARRAY|OBJECT)<' THEN NULL "
            f"ELSE try_variant_get({value}, '$', 'string') END"
        )

    entries = spark.sql(
        f"""
        SELECT m.app_id,
               CAST(e.pos AS INT) + 1 AS entry_no,
               CAST(coalesce(k.pos, 0) AS INT) + 1 AS key_no,
               coalesce(k.key, {scalar("e.value")}) AS entry,
               k.key AS entry_key,
               CAST(coalesce(o.pos, 0) AS INT) + 1 AS object_no,
               coalesce({scalar("o.value")}, {scalar("k.value")}) AS object
        FROM {{manifests}} m,
             LATERAL variant_explode(m.privileges) e,
             LATERAL variant_explode_outer(e.value) k,
             LATERAL variant_explode_outer(k.value) o
        """,
        manifests=manifests.select("app_id", "privileges"),
    )
    parts = F.split("entry", "(?i) on ", 2)
    return entries.select(
        "app_id",
        "entry_no",
        "key_no",
        "entry_key",
        F.upper(F.get(parts, 0)).alias("verb"),
        F.get(parts, 1).alias("object_type"),
        "object_no",
        "object",
    )


def manifest_permissions(privileges: DataFrame) -> DataFrame:
    """Entries whose key is literally ``privilege`` become one user permission; others give none."""
    return (
        privileges.filter((F.col("entry_key") == rules.PERMISSION_KEY) & (F.col("object_no") == 1))
        .select("app_id", "entry_no", F.lit(rules.PERMISSION).alias("permission"), F.col("object").alias("source"))
    )


def manifest_configuration(manifests: DataFrame) -> DataFrame:
    """(key, value) of every configuration setting, values as text."""
    return manifests.sparkSession.sql(
        """
        SELECT m.app_id, c.key, try_variant_get(c.value, '$', 'string') AS value
        FROM {manifests} m, LATERAL variant_explode(m.configuration) c
        """,
        manifests=manifests.select("app_id", "configuration"),
    )


def manifest_artifacts(manifests: DataFrame) -> DataFrame:
    """(src, dest) of every artifact."""
    return manifests.sparkSession.sql(
        """
        SELECT m.app_id,
               CAST(a.pos AS INT) + 1 AS artifact_no,
               try_variant_get(a.value, '$.src', 'string') AS src,
               try_variant_get(a.value, '$.dest', 'string') AS dest
        FROM {manifests} m, LATERAL variant_explode(m.artifacts) a
        """,
        manifests=manifests.select("app_id", "artifacts"),
    )


def privilege_targets(spark) -> DataFrame:
    """The fixed verb lookup: four rows, whatever the estate."""
    import pyarrow as pa

    verbs, targets = zip(*rules.PRIVILEGE_TARGETS)
    return spark.createDataFrame(pa.table({"verb": list(verbs), "target": list(targets)}))


def privilege_map(privileges: DataFrame) -> DataFrame:
    """Target privilege of every entry; verbs without one are kept and marked for review."""
    lookup = F.broadcast(privilege_targets(privileges.sparkSession))
    return privileges.join(lookup, "verb", "left").select(
        "app_id",
        "entry_no",
        "key_no",
        "entry_key",
        "object_no",
        "verb",
        "object_type",
        "object",
        F.coalesce("target", F.lit(rules.NEEDS_REVIEW)).alias("target"),
    )


def provisioning_plan(apps: DataFrame, privileges: DataFrame) -> DataFrame:
    """Ordered setup steps per application: catalog, schema, then one per privilege entry. Never executed.

    The objects of an entry are the parts of its step. Where an entry has a key that is literally
    ``privilege``, its other keys are remarks. The windows run over the entries of one manifest.
    """
    catalog = F.concat(F.lower("app_id"), F.lit("_catalog"))
    base = apps.select(
        "app_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit(1).alias("step"),
                    F.lit(1).alias("part"),
                    F.lit("create_catalog").alias("action"),
                    catalog.alias("detail"),
                ),
                F.struct(
                    F.lit(2).alias("step"),
                    F.lit(1).alias("part"),
                    F.lit("create_schema").alias("action"),
                    F.concat(catalog, F.lit(".main")).alias("detail"),
                ),
            )
        ),
    )
    entry = Window.partitionBy("app_id", "entry_no")
    literal = F.col("entry_key").eqNullSafe(rules.PERMISSION_KEY)
    planned = privileges.withColumn("has_literal", F.max(literal).over(entry)).filter(literal | ~F.col("has_literal"))
    planned = planned.withColumn("part", F.row_number().over(entry.orderBy("key_no", "object_no")))
    lookup = F.broadcast(privilege_targets(privileges.sparkSession))
    planned = planned.join(lookup, "verb", "left").withColumn("target", F.coalesce("target", F.lit(rules.NEEDS_REVIEW)))
    grants = planned.select(
        "app_id",
        (F.col("entry_no") + 2).alias("step"),
        "part",
        F.when(F.col("target") == rules.NEEDS_REVIEW, rules.NEEDS_REVIEW).otherwise("grant").alias("action"),
        F.concat_ws(" ", F.col("target"), F.lit("on"), F.coalesce("object_type", F.lit("?")), F.coalesce("object", F.lit("?"))).alias("detail"),
    )
    return base.unionByName(grants)
