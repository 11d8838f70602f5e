"""Per-file facts. Everything is decided map-side in one pass, after which the text is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfreight import rules
from wayfreight.functions.rows import keep_if
from wayfreight.functions.text import base_name, contains_any, count_literal
from wayfreight.operators.deps import packages

# ``st.`` not preceded by a letter, digit or underscore of any script.
STRICT_BARE = r"(^|[^\p{L}\p{N}_])st\."

USAGE_COLUMNS = [column for _, _, column in rules.API_FEATURES]


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def with_gates(files: DataFrame) -> DataFrame:
    """Shared parts of the Python literals, each looked for once per file.

    Every literal below holds one of these parts, so a file without the part cannot hold the literal.
    Most files hold none and are scanned a handful of times instead of once per literal.
    """
    python = F.col("kind") == "python"
    return files.withColumns(
        {gate: _flag(python & F.col("content").contains(part)) for gate, part in rules.GATES.items()}
    )


def _names(package: str) -> Column:
    """Whether a requirements file names the package; only files that hold the text are parsed."""
    content = F.col("content")
    # when() rather than &: subexpression elimination looks past the short cut of an AND and would
    # parse every file.
    holds = (F.col("kind") == "requirements") & content.contains(package)
    return F.when(holds, F.array_contains(packages(content), package)).otherwise(False)


def with_python_flags(gated: DataFrame, strict: bool = False) -> DataFrame:
    """UI, API, UDF and procedure flags of readable Python files, after :func:`with_gates`.

    ``st.`` counts wherever it stands, inside words too; ``strict=True`` asks for a word boundary.
    """
    content = F.col("content")
    python = F.col("kind") == "python"
    named = tuple(m for m in rules.UI_MARKERS if m != rules.UI_BARE)
    bare = content.rlike(STRICT_BARE) if strict else content.contains(rules.UI_BARE)
    decorators = tuple(m for m in rules.API_MARKERS if m.startswith("@"))
    imports = tuple(m for m in rules.API_MARKERS if not m.startswith("@"))
    at = F.col("has_at")
    return gated.withColumns(
        {
            "is_ui": _flag(python & (bare | (content.contains(rules.UI_PART) & contains_any(content, named)))),
            "is_api": _flag(python & ((at & contains_any(content, decorators)) | (content.contains(rules.API_IMPORT_PART) & contains_any(content, imports)))),
            "py_udf": _flag(at & content.contains(rules.UDF_MARKER)),
            "py_procedure": _flag(at & content.contains(rules.PROCEDURE_MARKER)),
        }
    )


def constructs(upper: Column) -> Column:
    """Flagged constructs in upper-cased SQL, in a fixed order (array<string>)."""
    return F.array_compact(
        F.array(*[F.when(upper.contains(text), label) for label, text in rules.SQL_CONSTRUCTS])
    )


def sql_feature_flags(files: DataFrame) -> DataFrame:
    """One row per file and flagged construct."""
    return files.filter((F.col("kind") == "sql") & F.col("readable")).withColumn("upper", F.upper("content")).select(
        "app_id", "path", F.explode(constructs(F.col("upper"))).alias("construct")
    )


def with_sql_flags(files: DataFrame) -> DataFrame:
    """Object and construct flags of readable SQL files, from one upper-cased copy of the text."""
    upper = F.col("upper")
    create = F.col("has_create")
    return (
        files.withColumn("upper", F.when(F.col("kind") == "sql", F.upper("content")))
        .withColumn("has_create", _flag(upper.contains(rules.SQL_CREATE_PART)))
        .withColumns(
            {
                "sql_procedure": _flag(create & contains_any(upper, rules.SQL_PROCEDURE_MARKERS)),
                "sql_udf": _flag(create & contains_any(upper, rules.SQL_FUNCTION_MARKERS)),
                "is_view": _flag(create & contains_any(upper, rules.SQL_VIEW_MARKERS)),
                "constructs": constructs(upper),
            }
        )
        .drop("upper", "has_create")
    )


def python_type() -> Column:
    """Later checks win, so the chain asks for them first."""
    return (
        F.when(F.col("py_procedure"), "procedure")
        .when(F.col("py_udf"), "udf")
        .when(F.col("is_api"), "api")
        .when(F.col("is_ui"), "streamlit")
        .otherwise("python")
    )


def sql_type() -> Column:
    return (
        F.when(F.col("is_view"), "view")
        .when(F.col("sql_udf"), "udf")
        .when(F.col("sql_procedure"), "procedure")
        .otherwise("sql")
    )


def python_complexity() -> Column:
    return F.when(F.col("py_udf") | F.col("py_procedure"), "medium").otherwise("low")


def sql_complexity() -> Column:
    return (
        F.when(F.size("constructs") > 0, "high")
        .when(F.col("is_view"), "low")
        .when(F.col("sql_udf"), "medium")
        .when(F.col("sql_procedure"), "high")
        .otherwise("low")
    )


def with_usage(gated: DataFrame) -> DataFrame:
    """Number of uses of each platform-API feature, as columns: no join with a pattern table."""

    def gate_of(literal: str) -> str:
        return next(gate for gate, part in rules.GATES.items() if part in literal)

    none = F.lit(0).cast("bigint")
    return gated.withColumns(
        {
            column: F.when(F.col(gate_of(literal)), count_literal(F.col("content"), literal)).otherwise(none)
            for _, literal, column in rules.API_FEATURES
        }
    )


def file_facts(files: DataFrame, strict: bool = False, keep_content: bool = False) -> DataFrame:
    """All facts of every file, one row per file. The text leaves the plan here unless asked for."""
    component = F.col("readable") & F.col("kind").isin("python", "sql")
    python = F.col("kind") == "python"
    facts = (
        with_usage(with_sql_flags(with_python_flags(with_gates(files), strict)))
        .withColumns(
            {
                "name": base_name(F.col("path")),
                "is_component": component,
                "is_empty": _flag(F.octet_length("content") == 0),
                "is_udf": F.col("py_udf") | F.col("sql_udf"),
                "is_procedure": F.col("py_procedure") | F.col("sql_procedure"),
                "type": F.when(component, F.when(python, python_type()).otherwise(sql_type())),
                "complexity": F.when(component, F.when(python, python_complexity()).otherwise(sql_complexity())),
                "needs_connector": _names(rules.CONNECTOR_PACKAGE),
                "needs_snowpark": _names(rules.SNOWPARK_PACKAGE),
            }
        )
    )
    facts = facts.drop(*rules.GATES)
    return facts if keep_content else facts.drop("content")


def components(facts: DataFrame) -> DataFrame:
    """The component table: readable Python and SQL files with type, complexity and notes."""
    return facts.filter("is_component").select(
        "app_id",
        "path",
        "name",
        "type",
        "complexity",
        (reduce(lambda a, b: a + b, [F.col(c) for c in USAGE_COLUMNS]) > 0).alias("has_api_usage"),
        notes().alias("notes"),
    )


def notes() -> Column:
    """Ordered note codes of one file (array<string>, at most one entry per rule)."""
    used = [
        F.when(F.col(column) > 0, f"uses {label}") for label, _, column in rules.API_FEATURES
    ]
    return F.array_compact(
        F.array(
            F.when(F.col("is_ui"), "ui"),
            F.when(F.col("is_api"), "api"),
            *used,
            F.when(F.col("py_udf") | F.col("py_procedure"), "python udf or procedure"),
            F.when(F.col("sql_procedure"), "sql procedure"),
            F.when(F.col("sql_udf"), "sql udf"),
            F.when(F.col("is_view"), "sql view"),
            F.when(
                F.size("constructs") > 0,
                F.concat(F.lit("constructs "), F.array_join("constructs", ", ")),
            ),
        )
    )


def udf_inventory(files: DataFrame) -> DataFrame:
    """Files that define UDFs or procedures, in Python or SQL, and how many decorators they hold."""
    return keep_if(
        file_facts(files),
        F.col("is_udf") | F.col("is_procedure"),
        derived=[
            F.col("kind").alias("language"),
            F.col("is_udf"),
            F.col("is_procedure"),
            F.col("n_udf").alias("udf_decorators"),
            F.col("n_sproc").alias("procedure_decorators"),
        ],
        through=["app_id", "path"],
    )
