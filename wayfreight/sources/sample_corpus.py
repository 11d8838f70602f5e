"""An estate of application files derived from the sample tables.

Every document becomes one source file: a code snippet chosen by its position in the application,
followed by the whole document text. Some files carry CRLF line ends, some a byte that is not UTF-8,
some applications have empty ``__init__.py`` files, notes that the scan must ignore, and manifests in
every state (absent, ``.yml``, ``.yaml``, both, broken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfreight.functions.text import swap
from wayfreight.sources.files import decode_files
from wayfreight.sources.tables import table

# Snippet texts by position; ``|`` stands for a line end.
SNIPPETS = (
    "import pandas as pd|df = pd.DataFrame()|",
    "SELECT 1 AS one;|",
    "import streamlit as st|st.title(1)|",
    "# core|pandas==2.0|  snowflake-connector-python>=3.0|streamlit||numpy<=1.26|Flask~=2.0|",
    "import streamlit as st|import snowflake.connector|conn = snowflake.connector.connect(x)|session.sql(q)|",
    "CREATE OR REPLACE VIEW v AS SELECT 1;|",
    "from snowflake.snowpark import Session|a = session.table(1)|b = session.table(2)|"
    "c = session.create_dataframe(z)|d = session.sql(a)|e = session.sql(b)|f = session.sql(c)|",
    "create or replace function f() returns int;|",
    "from snowflake.snowpark.functions import udf|@udf|def f(x): pass|",
    "CREATE OR REPLACE PROCEDURE p() AS x; COPY INTO t FROM @s;|",
    "from flask import Flask|@app.route(1)|",
    "SELECT f.value FROM t, LATERAL FLATTEN(input => t.v) f; -- VARIANT|",
    "@sproc|@udf|def p(session): return session.sql(q)|",
)
SQL_POSITIONS = (1, 5, 7, 9, 11)
REQUIREMENTS_POSITION = 3
EMPTY_POSITION = 0
NOTES_POSITION = 5


def _app_columns(doc_id: Column) -> dict[str, Column]:
    group = F.floor(doc_id / 20)
    place = doc_id % 20
    return {
        "g": group,
        "i": place,
        "k": (place % (1 + group % 13)).cast("int"),
        # Even groups are one application of 20 files, odd groups five applications of 4.
        "app_id": F.when(
            group % 2 == 0, F.concat(F.lit("App "), group)
        ).otherwise(F.concat(F.lit("App "), group, F.lit("-"), F.floor(place / 4))),
    }


def raw_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """``app_id, path, content binary`` for every document of the sample."""
    docs = table(spark, data_dir, "documents").select("doc_id", "text", "lang")
    d = docs.select("*", *[c.alias(n) for n, c in _app_columns(F.col("doc_id")).items()])
    k, i, doc_id = F.col("k"), F.col("i"), F.col("doc_id")

    snippet = F.element_at(F.array(*[F.lit(s.replace("|", "\n")) for s in SNIPPETS]), k + 1)
    commented = F.concat(
        F.col("lang"), F.lit("-tools>=1.0\n# "), swap(F.col("text"), "\n", "\n# "), F.lit("\n")
    )
    body = F.concat(snippet, F.when(k == REQUIREMENTS_POSITION, commented).otherwise(F.col("text")))
    lines = F.when(doc_id % 7 == 3, swap(body, "\n", "\r\n")).otherwise(body)
    content = F.when(
        doc_id % 17 == 5, F.concat(lines.cast("binary"), F.lit(bytearray(b"\xff")))
    ).otherwise(lines.cast("binary"))

    folder = F.concat(F.lit("d"), i)
    path = (
        F.when(k == REQUIREMENTS_POSITION, F.concat(folder, F.lit("/requirements.txt")))
        .when(k.isin(*SQL_POSITIONS), F.concat(F.lit("sql/"), folder, F.lit("/s"), doc_id % 3, F.lit(".sql")))
        .when((k == 2) & (doc_id % 2 == 0), F.concat(F.lit("pages/p"), i, F.lit(".py")))
        .otherwise(F.concat(folder, F.lit("/m"), doc_id % 3, F.lit(".py")))
    )
    main = F.struct(path.alias("path"), content.alias("content"))
    empty = F.struct(
        F.concat(folder, F.lit("/__init__.py")).alias("path"), F.lit(bytearray(b"")).alias("content")
    )
    notes = F.struct(
        F.concat(folder, F.lit("/notes.md")).alias("path"), F.col("text").cast("binary").alias("content")
    )
    found = F.array_compact(
        F.array(main, F.when(k == EMPTY_POSITION, empty), F.when(k == NOTES_POSITION, notes))
    )
    return d.select("app_id", F.inline(found))


#: What the later scan of the sample estate appends to changed files.
LATER_LINES = "\nimport streamlit as st\nresult = session.sql(q)\n"


def later_files(raw: DataFrame) -> DataFrame:
    """The same estate some time later: by a digest of a file's place some are gone, changed, moved, copied, or split in two."""
    place = F.md5(F.concat("app_id", F.lit("/"), "path").cast("binary"))
    n = F.conv(F.substring(place, 1, 4), 16, 10).cast("int") % 29

    def at(folder: str) -> Column:
        return F.struct(F.concat(F.lit(folder), "path").alias("path"), F.col("content").alias("content"))

    longer = F.concat("content", F.lit(LATER_LINES).cast("binary"))
    found = (
        F.when(n == 3, F.array().cast("array<struct<path: string, content: binary>>"))
        .when(n == 4, F.array(F.struct("path", longer.alias("content"))))
        .when(n == 5, F.array(at("moved/")))
        .when(n == 6, F.array(at(""), at("copies/")))
        .when(n == 7, F.array(at("left/"), at("right/")))
        .otherwise(F.array(at("")))
    )
    return raw.select("app_id", F.inline(found))


def _manifest_text(version_lines: Column) -> Column:
    g = F.col("g")
    return F.concat(
        F.lit("manifest_version: 1\nversion:\n"),
        version_lines,
        F.lit("  label: Dashboard "), g,
        F.lit("\nartifacts:\n  - src: streamlit_app.py\n    dest: /\n  - src: sql/setup_"), g,
        F.lit(".sql\n    dest: /\nprivileges:\n  - USAGE on SCHEMA:\n      - app_schema_"), g,
        F.lit("\n  - SELECT on ALL TABLES IN SCHEMA:\n      - app_schema_"), g,
        F.lit("\n      - ref_schema\n  - EXECUTE on ALL FUNCTIONS IN SCHEMA:\n      - app_schema\n"),
        F.when(g % 2 == 0, F.lit("  - privilege: CREATE DATABASE\n")).otherwise(F.lit("")),
        F.when(g % 3 == 0, F.lit("  - APPLICATION ROLE on SCHEMA: [app_schema]\n")).otherwise(F.lit("")),
        F.when(g % 7 == 1, F.lit("  - privilege: MANAGE EVENTS\n    remark: odd\n")).otherwise(F.lit("")),
        F.lit("configuration:\n  log_level: INFO\n  enable_telemetry: true\n"),
        F.when(g % 4 == 1, F.lit("  limit: .nan\n  2024-01-05: .inf\n")).otherwise(F.lit("")),
    )


def raw_manifests(spark: SparkSession, data_dir: str) -> DataFrame:
    """Manifest files of the derived applications, same columns as :func:`raw_files`.

    By ``g % 5``: 0 none, 1 ``.yml``, 2 ``.yaml`` without a version name, 3 broken, 4 both spellings.
    """
    cols = _app_columns(F.col("doc_id"))
    apps = (
        table(spark, data_dir, "documents")
        .select(cols["g"].alias("g"), cols["app_id"].alias("app_id"))
        .distinct()
    )
    g = F.col("g")
    named = F.concat(F.lit("  name: 1."), g, F.lit(".0\n"))
    other = F.concat(F.lit("  name: 0."), g, F.lit(".9\n"))

    def entry(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("path"), text.cast("binary").alias("content"))

    variant = g % 5
    found = F.array_compact(
        F.array(
            F.when(variant.isin(1, 4), entry("manifest.yml", _manifest_text(named))),
            F.when(variant == 2, entry("manifest.yaml", _manifest_text(F.lit("")))),
            F.when(variant == 3, entry("manifest.yml", F.lit("manifest_version: 1\nversion: abc\n"))),
            F.when(variant == 4, entry("manifest.yaml", _manifest_text(other))),
        )
    )
    return apps.select("app_id", F.inline(found))


#: Requirement lines by document number; {p} is its remainder by 9, {a} by 4 and {b} by 11.
PINS = (
    "Lib_{p}>={a}.{b}", "lib.{p} < {a}.{b}.0", "lib-{p}[fast]~={a}.{b}.1  # note", "lib-{p}=={a}.{b}", "lib-{p}!={a}.*,<=3.{b}",
    "lib-{p}>{a}.{b}rc1,!={a}.10", "lib-{p}=={a}.*", "lib-{p}>={b}.0; python_version<'3.9'", "lib-{p} (>={a}.1.0, <{b})", "lib-{p}==latest\nlib-{p}~={b}",
    "lib-{p}==0.{b}.0", "lib-{p}",
)


def pinned_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The decoded files, and for each document a requirements file with versions."""
    docs = table(spark, data_dir, "documents").select("doc_id")
    doc_id = F.col("doc_id")
    line = F.element_at(F.array(*[F.lit(p) for p in PINS]), (doc_id % len(PINS) + 1).cast("int"))
    for name, modulus in (("{p}", 9), ("{a}", 4), ("{b}", 11)):
        line = F.replace(line, F.lit(name), (doc_id % modulus).cast("string"))
    more = docs.select(
        _app_columns(doc_id)["app_id"].alias("app_id"),
        F.concat(F.lit("pins/"), doc_id, F.lit("/requirements.txt")).alias("path"),
        line.cast("binary").alias("content"),
    )
    return decode_files(raw_files(spark, data_dir).unionByName(more))


def granting_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """The decoded files, and for each document a file of grants: its role joins a tree, in some applications with a cycle."""
    cols = _app_columns(F.col("doc_id"))
    g, i = F.col("g"), F.col("i")
    docs = table(spark, data_dir, "documents").select(*[cols[c].alias(c) for c in ("g", "i", "app_id")], "doc_id")
    text = F.concat(
        F.lit("-- GRANT ROLE r98 TO ROLE r0;\ngrant select, Insert\n ON TABLE app_schema.t"), i, F.lit(" TO APPLICATION ROLE r"), i,
        F.lit(";\n/* GRANT ROLE r99\n TO ROLE r0; */ GRANT USAGE ON ALL TABLES IN SCHEMA \"App s\" to role R0 WITH GRANT OPTION;\n"),
        F.when(i > 0, F.concat(F.lit("GRANT ROLE r"), i, F.lit(" TO ROLE r"), F.floor(i / 2), F.lit(";\n"))).otherwise(
            F.when(g % 3 == 0, F.lit("Grant Database Role R0 to Database Role r5;\n")).otherwise("")
        ),
        F.when(i % 4 == 1, F.concat(F.lit("GRANT APPLICATION ROLE r"), i, F.lit(" TO USER u"), i % 3)).otherwise(""),
    )
    more = docs.select("app_id", F.concat(F.lit("grants/"), "doc_id", F.lit(".sql")).alias("path"), text.cast("binary").alias("content"))
    return decode_files(raw_files(spark, data_dir).unionByName(more))


def apps(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every application folder, with or without usable files."""
    return (
        table(spark, data_dir, "documents")
        .select(_app_columns(F.col("doc_id"))["app_id"].alias("app_id"))
        .distinct()
    )


def src_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """Decoded Python, SQL and requirements files."""
    return decode_files(raw_files(spark, data_dir))


def manifest_files(spark: SparkSession, data_dir: str) -> DataFrame:
    return decode_files(raw_manifests(spark, data_dir))
