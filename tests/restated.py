"""The estate semantics restated row by row in plain Python, as a check on the Spark plans."""

from __future__ import annotations

import re

UI = {"import streamlit", "from streamlit", "st.", "streamlit_app"}
API = {"from flask", "from fastapi", "@app.route", "@app.get", "@app.post"}
FEATURES = {
    "from snowflake.snowpark": r"from snowflake\.snowpark",
    "import snowflake.snowpark": r"import snowflake\.snowpark",
    "session.table": r"session\.table\(",
    "session.create_dataframe": r"session\.create_dataframe\(",
    "session.sql": r"session\.sql\(",
    "@udf": "@udf",
    "@sproc": "@sproc",
}


def holds(text, marks):
    return any(mark in text for mark in marks)


def classify(path, text):
    """(type, complexity) of a readable file."""
    if path.endswith(".py"):
        ranked = [
            ("procedure", "@sproc" in text),
            ("udf", "@udf" in text),
            ("api", holds(text, API)),
            ("streamlit", holds(text, UI)),
            ("python", True),
        ]
        level = "medium" if holds(text, {"@udf", "@sproc"}) else "low"
        return next(name for name, hit in ranked if hit), level
    loud = text.upper()
    ranked = [
        ("view", "low", holds(loud, {"CREATE OR REPLACE VIEW", "CREATE VIEW"})),
        ("udf", "medium", "CREATE OR REPLACE FUNCTION" in loud),
        ("procedure", "high", "CREATE OR REPLACE PROCEDURE" in loud),
        ("sql", "low", True),
    ]
    name, level = next((n, c) for n, c, hit in ranked if hit)
    if holds(loud, {"VARIANT", "FLATTEN(", "LATERAL FLATTEN", "COPY INTO"}):
        level = "high"
    return name, level


def usage(text):
    found = {label: len(re.findall(pattern, text)) for label, pattern in FEATURES.items()}
    return {label: n for label, n in found.items() if n}


def dependencies(text):
    names = set()
    for line in map(str.strip, text.split("\n")):
        if line and line[0] != "#":
            for operator in ("==", ">=", "<="):
                line = line.partition(operator)[0]
            names.add(line.strip())
    return names


UI_SWAPS = [
    ("import snowflake.connector", "from databricks import sql"),
    ("from snowflake import connector", "from databricks import sql"),
    ("snowflake.connector.connect(", "sql.connect("),
    ("from snowflake.snowpark import Session", "from pyspark.sql import SparkSession"),
    ("session.table(", "spark.table("),
    ("session.sql(", "spark.sql("),
]


def rewrite(kind, text):
    """(new text without helper or stamp, replacements per rule)."""
    hits = {}

    def swap(label, pattern, new, old_text):
        changed, n = re.subn(pattern, lambda _: new, old_text)
        if n:
            hits[label] = n
        return changed

    if kind == "streamlit":
        for old, new in UI_SWAPS:
            text = swap(f"ui: {old}", re.escape(old), new, text)
    elif "snowpark" in text:
        text = swap(
            "py: from snowflake.snowpark import",
            r"from snowflake\.snowpark import.*",
            "from pyspark.sql import SparkSession, DataFrame",
            text,
        )
        text = swap("py: snowpark.Session", r"snowpark\.Session", "SparkSession", text)
        text = swap("py: session.", r"session\.", "spark.", text)
    return text, hits
