from __future__ import annotations

import random

import restated
from conftest import rows

from wayfreight.operators import deps


def test_package_names_equal_the_restatement(make_files):
    rng = random.Random(3)
    parts = ["pandas", "==", ">=", "<=", "~=", "1.0", " ", "\t", "　", "#", "# c", "[x]", ";", "\x1c", "Flask", ""]
    texts = {
        (f"app{n}", "d/requirements.txt"): "\n".join(
            "".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(8))
        )
        for n in range(150)
    }
    got = {}
    for app, package in rows(deps.dependency_set(make_files(texts)), "app_id", "package"):
        got.setdefault(app, set()).add(package)
    want = {app: names for (app, _), text in texts.items() if (names := restated.dependencies(text))}
    assert got == want


def test_lines_are_numbered_and_cleaned(make_files):
    files = make_files({("a", "requirements.txt"): "# core\r\npandas==2.0\r\n\r\n  numpy <= 1.26  \nFlask~=2.0"})
    assert rows(deps.requirements_parse(files), "line_no", "package") == [(2, "pandas"), (4, "numpy"), (5, "Flask~=2.0")]


def test_drop_is_by_part_and_by_exact_name(spark):
    names = ["snowflake-connector-python", "x-snowflake-snowpark-y", "streamlit", "Streamlit", "flask", "pyspark", "pandas"]
    frame = spark.createDataFrame([("a", n) for n in names], "app_id string, package string")
    assert rows(deps.dependency_drop(frame), "package") == [("Streamlit",), ("pandas",)]


def test_target_requirements_by_guard(make_estate):
    estate = make_estate(
        {
            ("api", "m.py"): "from fastapi import x",
            ("api", "requirements.txt"): "flask==1\npandas",
            ("use", "m.py"): "q = session.sql(1)",
        },
        apps=["bare"],
    )
    got = rows(deps.target_requirements(estate.app_facts, estate.dependencies))
    base = "databricks-sql-connector>=3.0.0"
    assert got == sorted(
        [("api", base), ("api", "flask>=3.0.0"), ("api", "pandas"), ("bare", base), ("use", base), ("use", "pyspark>=3.5.0")],
        key=str,
    )
