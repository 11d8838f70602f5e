from __future__ import annotations

import pytest
from conftest import rows
from wayfreight.operators import appfacts
from wayfreight.operators.classify import USAGE_COLUMNS
from wayfreight.plans import estate as plans

# A small application with known facts: one dashboard, one set-up script, a full manifest.
DASHBOARD = """import streamlit as st
import snowflake.connector
from snowflake.snowpark import Session
st.title("Sales")
conn = snowflake.connector.connect(account=st.secrets["a"])
sess = Session.builder.create()
frame = session.table("sales").filter(session.col("year") == 1).to_pandas()
"""
SETUP = """CREATE OR REPLACE VIEW monthly AS SELECT 1;
CREATE OR REPLACE PROCEDURE forecast(y INTEGER) RETURNS FLOAT AS 'x';
CREATE OR REPLACE FUNCTION category(r FLOAT) RETURNS VARCHAR AS 'y';
"""
MANIFEST = """manifest_version: 1
version: {name: 1.0.0, label: Dashboard}
artifacts: [{src: a.py, dest: /}, {src: b.sql, dest: /}]
privileges:
  - USAGE on SCHEMA: [s]
  - SELECT on ALL TABLES IN SCHEMA: [s]
  - EXECUTE on ALL FUNCTIONS IN SCHEMA: [s]
configuration: {log_level: INFO, enable_telemetry: true}
"""


@pytest.fixture
def sample(make_estate):
    return make_estate(
        {("Shop", "streamlit_app.py"): DASHBOARD, ("Shop", "setup.sql"): SETUP, ("Shop", "manifest.yml"): MANIFEST}
    )


def test_golden_trace_of_the_sample_app(sample):
    report = plans.analysis_report(sample).collect()
    assert len(report) == 1
    r = report[0]
    assert (r.app_name, r.migration_complexity, r.components, r.python_files, r.sql_files) == ("Shop", "high", 2, 1, 1)
    assert (r.has_streamlit, r.has_api, r.has_stored_procedures, r.has_udfs) == (True, False, True, True)
    assert r.api_usage == {"from snowflake.snowpark": 1, "session.table": 1}
    assert r.warnings == []
    assert len(r.recommendations) == 13
    facts = sample.app_facts.first()
    assert (facts.score, facts.ui_pages, facts.app_type) == (13, 1, "Streamlit")
    assert rows(sample.facts.filter("is_component"), "path", "type", "complexity") == [
        ("setup.sql", "view", "low"),
        ("streamlit_app.py", "streamlit", "low"),
    ]
    coverage = rows(sample.targets, "path", "target_path", "status")
    assert coverage == [("setup.sql", None, "skipped_type"), ("streamlit_app.py", "src/streamlit_app.py", "written")]


def summary(spark, **values):
    row = {
        "app_id": "a",
        "python_files": 0,
        "sql_files": 0,
        "has_streamlit": False,
        "has_api": False,
        "has_stored_procedures": False,
        "has_udfs": False,
        **dict.fromkeys(USAGE_COLUMNS, 0),
        **values,
    }
    return appfacts.with_score(spark.createDataFrame([row])).first()


@pytest.mark.parametrize(
    "values, score, level",
    [
        ({}, 0, "low"),
        ({"sql_files": 50}, 5, "low"),
        ({"sql_files": 1, "has_stored_procedures": True}, 6, "medium"),
        ({"sql_files": 5, "has_stored_procedures": True, "has_streamlit": True}, 12, "medium"),
        ({"sql_files": 5, "has_stored_procedures": True, "has_api": True}, 13, "high"),
        ({"has_udfs": True, **dict.fromkeys(USAGE_COLUMNS, 3)}, 8, "medium"),
    ],
)
def test_score_boundaries(spark, values, score, level):
    got = summary(spark, **values)
    assert (got.score, got.migration_complexity) == (score, level)


def test_app_type_prefers_the_ui(spark):
    assert summary(spark, has_api=True, has_streamlit=True).app_type == "Streamlit"
    assert summary(spark, has_api=True).app_type == "API"
    assert summary(spark).app_type == "Generic"


def test_heavy_usage_starts_above_twenty(make_estate):
    estate = make_estate({("a", "m.py"): "@udf" * 20, ("b", "m.py"): "@udf" * 21})
    heavy = rows(appfacts.usage_total(estate.app_facts))
    assert heavy == [("a", 20, False), ("b", 21, True)]
    codes = rows(appfacts.warnings(estate.facts, estate.app_facts, estate.catalog).filter("code = 'heavy_usage'"))
    assert codes == [("b", "heavy_usage", None, "21")]


def test_unreadable_files_count_but_are_no_components(make_estate):
    estate = make_estate({("a", "x.py"): b"\xff@udf", ("a", "requirements.txt"): b"\xfe", ("a", "y.sql"): "select 1"})
    facts = estate.app_facts.first()
    assert (facts.python_files, facts.sql_files, facts.components, facts.has_udfs) == (1, 1, 1, False)
    found = rows(appfacts.warnings(estate.facts, estate.app_facts, estate.catalog), "code", "path")
    assert found == [
        ("file_unreadable", "x.py"),
        ("manifest_missing", None),
        ("requirements_unreadable", "requirements.txt"),
    ]


def test_apps_without_files_appear_with_zeros(make_estate):
    estate = make_estate({("a", "x.py"): ""}, apps=["empty"])
    got = {r.app_id: r for r in estate.app_facts.collect()}
    assert got["empty"].components == 0 and got["empty"].has_api is False
    assert (got["empty"].score, got["empty"].app_type) == (0, "Generic")


def test_hot_application_keeps_whole_results(spark, make_estate):
    """One application owns most files, all claiming one target; nothing is lost or capped."""
    entries = {("hot", f"d{n}/main.py"): f"import streamlit\nx{n} = session.sql(1)" for n in range(400)}
    entries |= {(f"cold{n}", "main.py"): "import pandas" for n in range(40)}
    estate = make_estate(entries)
    hot = estate.app_facts.filter("app_id = 'hot'").first()
    assert (hot.components, hot.ui_pages, hot.n_session_sql) == (400, 400, 400)
    status = dict(rows(estate.targets.filter("app_id = 'hot'").groupBy("status").count()))
    assert status == {"written": 1, "lost_to_collision": 399}
    winner = estate.targets.filter("app_id = 'hot' AND status = 'written'").first()
    assert (winner.path, winner.sources) == ("d99/main.py", 400)
