from __future__ import annotations

import random

import pytest
import restated
from conftest import rows

from wayfreight import rules
from wayfreight.functions.text import WHITE_SPACE
from wayfreight.operators import classify
from wayfreight.rules import API_FEATURES, API_MARKERS, GATES, REWRITE_PARTS, PY_REWRITES, UI_MARKERS, UI_REWRITES

PIECES = [
    *UI_MARKERS, *API_MARKERS, *(lit for _, lit, _ in API_FEATURES), "@udf@udf", "first.", "my_session.sql(",
    "from snowflake import connector", "import snowflake.connector", "snowflake.connector.connect(",
    "snowpark.Session", "from snowflake.snowpark import Session, col", "CREATE OR REPLACE PROCEDURE",
    "create or replace function", "Create View", "CREATE OR REPLACE VIEW", "create procedure", "variant", "flatten(",
    "lateral flatten(", "copy into", "get_db_connection", "sql.connect(", "Ünïcode ß", "x = 1", "", " ", "\t",
]


def random_text(rng):
    return "".join(rng.choice(PIECES) + rng.choice(["\n", " ", ""]) for _ in range(rng.randrange(7)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    return {
        (f"app{n % 9}", f"{rng.choice(['a', 'pages', 'b/c'])}/f{n}.{'py' if n % 3 else 'sql'}"): random_text(rng)
        for n in range(600)
    }


def test_types_and_usage_equal_the_row_by_row_restatement(make_files, corpus):
    facts = classify.file_facts(make_files(corpus)).collect()
    assert len(facts) == len(corpus)
    for f in facts:
        text = corpus[(f.app_id, f.path)]
        assert (f.type, f.complexity) == restated.classify(f.path, text), text
        used = {label: f[column] for label, _, column in API_FEATURES if f[column]}
        assert used == (restated.usage(text) if f.path.endswith(".py") else {}), text


def test_every_literal_holds_its_gate():
    for _, literal, _ in API_FEATURES:
        assert sum(part in literal for part in GATES.values()) == 1
    for marker in UI_MARKERS:
        assert marker == rules.UI_BARE or rules.UI_PART in marker
    for marker in API_MARKERS:
        assert marker.startswith("@") or rules.API_IMPORT_PART in marker
    for marker in rules.SQL_PROCEDURE_MARKERS + rules.SQL_FUNCTION_MARKERS + rules.SQL_VIEW_MARKERS:
        assert rules.SQL_CREATE_PART in marker
    for old, _ in UI_REWRITES + PY_REWRITES:
        assert any(part in old for part in REWRITE_PARTS)


def test_white_space_is_what_str_strip_takes():
    assert set(WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_last_match_wins_and_flags_stay(make_files):
    files = make_files(
        {
            ("a", "all.py"): "import streamlit\nfrom flask import x\n@udf\n@sproc\n",
            ("a", "web.py"): "import streamlit\nfrom fastapi import x\n",
            ("a", "all.sql"): "create or replace procedure p; create or replace function f; create view v",
            ("a", "plain.sql"): "CREATE PROCEDURE p() ; CREATE FUNCTION f()",
            ("a", "lateral.sql"): "select * from t, lateral flatten(input => x)",
            ("a", "view.sql"): "create or replace view v as select variant from t",
        }
    )
    facts = {f.path: f for f in classify.file_facts(files).collect()}
    assert facts["all.py"].type == "procedure" and facts["all.py"].is_ui and facts["all.py"].is_api
    assert facts["all.py"].is_udf and facts["all.py"].complexity == "medium"
    assert facts["web.py"].type == "api" and facts["web.py"].is_ui
    assert (facts["all.sql"].type, facts["all.sql"].complexity) == ("view", "low")
    assert facts["all.sql"].is_procedure and facts["all.sql"].is_udf
    assert (facts["plain.sql"].type, facts["plain.sql"].complexity) == ("sql", "low")
    assert facts["lateral.sql"].constructs == ["FLATTEN function", "LATERAL FLATTEN"]
    assert (facts["view.sql"].type, facts["view.sql"].complexity) == ("view", "high")


def test_bare_marker_matches_inside_words_unless_strict(make_files):
    files = make_files({("a", "x.py"): "test.run()", ("a", "y.py"): "st.title(1)", ("a", "z.py"): "ést.x\n(st.x)"})
    loose = dict(rows(classify.file_facts(files), "path", "type"))
    strict = dict(rows(classify.file_facts(files, strict=True), "path", "type"))
    assert loose == {"x.py": "streamlit", "y.py": "streamlit", "z.py": "streamlit"}
    assert strict == {"x.py": "python", "y.py": "streamlit", "z.py": "streamlit"}


def test_decode_keeps_bad_files_as_rows(make_files):
    files = make_files(
        {
            ("a", "bad.py"): b"st.\xff",
            ("a", "crlf.py"): "import pandas\r\nst.x\rend",
            ("a", "empty.py"): "",
            ("a", "notes.md"): "ignored",
            ("a", "sub/manifest.yml"): "not at the root",
            ("a", "Requirements.txt"): "wrong case",
        }
    )
    got = {r.path: (r.readable, r.content) for r in files.collect()}
    assert got == {
        "bad.py": (False, None),
        "crlf.py": (True, "import pandas\nst.x\nend"),
        "empty.py": (True, ""),
    }
    facts = {f.path: f for f in classify.file_facts(files).collect()}
    assert not facts["bad.py"].is_component and facts["bad.py"].type is None and not facts["bad.py"].is_ui
    assert facts["empty.py"].is_component and facts["empty.py"].is_empty
