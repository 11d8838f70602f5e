from __future__ import annotations

import random

import restated
from conftest import rows
from pyspark.sql import functions as F
from test_classify import random_text

from wayfreight import rules
from wayfreight.functions.text import first_lines
from wayfreight.operators import rewrite


def test_rewrites_and_hits_equal_the_restatement(make_estate):
    rng = random.Random(11)
    corpus = {(f"app{n}", f"f{n}.{'py' if n % 4 else 'sql'}"): random_text(rng) for n in range(500)}
    estate = make_estate(corpus)
    written = {r.app_id: r for r in rewrite.converted_files(estate.facts, estate.files).collect()}
    hits = {}
    for app, rule, n in rows(rewrite.rewrite_hits(estate.files)):
        hits.setdefault(app, {})[rule] = n
    for (app, path), text in corpus.items():
        kind, _ = restated.classify(path, text)
        if not text or kind in ("udf", "procedure", "view"):
            assert app not in written
            continue
        got = written[app].content
        if kind == "sql":
            assert got.endswith(text) and got.startswith(f"-- Source file: {path}\n")
            assert got[: len(got) - len(text)].count("\n") == 4
            continue
        want, want_hits = restated.rewrite(kind, text)
        if kind == "streamlit" and "sql.connect(" in want and "get_db_connection" not in want:
            assert got.startswith(rules.CONNECTION_HELPER)
            got = got.removeprefix(rules.CONNECTION_HELPER)
        assert got == want, text
        assert hits.get(app, {}) == want_hits, text


def test_ui_rewrite_is_idempotent(spark):
    text = "import streamlit\nimport snowflake.connector\nc = snowflake.connector.connect(x)\nsession.sql(q)"
    once = rewrite.with_helper(rewrite.rewrite_ui(F.col("c")))
    frame = spark.createDataFrame([(text,)], "c string").select(once.alias("c"))
    again = frame.select("c", once.alias("d")).first()
    assert again.c == again.d and again.c.count("def get_db_connection") == 1


def test_targets_and_collisions(make_estate):
    estate = make_estate(
        {
            ("a", "one.py"): "st.x",
            ("a", "z/two.py"): "st.x",
            ("a", "pages/p.py"): "st.x",
            ("a", "lib/util.py"): "x = 1",
            ("a", "util.py"): "from flask import x",
            ("a", "q/s.sql"): "select 1",
            ("a", "f.py"): "@udf",
            ("a", "__init__.py"): "",
            ("b", "util.py"): "x = 1",
        }
    )
    got = {(r.app_id, r.path): (r.target_path, r.status, r.sources) for r in estate.targets.collect()}
    assert got == {
        ("a", "one.py"): ("src/streamlit_app.py", "lost_to_collision", None),
        ("a", "z/two.py"): ("src/streamlit_app.py", "written", 2),
        ("a", "pages/p.py"): ("src/pages/p.py", "written", 1),
        ("a", "lib/util.py"): ("src/util.py", "lost_to_collision", None),
        ("a", "util.py"): ("src/util.py", "written", 2),
        ("a", "q/s.sql"): ("databricks/s.sql", "written", 1),
        ("a", "f.py"): (None, "skipped_type", None),
        ("a", "__init__.py"): (None, "skipped_empty", None),
        ("b", "util.py"): ("src/util.py", "written", 1),
    }
    coverage = {r.app_id: r for r in rewrite.conversion_coverage(estate.targets).collect()}
    a = coverage["a"]
    assert a.components == a.written + a.skipped_type + a.skipped_empty + a.lost_to_collision == 8
    assert rows(rewrite.skip_empty(estate.facts).filter("status = 'skipped_empty'"), "path") == [("__init__.py",)]


def test_converted_sink_keeps_every_winner(make_estate, spark, tmp_path):
    estate = make_estate({(f"app{n % 7}", f"m{n}.py"): f"x = {n}" for n in range(60)})
    rewrite.write_converted(rewrite.converted_files(estate.facts, estate.files), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_preview_takes_ten_lines(spark):
    texts = ["", "one", "\n".join(map(str, range(10))), "\n".join(map(str, range(30)))]
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in frame.select(first_lines(F.col("c"), 10)).collect()]
    assert got == ["\n".join(t.split("\n")[:10]) for t in texts]
