from __future__ import annotations

import random

from conftest import rows

from wayfreight import rules
from wayfreight.operators import places, rewrite


def test_no_rule_reaches_over_a_line():
    for kind in places.RULES.values():
        assert not any("\n" in new or "\n" in pattern.replace("[^\\n]", "") or not new for _, pattern, new in kind)


def test_places_are_those_of_the_source():
    line = "é = session.sql(session.table(x)); import snowflake.connector"
    assert places.line_hits("streamlit", line) == [
        ("ui: import snowflake.connector", 36, 26, 32),
        ("ui: session.table(", 17, 14, 15),
        ("ui: session.sql(", 5, 12, 5),
    ]


def test_a_hit_in_written_text_takes_the_place_of_what_it_stands_for():
    offsets = places.OffsetMap("a bb c")
    assert offsets.replace("bb", "xyx") == [(2, 4)]
    assert offsets.replace("x c", "-") == [(2, 6)]
    assert offsets.replace("x", "+") == [(2, 4)]
    assert (offsets.text, offsets.target((2, 4)), offsets.target((2, 6))) == ("a +y-", 2, 4)


def test_lines_come_out_as_the_rewrite_makes_them(spark):
    rng = random.Random(6)
    parts = [old for old, _ in rules.UI_REWRITES + rules.PY_REWRITES] + ["from snowflake.snowpark import x", "snowpark", " ", "é", "😀", "session", ".", "("]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, text string")
    ui, py = ({r.n: r.out for r in frame.select("n", f(frame.text).alias("out")).collect()} for f in (rewrite.rewrite_ui, rewrite.rewrite_py))
    for n, line in enumerate(lines):
        for kind, done in (("streamlit", ui), ("python", py)):
            offsets = places.OffsetMap(line)
            for _, pattern, new in places.RULES[kind]:
                for a, b in offsets.replace(pattern, new):
                    assert 0 <= a < b <= len(line)
            if kind == "streamlit" or rules.PY_REWRITE_GUARD in line:
                assert offsets.text == done[n]
            assert len(offsets.origin) == len(offsets.text)
            for at, (a, b) in enumerate(offsets.origin):  # what no rule wrote is as in the source
                if b == a + 1 and offsets.text[at] != line[a]:
                    raise AssertionError((line, at))


def test_totals_equal_the_hits(make_files):
    files = make_files({
        ("a", "pages/p.py"): "import streamlit as st\r\nx = session.sql(1); y = session.sql(2)\r\n\nsession.table(3)",
        ("a", "m.py"): "from snowflake.snowpark import Session, y\n# snowpark.Session\nsession.sql(1)",
        ("b", "m.py"): "session.sql(1)",
        ("b", "q.sql"): "-- session.sql( snowpark",
        ("b", "__init__.py"): "",
    })
    found = places.rewrite_places(files)
    assert rows(found.groupBy("app_id", "rule").count()) == rows(rewrite.rewrite_hits(files))
    assert rows(found.filter("path = 'pages/p.py'"), "line", "column", "length", "target_column") == [(2, 25, 12, 23), (2, 5, 12, 5), (4, 1, 14, 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert places.rewrite_places(files.limit(0)).collect() == []
