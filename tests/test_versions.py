from __future__ import annotations

import random

import pytest
from conftest import rows

from wayfreight.operators import versions

ORDER = ["1.dev0", "1.dev3", "1a1", "1b0", "1rc1", "1.0", "1.0.post0", "1.0.post2", "1.0.0.1", "1.0.1", "1.2", "1.10", "2", "10.1", "1!0.1"]


def test_keys_sort_as_versions(spark):
    shuffled = random.Random(4).sample(ORDER, len(ORDER))
    frame = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r.v for r in frame.orderBy(versions.version_key(frame.v)).collect()] == ORDER


def test_equal_and_unreadable_versions(spark):
    frame = spark.createDataFrame([(v,) for v in ("1", "1.0", "01.0.0", "latest", "1..2", "", None, "9" * 19, "1.0+local")], "v string")
    keys = [r[0] for r in frame.select(versions.version_key(frame.v)).collect()]
    assert keys[0] == keys[1] == keys[2] == [0, 1, -1, 0]
    assert keys[3:] == [None] * 6


def found(make_files, text):
    return rows(versions.version_ranges(make_files({("a", "requirements.txt"): text})), "package", "lower", "upper", "status", "requirement")


@pytest.mark.parametrize(
    ("lines", "lower", "upper", "status", "requirement"),
    [
        ("p", None, None, "any", "p"),
        ("p>=1.9\np>=1.10", ">=1.10", None, "range", "p>=1.10"),
        ("P.q_r>=1\np-q-r<3", ">=1", "<3", "range", "p-q-r>=1,<3"),
        ("p==2.0\np>=1", ">=2.0", "<=2.0", "pinned", "p==2.0"),
        ("p>=2\np<2", ">=2", "<2", "conflict", None),
        ("p>2\np<=2", ">2", "<=2", "conflict", None),
        ("p>=2\np<=2", ">=2", "<=2", "pinned", "p==2"),
        ("p~=1.4.2\np>=1.4.5", ">=1.4.5", "<1.5.dev0", "range", "p>=1.4.5,<1.5.dev0"),
        ("p~=1", None, None, "any", "p"),
        ("p==1.*,!=1.3", ">=1.dev0", "<2.dev0", "range", "p>=1.dev0,<2.dev0"),
        ("p==1.3\np!=1.3.0", ">=1.3", "<=1.3", "conflict", None),
        ("p>=1.2,<1.4\np!=1.*", ">=1.2", "<1.4", "conflict", None),
        ("p<2\np>=2rc1", ">=2rc1", "<2", "conflict", None),
        ("p>1\np==1.post3", ">1", "<=1.post3", "conflict", None),
        ("p[x,y] ( >= 1 , < 2 )  # why", ">=1", "<2", "range", "p>=1,<2"),
        ("p==1!1\np>=3", ">=1!1", "<=1!1", "pinned", "p==1!1"),
    ],
)
def test_ranges(make_files, lines, lower, upper, status, requirement):
    package = "p-q-r" if "q" in lines else "p"
    assert found(make_files, lines) == [(package, lower, upper, status, requirement)]


def test_markers_are_kept_apart_and_other_lines_left_out(make_files):
    text = "n<1.20; python_version<'3.8'\nn>=1.26; python_version>='3.9'\n-r more.txt\ng @ git+https://x/y\n./local.whl\n# n==1\n"
    assert found(make_files, text) == [
        ("n", ">=1.26", None, "range", "n>=1.26; python_version>='3.9'"),
        ("n", None, "<1.20", "range", "n<1.20; python_version<'3.8'"),
    ]


def test_random_lines_allow_what_each_of_them_allows(make_files):
    """Against brute force: a version is inside the range when every line admits it."""
    rng = random.Random(11)
    grid = [(a, b) for a in range(4) for b in range(4)]
    admits = {
        "==": lambda v, w: v == w, ">=": lambda v, w: v >= w, "<=": lambda v, w: v <= w, "<": lambda v, w: v < w, ">": lambda v, w: v > w,
        "~=": lambda v, w: v >= w and v[0] == w[0],
    }
    cases = {f"app{n}": [(rng.choice(list(admits)), rng.choice(grid)) for _ in range(rng.randrange(1, 4))] for n in range(120)}
    files = make_files({(app, "requirements.txt"): "\n".join(f"p{s}{a}.{b}" for s, (a, b) in lines) for app, lines in cases.items()})
    for row in versions.version_ranges(files).collect():
        allowed = {v for v in grid if all(admits[s](v, w) for s, w in cases[row.app_id])}
        inside = set(grid)
        for bound in (row.lower, row.upper):
            if bound:
                sign = bound.rstrip("0123456789.dev")
                at = tuple(int(x) for x in bound[len(sign) :].removesuffix(".dev0").split("."))
                inside &= {v for v in grid if admits[sign](v, at if len(at) == 2 else (at[0], 0))}
        assert inside == allowed, (cases[row.app_id], row)
        if row.status == "conflict":
            assert not allowed
        if row.status == "pinned":
            assert len(allowed) <= 1


def test_no_files_and_dropped_packages(make_files):
    assert versions.version_ranges(make_files({("a", "m.py"): "x"})).collect() == []
    files = make_files({("a", "requirements.txt"): "streamlit>=1\npandas==2"})
    assert rows(versions.carried_ranges(versions.version_ranges(files)), "requirement") == [("pandas==2",)]
