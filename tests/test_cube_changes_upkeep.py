from __future__ import annotations

import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayfreight.operators import appfacts, changes, classify, cube, upkeep
from wayfreight.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- the cube --------------------------------------------------------------------------------------

SALES = "year int, month int, region string, customer_id string, revenue decimal(18,2), order_count int"


def some_sales(seed, n=600):
    rng = random.Random(seed)
    customers = ["7", "32767", "32768", "99999999999", None, *map(str, range(40))]
    return [
        (rng.choice((1995, 1996, None)), rng.choice((1, 2, None)), rng.choice(("ASIA", "EUROPE", None)), rng.choice(customers), Decimal(rng.randrange(10**6)) / 100, 1)
        for _ in range(n)
    ]


def brute_roll_up(sales, by):
    at = [("year", "month", "region").index(c) for c in by]
    groups = defaultdict(list)
    for s in sales:
        groups[tuple(s[k] for k in at)].append(s)
    return sorted(((*key, sum(s[4] for s in g), sum(s[5] for s in g), len({s[3] for s in g} - {None})) for key, g in groups.items()), key=str)


LEVELS = [(), ("year",), ("region",), ("year", "region"), ("year", "month", "region")]


@pytest.mark.parametrize("by", LEVELS)
def test_every_level_is_exact_from_loads_counted_apart(spark, tmp_path, by):
    loads = [some_sales(1), some_sales(2), some_sales(2)[:50]]
    at = f"file://{tmp_path}/cube"
    for k, load in enumerate(loads):
        cube.append_to_cube(cube.sales_cube(spark.createDataFrame(load, SALES)), at, f"day-{k}")
    cube.append_to_cube(cube.sales_cube(spark.createDataFrame(loads[0], SALES)), at, "day-0")  # a rerun counts once
    stored = cube.stored_cube(spark, at)
    expected = brute_roll_up([s for load in loads for s in load], by)
    assert rows(cube.roll_up(stored, by)) == expected
    merged = cube.merge_cubes([stored.filter("year = 1995"), stored.filter("year <> 1995 OR year IS NULL")])
    assert rows(cube.roll_up(merged, by)) == expected
    assert merged.groupBy("year", "month", "region", "block").count().filter("count > 1").isEmpty()


def test_roll_ups_read_the_cube_and_not_the_fact(spark):
    for name in ("cube_by_year", "cube_by_region", "cube_monthly"):
        text = plan(QUERIES[name](spark, DATA))
        assert "lineitem" not in text and "orders.parquet" not in text and "wayfreight/cube" in text


def test_ids_that_are_no_numbers(spark):
    ids = [f"c{k % 30}" for k in range(200)] + [None]
    sales = spark.createDataFrame([(1995, 1, "ASIA", i, Decimal(1), 1) for i in ids], SALES)
    with pytest.raises(Exception, match="without a number"):
        cube.sales_cube(sales).collect()
    numbers = cube.customer_numbers(sales)
    assert sorted(r.customer_no for r in numbers.collect()) == list(range(30))
    counted = cube.sales_cube(sales.join(numbers, "customer_id", "left"), "customer_no")
    assert rows(cube.roll_up(counted, ["region"])) == [("ASIA", Decimal(201), 201, 30)]
    later = sales.withColumn("customer_id", F.regexp_replace("customer_id", "^c1", "new"))
    more = cube.customer_numbers(later, numbers)
    before, after = dict(rows(numbers)), dict(rows(more))
    assert {k: after[k] for k in before} == before
    assert sorted(v for k, v in after.items() if k not in before) == list(range(30, 30 + len(after) - 30)) and len(after) == 41


def test_an_empty_cube(spark):
    none = cube.sales_cube(spark.createDataFrame([], SALES))
    assert rows(cube.roll_up(none, ["year"])) == []
    assert rows(cube.roll_up(none)) == [(None, None, 0)]


def test_loads_have_plain_names(spark):
    with pytest.raises(ValueError, match="load"):
        cube.append_to_cube(spark.range(1), "/nowhere", "../x")


# --- changes between scans -------------------------------------------------------------------------


def frame(spark, state):
    listed = [(app, path, len(text), text) for (app, path), text in state.items()]
    return spark.createDataFrame(listed, "app_id string, path string, size bigint, digest string")


def brute_changes(old, new):
    found, gone, come = [], defaultdict(list), defaultdict(list)
    for at in sorted(old.keys() | new.keys()):
        if at not in new:
            gone[old[at]].append(at)
        elif at not in old:
            come[new[at]].append(at)
        elif old[at] != new[at]:
            found.append((*at, "changed", None, None))
    for text in gone.keys() | come.keys():
        if len(gone[text]) == len(come[text]) == 1:
            found.append((*come[text][0], "moved", *gone[text][0]))
        else:
            found += [(*at, "removed", None, None) for at in gone[text]] + [(*at, "added", None, None) for at in come[text]]
    return sorted(found, key=str)


def random_estate(rng, n=120):
    folders = ["", "a/", "a/b/", "a/b/c/", "d/", "d/e/", "a b/é/"]
    return {(f"app{rng.randrange(4)}", f"{rng.choice(folders)}f{rng.randrange(40)}.py"): rng.choice(["", "same", f"t{rng.randrange(10**6)}"]) for _ in range(n)}


def altered(rng, state):
    out = {}
    for (app, path), text in state.items():
        n = rng.random()
        if n < 0.05:
            continue
        if n < 0.1:
            text += "more"
        elif n < 0.15:
            path = f"moved/{path}"
        elif n < 0.18:
            app = "app9"
        out[app, path] = text
        if n > 0.97:
            out[app, f"new/x/{path}"] = text
    return out


@pytest.mark.parametrize("seed", range(3))
def test_changes_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    old = random_estate(rng)
    new = altered(rng, old)
    before, after = (changes.take_snapshot(frame(spark, s), f"file://{tmp_path}/{n}") for n, s in (("old", old), ("new", new)))
    assert rows(changes.estate_changes(spark, before, after)) == brute_changes(old, new)
    differing = {at for at in old.keys() | new.keys() if old.get(at) != new.get(at)}
    expected = defaultdict(bool)
    for app, path in differing:
        parts = path.split("/")[:-1]
        for k in range(len(parts) + 1):
            expected[app, "/".join(parts[:k])] |= k == len(parts)
    assert rows(changes.changed_folders(spark, before, after)) == sorted(((*k, own) for k, own in expected.items()), key=str)


def test_unchanged_estates_and_empty_ones(spark, tmp_path):
    state = random_estate(random.Random(9))
    one, other = (changes.take_snapshot(frame(spark, state).repartition(n), f"file://{tmp_path}/{n}") for n in (1, 5))
    assert changes.changed_folders(spark, one, other).count() == 0
    assert rows(changes.estate_changes(spark, one, other)) == []
    none = changes.take_snapshot(frame(spark, state).limit(0), f"file://{tmp_path}/none")
    assert rows(changes.estate_changes(spark, none, none)) == []
    assert {r.change for r in changes.estate_changes(spark, none, one).collect()} == {"added"}
    assert {r.change for r in changes.estate_changes(spark, one, none).collect()} == {"removed"}


def test_only_changed_folders_are_looked_into(spark, tmp_path, monkeypatch):
    """A change deep in one of many folders: each level compares that branch only, and the walk ends with it."""
    old = {("app", f"d{n}/e{m}/f/x.py"): f"{n} {m}" for n in range(20) for m in range(5)} | {("calm", "x/y/z/w/v.py"): "1"}
    new = old | {("app", "d3/e2/f/x.py"): "other"}
    before, after = (changes.take_snapshot(frame(spark, s), f"file://{tmp_path}/{n}") for n, s in (("old", old), ("new", new)))
    levels = []
    real = changes._kept
    monkeypatch.setattr(changes, "_kept", lambda df, purpose: levels.append((purpose, plan(df))) or real(df, purpose))
    assert rows(changes.changed_folders(spark, before, after)) == [
        ("app", "", False), ("app", "d3", False), ("app", "d3/e2", False), ("app", "d3/e2/f", True)
    ]
    assert len(levels) == 5  # four that differ, and one more that finds nothing; the calm application has five
    for depth, (_, text) in enumerate(levels):
        assert set(re.findall(r"\(depth#\d+ = (\d)\)", text)) == {str(depth)}
    seen = []
    monkeypatch.setattr(changes, "_kept", lambda df, purpose: seen.append((purpose, real(df, purpose))) or seen[-1][1])
    assert changes.estate_changes(spark, before, after).count() == 1
    assert next(df for purpose, df in seen if purpose == "changed-files").count() == 1


def test_a_folder_that_moves_keeps_its_digests(spark):
    state = {("a", "p/q/x.py"): "1", ("a", "p/q/r/y.py"): "2", ("b", "z/x.py"): "1", ("b", "z/r/y.py"): "2"}
    found = {(r.app_id, r.folder): tuple(r[c] for c in changes.DIGESTS) for r in changes.folder_digests(frame(spark, state)).collect()}
    assert found["a", "p/q"] == found["b", "z"] and found["a", "p/q/r"] == found["b", "z/r"]
    assert found["a", "p"] != found["b", ""]


def test_a_listing_alone_shows_changes(spark, tmp_path):
    schema = "app_id string, path string, is_dir boolean, size bigint, mtime double, error string"
    old = [("a", "", True, None, None, None), ("a", "x.py", False, 3, 1.0, None), ("a", "y.py", False, None, None, None), ("a", "z.py", False, 4, 2.0, None)]
    new = [*old[:1], ("a", "x.py", False, 3, 9.0, None), *old[2:]]
    before, after = (
        changes.take_snapshot(changes.listed(spark.createDataFrame(s, schema)), f"file://{tmp_path}/{n}") for n, s in (("old", old), ("new", new))
    )
    assert rows(changes.estate_changes(spark, before, after), "path", "change") == [("x.py", "changed")]


# --- upkeep of application facts -------------------------------------------------------------------

TEXTS = ["", "x = 1", "import streamlit as st\n", "@udf\nsession.sql(q)", "from flask import Flask", "@sproc", b"\xff"]
SQLS = ["select 1", "CREATE OR REPLACE VIEW v", "create or replace function f", "CREATE OR REPLACE PROCEDURE p"]


def random_files(rng, n=60):
    found = {}
    for _ in range(n):
        app = f"app{rng.randrange(6)}"
        k = rng.randrange(30)
        if rng.random() < 0.6:
            found[app, f"m{k}.py"] = rng.choice(TEXTS)
        elif rng.random() < 0.8:
            found[app, f"s{k}.sql"] = rng.choice(SQLS)
        else:
            found[app, f"d{k}/requirements.txt"] = rng.choice(["snowflake-connector-python>=3\npandas", "pandas", b"\xff", "snowflake-snowpark-python"])
    return found


FACTS = (
    "app_id", "python_files", "sql_files", "components", "ui_pages", "unreadable_files", "unreadable_requirements", "has_streamlit", "has_api",
    "has_stored_procedures", "has_udfs", "needs_connector", "needs_snowpark", "api_usage_total", "features", "score", "migration_complexity", "app_type", "has_api_usage",
)


def test_facts_after_many_changes_equal_a_full_run(spark, make_files, tmp_path):
    rng = random.Random(6)
    at = f"file://{tmp_path}/facts"
    state = random_files(rng)
    upkeep.start_upkeep(classify.file_facts(make_files(state)), at)
    for batch in (1, 2, 3):
        before = dict(state)
        for key in rng.sample(sorted(state), 12):
            del state[key]
        if batch == 2:  # an application goes, and one comes
            state = {k: v for k, v in state.items() if k[0] != "app3"} | {("fresh", "a.py"): "@udf"}
        state |= random_files(rng, 10)
        gone = {k: v for k, v in before.items() if state.get(k) != v}
        come = {k: v for k, v in state.items() if before.get(k) != v}
        for _ in range(2):  # a retry counts once
            upkeep.keep_up(at, batch, classify.file_facts(make_files(come)), classify.file_facts(make_files(gone)))
        full = appfacts.app_facts(classify.file_facts(make_files(state)))
        assert rows(upkeep.facts_of_totals(upkeep.totals(spark, at)), *FACTS) == rows(full, *FACTS)
        touched = {k[0] for k in gone} | {k[0] for k in come}
        written = {r.app_id for r in spark.read.parquet(f"{at}/batch={batch}").collect()}
        assert written <= touched
        found = {r[0]: r for r in rows(upkeep.changed_facts(spark, at, batch), *FACTS)}
        assert found.keys() == written
        whole = {r[0]: r for r in rows(full, *FACTS)}
        assert {app: r for app, r in found.items() if app in whole} == {app: whole[app] for app in written & whole.keys()}
        assert written - whole.keys() == ({"app3"} if batch == 2 else set())
    upkeep.compact(spark, at, f"file://{tmp_path}/compact")
    assert rows(upkeep.facts_of_totals(upkeep.totals(spark, f"file://{tmp_path}/compact")), *FACTS) == rows(full, *FACTS)
    everyone = spark.createDataFrame([(f"app{k}",) for k in range(9)] + [("fresh",)], "app_id string")
    all_apps = appfacts.app_facts(classify.file_facts(make_files(state)), everyone)
    assert rows(upkeep.facts_of_totals(upkeep.totals(spark, at), everyone), *FACTS) == rows(all_apps, *FACTS)


def test_an_application_that_loses_its_files_is_reported_with_zeros(spark, make_files, tmp_path):
    at = f"file://{tmp_path}/facts"
    files = classify.file_facts(make_files({("a", "x.py"): "@udf", ("b", "y.py"): "z"}))
    upkeep.start_upkeep(files, at)
    upkeep.keep_up(at, 1, None, files.filter("app_id = 'a'"))
    assert rows(upkeep.totals(spark, at), "app_id") == [("b",)]
    assert rows(upkeep.changed_facts(spark, at, 1), "app_id", "python_files", "has_udfs", "score") == [("a", 0, False, 0)]
    assert rows(upkeep.totals(spark, at, 0), "app_id") == [("a",), ("b",)]


def test_swapped_equals_leave_nothing_to_write(spark, make_files):
    one = classify.file_facts(make_files({("a", "x.py"): "@udf"}))
    other = classify.file_facts(make_files({("a", "renamed.py"): "@udf"}))
    assert rows(upkeep.signed_totals(other, one)) == []


def test_one_shuffle_by_application(spark, make_files):
    facts = classify.file_facts(make_files({("a", "x.py"): "@udf"}))
    text = plan(upkeep.signed_totals(facts, facts))
    assert text.count("Exchange") == 1 and "hashpartitioning(app_id" in text
