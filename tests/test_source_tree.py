from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, IsNull, LessThan, Not, StringContains, StringStartsWith
from test_tree import build

from wayfreight.sources import files, source_tree, tree

ENTRIES = {
    "app one/__init__.py": b"",
    "app one/_priv/_u.py": b"x = 1",
    "app one/.hid/deep/er/q.sql": b"select 1",
    "app one/requirements.txt": b"pandas",
    "app one/manifest.yml": b"a: 1",
    "app one/sub/manifest.yml": b"a: 2",
    "app one/data.csv": b"1,2",
    "app two/bad.py": b"\xff",
    "app two/sql/s.sql": b"select 2",
    "loose.py": b"belongs to no application",
}


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "estate"
    build(at, ENTRIES)
    (at / "hollow").mkdir()
    os.symlink(at / "app two", at / "app one" / "linked")
    os.symlink(at / "nowhere", at / "app one" / "dangling.py")
    return str(at)


def explained(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_rows_are_those_of_the_distributed_walk(spark, root):
    found = source_tree.source_tree(spark, root)
    picked = rows(tree.estate_scan(tree.list_tree(spark, root)), "app_id", "path", "kind", "size")
    assert rows(found, "app_id", "path", "kind", "size") == picked
    read = {(r.app_id, r.path): r.content if r.content is None else bytes(r.content) for r in found.collect()}
    assert read == {
        tuple(k.split("/", 1)): v for k, v in ENTRIES.items() if k.endswith((".py", ".sql", "requirements.txt", "one/manifest.yml")) and "/" in k
    } | {("app one", "dangling.py"): None}
    assert rows(found.filter("error IS NOT NULL"), "path", "error") == [("dangling.py", "FileNotFoundError")]
    everything = source_tree.source_tree(spark, root, all="true")
    assert rows(everything.filter("kind = 'other'"), "path") == [("data.csv",), ("sub/manifest.yml",)]


@pytest.mark.parametrize(
    "where",
    [
        "kind = 'sql'",
        "app_id = 'app two'",
        "app_id IN ('app two', 'nobody') AND path LIKE 'sql/%'",
        "path LIKE '.hid/%' AND size > 3",
        "path = 'sub/manifest.yml' OR path = '_priv/_u.py'",
        "path IN ('sub/manifest.yml', '_priv/_u.py')",
        "kind <> 'python' AND NOT path LIKE '%sql%'",
        "size IS NULL",
        "size <= 5 AND octet_length(content) > 0",
        "path LIKE '%e%r%' AND app_id > 'app one'",
        "app_id = 'nobody'",
    ],
)
def test_pushed_filters_select_the_same_rows(spark, root, where):
    plain = source_tree.source_tree(spark, root).filter(where)
    assert rows(source_tree.source_tree(spark, root, where), "app_id", "path", "kind", "size", "content", "error") == rows(
        plain, "app_id", "path", "kind", "size", "content", "error"
    )


def test_filters_show_in_the_plan_and_need_no_second_look(spark, root):
    found = source_tree.source_tree(spark, root, "kind = 'sql' AND path LIKE 'sql/%' AND size > 1")
    text = explained(spark, found)
    assert "EqualTo(kind,sql)" in text and "StringStartsWith(path,sql/)" in text and "GreaterThan(size,1)" in text
    assert "Filter" not in found._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "").replace("RuntimeFilters", "")


def reader_for(root, filters=(), **options):
    reader = source_tree.SourceTreeReader({"path": root, "push": "true", **options})
    assert list(reader.pushFilters(list(filters))) == [f for f in filters if not source_tree.decidable(f)]
    return reader


def test_files_that_fail_are_never_opened(root, monkeypatch):
    opened = []
    real = source_tree.Tree.read
    monkeypatch.setattr(source_tree.Tree, "read", lambda self, app, path: opened.append(path) or real(self, app, path))
    reader = reader_for(root, [EqualTo(("kind",), "sql"), StringStartsWith(("path",), "sql/")])
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [(r["path"], r["content"]) for r in found] == [("sql/s.sql", b"select 2")] and opened == ["sql/s.sql"]
    reader = reader_for(root, content="false")
    assert len([r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]) == 8
    assert opened == ["sql/s.sql"]


def test_folders_that_cannot_match_are_not_walked(root, monkeypatch):
    def walked(*filters):
        seen = []
        real = source_tree.Tree.children
        monkeypatch.setattr(source_tree.Tree, "children", lambda self, app, folder: seen.append((app, folder)) or real(self, app, folder))
        reader_for(root, filters).partitions()
        monkeypatch.setattr(source_tree.Tree, "children", real)
        return {f for f in seen if f != ("", "")}

    assert len(walked()) == 9
    assert walked(EqualTo(("app_id",), "app two")) == {("app two", ""), ("app two", "sql")}
    assert walked(In(("app_id",), ("app two", "x")), StringStartsWith(("path",), "sq")) == {("app two", ""), ("app two", "sql")}
    assert walked(EqualTo(("path",), ".hid/deep/x.py")) == {("app one", ""), ("app two", ""), ("hollow", ""), ("app one", ".hid"), ("app one", ".hid/deep")}
    assert walked(StringContains(("path",), "deep"), Not(EqualTo(("app_id",), "app two"))) == walked()


def test_one_partition_for_each_batch_of_folders(spark, tmp_path):
    build(tmp_path, {f"hot/d{n}/f{m}.py": b"x" for n in range(60) for m in range(5)} | {"cold/f.py": b"y"})
    reader = reader_for(str(tmp_path), folders="10")
    parts = reader.partitions()
    assert [len(p.folders) for p in parts] == [10] * 6 + [2]
    assert source_tree.source_tree(spark, str(tmp_path), folders="10").count() == 301


def test_a_saved_listing_takes_the_place_of_the_walk(spark, root, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/listing"
    tree.save_listing(tree.list_tree(spark, root), at, rows_per_task=4)
    walked = source_tree.source_tree(spark, root)
    columns = ("app_id", "path", "kind", "size", "content", "error")
    assert rows(source_tree.source_tree(spark, root, listing=at), *columns) == rows(walked, *columns)
    assert rows(source_tree.source_tree(spark, root, "kind = 'sql'", listing=at), *columns) == rows(walked.filter("kind = 'sql'"), *columns)
    monkeypatch.setattr(source_tree.Tree, "children", None)
    reader = reader_for(root, listing=at)
    parts = reader.partitions()
    assert len(parts) > 3 and all(isinstance(p, source_tree.Listed) for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == walked.count()


def test_without_push_one_relation_serves_two_filters(spark, root):
    found = source_tree.source_tree(spark, root)
    both = found.filter("kind = 'sql'").union(found.filter("kind = 'python'"))
    assert rows(both.groupBy("kind").count()) == [("python", 4), ("sql", 2)]
    assert found.count() == 8


def test_sql_reads_the_source(spark, root):
    source_tree.source_tree(spark, root).createOrReplaceTempView("estate_files")
    assert rows(spark.sql("SELECT kind, count(*) FROM estate_files GROUP BY kind")) == [("manifest", 1), ("python", 4), ("requirements", 1), ("sql", 2)]


def test_nulls_are_neither_true_nor_false():
    row = {"app_id": "a", "path": "p.py", "kind": "python", "size": None}
    assert source_tree.verdict(LessThan(("size",), 3), row) is None
    assert source_tree.verdict(Not(LessThan(("size",), 3)), row) is None
    assert source_tree.verdict(IsNull(("size",)), row) is True and source_tree.verdict(IsNotNull(("size",)), row) is False
    assert not source_tree.decidable(EqualTo(("content",), b"x")) and not source_tree.decidable(EqualTo(("kind", "x"), "y"))


def test_kinds_agree_with_the_column_expression(spark):
    paths = ["a.py", "a.PY", "sql/x.sql", "requirements.txt", "d/requirements.txt", "xrequirements.txt", "manifest.yml", "d/manifest.yml", "manifest.yaml", ".sql", "n"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.kind_of(F.col("path")).alias("kind"))
    assert {r.path: r.kind for r in frame.collect()} == {p: source_tree.kind_name(p) for p in paths}


def test_missing_roots_and_folders(spark, tmp_path):
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        source_tree.source_tree(spark, str(tmp_path / "nowhere")).count()
    assert source_tree.source_tree(spark, str(tmp_path)).count() == 0
    reader = reader_for(str(tmp_path))
    (row,) = [r for b in reader.read(source_tree.Folders([("a", "gone")])) for r in b.to_pylist()]
    assert (row["path"], row["kind"], row["error"]) == ("gone", None, "FileNotFoundError")


def test_the_query_leaves_the_walk_to_tasks(spark, monkeypatch):
    """Where a query is planned one process lists all folders; the reader travels by value, so the planner's has no walk either."""
    from wayfreight.plans.catalogue import QUERIES

    monkeypatch.setattr(source_tree.SourceTreeReader, "_walked", None)
    found = QUERIES["tree_source"](spark, "/root/testdata/sf0.001")
    wanted = QUERIES["estate_scan"](spark, "/root/testdata/sf0.001").filter("kind IN ('python', 'sql') AND NOT startswith(path, 'pages/')")
    assert rows(found) == rows(wanted) != []
