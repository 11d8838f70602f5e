from __future__ import annotations

import os

from conftest import rows

from wayfreight.schemas import RAW_FILES
from wayfreight.sources import files, tree


def build(root, entries):
    for path, data in entries.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


def test_walk_sees_every_name_and_follows_no_folder_links(spark, tmp_path):
    root = tmp_path / "estate"
    build(
        root,
        {
            "app one/__init__.py": b"",
            "app one/_priv/_u.py": b"x = 1",
            "app one/.hid/deep/er/q.sql": b"select 1",
            "app one/requirements.txt": b"pandas",
            "app one/manifest.yml": b"a: 1",
            "app one/sub/manifest.yml": b"a: 2",
            "app one/data.csv": b"1,2",
            "app two/bad.py": b"\xff",
            "loose.py": b"belongs to no application",
        },
    )
    (root / "hollow").mkdir()
    os.symlink(root / "app two", root / "app one" / "linked")
    os.symlink(root / "app two" / "bad.py", root / "app one" / "link.py")
    os.symlink(root / "nowhere", root / "app one" / "dangling.py")

    listing = tree.list_tree(spark, str(root))
    assert rows(tree.apps_of(listing)) == [("app one",), ("app two",), ("hollow",)]
    picked = rows(tree.estate_scan(listing), "app_id", "path", "kind", "size")
    assert picked == sorted(
        [
            ("app one", ".hid/deep/er/q.sql", "sql", 8),
            ("app one", "__init__.py", "python", 0),
            ("app one", "_priv/_u.py", "python", 5),
            ("app one", "dangling.py", "python", None),
            ("app one", "link.py", "python", 1),
            ("app one", "manifest.yml", "manifest", 4),
            ("app one", "requirements.txt", "requirements", 6),
            ("app two", "bad.py", "python", 1),
        ],
        key=str,
    )
    decoded = files.decode_files(tree.read_tree(spark, str(root), listing))
    assert rows(files.read_errors(decoded), "path") == [("bad.py",), ("dangling.py",), ("link.py",)]
    assert rows(decoded.filter("path = '__init__.py'"), "content") == [("",)]
    assert rows(tree.stage_listing(listing.filter("app_id = 'app two'"))) == [("app two", 1, 1)]


def test_write_then_read_gives_the_same_bytes(spark, tmp_path):
    entries = [("a", f"d{n % 3}/é {n}.py", bytearray(os.urandom(n))) for n in range(40)]
    frame = spark.createDataFrame(entries, RAW_FILES).repartition(4)
    root = f"file:{tmp_path}/out"
    assert tree.write_tree(frame, root) == 40
    assert tree.write_tree(frame, root) == 40  # a second run replaces, it does not add
    back = {(r.app_id, r.path): bytes(r.content) for r in tree.read_tree(spark, root).collect()}
    assert back == {(a, p): bytes(c) for a, p, c in entries}


def test_empty_estate(spark, tmp_path):
    listing = tree.list_tree(spark, str(tmp_path))
    assert listing.count() == 0
    assert tree.read_tree(spark, str(tmp_path), listing).count() == 0


def test_a_hot_application_is_listed_by_folder(spark, tmp_path):
    root = tmp_path / "estate"
    build(root, {f"hot/d{n}/f{m}.py": b"x" for n in range(60) for m in range(5)} | {"cold/f.py": b"y"})
    assert rows(tree.stage_listing(tree.list_tree(spark, str(root)))) == [("cold", 1, 1), ("hot", 300, 300)]


def test_listing_through_a_uri_equals_the_local_walk(tmp_path):
    """The branch for object stores, driven over a file URI."""
    import pyarrow as pa

    build(tmp_path, {"app one/x y.py": b"abc", "app one/sub/.q.sql": b""})
    folders = pa.RecordBatch.from_pydict({"app_id": ["", "app one", "app one"], "path": ["", "", "sub"]})

    def listed(root):
        found = [row for batch in tree._list_folders(root)([folders]) for row in batch.to_pylist()]
        return sorted((r["app_id"], r["path"], r["is_dir"], r["size"]) for r in found)

    assert listed(tmp_path.as_uri()) == listed(str(tmp_path)) == [
        ("app one", "", True, None),
        ("app one", "sub", True, None),
        ("app one", "sub/.q.sql", False, 0),
        ("app one", "x y.py", False, 3),
    ]


def test_linked_applications_and_folders_that_cannot_be_listed(spark, tmp_path):
    root, elsewhere = tmp_path / "apps", tmp_path / "elsewhere"
    (root / "plain" / "sub").mkdir(parents=True)
    elsewhere.mkdir()
    (root / "plain" / "a.py").write_text("x = 1")
    (elsewhere / "b.py").write_text("y = 1")
    (root / "linked").symlink_to(elsewhere)
    (root / "plain" / "sub" / "circle").symlink_to(root / "plain")
    listing = tree.list_tree(spark, str(root))
    assert rows(tree.files_of(listing), "app_id", "path") == [("linked", "b.py"), ("plain", "a.py")]
    batch = tree._list_folders(str(root))
    import pyarrow as pa

    gone = pa.RecordBatch.from_pydict({"app_id": ["plain", "plain"], "path": ["gone", ""]})
    found = [r for b in batch(iter([gone])) for r in b.to_pylist()]
    assert [(r["path"], r["error"]) for r in found if r["error"]] == [("gone", "FileNotFoundError")]
    assert {r["path"] for r in found if not r["error"]} == {"a.py", "sub"}
