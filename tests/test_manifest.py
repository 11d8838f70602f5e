from __future__ import annotations

import pytest
from conftest import rows

from wayfreight.operators import manifest

FULL = """manifest_version: 1
version: {name: 1.0.0, label: Sales}
artifacts:
  - {src: a.py, dest: /}
  - {src: b.sql}
privileges:
  - USAGE on SCHEMA: [s1]
  - select ON ALL TABLES IN SCHEMA: [s1, s2]
  - privilege: CREATE DATABASE
  - EXECUTE
  - APPLICATION ROLE on SCHEMA: []
configuration: {log_level: INFO, since: 2024-01-01}
"""


@pytest.fixture
def catalogue(make_estate):
    def read(texts, apps=()):
        estate = make_estate(texts, apps)
        return estate, {r.app_id: r for r in estate.catalog.collect()}

    return read


def test_status_defaults_and_preference(catalogue):
    _, got = catalogue(
        {
            ("full", "manifest.yml"): FULL,
            ("both", "manifest.yaml"): "version: {name: old}",
            ("both", "manifest.yml"): "version: {name: new}",
            ("bare", "manifest.yaml"): "privileges: []",
            ("float", "manifest.yml"): "version: {name: 1.0}",
            ("null_name", "manifest.yml"): "version: {name: null}",
            ("null_version", "manifest.yml"): "version:",
            ("text", "manifest.yml"): "version: abc",
            ("empty", "manifest.yml"): "",
            ("list", "manifest.yml"): "- a",
            ("broken", "manifest.yml"): "a: [",
            ("bytes", "manifest.yml"): b"\xff",
            ("nested", "sub/manifest.yml"): FULL,
        },
        apps=["none"],
    )
    status = {app: r.status for app, r in got.items()}
    assert status == {
        **dict.fromkeys(["full", "both", "bare", "float", "null_name"], "ok"),
        **dict.fromkeys(["null_version", "text", "empty", "list", "broken", "bytes"], "invalid"),
        **dict.fromkeys(["none", "nested"], "missing"),
    }
    assert (got["full"].manifest_version, got["full"].version, got["full"].label) == ("1", "1.0.0", "Sales")
    assert got["both"].version == "new"
    assert (got["bare"].manifest_version, got["bare"].version, got["bare"].has_privileges) == ("unknown", "1.0", False)
    assert got["float"].version == "1.0"
    assert got["null_name"].version is None
    assert got["full"].has_privileges


def test_privileges_explode_and_map(catalogue):
    estate, _ = catalogue({("full", "manifest.yml"): FULL})
    mapped = manifest.privilege_map(estate.privileges).drop("app_id", "key_no", "entry_key")
    got = sorted(tuple(r) for r in mapped.collect())
    assert got == [
        (1, 1, "USAGE", "SCHEMA", "s1", "USE SCHEMA"),
        (2, 1, "SELECT", "ALL TABLES IN SCHEMA", "s1", "SELECT"),
        (2, 2, "SELECT", "ALL TABLES IN SCHEMA", "s2", "SELECT"),
        (3, 1, "PRIVILEGE", None, "CREATE DATABASE", "needs_review"),
        (4, 1, "EXECUTE", None, None, "EXECUTE"),
        (5, 1, "APPLICATION ROLE", "SCHEMA", None, "SERVICE PRINCIPAL"),
    ]
    assert rows(manifest.manifest_permissions(estate.privileges)) == [("full", 3, "CAN_VIEW", "CREATE DATABASE")]


def test_artifacts_and_plan(catalogue):
    estate, _ = catalogue({("My App", "manifest.yml"): FULL})
    assert rows(manifest.manifest_artifacts(estate.manifests)) == [("My App", 1, "a.py", "/"), ("My App", 2, "b.sql", None)]
    plan = manifest.provisioning_plan(estate.apps, estate.privileges).orderBy("step", "part").collect()
    assert [(r.step, r.part, r.action) for r in plan] == [
        (1, 1, "create_catalog"),
        (2, 1, "create_schema"),
        (3, 1, "grant"),
        (4, 1, "grant"),
        (4, 2, "grant"),
        (5, 1, "needs_review"),
        (6, 1, "grant"),
        (7, 1, "grant"),
    ]
    assert [r.detail for r in plan[:3]] == ["my app_catalog", "my app_catalog.main", "USE SCHEMA on SCHEMA s1"]


def test_odd_values_keep_the_rest_of_the_manifest(catalogue):
    text = """manifest_version: 1
version: {name: "2"}
privileges:
  - USAGE on SCHEMA: [s1]
configuration:
  limit: .nan
  top: [.inf, 1]
  2024-01-05: when
  3: three
"""
    estate, found = catalogue({("odd", "manifest.yml"): text})
    assert found["odd"].status == "ok" and found["odd"].version == "2"
    assert estate.privileges.count() == 1
    settings = dict(rows(manifest.manifest_configuration(estate.manifests), "key", "value"))
    assert settings["limit"] == "nan" and settings["2024-01-05"] == "when" and settings["3"] == "three"


def test_entries_with_several_keys_are_one_step(catalogue):
    text = "privileges:\n  - privilege: A\n    comment: b\n  - USAGE on SCHEMA: [s1, s2]\n    SELECT on TABLE: [t]\n"
    estate, _ = catalogue({("two", "manifest.yml"): text})
    keyed = rows(estate.privileges, "entry_no", "key_no", "object_no")
    assert len(set(keyed)) == len(keyed) == 5
    plan = [(r.step, r.part, r.detail) for r in manifest.provisioning_plan(estate.apps, estate.privileges).orderBy("step", "part").collect()]
    assert plan[2:] == [
        (3, 1, "needs_review on ? A"),
        (4, 1, "SELECT on TABLE t"),
        (4, 2, "USE SCHEMA on SCHEMA s1"),
        (4, 3, "USE SCHEMA on SCHEMA s2"),
    ]
    assert len(rows(manifest.manifest_permissions(estate.privileges))) == 1


def test_the_cause_of_a_bad_manifest_is_kept(catalogue):
    _, found = catalogue({("bad", "manifest.yml"): "a: [1\nb: 2"})
    assert found["bad"].status == "invalid"
    assert "Error: while parsing" in found["bad"].error and "(line 2" in found["bad"].error
