"""From a folder of applications to written results and back to files."""

from __future__ import annotations

import json

from conftest import rows
from test_appfacts import DASHBOARD, MANIFEST, SETUP
from test_tree import build

from wayfreight.plans import migration


def test_tree_to_results_to_tree(spark, tmp_path):
    root, out, back = tmp_path / "apps", str(tmp_path / "out"), tmp_path / "migrated"
    build(
        root,
        {
            "Shop/streamlit_app.py": DASHBOARD.encode(),
            "Shop/setup.sql": SETUP.encode(),
            "Shop/manifest.yml": MANIFEST.encode(),
            "Shop/requirements.txt": b"pandas==1\nsnowflake-connector-python\n",
            "Shop/bad.py": b"\xff",
            "Shop/lib/helper.py": b"from snowflake.snowpark import Session\nsession.table(1)\n",
        },
    )
    (root / "Hollow").mkdir()
    estate = migration.estate_of_tree(spark, str(root))
    migration.migrate(estate, out)

    report = {}
    for part in (tmp_path / "out" / "report").glob("part-*"):
        for line in part.read_text().splitlines():
            report[json.loads(line)["app_name"]] = json.loads(line)
    assert set(report) == {"Shop", "Hollow"}
    shop = report["Shop"]
    assert (shop["python_files"], shop["components"], shop["migration_complexity"]) == (3, 3, "high")
    assert shop["api_usage"] == {"from snowflake.snowpark": 2, "session.table": 2}
    assert shop["warnings"] == [{"code": "file_unreadable", "n": 1}]
    assert report["Hollow"]["warnings"] == [{"code": "manifest_missing", "n": 1}]

    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert rows(read("warnings"), "app_id", "code", "path") == [
        ("Hollow", "manifest_missing", None), ("Shop", "file_unreadable", "bad.py"),
    ]
    assert rows(read("requirements").filter("app_id = 'Shop'"), "requirement") == [
        ("databricks-sql-connector>=3.0.0",), ("pandas",), ("pyspark>=3.5.0",), ("streamlit>=1.30.0",),
    ]
    assert read("provisioning").count() == 2 + 2 + 3
    assert rows(read("coverage"), "app_id", "components", "written", "skipped_type") == [("Shop", 3, 2, 1)]

    assert migration.export_converted(spark, out, str(back)) == 2
    helper = (back / "Shop" / "src" / "helper.py").read_text()
    assert helper == "from pyspark.sql import SparkSession, DataFrame\nspark.table(1)\n"
    ui = (back / "Shop" / "src" / "streamlit_app.py").read_text()
    assert "def get_db_connection" in ui and "spark.table(" in ui and "import snowflake.connector" not in ui


def test_analysis_only_writes_no_conversion(spark, make_estate, tmp_path):
    estate = make_estate({(f"a{n % 3}", f"x{n}.py"): b"\xff" for n in range(30)})
    migration.migrate(estate, str(tmp_path), convert=False)
    assert not (tmp_path / "converted").exists()
    assert spark.read.parquet(str(tmp_path / "warnings")).filter("code = 'file_unreadable'").count() == 30
