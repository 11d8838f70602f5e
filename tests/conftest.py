from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from wayfreight.session import local_session

    session = local_session("8", shuffle_partitions=8, app="wayfreight-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """Decoded file rows from {(app, path): text or bytes}."""
    from wayfreight.schemas import RAW_FILES
    from wayfreight.sources.files import decode_files

    def make(entries):
        rows = [
            (app, path, bytearray(text.encode() if isinstance(text, str) else text))
            for (app, path), text in entries.items()
        ]
        return decode_files(spark.createDataFrame(rows, RAW_FILES))

    return make


@pytest.fixture
def make_estate(spark, make_files):
    """An estate from {(app, path): text}; manifests are told apart by their path."""
    from pyspark.sql import functions as F

    from wayfreight.plans.estate import Estate

    def make(entries, apps=()):
        files = make_files(entries)
        names = sorted({app for app, _ in entries} | set(apps))
        return Estate(
            files=files.filter(F.col("kind") != "manifest"),
            manifest_files=files.filter(F.col("kind") == "manifest"),
            apps=spark.createDataFrame([(n,) for n in names], "app_id string"),
        )

    return make


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
