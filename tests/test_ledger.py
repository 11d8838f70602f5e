from __future__ import annotations

import os

import pytest
from conftest import rows

from wayfreight.functions import revenue
from wayfreight.streaming import ledger

SCHEMA = "id bigint, text string"


@pytest.fixture
def places(tmp_path):
    (tmp_path / "drop").mkdir()
    return str(tmp_path / "drop"), str(tmp_path / "target"), str(tmp_path / "checkpoint")


def deliver(drop, name, ids, broken=0):
    lines = [f'{{"id": {i}, "text": "t{i}"}}' for i in ids] + [f'{{"id": "x{n}' for n in range(broken)]
    with open(f"{drop}/{name}.json", "w") as out:
        out.write("\n".join(lines) + "\n")


def entries(spark, target):
    return sorted((os.path.basename(r.file), r.loaded, r.corrupt) for r in ledger.ledger(spark, target).collect())


def loaded(spark, target):
    return sorted(r.id for r in ledger.loaded_rows(spark, target, SCHEMA).collect())


def test_one_entry_a_file_and_reruns_add_nothing(spark, places):
    drop, target, checkpoint = places
    deliver(drop, "a", range(3), broken=2)
    deliver(drop, "b", range(3, 9))
    deliver(drop, "c", [], broken=1)
    for _ in range(2):
        ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA, files_per_batch=2)
        assert entries(spark, target) == [("a.json", 3, 2), ("b.json", 6, 0), ("c.json", 0, 1)]
        assert loaded(spark, target) == list(range(9))
    assert rows(ledger.quarantine(spark, target, SCHEMA), "row") == [('{"id": "x0',), ('{"id": "x0',), ('{"id": "x1',)]
    deliver(drop, "d", [9])
    ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA)
    assert loaded(spark, target) == list(range(10))


def test_a_crash_between_rows_and_ledger_is_mended_by_the_next_run(spark, places, monkeypatch):
    drop, target, checkpoint = places
    deliver(drop, "a", range(5), broken=1)

    def crash(entries, at):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(ledger, "_enter", crash)
        with pytest.raises(Exception, match="lost"):
            ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA)
    assert os.path.isdir(f"{target}/rows/batch=0")
    assert loaded(spark, target) == [] and entries(spark, target) == []
    deliver(drop, "b", range(5, 7))
    ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA)
    assert entries(spark, target) == [("a.json", 5, 1), ("b.json", 2, 0)]
    assert loaded(spark, target) == list(range(7))


def test_a_replaced_file_is_named_and_not_loaded_again(spark, places):
    drop, target, checkpoint = places
    deliver(drop, "a", range(2))
    deliver(drop, "b", range(2, 4))
    ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA)
    assert ledger.replaced_files(spark, drop, target).collect() == []
    deliver(drop, "a", range(50, 55))
    ledger.copy_with_ledger(spark, drop, target, checkpoint, SCHEMA)
    assert loaded(spark, target) == list(range(4))
    assert [os.path.basename(r.file) for r in ledger.replaced_files(spark, drop, target).collect()] == ["a.json"]


def test_before_any_load_and_clashing_names(spark, places):
    drop, target, checkpoint = places
    assert entries(spark, target) == [] and loaded(spark, target) == []
    with pytest.raises(ValueError, match="file"):
        ledger.copy_with_ledger(spark, drop, target, checkpoint, "file string")


def test_split_to_table_in_sql(spark):
    revenue.register_sql_functions(spark)
    frame = spark.createDataFrame([(1, "a.b..c"), (2, ""), (3, None), (4, r"x\Ey")], "id int, t string")

    def split(separator):
        return rows(spark.sql("SELECT id, s.index, s.value FROM {f} f, LATERAL split_to_table(f.t, :by) s", args={"by": separator}, f=frame))

    assert split(".") == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (2, 1, ""), (4, 1, r"x\Ey")]
    assert split(r"\E")[-2:] == [(4, 1, "x"), (4, 2, "y")]
    assert split("")[0] == (1, 1, "a.b..c")
