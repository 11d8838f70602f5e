from __future__ import annotations

from types import SimpleNamespace

import pytest

from wayfreight.session import drop_dir, shared_dir


class Conf:
    def get(self, key, default=None):
        return default


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master)), "x")


def test_folders_are_uris_and_can_be_dropped(spark, tmp_path):
    at = shared_dir(spark, "x")
    assert at.startswith("file:/")
    spark.range(3).write.parquet(at)
    drop_dir(spark, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(at)
