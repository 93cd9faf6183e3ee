"""The shared folder for intermediate tables."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from basketry.session import checkpoint_root, freeze, scratch_path, stage_scope


class Context(SimpleNamespace):
    """A stand-in for the Spark context: only the checkpoint folder and the master."""

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake_session(master, configured=None, folder=None):
    settings = {"spark.checkpoint.dir": configured, "spark.sql.warehouse.dir": "hdfs:///warehouse/"}
    conf = SimpleNamespace(get=lambda key, default=None: settings[key])
    return SimpleNamespace(sparkContext=Context(master=master, folder=folder), conf=conf)


def test_the_named_folder_wins():
    assert checkpoint_root(fake_session("yarn", folder="hdfs:///set")) == "hdfs:///set"
    assert checkpoint_root(fake_session("yarn", configured="hdfs:///named")) == "hdfs:///named"


def test_without_a_named_folder_the_warehouse_holds_the_stages():
    for master in ("local[2]", "yarn"):
        assert checkpoint_root(fake_session(master)) == "hdfs:///warehouse/_stages"


def test_a_scope_leaves_nothing_behind(spark):
    from pathlib import Path

    folder = Path(checkpoint_root(spark).removeprefix("file:"))
    before = freeze(spark.range(3))
    there = {p.name for p in folder.iterdir()}
    with stage_scope(spark):
        with stage_scope(spark):
            inner = freeze(spark.range(5))
            assert inner.count() == 5
        freeze(spark.range(7))
        assert len({p.name for p in folder.iterdir()} - there) == 1
    assert {p.name for p in folder.iterdir()} == there and before.count() == 3


def test_frozen_rows_do_not_change(spark):
    from pyspark.sql import functions as F

    frozen = freeze(spark.range(100).withColumn("x", F.rand()))
    assert frozen.exceptAll(frozen).count() == 0
    assert frozen.agg(F.sum("x")).first() == frozen.agg(F.sum("x")).first()
    assert scratch_path(spark, "t") != scratch_path(spark, "t")


def test_scope_of_one_thread_keeps_tables_of_others(spark):
    from concurrent.futures import ThreadPoolExecutor

    from basketry.session import freeze, stage_scope

    with ThreadPoolExecutor(1) as other:
        with stage_scope(spark, own_thread=True):
            own, kept = freeze(spark.range(5)), other.submit(lambda: freeze(spark.range(7))).result()
    assert kept.count() == 7
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        own.collect()


def test_shuffle_files_of_a_stored_step_are_removed(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = manager.getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {n for n in names if n.startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffles(), spark.conf.get(setting, "false")
    kept = freeze(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert kept.count() == 10 and spark.conf.get(setting, "false") == given
