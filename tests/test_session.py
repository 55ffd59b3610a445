"""Staged tables: where they go, and that they go again."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallyward.session import CLEANUP, discard, shared_dir, stage


def test_staged_tables_are_read_back_and_discarded(spark):
    kept, gone = stage(spark.range(5), "kept"), stage(spark.range(7), "gone")
    folder = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert gone.count() == 7 and os.path.isdir(folder)
    discard(gone)
    assert not os.path.exists(folder) and kept.count() == 5


def test_the_shuffle_files_of_a_staged_table_go_with_its_write(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def of_shuffles():
        names = (f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))
        return {n for n in names if n.startswith("shuffle_")}

    before, setting = of_shuffles(), spark.conf.get(CLEANUP)
    counts = spark.range(10_000).groupBy((F.col("id") % 100).alias("key")).count()
    assert counts.count() == 100 and of_shuffles() - before
    known = of_shuffles()
    staged = stage(counts, "counts")
    for _ in range(50):  # files go just after the write
        if not of_shuffles() - known:
            break
        time.sleep(0.1)
    assert not of_shuffles() - known and staged.count() == 100 and spark.conf.get(CLEANUP) == setting


class _Session:
    """Just the settings that shared_dir asks for."""

    def __init__(self, master, warehouse, checkpoints=None):
        settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoints}
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings[key] or default)})
        self.sparkContext = type("Context", (), {"master": master})


def test_a_local_warehouse_is_refused_on_a_cluster():
    assert shared_dir(_Session("local[4]", "file:/tmp/w")) == "file:/tmp/w/staged"
    assert shared_dir(_Session("yarn", "hdfs://n/w/")) == "hdfs://n/w/staged"
    assert shared_dir(_Session("yarn", "file:/tmp/w", "s3a://b/c/")) == "s3a://b/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn", "file:/tmp/w"))
