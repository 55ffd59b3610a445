"""Session settings and staged tables in the shared checkpoint folder."""

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # INT96 timestamps carry no column statistics, so range filters could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Spark drops the shuffle files of a query when it ends. A table that was written does not need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The number of tasks that look up a list of paths; Spark's own is a task for each path.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to a session somebody else made."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "tallyward", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder, else one in the warehouse.

    A warehouse on a local disk serves a local master only, as executors elsewhere would not see what others wrote.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; the warehouse is {warehouse}")
    return f"{warehouse}/staged"


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tallyward/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A runtime setting that holds inside only."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df once and read it back.

    The result survives lost executors, is computed once however often it is used, and has a
    true size on file: Spark broadcasts it in a join only when that size is under
    spark.sql.autoBroadcastJoinThreshold, and otherwise shuffles with AQE skew handling. The shuffle files of
    the write are gone with it, so steps staged one after another need the disk of the largest, not of all.
    """
    spark = df.sparkSession
    path = path or new_dir(spark, label)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now.

    Spark removes them when the driver collects the plans that made them, which on a large heap may come only after
    the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no result depends on any more: what was made of them has been staged itself."""
    for table in staged:
        context = table.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if staged:
        release(staged[0].sparkSession)


def one_row(spark: SparkSession, schema: T.StructType, values: dict) -> DataFrame:
    """A single row of literals; missing values are NULL."""

    def literal(value):
        if isinstance(value, dict):
            return F.create_map(*[F.lit(part) for pair in value.items() for part in pair])
        return F.lit(value)

    columns = [literal(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(0, 1, 1, 1).select(*columns)
