"""Arrival-window counts in Spark's own state store.

Spark's watermark moves between triggers and drops rows behind it, so it cannot give event-time counts whose rule
is stated per trip. On the arrival clock it is exact with no delay at all: the stream's trips are stored
in arrival order, batch by batch, so no trigger holds a row older than a trigger before it. Should Spark drop a row all
the same, the run fails instead of counting short.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.policy import LatenessPolicy
from tallyward.sources.trips import TRIP_SCHEMA

COUNTED = "zone STRING, window_start TIMESTAMP, trip_count BIGINT"


class ArrivalCounts:
    """Closed arrival windows of a stored stream, carried from run to run by the query's checkpoint."""

    def __init__(self, spark: SparkSession, trips_path: str, root: str, policy: LatenessPolicy | None = None):
        """trips_path is the trips_raw folder of a CountingStream, read after its run; root holds counts and checkpoint."""
        self.spark, self.trips_path, self.root = spark, trips_path, root.rstrip("/")
        self.policy = policy or LatenessPolicy()

    def counts(self) -> DataFrame:
        """The streaming aggregation: one state row per zone and open window."""
        # Files of runs of batches and folders of batches may stand side by side.
        trips = self.spark.readStream.schema(TRIP_SCHEMA).option("recursiveFileLookup", "true").parquet(self.trips_path)
        window = F.window("processing_time", f"{self.policy.window_minutes} minutes")
        return (
            trips.select("zone", "processing_time")
            .withWatermark("processing_time", "0 seconds")
            .groupBy("zone", window.alias("w"))
            .agg(F.count(F.lit(1)).alias("trip_count"))
            .select("zone", F.col("w.start").alias("window_start"), "trip_count")
        )

    def run(self) -> None:
        """Count what has been stored since the last run."""
        query = (
            self.counts()
            .writeStream.format("parquet")
            .option("path", f"{self.root}/arrival_counts")
            .option("checkpointLocation", f"{self.root}/_arrival_checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
        if dropped:
            raise ValueError(f"{dropped} groups of trips arrived behind trips of an earlier run")

    def closed(self) -> DataFrame:
        return self.spark.read.schema(COUNTED).parquet(f"{self.root}/arrival_counts")
