"""SQL over plain tables: views by name, and table functions with named parameters on top of them."""

from pyspark.sql import DataFrame, SparkSession

from tallyward.policy import LatenessPolicy

ARRIVED = "trips_arrived"
COUNTED = "windows_between"


def register(spark: SparkSession, trips: DataFrame, counts: DataFrame, policy: LatenessPolicy) -> None:
    """Views `trips` and `zone_counts`, and two functions for queries like

    SELECT * FROM windows_between(zone => 'airport', since => TIMESTAMP '2024-01-02', upto => TIMESTAMP '2024-01-03')

    A parameter that is left out, or NULL, does not restrict. Functions are inlined into the query, so filters and
    columns reach the files as if they had been written there.
    """
    trips.createOrReplaceTempView("trips")
    counts.createOrReplaceTempView("zone_counts")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {ARRIVED}(
            zone STRING DEFAULT NULL, since TIMESTAMP DEFAULT NULL, upto TIMESTAMP DEFAULT NULL)
        RETURNS TABLE (trip_seq BIGINT, zone STRING, event_time TIMESTAMP, processing_time TIMESTAMP, delay_seconds DOUBLE)
        RETURN SELECT t.trip_seq, t.zone, t.event_time, t.processing_time,
                      (unix_micros(t.processing_time) - unix_micros(t.event_time)) / 1e6D
               FROM trips t
               WHERE ({ARRIVED}.zone IS NULL OR t.zone = {ARRIVED}.zone)
                 AND ({ARRIVED}.since IS NULL OR t.processing_time >= {ARRIVED}.since)
                 AND ({ARRIVED}.upto IS NULL OR t.processing_time < {ARRIVED}.upto)
    """)
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {COUNTED}(
            zone STRING DEFAULT NULL, since TIMESTAMP DEFAULT NULL, upto TIMESTAMP DEFAULT NULL)
        RETURNS TABLE (zone STRING, window_start TIMESTAMP, window_end TIMESTAMP, trip_count BIGINT)
        RETURN SELECT c.zone, c.window_start, c.window_start + INTERVAL '{policy.window_minutes}' MINUTE, c.trip_count
               FROM zone_counts c
               WHERE ({COUNTED}.zone IS NULL OR c.zone = {COUNTED}.zone)
                 AND ({COUNTED}.since IS NULL OR c.window_start >= {COUNTED}.since)
                 AND ({COUNTED}.upto IS NULL OR c.window_start < {COUNTED}.upto)
    """)
