"""Trips as an arrival stream: the JSON-lines form and a view over the `events` table."""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tallyward.policy import ZONES

# Arrival order. trip_seq breaks ties, so the order is total.
ARRIVAL = ("processing_time", "trip_seq")

TRIP_SCHEMA = (
    "trip_seq BIGINT, trip_id STRING, zone STRING, event_time TIMESTAMP, "
    "processing_time TIMESTAMP, fare DOUBLE, surge_multiplier DOUBLE"
)
OPTIONAL_COLUMNS = ("surge_multiplier",)
# Fields that nobody declared, as they came.
REST = "rest"

# Only what the view needs; the time is declared zoned because the pipeline works in UTC instants.
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE"

# Delay classes of the view, trips of a thousand: made up for this fixture, enough of each class to be seen.
DELAY_SHARES = {
    "street": {"normal": 900, "tunnel": 50, "very_late": 40, "next_morning": 10},
    "harbor": {"normal": 640, "tunnel": 310, "very_late": 40, "next_morning": 10},
}


def delay_limits(kind: str) -> dict[str, int]:
    """The draw (0 to 999) below which a trip is in a class or one before it."""
    return dict(zip(DELAY_SHARES[kind], accumulate(DELAY_SHARES[kind].values())))


# First day on which phones of the view send surge_multiplier.
SURGE_FROM = "2024-01-16"


def trips_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip view over `events`: zone, arrival clock and optional column derive from each row."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    event_id, ts = F.col("event_id"), F.col("ts")
    zone_no = F.col("user_id") % 6
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (zone_no + 1).cast("int"))
    draw = (event_id * 7919 + 104729) % 1000
    street, harbor = delay_limits("street"), delay_limits("harbor")

    def drawn(kind: str) -> Column:
        return draw < F.when(zone_no >= ZONES.index("harbor_north"), harbor[kind]).otherwise(street[kind])

    base = F.unix_micros(F.when(drawn("very_late"), ts).otherwise(F.date_trunc("day", ts)))
    delay_ms = (
        F.when(drawn("normal"), 1000 + event_id * 31 % 4001)
        .when(drawn("tunnel"), 120_000 + event_id * 6151 % 360_001)
        .when(drawn("very_late"), 1_200_000 + event_id * 9973 % 2_400_001)
        .otherwise(108_000_000 + event_id * 7907 % 10_800_001)
    )
    surge = F.when(
        ts >= F.lit(SURGE_FROM).cast("timestamp"), (1.0 + 0.25 * (event_id % 5)).cast("double")
    )
    return events.select(
        event_id.alias("trip_seq"),
        event_id.cast("string").alias("trip_id"),
        zone.alias("zone"),
        ts.alias("event_time"),
        F.timestamp_micros(base + delay_ms * 1000).alias("processing_time"),
        F.col("value").alias("fare"),
        surge.alias("surge_multiplier"),
    )


def through_day(trips: DataFrame, first_day: str, days: int) -> DataFrame:
    """Arrivals before the end of the given number of days. Arrival order is processing_time
    order, so this is exactly the prefix of the stream a stopped run has read."""
    stop = F.lit(first_day).cast("timestamp") + F.expr(f"INTERVAL '{int(days)}' DAY")
    return trips.where(F.col("processing_time") < stop)


def arrivals_between(trips: DataFrame, start_us: int | None, stop_us: int | None) -> DataFrame:
    """Half-open slice of the arrival clock, in epoch microseconds; None leaves that side open."""
    arrived = F.col("processing_time")
    if start_us is not None:
        trips = trips.where(arrived >= F.timestamp_micros(F.lit(start_us)))
    if stop_us is not None:
        trips = trips.where(arrived < F.timestamp_micros(F.lit(stop_us)))
    return trips


def write_arrivals(trips: DataFrame, path: str, files: int | None = None) -> None:
    """Append JSON lines in arrival order: files cover successive ranges, rows inside are sorted.

    A column that is NULL is left out of its line, as from a phone that does not know it yet.
    """
    if files == 1:
        # All tasks sort, each a range. The one that writes the file takes the sorted ranges one after another from disk,
        # and holds none of them.
        ranges = trips.orderBy(*ARRIVAL).persist(StorageLevel.DISK_ONLY)
        try:
            ranges.count()
            _write_lines(ranges.coalesce(1), path)
        finally:
            ranges.unpersist()
        return
    ranged = trips.repartitionByRange(files, *ARRIVAL) if files else trips.repartitionByRange(*ARRIVAL)
    _write_lines(ranged.sortWithinPartitions(*ARRIVAL), path)


def write_batches(numbered: DataFrame, path: str, rows_per_file: int) -> None:
    """Append JSON lines in arrival order, rows_per_file in each file but the last of all. numbered are trips with
    their batch_id for that batch size (number_arrivals)."""
    # A task holds whole batches, the shorter one last, so files that are cut by their length are the batches. Ranges would
    # be found by a look at all rows, for which they would be numbered once more.
    dealt = numbered.repartition("batch_id").sortWithinPartitions("batch_id", *ARRIVAL)
    added = ("position", "batch_id", "max_before", "watermark")
    _write_lines(dealt.drop(*added), path, maxRecordsPerFile=rows_per_file)


def _write_lines(rows: DataFrame, path: str, **options) -> None:
    wire = rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    wire.options(**options).json(path)


def _with_sequence(trips: DataFrame) -> DataFrame:
    """Producers that send no trip_seq get one from trip_id, so that equal arrival times still
    have one fixed order."""
    return trips.withColumn("trip_seq", F.coalesce("trip_seq", F.xxhash64("trip_id")))


def read_arrivals(spark: SparkSession, path: str | list[str], rest: bool = False) -> DataFrame:
    """Batch read of JSON lines. A malformed line fails the read instead of becoming NULLs.

    With rest, fields that TRIP_SCHEMA does not declare come as one VARIANT column `rest`, NULL where there are none.
    Lines are then parsed once more, so readers that want declared fields only leave it out.
    """
    if not rest:
        return _with_sequence(spark.read.schema(TRIP_SCHEMA).option("mode", "FAILFAST").json(path))
    declared = T.StructType.fromDDL(TRIP_SCHEMA)
    options = {"mode": "FAILFAST"}
    fields = F.map_filter(F.from_json("value", "MAP<STRING, VARIANT>", options), lambda k, v: ~k.isin(declared.names))
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", declared, options).alias("trip"),
        F.when(F.size(fields) > 0, F.parse_json(F.to_json(fields))).alias(REST),
    )
    return _with_sequence(parsed.select("trip.*", REST))
