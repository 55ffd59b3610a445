"""Every query of the library by name, each over the whole `events` table of a data folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.clock import fmt, outside_day, within_day
from tallyward.functions.measures import zero_if_null
from tallyward.operators import arrival, asof, batches, counts, delays, equality, health, schema
from tallyward.operators.closing import flag_late, window_closers
from tallyward.plans import sql_functions
from tallyward.policy import BATCH_SIZE, BATCHES_PER_TRIGGER, CORRECTION_JOB, SAMPLE_ROWS, LatenessPolicy
from tallyward.session import new_dir, prepare, stage
from tallyward.sources.trips import (
    SURGE_FROM,
    arrivals_between,
    read_arrivals,
    through_day,
    trips_from_events,
    write_arrivals,
    write_batches,
)
from tallyward.streaming.ingest import COUNT_SCHEMA, CountingStream
from tallyward.streaming.native import ArrivalCounts
from tallyward.tables import changelog, corrections
from tallyward.tables.changelog import ChangeLog

POLICY = LatenessPolicy()
FIRST_DAY = "2024-01-01"
CORRECTED_DAY = "2024-01-02"
NEXT_DAY = "2024-01-03"
HARBOR_ZONE = "harbor_tunnel"
OTHER_ZONE = "downtown"
STREAM_SLICES = 3
WAIT_FROM = "2024-01-25"  # when the undeclared field of the stream queries gets one more
REPORTED_COMMITS = 3  # of five, so that the limit shows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _wall_clock(df: DataFrame) -> DataFrame:
    """UTC instants without zone and days as text, so a collected result does not depend on the client."""
    kinds = {T.TimestampType: "timestamp_ntz", T.DateType: "string"}
    casts = {f.name: F.col(f.name).cast(kinds[type(f.dataType)]) for f in df.schema if type(f.dataType) in kinds}
    return df.withColumns(casts)


def query(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that takes the trip view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return _wall_clock(function(trips_from_events(spark, sf_dir)))

    QUERIES[function.__name__] = run
    return function


def _flagged(trips: DataFrame) -> DataFrame:
    return flag_late(trips, window_closers(trips, POLICY), POLICY)


def _closed_event(trips: DataFrame) -> DataFrame:
    return counts.closed_counts(counts.event_time_windows(trips, POLICY))


def _closed_processing(trips: DataFrame) -> DataFrame:
    return counts.closed_counts(counts.processing_time_windows(trips, POLICY))


def _numbered(trips: DataFrame) -> DataFrame:
    return batches.flag_numbered(arrival.number_arrivals(trips, POLICY), POLICY)


# -- windows, watermark, side output --------------------------------------------------------------


@query
def trip_window_assign(trips):
    assigned = counts.assign_windows(trips, POLICY)
    return assigned.select("trip_seq", "zone", "window_start", "window_end", "closes_at", "arrival_window_start")


@query
def watermark_at_arrival(trips):
    narrow = trips.select("trip_seq", "event_time", "processing_time")
    return arrival.number_arrivals(narrow, POLICY).select("trip_seq", "position", "batch_id", "watermark")


@query
def late_events(trips):
    return arrival.late_side_output(trips, POLICY)


@query
def zone_counts_event_time(trips):
    return _closed_event(trips)


@query
def zone_counts_processing_time(trips):
    return _closed_processing(trips)


@query
def open_windows(trips):
    return counts.both_clocks(
        counts.open_counts(counts.event_time_windows(trips, POLICY)),
        counts.open_counts(counts.processing_time_windows(trips, POLICY)),
    )


@query
def conservation(trips):
    return counts.conservation(trips, POLICY)


@query
def window_span(trips):
    return counts.window_span(counts.both_clocks(_closed_event(trips), _closed_processing(trips)), POLICY)


@query
def through_day_windows(trips):
    """What a run stopped at the end of its second day has closed."""
    return _closed_event(through_day(trips, FIRST_DAY, 2))


# -- micro-batch bookkeeping ----------------------------------------------------------------------


@query
def emission_batch(trips):
    return batches.emitted_windows(trips, POLICY)


@query
def batch_summary(trips):
    flagged = _numbered(trips.select("trip_seq", "event_time", "processing_time"))
    return batches.batch_summary(flagged, batches.emitted_windows(trips, POLICY), POLICY)


@query
def batch_zone_totals(trips):
    return batches.batch_zone_totals(batches.emitted_windows(trips, POLICY))


@query
def late_by_batch(trips):
    return batches.late_by_batch(_numbered(trips.select("trip_seq", "zone", "event_time", "processing_time")))


@query
def late_examples_per_batch(trips):
    return batches.late_examples(_numbered(trips.select("trip_seq", "zone", "event_time", "processing_time")))


# -- health signals -------------------------------------------------------------------------------


@query
def event_vs_processing(trips):
    return health.align_clocks(_closed_event(trips), _closed_processing(trips))


@query
def event_vs_processing_busiest(trips):
    aligned = health.align_clocks(_closed_event(trips), _closed_processing(trips))
    return health.busiest_windows(aligned, HARBOR_ZONE, OTHER_ZONE)


@query
def disagreement_share(trips):
    return health.disagreement_share(health.align_clocks(_closed_event(trips), _closed_processing(trips)))


@query
def hourly_rollup(trips):
    """Closed 15-minute counts rolled up to hours of the day."""
    return corrections.hourly(_closed_event(trips), "trips")


@query
def late_by_zone(trips):
    return health.late_by_zone(_flagged(trips)).orderBy(F.desc("late"), "zone")


@query
def side_output_rate(trips):
    return health.side_output_rate(health.late_by_zone(_flagged(trips)))


@query
def completeness_by_window(trips):
    return health.completeness_by_window(health.window_tallies(_flagged(trips)))


@query
def completeness_by_zone(trips):
    return health.completeness_by_zone(health.completeness_by_window(health.window_tallies(_flagged(trips))))


@query
def worst_windows(trips):
    return health.worst_windows(health.completeness_by_window(health.window_tallies(_flagged(trips))))


@query
def delay_profile(trips):
    return delays.delay_profile(trips)


@query
def zone_tunnel_share(trips):
    return delays.zone_class_share(trips, "tunnel")


@query
def delay_class_examples(trips):
    return delays.class_examples(trips)


# -- filters, SQL, schema -------------------------------------------------------------------------


@query
def day_filter(trips):
    """Trips of one zone inside and outside of a day, from two complementary filters."""
    mine = trips.where(F.col("zone") == HARBOR_ZONE)
    inside = mine.where(within_day(F.col("event_time"), CORRECTED_DAY)).withColumn("part", F.lit("inside"))
    outside = mine.where(outside_day(F.col("event_time"), CORRECTED_DAY)).withColumn("part", F.lit("outside"))
    both = inside.unionByName(outside).groupBy("part").agg(
        F.count(F.lit(1)).alias("trips"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    return both.withColumn("first_text", fmt(F.col("first")))


@query
def surge_coverage(trips):
    """Per zone: share of trips that carry the column, its highest value, and its first value above one."""
    above = F.col("surge_multiplier") > 1
    return trips.groupBy("zone").agg(
        (F.count("surge_multiplier") / F.count(F.lit(1))).alias("known_share"),
        F.max("surge_multiplier").alias("highest"),
        F.min(F.when(above, F.col("event_time"))).alias("first_above_one"),
    )


@query
def surge_coverage_by_day(trips):
    return schema.coverage_by_day(trips)


@query
def surge_samples(trips):
    """First trips before and after the column appeared."""
    appeared = F.lit(SURGE_FROM).cast("timestamp")
    columns = ["trip_seq", "zone", "event_time", "fare", "surge_multiplier"]

    def first_of(part, name):
        sample = part.orderBy("event_time", "trip_seq").limit(SAMPLE_ROWS)
        return sample.select(F.lit(name).alias("sample"), *columns)

    return first_of(trips.where(F.col("event_time") < appeared), "before").unionByName(
        first_of(trips.where(F.col("event_time") >= appeared), "after")
    )


def _evolving_table(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trip table before and after the batch that brings the new column."""
    spark, path = trips.sparkSession, new_dir(trips.sparkSession, "evolving")
    arrived = F.col("processing_time") < F.lit(SURGE_FROM).cast("timestamp")
    trips.where(arrived).drop("surge_multiplier").write.parquet(f"{path}/batch_id=1")
    before = spark.read.parquet(path)
    trips.where(~arrived).write.parquet(f"{path}/batch_id=2")
    return before, spark.read.option("mergeSchema", "true").parquet(path)


@query
def schema_diff(trips):
    before, after = _evolving_table(trips)
    ordered = [c for c in after.columns if c in before.columns] + [c for c in after.columns if c not in before.columns]
    return schema.describe_columns(after.select(ordered), before)


@query
def file_inventory(trips):
    """Rows in files kept and added when the new column appears; how many files depends on the cluster."""
    before, after = _evolving_table(trips)
    return schema.file_changes(schema.data_files(before), schema.data_files(after)).drop("files")


@query
def json_round_trip(trips):
    """Trips written as JSON lines in arrival order and read back, as counts per zone."""
    path = new_dir(trips.sparkSession, "arrivals")
    write_arrivals(trips, path)
    back = read_arrivals(trips.sparkSession, path)
    return back.groupBy("zone").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count("surge_multiplier").alias("with_surge"),
        F.min("event_time").alias("first_event"),
        F.max("processing_time").alias("last_arrival"),
        F.max("fare").alias("max_fare"),
    )


@query
def late_trip_finished_batch(trips):
    """Each late trip with the newest batch that had finished before it arrived, and whether that batch or one before it
    had already emitted the trip's window."""
    flagged = _numbered(trips.select("trip_seq", "event_time", "processing_time"))
    ends = flagged.groupBy("batch_id").agg(
        F.max("processing_time").alias("ended"), F.max(F.greatest("max_before", "event_time")).alias("max_event")
    )
    # A batch has finished before a trip if its last trip arrived earlier than the trip.
    after = (F.col("ended") + F.expr("INTERVAL '0.000001' SECOND")).alias("after")
    ends = ends.select(F.col("batch_id").alias("finished_batch"), "max_event", after)
    late = flagged.where("is_late").select("trip_seq", "processing_time", "window_start")
    found = asof.asof_join(late, ends, "processing_time", "after", "trip_seq", ["finished_batch", "max_event"])
    final = F.col("window_start") + F.expr(f"INTERVAL '{POLICY.final_after}' MINUTE") <= F.col("max_event")
    finished = F.coalesce("finished_batch", F.lit(0)).alias("finished_batch")  # none yet
    return found.select("trip_seq", "processing_time", finished, F.coalesce(final, F.lit(False)).alias("window_emitted"))


@query
def hourly_both_clocks(trips):
    """One zone's day, hour by hour on both clocks, with empty hours and a total row."""
    hours = corrections.hourly_before_after(_closed_event(trips), _closed_processing(trips), CORRECTED_DAY, HARBOR_ZONE)
    return hours.withColumnsRenamed({"before": "event", "latest": "processing", "missing": "diff"})


@query
def first_and_last_batches(trips):
    """Ends of the list of batches: the first three and last two, with how many lie between."""
    numbered = arrival.number_arrivals(trips.select("trip_seq", "event_time", "processing_time"), POLICY)
    listed = stage(numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("trips"), F.max("processing_time").alias("last_arrival")), "batches")
    return schema.first_and_last(listed, "batch_id")


def _counts_and_changed(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closed counts as a plain table, and a copy in which one window has one trip more."""
    table = stage(_closed_event(trips), "closed-counts")
    first = table.agg(F.min(F.struct("window_start", "zone")).alias("first"))
    one_more = F.col("trip_count") + F.when(F.struct("window_start", "zone") == first.scalar(), 1).otherwise(0)
    return table, stage(table.withColumn("trip_count", one_more).repartition(7), "changed-counts")


@query
def table_differences(trips):
    """Rows in which two plain tables differ, and how often each side has them."""
    return equality.row_differences(*_counts_and_changed(trips))


@query
def tables_equal(trips):
    """A table against a copy in another order, and against one with a changed row."""
    table, changed = _counts_and_changed(trips)
    copy = stage(table.repartition(5, "zone"), "copied-counts")
    return trips.sparkSession.range(0, 1, 1, 1).select(
        F.lit(equality.same_rows(table, copy)).alias("copy_equal"),
        F.lit(equality.same_rows(table, changed)).alias("changed_equal"),
        F.lit(table.count()).alias("rows"),
    )


@query
def windows_by_sql_function(trips):
    """A zone's day asked through SQL table functions over plain views: windows, trips in them, arrivals and longest delay."""
    spark = trips.sparkSession
    sql_functions.register(spark, trips, _closed_event(trips), POLICY)
    return spark.sql(
        f"""SELECT w.window_start, w.trip_count, count(a.trip_seq) AS arrived, max(a.delay_seconds) AS longest_delay
        FROM windows_between(zone => '{HARBOR_ZONE}', upto => TIMESTAMP '{NEXT_DAY}', since => TIMESTAMP '{CORRECTED_DAY}') w
        LEFT JOIN trips_arrived(zone => '{HARBOR_ZONE}', since => TIMESTAMP '{CORRECTED_DAY}') a
          ON a.processing_time >= w.window_start AND a.processing_time < w.window_end
        GROUP BY ALL"""
    )


# -- versioned count table ------------------------------------------------------------------------


def _counts_log(trips: DataFrame) -> tuple[ChangeLog, DataFrame]:
    """Closed counts as three appends (before, on and after the day to be corrected), and late trips."""
    spark = trips.sparkSession
    flagged = _flagged(trips)
    tallies = stage(health.window_tallies(flagged), "tallies")
    closed = tallies.where(F.col("on_time") > 0).withColumnRenamed("on_time", "trip_count")
    late = flagged.where("is_late").select("zone", "window_start")
    log = ChangeLog(spark, new_dir(spark, "zone-counts"), COUNT_SCHEMA)
    start = F.col("window_start")
    corrected, following = (F.lit(d).cast("timestamp") for d in (CORRECTED_DAY, NEXT_DAY))
    for batch_id, part in enumerate(
        [start < corrected, within_day(start, CORRECTED_DAY), start >= following], start=1
    ):
        rows = closed.where(part).withColumn("batch_id", F.lit(batch_id).cast("long"))
        log.append(rows, app_id="catalog", batch_id=batch_id)
    return log, late


def _corrected_log(trips: DataFrame) -> tuple[ChangeLog, int, int]:
    log, late = _counts_log(trips)
    good, bad = corrections.apply_bad_correction(log, late, CORRECTED_DAY)
    return log, good, bad


@query
def append_once(trips):
    """A batch that is appended a second time changes nothing."""
    log, _ = _counts_log(trips)
    log.append(log.read(), app_id="catalog", batch_id=3)
    return log.read()


@query
def replace_where(trips):
    log, _, _ = _corrected_log(trips)
    return log.read()


@query
def asof_read(trips):
    log, good, _ = _corrected_log(trips)
    return log.as_of(good)


@query
def version_diff_hourly(trips):
    log, good, bad = _corrected_log(trips)
    return corrections.hourly_before_after(log.as_of(good), log.as_of(bad), CORRECTED_DAY, HARBOR_ZONE)


@query
def version_difference(trips):
    log, good, bad = _corrected_log(trips)
    return log.difference(good, bad)


@query
def restored_table(trips):
    log, _, _ = _corrected_log(trips)
    corrections.undo_correction(log)
    return log.read()


@query
def restore_equals_good(trips):
    """Trips of the corrected day and of all other days in the good, bad and restored version."""
    log, good, bad = _corrected_log(trips)
    restored = corrections.undo_correction(log)
    on_day = within_day(F.col("window_start"), CORRECTED_DAY)

    def totals(version, name):
        return log.as_of(version).agg(
            F.lit(name).alias("table"),
            F.sum(F.when(on_day, F.col("trip_count"))).alias("day_trips"),
            F.sum(F.when(~on_day, F.col("trip_count"))).alias("other_trips"),
            F.lit(log.same(good, version)).alias("equals_good"),
        )

    return totals(good, "good").unionByName(totals(bad, "bad")).unionByName(totals(restored, "restored"))


@query
def commit_history(trips):
    log, _, _ = _corrected_log(trips)
    corrections.undo_correction(log)
    return log.history().select(
        "version", "operation", "mode", "rows_added", "rows_removed", F.col("metadata")["job"].alias("job")
    )


@query
def version_by_sql(trips):
    """SQL over one registered version of the count table: windows, trips and newest window of each zone."""
    log, _ = _counts_log(trips)
    log.register("closed_counts", version=1)
    return trips.sparkSession.sql(
        "SELECT zone, count(*) AS windows, sum(trip_count) AS trips, max(window_start) AS newest FROM closed_counts GROUP BY zone"
    )


@query
def restored_equals_good_rows(trips):
    """Both as-of tables compared row by row, not by the log between them."""
    log, good, bad = _corrected_log(trips)
    restored = corrections.undo_correction(log)
    table = log.as_of(good)
    return trips.sparkSession.range(0, 1, 1, 1).select(
        F.lit(changelog.same_rows(table, log.as_of(bad))).alias("bad_equals_good"),
        F.lit(changelog.same_rows(table, log.as_of(restored))).alias("restored_equals_good"),
        F.lit(not table.head(1)).alias("empty"),
    )


@query
def commit_summary(trips):
    log, _, _ = _corrected_log(trips)
    corrections.undo_correction(log)
    return changelog.commit_summary(log.commits_since(1)).drop("files_added")


@query
def commit_report(trips):
    log, _, _ = _corrected_log(trips)
    corrections.undo_correction(log)
    newest = changelog.commit_report(log.history(REPORTED_COMMITS))
    return newest.select("version", "operation", "rows_added", "details")


@query
def correction_commits(trips):
    log, _, _ = _corrected_log(trips)
    return log.commits_of_job(CORRECTION_JOB).select(
        F.col("parent_version").alias("good_version"),
        F.col("version").alias("bad_version"),
        F.col("metadata")["description"].alias("description"),
    )


@query
def commit_ends(trips):
    """First three and last two commits, and how many lie between."""
    log, _, _ = _corrected_log(trips)
    corrections.undo_correction(log)
    return schema.first_and_last(log.commits(), "version", first=3, last=1).select(
        "version", "operation", "rows_added", "rows_removed", "end", "skipped"
    )


@query
def log_files(trips):
    """Log rows in files kept, added and removed by the correction. A change log never removes one."""
    log, good, bad = _corrected_log(trips)
    return schema.file_changes(log.files(good), log.files(bad)).drop("files")


# -- streaming ------------------------------------------------------------------------------------


class _Crash(Exception):
    pass


def _streamed(
    trips: DataFrame,
    crash_after: tuple[str, int] | None = None,
    after_landing: Callable[[CountingStream], None] | None = None,
) -> CountingStream:
    """Publish the trips in slices of the arrival clock and stream each one as it lands."""
    spark = trips.sparkSession
    first, last = trips.agg(
        F.min(F.unix_micros("processing_time")), F.max(F.unix_micros("processing_time"))
    ).first()
    marks = [None, *(first + (last - first) * i // STREAM_SLICES for i in range(1, STREAM_SLICES)), None]
    landing, root = new_dir(spark, "landing"), new_dir(spark, "stream")

    def crash(step, batch_id):
        if (step, batch_id) == crash_after:
            raise _Crash(step)

    stream = CountingStream(spark, root, POLICY, after_step=crash)
    for start, stop in zip(marks, marks[1:]):
        write_arrivals(arrivals_between(trips, start, stop), landing)
        try:
            stream.run(landing)
        except Exception:
            if crash_after is None:
                raise
            crash_after = None
            stream.run(landing)
        if after_landing:
            after_landing(stream)
    return stream


@query
def stream_zone_counts(trips):
    return _streamed(trips).zone_counts("event").drop("batch_id")


@query
def stream_processing_counts(trips):
    return _streamed(trips).zone_counts("processing").drop("batch_id")


@query
def stream_late_events(trips):
    return _streamed(trips).late_events().drop("batch_id")


@query
def stream_open_windows(trips):
    return _streamed(trips).open_windows()


@query
def idempotent_replay(trips):
    """Row counts after a crash between two tables of a batch and a restart."""
    stream = _streamed(trips, crash_after=("late_events", 2))
    raw, late = stream.trips(), stream.late_events()
    stored = raw.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("trip_seq").alias("trips"))
    on_time = stream.zone_counts("event").agg(F.sum("trip_count")).scalar()
    still_open = stream.open_windows().where("clock = 'event'").agg(F.sum("trip_count")).scalar()
    return (
        stored.withColumn("on_time", on_time)
        .withColumn("late", late.agg(F.count(F.lit(1))).scalar())
        .withColumn("still_open", F.coalesce(still_open, F.lit(0)))
    )


@query
def stream_conservation(trips):
    """What a reader sees after a crash within the second batch, before any replay: the first batch, whole."""
    spark = trips.sparkSession

    def crash(step, batch_id):
        if (step, batch_id) == ("zone_counts_processing_time", 2):
            raise _Crash(step)

    first_part = F.col("processing_time") < F.lit(NEXT_DAY).cast("timestamp")
    broken = CountingStream(spark, new_dir(spark, "stream"), POLICY, after_step=crash)
    broken.apply(trips.where(first_part), 1)
    try:
        broken.apply(trips.where(~first_part), 2)
    except _Crash:
        pass
    stream = CountingStream(spark, broken.root, POLICY)
    totals = stream.progress().agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))
    on_time = stream.zone_counts("event").agg(F.coalesce(F.sum("trip_count"), F.lit(0)).alias("on_time"))
    left = stream.open_windows().where("clock = 'event'").agg(F.coalesce(F.sum("trip_count"), F.lit(0)).alias("still_open"))
    joined = totals.withColumns({"on_time": on_time.scalar(), "still_open": left.scalar()})
    return joined.withColumn("balanced", F.expr("on_time + late + still_open = rows"))


def _micro_batched(trips: DataFrame) -> CountingStream:
    """The whole stream in micro-batches of BATCH_SIZE trips, one landed file each, worked off as a backlog."""
    spark = trips.sparkSession
    landing = new_dir(spark, "landing")
    write_batches(arrival.number_arrivals(trips, POLICY), landing, BATCH_SIZE)
    stream = CountingStream(spark, new_dir(spark, "stream"), POLICY)
    stream.run(landing, files_per_batch=1, batches_per_trigger=BATCHES_PER_TRIGGER)
    return stream


@query
def stream_emission_batch(trips):
    """Which micro-batch of the stream closed each window."""
    stream = _micro_batched(trips)
    return counts.both_clocks(stream.zone_counts("event"), stream.zone_counts("processing"))


@query
def stream_batch_report(trips):
    """Per micro-batch and zone: trips in windows closed on each clock, late trips and the zone's place among late ones."""
    stream = _micro_batched(trips)
    both = stream.batch_zone_totals().join(stream.late_by_batch(), ["batch_id", "zone"], "full")
    numbers = ("event_trips", "processing_trips", "late", "place")
    return both.withColumns({c: zero_if_null(F.col(c)) for c in numbers})


@query
def stream_late_examples(trips):
    """First late trips of each micro-batch, and how many more there were."""
    return _micro_batched(trips).late_examples()


@query
def stream_batch_summary(trips):
    """Bounds, watermark, late trips and closed windows of each micro-batch, from progress alone."""
    return _micro_batched(trips).summary().drop("event_trips", "processing_trips")


@query
def stored_side_output_rate(trips):
    """Side-output rate from what each batch added, not from trips."""
    return health.side_output_rate(_streamed(trips).late_by_zone())


@query
def stored_completeness_by_zone(trips):
    stream = _streamed(trips, crash_after=("tallies", 2))
    return health.completeness_by_zone(health.completeness_by_window(stream.window_tallies()))


@query
def stored_worst_windows(trips):
    return health.worst_windows(health.completeness_by_window(_streamed(trips).window_tallies()))


@query
def stop_inside_a_file(trips):
    """One landed file, read up to the end of the second day, then to its end: batches, trips and closed windows of both."""
    spark = trips.sparkSession
    landing, stop = new_dir(spark, "landing"), F.unix_micros(F.lit(NEXT_DAY).cast("timestamp"))
    write_arrivals(trips, landing, files=1)
    stream = CountingStream(spark, new_dir(spark, "stream"), POLICY)
    stream.run(landing, stop_us=spark.range(1).select(stop).first()[0])
    stream.run(landing)
    closed = [f"{clock}_{what}" for clock in ("event", "processing") for what in ("windows", "trips")]
    return stream.summary().select("batch_id", "first_row", "last_row", "late", *closed)


@query
def native_arrival_counts(trips):
    """Arrival windows counted by Spark's state store, carried over three runs by its checkpoint."""
    root = new_dir(trips.sparkSession, "arrival-counts")

    def stored(stream: CountingStream) -> ArrivalCounts:
        return ArrivalCounts(stream.spark, f"{stream.root}/trips_raw", root, POLICY)

    return stored(_streamed(trips, after_landing=lambda stream: stored(stream).run())).closed()


def _with_undeclared(trips: DataFrame) -> DataFrame:
    """Phones send a nested field that no schema declares, and later a further field in it."""
    seats, pool = F.col("trip_seq") % 4 + 1, F.col("trip_seq") % 3 == 0
    waits = F.when(F.col("event_time") >= F.lit(WAIT_FROM).cast("timestamp"), F.col("trip_seq") % 7 + 0.5)
    ride = F.struct(seats.alias("seats"), pool.alias("pool"), waits.cast("decimal(3,1)").alias("wait"))
    return trips.withColumn("ride", F.when(F.col("surge_multiplier").isNotNull(), ride))


@query
def promoted_field(trips):
    """A nested field first sent in the middle of the stream, read as a column over all batches."""
    stream = _streamed(_with_undeclared(trips))
    stream.promote("seats", "int", "$.ride.seats")
    stream.promote("pool", "boolean", "$.ride.pool")
    return stream.trips().groupBy("zone").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count("seats").alias("with_seats"),
        F.sum("seats").alias("seats"),
        F.count_if("pool").alias("pools"),
        F.min(F.when(F.col("seats").isNotNull(), F.col("event_time"))).alias("first_with_seats"),
    )


@query
def schema_history(trips):
    """Which batch brought which undeclared field."""
    return _streamed(_with_undeclared(trips)).schema_history().drop("old_type")
