"""Micro-batch bookkeeping over a numbered stream: which batch emits a window, batch summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.functions.clock import delay_minutes, lateness_seconds, minutes, watermark, window_start
from tallyward.functions.measures import zero_if_null
from tallyward.operators.arrival import late_by_watermark
from tallyward.operators.closing import window_closers
from tallyward.operators.counts import both_clocks, closed_counts, event_time_windows, processing_time_windows
from tallyward.policy import BATCH_SIZE, LATE_EXAMPLES, LatenessPolicy
from tallyward.session import stage
from tallyward.sources.trips import ARRIVAL

TOTAL = "TOTAL"
#: Closers are looked up by the quarter hour of arrival that a trip falls into.
SPAN_MICROS = 900_000_000


def _key(time: str, seq: str) -> Column:
    return F.struct(F.unix_micros(time).alias("us"), F.col(seq).alias("seq"))


def closer_positions(trips: DataFrame, closers: DataFrame) -> DataFrame:
    """Stream position of every closer: closer_time, closer_seq, position.

    Only these few positions are needed, so the trips are counted, not sorted: each falls into a slot between two
    closers of its span of the arrival clock, and slots are counted with a map-side combine and added up along the stream.
    A closer, itself a trip, is the last one of its slot. There is at most one closer per distinct window and clock, and
    the ordered sum sees one row per closer and span, never trips. The lists of closers are staged, so they
    go to every task only while they are small.
    """
    span = F.floor(F.col("key.us") / SPAN_MICROS)
    points = closers.where(F.col("closer_time").isNotNull()).select(_key("closer_time", "closer_seq").alias("key"))
    lists = points.groupBy(span.alias("span")).agg(F.array_sort(F.collect_set("key")).alias("points"))
    lists = stage(lists, "closer-points")
    rows = trips.select(_key(*ARRIVAL).alias("key")).withColumn("span", span).join(lists, "span", "left")
    before = F.size(F.filter("points", lambda point: point < F.col("key")))
    slot = F.when(F.col("points").isNull(), 0).otherwise(before).alias("slot")
    slots = rows.groupBy("span", slot).agg(F.count(F.lit(1)).alias("trips"))
    upto = slots.withColumn("position", F.sum("trips").over(W.orderBy("span", "slot")))
    each = lists.select("span", F.posexplode("points").alias("slot", "key"))
    return each.join(upto, ["span", "slot"]).select(
        F.timestamp_micros("key.us").alias("closer_time"), F.col("key.seq").alias("closer_seq"), "position"
    )


def emitted_windows(trips: DataFrame, policy: LatenessPolicy, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Closed windows of both clocks with their count and the batch that emits them: the batch that
    holds the window's closer, as that is the first whose end finds the window final."""
    event_closers = window_closers(trips, policy)
    arrival_closers = window_closers(trips, policy, clock="processing_time", final_after=policy.window_minutes)
    closers = both_clocks(event_closers, arrival_closers)
    batch_id = F.expr(f"(position - 1) div {int(batch_size)} + 1").alias("batch_id")
    batches = closers.join(closer_positions(trips, closers), ["closer_time", "closer_seq"]).select(
        "clock", "window_start", batch_id
    )
    windows = both_clocks(
        closed_counts(event_time_windows(trips, policy, event_closers)),
        closed_counts(processing_time_windows(trips, policy)),
    )
    return windows.join(batches, ["clock", "window_start"]).select(
        "clock", "zone", "window_start", "trip_count", "batch_id"
    )


def flag_numbered(numbered: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """Late flag and lateness of a numbered stream, from the watermark met at arrival."""
    return (
        numbered.withColumn("window_start", window_start(F.col("event_time"), policy))
        .withColumn("is_late", late_by_watermark(policy))
        .withColumn("lateness_seconds", lateness_seconds(F.col("watermark"), F.col("event_time")))
    )


def batch_summary(flagged: DataFrame, emitted: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """Per batch: rows, arrival range, watermark at its end, late trips, windows closed per clock."""
    newest = F.greatest("max_before", "event_time")
    batches = (
        flagged.groupBy("batch_id")
        .agg(
            F.min("position").alias("first_row"),
            F.max("position").alias("last_row"),
            F.min("processing_time").alias("first_arrival"),
            F.max("processing_time").alias("last_arrival"),
            F.max(newest).alias("max_event_time"),
            F.count_if("is_late").alias("late"),
        )
        .withColumn("watermark", watermark(F.col("max_event_time"), policy))
    )

    def of_clock(clock, prefix) -> list[Column]:
        mine = F.col("clock") == clock
        start = F.when(mine, F.col("window_start"))
        return [
            F.count_if(mine).alias(f"{prefix}_windows"),
            F.min(start).alias(f"{prefix}_first_start"),
            (F.max(start) + minutes(policy.window_minutes)).alias(f"{prefix}_last_end"),
        ]

    closed = emitted.groupBy("batch_id").agg(*of_clock("event", "event"), *of_clock("processing", "processing"))
    joined = batches.join(closed, "batch_id", "left")
    for name in ("event_windows", "processing_windows"):
        joined = joined.withColumn(name, zero_if_null(F.col(name)))
    return joined


def batch_zone_totals(emitted: DataFrame) -> DataFrame:
    """Trips in windows emitted by each batch per zone and clock, with a total row per batch."""

    def of_clock(clock):
        return zero_if_null(F.sum(F.when(F.col("clock") == clock, F.col("trip_count"))))

    per_zone = emitted.groupBy("batch_id", "zone").agg(
        of_clock("event").alias("event_trips"), of_clock("processing").alias("processing_trips")
    )
    return (
        per_zone.rollup("batch_id", "zone")
        .agg(
            F.sum("event_trips").alias("event_trips"),
            F.sum("processing_trips").alias("processing_trips"),
            F.grouping("zone").alias("all_zones"),
            F.grouping("batch_id").alias("all_batches"),
        )
        .where(F.col("all_batches") == 0)
        .withColumn("zone", F.when(F.col("all_zones") == 1, TOTAL).otherwise(F.col("zone")))
        .drop("all_zones", "all_batches")
    )


def late_by_batch(flagged: DataFrame) -> DataFrame:
    """Late trips per batch and zone, ranked most first; a zone's name settles ties."""
    return ranked_late(flagged.where("is_late").groupBy("batch_id", "zone").agg(F.count(F.lit(1)).alias("late")))


def ranked_late(counts: DataFrame) -> DataFrame:
    """batch_id, zone and late with the place of each zone in its batch."""
    most_first = W.partitionBy("batch_id").orderBy(F.desc("late"), "zone")
    return counts.withColumn("place", F.row_number().over(most_first).cast("long"))


def late_examples(flagged: DataFrame, n: int = LATE_EXAMPLES) -> DataFrame:
    """First n late trips of each batch with their delay, and how many more there were."""
    counts = flagged.where("is_late").groupBy("batch_id").agg(F.count(F.lit(1)).alias("all_late"))
    more = counts.select("batch_id", F.greatest(F.col("all_late") - n, F.lit(0)).alias("more"))
    return first_late(flagged, n).join(more, "batch_id")


def first_late(flagged: DataFrame, n: int = LATE_EXAMPLES) -> DataFrame:
    """First n late trips of each batch in arrival order. The limit holds before the shuffle too, so a batch of any
    number of late trips deals n rows per task."""
    delay = delay_minutes(F.col("event_time"), F.col("processing_time"))
    arrived = W.partitionBy("batch_id").orderBy(*ARRIVAL)
    return (
        flagged.where("is_late")
        .withColumn("place", F.row_number().over(arrived).cast("long"))
        .where(F.col("place") <= n)
        .withColumn("delay", delay)
        .select(
            "batch_id",
            "place",
            "zone",
            "trip_seq",
            "event_time",
            "processing_time",
            F.expr("delay div 60").alias("delay_hours"),
            (F.col("delay") % 60).alias("delay_minutes"),
            "lateness_seconds",
        )
    )
