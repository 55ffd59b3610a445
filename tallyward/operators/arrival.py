"""Positions and running maxima over the whole arrival order, in two levels and without a single-task sort.

Arrivals are cut into cells that follow one another in arrival order: hours of the arrival clock, where an hour with
too many rows is cut into shorter steps, and an instant with too many rows into ranges of trip_seq. Each cell is
scanned by one native window; the totals of earlier cells, one row per cell, are carried in. So a third of
all rows in one hour, or in one instant, is spread over as many cells as its size asks for.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.functions.clock import lateness_seconds, minutes, watermark, window_end, window_start
from tallyward.operators.closing import flag_late, window_closers
from tallyward.policy import BATCH_SIZE, LatenessPolicy
from tallyward.session import stage
from tallyward.sources.trips import ARRIVAL

CELL_MICROS = 3_600_000_000
#: Rows up to which an hour or an instant stays one cell.
CELL_ROWS = 1 << 20
CELL = ("cell_start", "cell_piece")


class ArrivalCells:
    """The cells of a set of arrivals, given as the ARRIVAL columns and seen_us, the event time in microseconds."""

    def __init__(self, seen: DataFrame, most: int = CELL_ROWS):
        self._crowded = None
        totals = [F.max("seen_us").alias("cell_max"), F.count(F.lit(1)).alias("cell_rows")]
        sizes = stage(self.place(seen).groupBy(*CELL).agg(*totals), "arrival-cells")
        if sizes.where(F.col("cell_rows") > most).head(1):
            self._crowded = stage(self._cuts(seen, sizes.where(F.col("cell_rows") > most), most), "crowded-cells")
            sizes = stage(self.place(seen).groupBy(*CELL).agg(*totals), "arrival-cells")
        # The only pass over all cells sees one row for each.
        earlier = W.orderBy(*CELL).rowsBetween(W.unboundedPreceding, -1)
        self.carry = sizes.select(
            *CELL,
            F.max("cell_max").over(earlier).alias("carried_max"),
            F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)).alias("carried_rows"),
        )

    @staticmethod
    def _arrived() -> tuple[Column, Column]:
        """Arrival in microseconds, and the start of its hour."""
        us = F.unix_micros(ARRIVAL[0])
        return us, us - F.pmod(us, F.lit(CELL_MICROS))

    def _cuts(self, seen: DataFrame, crowded: DataFrame, most: int) -> DataFrame:
        """Per crowded hour: the step it is cut into, and its crowded instants with their range of trip_seq."""
        us, hour = self._arrived()
        step = F.greatest(F.expr(f"{CELL_MICROS} div (cell_rows div {most} + 1)"), F.lit(1))
        steps = crowded.select(F.col("cell_start").alias("hour"), step.alias("step"))
        seq = F.col(ARRIVAL[1]).cast("double")
        instants = (
            seen.select(hour.alias("hour"), us.alias("us"), seq.alias("seq"))
            .join(steps, "hour", "left_semi")
            .groupBy("hour", "us")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high"))
            .where(F.col("rows") > most)
        )
        width = (F.col("high") - F.col("low")) / F.ceil(F.col("rows") / most)
        instant = F.struct(F.col("us"), F.col("low"), F.greatest(width, F.lit(1.0)).alias("width"))
        # Each instant in a list stands for more than `most` rows, so lists are short.
        lists = instants.groupBy("hour").agg(F.array_sort(F.collect_list(instant)).alias("instants"))
        return steps.join(lists, "hour", "left")

    def place(self, rows: DataFrame) -> DataFrame:
        """rows with the cell each falls into."""
        us, hour = self._arrived()
        if self._crowded is None:
            return rows.withColumn("cell_start", hour).withColumn("cell_piece", F.lit(0).cast("long"))
        cut = rows.withColumn("hour", hour).join(self._crowded, "hour", "left")
        into = us - F.col("hour")
        stepped = F.col("hour") + F.coalesce(into - into % F.col("step"), F.lit(0))
        mine = F.element_at(F.filter("instants", lambda i: i["us"] == us), 1)
        last = F.array_max(F.transform(F.filter("instants", lambda i: i["us"] < us), lambda i: i["us"]))
        instant = F.when(F.exists("instants", lambda i: i["us"] == us), mine)
        piece = F.floor((F.col(ARRIVAL[1]).cast("double") - F.col("instant.low")) / F.col("instant.width"))
        return (
            cut.withColumn("instant", instant)
            # What follows a crowded instant in its step starts a cell of its own.
            .withColumn("cell_start", F.coalesce(F.col("instant.us"), F.greatest(stepped, last + 1)))
            .withColumn("cell_piece", F.coalesce(piece, F.lit(0)).cast("long"))
            .drop("hour", "step", "instants", "instant")
        )

    def scan(self, rows: DataFrame) -> DataFrame:
        """Add `max_before`, the newest seen time of all earlier rows, and `position`, the place among rows if rows are
        all arrivals. Rows whose seen_us is NULL only look."""
        cell = W.partitionBy(*CELL).orderBy(*ARRIVAL)
        before = F.max("seen_us").over(cell.rowsBetween(W.unboundedPreceding, -1))
        return (
            self.place(rows)
            .join(self.carry, list(CELL))
            .withColumn("max_before", F.timestamp_micros(F.greatest("carried_max", before)))
            .withColumn("position", F.col("carried_rows") + F.row_number().over(cell))
            .drop(*CELL, "carried_max", "carried_rows", "seen_us")
        )


def seen(trips: DataFrame) -> DataFrame:
    """What cells and watermarks need of trips. A trip without one of its times is an error."""
    time, seq = ARRIVAL
    happened = F.coalesce("event_time", F.raise_error(F.lit("trip without event_time")))
    arrived = F.coalesce(time, F.raise_error(F.lit("trip without processing_time")))
    return trips.select(arrived.alias(time), seq, F.unix_micros(happened).alias("seen_us"))


def number_arrivals(
    trips: DataFrame, policy: LatenessPolicy, batch_size: int = BATCH_SIZE, most: int = CELL_ROWS
) -> DataFrame:
    """Stream position, batch number and watermark of every trip at its arrival."""
    scanned = ArrivalCells(seen(trips), most).scan(trips.withColumn("seen_us", F.unix_micros("event_time")))
    return scanned.withColumn("watermark", watermark(F.col("max_before"), policy)).withColumn(
        "batch_id", F.expr(f"(position - 1) div {int(batch_size)} + 1")
    )


def late_side_output(trips: DataFrame, policy: LatenessPolicy, most: int = CELL_ROWS) -> DataFrame:
    """Every late trip with its window, the watermark it met and how far behind that it was.

    Late trips are found by their window's closer. Only they are shuffled whole; of all others the arrival and the
    event time go to the scan.
    """
    late = flag_late(trips, window_closers(trips, policy), policy).where("is_late").drop("is_late", "window_closed")
    all_seen = seen(trips)
    looking = late.withColumn("seen_us", F.lit(None).cast("long"))
    scanned = ArrivalCells(all_seen, most).scan(looking.unionByName(all_seen, allowMissingColumns=True))
    return with_lateness(scanned.where(F.col("window_start").isNotNull()), policy).drop("position")


def with_lateness(late: DataFrame, policy: LatenessPolicy) -> DataFrame:
    """Scanned late trips with the watermark they met instead of max_before, the end of their window and their lateness."""
    return (
        late.withColumn("window_end", window_end(F.col("window_start"), policy))
        .withColumn("watermark", watermark(F.col("max_before"), policy))
        .withColumn("lateness_seconds", lateness_seconds(F.col("watermark"), F.col("event_time")))
        .drop("max_before")
    )


def late_by_watermark(policy: LatenessPolicy) -> Column:
    """The late test on a numbered stream: the window's closing mark is at or below the watermark."""
    closes = F.col("window_start") + minutes(policy.closes_after)
    return F.coalesce(closes <= F.col("watermark"), F.lit(False))


def judge_arrivals(
    trips: DataFrame, policy: LatenessPolicy, carried_max: Column, rows: int, most: int = CELL_ROWS, part: str | None = None
) -> DataFrame:
    """One part of a stream: its trips with position in the part, max_before, window_start and is_late.

    carried_max is the newest event time of all parts before, NULL for the first. A part known to have no more rows
    than a cell is one cell, and needs no totals. With `part`, the column that tells one part from another, trips are
    several parts of at most `rows` rows, each with its own carried_max.
    """
    looked = trips.withColumn("seen_us", F.unix_micros("event_time"))
    if rows <= most:
        order = W.partitionBy(*([part] if part else [])).orderBy(*ARRIVAL)
        before = F.max("seen_us").over(order.rowsBetween(W.unboundedPreceding, -1))
        scanned = looked.withColumn("max_before", F.timestamp_micros(before)).withColumn("position", F.row_number().over(order).cast("long"))
        scanned = scanned.drop("seen_us")
    else:
        scanned = ArrivalCells(seen(trips), most).scan(looked)
    newest = F.greatest("max_before", carried_max)
    return (
        scanned.withColumn("max_before", newest)
        .withColumn("window_start", window_start(F.col("event_time"), policy))
        .withColumn("watermark", watermark(F.col("max_before"), policy))
        .withColumn("is_late", late_by_watermark(policy))
        .drop("watermark")
    )
