"""Delay profile: how far apart the two clocks are, judged from the trips alone."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.functions.clock import delay_class
from tallyward.functions.measures import ratio, share_of
from tallyward.policy import HARBOR_ZONES
from tallyward.sources.trips import ARRIVAL


def with_delay_class(trips: DataFrame) -> DataFrame:
    return trips.withColumn("delay_class", delay_class(F.col("event_time"), F.col("processing_time")))


def delay_profile(trips: DataFrame) -> DataFrame:
    counts = with_delay_class(trips).groupBy("delay_class").agg(F.count(F.lit(1)).alias("events"))
    # The total is taken over the five class rows, not over the trips.
    total = F.sum("events").over(W.partitionBy())
    return counts.withColumn("share", ratio(F.col("events"), total))


def zone_class_share(trips: DataFrame, name: str = "tunnel") -> DataFrame:
    return (
        with_delay_class(trips)
        .groupBy("zone")
        .agg(F.count(F.lit(1)).alias("events"), share_of(F.col("delay_class") == name).alias("share"))
    )


def class_examples(trips: DataFrame) -> DataFrame:
    """First arrival of each delay class. For tunnel delays only harbor zones qualify.

    Two steps, so that the pass over all trips is a plain hash aggregate of one timestamp per class
    (min_by over a struct would sort every trip). The second pass keeps only the trips of those
    instants, and combines on the map side should one instant hold very many. The zone rule is part
    of the aggregates rather than a filter, which would evaluate the class a second time per trip.
    """
    time, seq = ARRIVAL
    classed = with_delay_class(trips)
    qualifies = (F.col("delay_class") != "tunnel") | F.col("zone").isin(HARBOR_ZONES)
    first_times = classed.groupBy("delay_class").agg(F.min(F.when(qualifies, F.col(time))).alias(time))
    example = F.struct("trip_seq", "trip_id", "zone", "event_time", "processing_time", "fare", "surge_multiplier")
    return (
        classed.join(F.broadcast(first_times), ["delay_class", time])  # one row per class
        .groupBy("delay_class")
        .agg(F.min_by(example, F.when(qualifies, F.col(seq))).alias("first"))
        .select("delay_class", "first.*")
    )
