"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tallyward.functions.clock import within_day
from tallyward.operators import arrival, counts, health
from tallyward.operators.closing import flag_late, window_closers
from tallyward.plans.catalog import QUERIES
from tallyward.policy import LatenessPolicy
from tallyward.session import new_dir, stage
from tallyward.sources.trips import trips_from_events

SF = "/root/testdata/sf0.001"
POLICY = LatenessPolicy()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_scan_three_columns_and_shuffle_once(spark):
    df = counts.closed_counts(counts.event_time_windows(trips_from_events(spark, SF), POLICY))
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan  # the staged closers are small on file
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp,user_id:bigint>" in plan


def test_closers_too_large_to_broadcast_are_shuffled_instead(spark):
    trips = trips_from_events(spark, SF)
    closers = window_closers(trips, POLICY)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        flagged = flag_late(trips, closers, POLICY)
        assert "SortMergeJoin" in plan_of(flagged) and "Broadcast" not in plan_of(flagged)
        shuffled = flagged.where("is_late").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffled == flag_late(trips, closers, POLICY).where("is_late").count()


def test_closers_reach_the_ordered_pass_pre_aggregated(spark, monkeypatch):
    """The single ordered pass is fed by an aggregate over windows, and adds one exchange only."""
    seen = []
    monkeypatch.setattr("tallyward.operators.closing.stage", lambda df, *a: seen.append(df) or stage(df, "closers"))
    window_closers(trips_from_events(spark, SF), POLICY)
    plan = plan_of(seen[0])
    single = plan.index("Exchange SinglePartition")
    assert plan.count("Exchange") == 2 and "Aggregate" in plan[single:] and "Exchange hashpartitioning" in plan[single:]


def test_numbering_gathers_one_row_per_cell_only(spark):
    narrow = trips_from_events(spark, SF).select("trip_seq", "event_time", "processing_time")
    plan = plan_of(arrival.number_arrivals(narrow, POLICY))
    single = re.findall(r"Exchange SinglePartition.*\n.*\n.*", plan)
    assert len(single) == 1 and "cell_rows" in single[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_day_filters_reach_the_parquet_scan(spark):
    df = trips_from_events(spark, SF).where(within_day(F.col("event_time"), "2024-01-02"))
    assert "GreaterThanOrEqual(ts,2024-01-02" in plan_of(df) and "LessThan(ts,2024-01-03" in plan_of(df)
    staged = stage(df, "day", new_dir(spark, "day"))
    assert "GreaterThanOrEqual(event_time" in plan_of(staged.where(within_day(F.col("event_time"), "2024-01-02")))


def test_side_output_rate_reads_only_what_it_needs(spark):
    trips = trips_from_events(spark, SF)
    flagged = flag_late(trips, window_closers(trips, POLICY), POLICY)
    plan = plan_of(health.side_output_rate(health.late_by_zone(flagged)))
    assert "value" not in re.search(r"events.parquet\].*ReadSchema: (\S+)", plan).group(1)


@pytest.mark.parametrize(
    "name",
    ["zone_counts_event_time", "completeness_by_zone", "delay_profile", "side_output_rate", "late_events", "watermark_at_arrival", "emission_batch", "batch_summary"],
)
def test_hot_paths_stay_in_the_jvm(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "Python" not in plan and "mapInArrow" not in plan and "MapInArrow" not in plan
