from datetime import timedelta

from model import MINUTE, at, frame, rows, trip

from tallyward.functions.clock import delay_minutes
from tallyward.operators import batches, counts, delays, health
from tallyward.operators.arrival import number_arrivals
from tallyward.operators.closing import flag_late, window_closers
from tallyward.policy import LatenessPolicy
from pyspark.sql import functions as F

POLICY = LatenessPolicy()


def table(spark, cells):
    return spark.createDataFrame(
        [(z, m, n) for z, m, n in cells], "zone STRING, m INT, trip_count BIGINT"
    ).select("zone", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins="m")).alias("window_start"), "trip_count")


def test_alignment_counts_a_missing_side_as_zero(spark):
    event, processing = table(spark, [("a", 0, 5), ("a", 15, 2)]), table(spark, [("a", 15, 3), ("a", 30, 1)])
    got = rows(health.align_clocks(event, processing).orderBy("window_start"), "event", "processing", "diff")
    assert got == [(5, 0, -5), (2, 3, 1), (0, 1, 1)]
    share = rows(health.disagreement_share(health.align_clocks(event, processing)))
    assert share == [("a", 3, 1.0)]


def test_busiest_windows_need_both_zones_and_prefer_earlier_ties(spark):
    event = table(spark, [("h", 0, 9), ("h", 15, 2), ("d", 15, 2), ("h", 30, 3), ("d", 30, 1), ("h", 45, 5), ("d", 45, 5)])
    aligned = health.align_clocks(event, event)
    got = rows(health.busiest_windows(aligned, "h", "d", n=2), "window_start", "first_event", "second_event")
    assert got == [(at("00:15"), 2, 2), (at("00:45"), 5, 5)]


def test_late_only_window_has_completeness_zero(spark):
    trips = [trip(1, "12:00:00", "12:00:01"), trip(2, "10:00:00", "12:00:02")]
    df = frame(spark, trips)
    flagged = flag_late(df, window_closers(df, POLICY), POLICY)
    windows = health.completeness_by_window(health.window_tallies(flagged))
    assert rows(windows, "on_time", "late", "completeness", "flagged") == [(0, 1, 0.0, True)]
    assert rows(health.completeness_by_zone(windows)) == [("downtown", 1, 0, 1, 1, 0.0, 1.0)]


def test_tables_and_flagged_trips_give_the_same_health(spark):
    trips = [
        trip(i, at("00:00") + i * 7 * MINUTE, at("00:00") + (i * 7 + (90 if i % 9 == 0 else 1)) * MINUTE, zone="ab"[i % 2])
        for i in range(120)
    ]
    df = frame(spark, trips)
    flagged = flag_late(df, window_closers(df, POLICY), POLICY)
    late = flagged.where("is_late")
    closed = counts.closed_counts(counts.event_time_windows(df, POLICY))
    assert sorted(rows(health.window_tallies(flagged))) == sorted(rows(health.window_tallies_from_tables(closed, late)))
    assert sorted(rows(health.late_by_zone(flagged))) == sorted(rows(health.late_by_zone_from_tables(df, late)))


def test_total_row_recomputes_the_rate(spark):
    by_zone = spark.createDataFrame([("a", 10, 1), ("b", 30, 0)], "zone STRING, events BIGINT, late BIGINT")
    assert dict((r[0], r[1:]) for r in rows(health.side_output_rate(by_zone))) == {
        "a": (10, 1, 0.1),
        "b": (30, 0, 0.0),
        "ALL ZONES": (40, 1, 0.025),
    }


def test_worst_windows_order(spark):
    tallies = spark.createDataFrame(
        [("a", 1, 1), ("b", 2, 2), ("c", 0, 1), ("d", 100, 1)], "zone STRING, on_time BIGINT, late BIGINT"
    ).withColumn("window_start", F.lit("2024-01-01").cast("timestamp"))
    assert [r[0] for r in rows(health.worst_windows(health.completeness_by_window(tallies)), "zone")] == ["c", "b", "a"]


def test_ratio_over_nothing_is_null(spark):
    tallies = spark.createDataFrame([("a", 0, 0)], "zone STRING, on_time BIGINT, late BIGINT")
    assert rows(health.completeness_by_window(tallies), "completeness") == [(None,)]


def test_delay_classes_at_their_bounds(spark):
    base = at("12:00:00")
    cases = {
        timedelta(seconds=1): "normal",
        timedelta(seconds=5): "normal",
        timedelta(seconds=5, microseconds=1): "other",
        timedelta(minutes=2): "tunnel",
        timedelta(minutes=8): "tunnel",
        timedelta(minutes=20): "very_late",
        timedelta(minutes=60): "very_late",
        timedelta(hours=18): "next_morning",
        timedelta(hours=21): "next_morning",
        timedelta(hours=21, seconds=1): "other",
    }
    trips = [trip(i, base, base + d) for i, d in enumerate(cases)]
    got = dict(rows(delays.with_delay_class(frame(spark, trips)), "trip_seq", "delay_class"))
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_first_example_of_a_class_skips_other_zones_for_tunnel(spark):
    trips = [
        trip(1, "10:00:00", "10:04:00", zone="downtown"),
        trip(2, "10:01:00", "10:05:00", zone="harbor_north"),
        trip(3, "10:01:00", "10:05:00", zone="harbor_north"),
        trip(4, "10:00:00", "10:00:02"),
    ]
    got = dict(rows(delays.class_examples(frame(spark, trips)), "delay_class", "trip_seq"))
    assert got == {"tunnel": 2, "normal": 4}


def test_delay_minutes_round_half_to_even(spark):
    base = at("10:00:00")
    trips = [trip(i, base, base + timedelta(seconds=s)) for i, s in enumerate([30, 90, 150, 91])]
    got = frame(spark, trips).orderBy("trip_seq").select(delay_minutes(F.col("event_time"), F.col("processing_time")).alias("m"))
    assert [r[0] for r in rows(got)] == [0, 2, 2, 2]


def test_late_examples_and_their_remainder(spark):
    trips = [trip(0, "12:00:00", "12:00:01")] + [
        trip(i, "10:00:00", at("12:00:01") + timedelta(seconds=i), zone="ab"[i % 2]) for i in range(1, 8)
    ]
    flagged = batches.flag_numbered(number_arrivals(frame(spark, trips), POLICY), POLICY)
    got = rows(batches.late_examples(flagged, n=5), "place", "trip_seq", "delay_hours", "delay_minutes", "more")
    assert [r[:2] for r in got] == [(i, i) for i in range(1, 6)]
    assert {r[2:] for r in got} == {(2, 0, 2)}
    ranked = rows(batches.late_by_batch(flagged).orderBy("place"), "zone", "late", "place")
    assert ranked == [("b", 4, 1), ("a", 3, 2)]
