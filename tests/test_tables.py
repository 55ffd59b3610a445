"""As-of join, table equality, SQL table functions and native arrival counts."""

import random
from collections import Counter

import pytest
from model import at, expected, frame, rows
from pyspark.sql import functions as F
from test_stream import make_trips

from tallyward.operators import equality
from tallyward.operators.asof import asof_join
from tallyward.operators.counts import closed_counts, processing_time_windows
from tallyward.operators.equality import differing_buckets, row_differences, same_rows
from tallyward.plans import sql_functions
from tallyward.policy import LatenessPolicy
from tallyward.session import new_dir, stage
from tallyward.streaming.ingest import CountingStream
from tallyward.streaming.native import ArrivalCounts


def asof_by_hand(left, right):
    out = []
    for t, k in left:
        seen = [r for r in right if r[0] is not None and t is not None and r[0] <= t]
        out.append((t, k, *(max(seen, key=lambda r: (r[0], r[1], r[2]))[1:] if seen else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 40, 5000])
def test_asof_join(spark, span):
    rng = random.Random(span)
    left = [(rng.randrange(span), i) for i in range(600)] + [(None, 600), (-1, 601)]
    right = [(rng.randrange(span), rng.randrange(50), rng.choice("ab")) for _ in range(90)] + [(None, 1, "n")]
    found = asof_join(
        spark.createDataFrame(left, "at BIGINT, k BIGINT"), spark.createDataFrame(right, "since BIGINT, v BIGINT, w STRING"), "at", "since", "k", ["v", "w"]
    )
    assert found.columns == ["at", "k", "v", "w"]
    assert sorted(rows(found), key=str) == asof_by_hand(left, right)


def test_asof_join_of_empty_sides(spark):
    left = spark.createDataFrame([(1, 1)], "at BIGINT, k BIGINT")
    right = spark.createDataFrame([(1, 5)], "since BIGINT, v BIGINT")
    assert rows(asof_join(left, right.limit(0), "at", "since", "k", ["v"])) == [(1, 1, None)]
    assert rows(asof_join(left.limit(0), right, "at", "since", "k", ["v"])) == []
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, right.withColumnRenamed("v", "k"), "at", "since", "k", ["k"])


def test_asof_join_spreads_one_instant(spark, monkeypatch):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("at"), F.col("id").alias("k"))
    right = spark.createDataFrame([(i * 10, i) for i in range(2000)], "since BIGINT, v BIGINT")
    staged = []
    monkeypatch.setattr("tallyward.operators.asof.stage", lambda df, label: staged.append(stage(df, label)) or staged[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables this small would be one range
    try:
        found = asof_join(left, right, "at", "since", "k", ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where(F.col("v") != F.expr("at div 10")).count() == 0 and found.count() == 20_000
    sizes = [r["count"] for r in staged[0].groupBy("range").count().collect()]
    assert max(sizes) < 22_000 / 2


ROWS = [(1, "a", 1.5), (1, "a", 1.5), (2, None, 0.0), (None, "b", None), (None, None, None)] + [(i, f"x{i}", i / 7) for i in range(200)]
SCHEMA = "n BIGINT, s STRING, d DOUBLE"


@pytest.mark.parametrize("buckets", [1, 16, equality.BUCKETS])
def test_table_equality(spark, buckets):
    table = spark.createDataFrame(ROWS, SCHEMA)
    assert same_rows(table, spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5), buckets)
    assert same_rows(table.limit(0), table.limit(0), buckets)
    changes = {
        "one copy less": ROWS[1:],
        "NULL elsewhere": [(None, "a", 1.5) if i == 0 else r for i, r in enumerate(ROWS)],
        "one value": [*ROWS[:-1], (199, "x199", 1.0)],
        "nothing": [],
    }
    for name, other in changes.items():
        mine, theirs = Counter(ROWS), Counter(other)
        want = {r: mine[r] - theirs[r] for r in mine | theirs if mine[r] != theirs[r]}
        got = {r[:3]: r[3] for r in rows(row_differences(table, spark.createDataFrame(other, SCHEMA), buckets))}
        assert got == want, name
    with pytest.raises(ValueError, match="different columns"):
        same_rows(table, table.drop("d"))


def test_only_differing_buckets_are_compared(spark):
    table = spark.range(50_000).withColumn("v", F.col("id") * 3)
    other = table.withColumn("v", F.when(F.col("id") == 777, 0).otherwise(F.col("v")))
    found = rows(differing_buckets(table, other), "bucket", "first_rows", "second_rows")
    assert 1 <= len(found) <= 2 and sum(r[1] for r in found) < 20
    assert sorted(rows(row_differences(table, other))) == [(777, 0, -1), (777, 2331, 1)]


def test_sql_functions_restrict_by_name(spark):
    trips = frame(spark, make_trips(120))
    counts = closed_counts(processing_time_windows(trips, LatenessPolicy()))
    sql_functions.register(spark, trips, counts, LatenessPolicy())
    every = spark.sql("SELECT * FROM windows_between()")
    assert every.columns == ["zone", "window_start", "window_end", "trip_count"] and every.count() == counts.count()
    some = spark.sql("SELECT window_start FROM windows_between(upto => TIMESTAMP '2024-01-01 05:00:00', zone => 'a')")
    want = {r[1] for r in rows(counts, "zone", "window_start") if r[0] == "a" and r[1] < at("05:00:00")}
    assert {r[0] for r in rows(some)} == want
    delays = spark.sql("SELECT max(delay_seconds) FROM trips_arrived(since => TIMESTAMP '2024-01-01 03:00:00')").first()[0]
    assert delays == 30000.0


def test_function_filters_reach_the_files(spark):
    trips = stage(frame(spark, make_trips(120)), "sql-trips")
    sql_functions.register(spark, trips, trips.groupBy("zone").count().selectExpr("zone", "TIMESTAMP '2024-01-01' AS window_start", "count AS trip_count"), LatenessPolicy())
    plan = spark.sql("SELECT trip_seq FROM trips_arrived(zone => 'a')")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(zone,a)" in plan and "fare" not in plan


def test_native_counts_over_runs_and_a_restart(spark):
    trips = make_trips(200)
    stream, root = CountingStream(spark, new_dir(spark, "stream")), new_dir(spark, "native")
    for i in range(4):
        stream.apply(frame(spark, trips[i * 50 : i * 50 + 50]), i + 1)
        if i != 1:  # one run sees two batches at once
            ArrivalCounts(spark, f"{stream.root}/trips_raw", root).run()
    closed = rows(ArrivalCounts(spark, f"{stream.root}/trips_raw", root).closed(), "zone", "window_start", "trip_count")
    assert sorted(closed) == sorted(w[:3] for w in expected(trips)["processing"])


def test_native_counts_refuse_a_loss(spark):
    trips = make_trips(90)
    path, root = new_dir(spark, "unordered"), new_dir(spark, "native")
    frame(spark, trips[45:]).write.parquet(f"{path}/batch_id=1")
    ArrivalCounts(spark, path, root).run()
    frame(spark, trips[:45]).write.parquet(f"{path}/batch_id=2")
    with pytest.raises(ValueError, match="behind trips of an earlier run"):
        ArrivalCounts(spark, path, root).run()
