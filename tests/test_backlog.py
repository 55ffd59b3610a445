"""A backlog worked off many batches at a time leaves what one batch after another leaves."""

import pytest
from model import at, frame
from pyspark.sql import functions as F
from test_stream import STEPS, check_equals_model, make_trips

from tallyward.operators.arrival import number_arrivals
from tallyward.policy import LatenessPolicy
from tallyward.session import new_dir
from tallyward.sources.trips import write_arrivals, write_batches
from tallyward.streaming.ingest import CountingStream

TABLES = [step for step in STEPS if step != "progress"]


def land(spark, trips, size=7):
    landing = new_dir(spark, "landing")
    ride = F.when(F.col("trip_seq") % 50 == 0, F.struct((F.col("trip_seq") % 3).alias("seats")))
    write_batches(number_arrivals(frame(spark, trips).withColumn("ride", ride), LatenessPolicy()), landing, size)
    return landing


def new_stream(spark, **kw):
    return CountingStream(spark, new_dir(spark, "stream"), **kw)


def contents(stream, table):
    written = stream.spark.read.option("mergeSchema", "true").parquet(f"{stream.root}/{table}")
    if "rest" in written.columns:
        written = written.withColumn("rest", F.to_json("rest"))
    return sorted(map(str, written.select(sorted(written.columns)).collect()))


def check_same(one, many):
    for table in TABLES:
        assert contents(one, table) == contents(many, table), table
    for mine in (CountingStream.progress, CountingStream.summary, CountingStream.late_examples, CountingStream.open_windows):
        assert sorted(map(str, mine(one).collect())) == sorted(map(str, mine(many).collect()))
    assert one.trips().schema == many.trips().schema and one.late_events().schema == many.late_events().schema


def test_many_batches_at_a_time_leave_the_same_tables(spark):
    trips = make_trips(60, surge_from=at("03:00"))
    landing = land(spark, trips)
    one, many, ends = new_stream(spark), new_stream(spark), []
    one.run(landing, files_per_batch=1)
    many.on_batch = lambda batch_id, figures: ends.append((batch_id, figures["total_rows"]))
    many.run(landing, files_per_batch=1, batches_per_trigger=6)  # two triggers
    assert ends == [(i, min(7 * i, 60)) for i in range(1, 10)]
    check_same(one, many)
    check_equals_model(many, trips)


def test_a_trigger_of_many_batches_is_replayed_as_a_whole(spark):
    trips = make_trips(36)
    landing = land(spark, trips[:28])
    one = new_stream(spark)
    one.run(landing, files_per_batch=1)
    for step in ("late_events", "window_state", "progress"):
        def crash(at_step, batch_id, step=step):
            if (at_step, batch_id) == (step, 3):  # in the second trigger
                raise RuntimeError(step)

        broken = new_stream(spark, after_step=crash)
        with pytest.raises(Exception, match=step):
            broken.run(landing, files_per_batch=1, batches_per_trigger=2)
        again = CountingStream(spark, broken.root)
        assert again.last_batch() == (4 if step == "progress" else 2)
        again.run(landing, files_per_batch=1, batches_per_trigger=2)
        check_same(one, again)
    # A later run, one batch at a time, goes on with the batch after the last one.
    write_arrivals(frame(spark, trips[28:]), landing, files=1)
    last = again.last_batch()
    again.run(landing)
    assert again.last_batch() == last + 1
    check_equals_model(again, trips)


def test_progress_shows_a_block_when_its_last_batch_is_there(spark):
    """A crash between the files of one commit leaves some batches of a block: none of them is finished."""
    trips = make_trips(60)
    stream = new_stream(spark)
    stream.run(land(spark, trips), files_per_batch=1, batches_per_trigger=5)
    assert stream.last_batch() == 9
    stray = spark.read.parquet(f"{stream.root}/progress/batch_id=9").withColumn("upto", F.lit(12).cast("long"))
    stray.write.parquet(f"{stream.root}/progress/batch_id=10")
    assert stream.last_batch() == 9 and stream.progress().count() == 9 and stream.trips().count() == 60


def test_overlapping_files_and_large_batches_stay_batches(spark):
    trips = make_trips(50)
    landing = land(spark, trips[:21])
    write_arrivals(frame(spark, trips[21::2]), landing, files=1)
    write_arrivals(frame(spark, trips[22::2]), landing, files=1)  # overlaps the one before
    one, many = new_stream(spark, cell_rows=10), new_stream(spark, cell_rows=10)
    one.run(landing, files_per_batch=1)
    many.run(landing, files_per_batch=1, batches_per_trigger=50)
    check_same(one, many)
    check_equals_model(many, trips)
