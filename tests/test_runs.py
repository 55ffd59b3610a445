"""Runs of batches share files: as many for a thousand batches as for ten, whole after a crash, and readable beside folders."""

import os

import pytest
from model import expected, frame, rows
from pyspark.sql import functions as F
from test_backlog import TABLES, check_same, land, new_stream
from test_stream import check_equals_model, make_trips

from tallyward.operators.arrival import number_arrivals
from tallyward.policy import LatenessPolicy
from tallyward.session import new_dir
from tallyward.sources.landing import index_of, publish
from tallyward.sources.trips import write_arrivals, write_batches
from tallyward.streaming.ingest import CountingStream
from tallyward.streaming.native import ArrivalCounts

BACKLOG = {"files_per_batch": 1, "batches_per_trigger": 50}


def data_files(folder, kind=".parquet"):
    found = os.walk(folder.removeprefix("file:"))
    return sorted(os.path.join(d, f) for d, _, names in found for f in names if f.endswith(kind) and f[0] not in "._")


def test_files_do_not_grow_with_the_batches(spark):
    trips = make_trips(80)
    landing, stream = land(spark, trips, size=2), new_stream(spark)
    stream.run(landing, **BACKLOG)
    assert stream.last_batch() == 40 and index_of(spark, landing).count() == 40 and len(data_files(landing, ".json")) == 41
    cores = spark.sparkContext.defaultParallelism
    for table in TABLES:  # a folder with a file for each of 40 batches before
        assert 0 < len(data_files(f"{stream.root}/{table}")) <= cores, table
    assert len(data_files(f"{stream.root}/progress")) == 1
    check_equals_model(stream, trips)


def test_triggers_take_what_the_index_files_hold(spark):
    """Seven entries in index files of three: three triggers. Entries published one by one are taken three at a time, too."""
    trips = make_trips(49)
    runs = []
    for entries_per_file, index_files in ((3, 3), (1, 7)):
        more = new_dir(spark, "landing")
        write_batches(number_arrivals(frame(spark, trips), LatenessPolicy(), 7), more, 7)
        publish(spark, more, together=entries_per_file)
        runs.append(new_stream(spark))
        runs[-1].run(more, files_per_batch=1, batches_per_trigger=3)
        assert len(data_files(f"{more}/_index", ".json")) == index_files
        assert len(data_files(f"{runs[-1].root}/progress")) == 3 and runs[-1].last_batch() == 7
    check_same(*runs)


@pytest.mark.parametrize(
    "modes, step", [("together-alone", "window_state"), ("alone-together", "trips_raw"), ("alone-together", "progress")]
)
def test_crash_in_one_mode_and_go_on_in_the_other(spark, step, modes):
    trips = make_trips(21)
    landing, alone = land(spark, trips), {"files_per_batch": 1}
    one = new_stream(spark)
    one.run(landing, **BACKLOG)

    def crash(at_step, batch_id):
        if (at_step, batch_id) == (step, 2):
            raise RuntimeError(step)

    first, then = (BACKLOG, alone) if modes == "together-alone" else (alone, BACKLOG)
    broken = new_stream(spark, after_step=crash)
    with pytest.raises(Exception, match=step):
        broken.run(landing, **first)
    again = CountingStream(spark, broken.root)
    again.run(landing, **then)
    check_equals_model(again, trips)
    mine = (CountingStream.progress, CountingStream.late_examples, CountingStream.tallies, CountingStream.trips, CountingStream.late_events)
    for read in mine:
        assert sorted(str(sorted(r.asDict().items())) for r in read(one).collect()) == sorted(str(sorted(r.asDict().items())) for r in read(again).collect())


def test_finished_runs_are_not_repeated_and_unfinished_ones_are_cleared(spark):
    trips = make_trips(21)
    landing, one = land(spark, trips), new_stream(spark)
    one.run(landing, files_per_batch=1)

    def crash(at_step, batch_id):
        if (at_step, batch_id) == ("progress", 3):  # all is written, but Spark does not know
            raise RuntimeError("crash")

    broken = new_stream(spark, after_step=crash)
    with pytest.raises(Exception, match="crash"):
        broken.run(landing, **BACKLOG)
    finished = {f: os.stat(f).st_mtime_ns for f in data_files(f"{broken.root}/trips_raw")}
    again = CountingStream(spark, broken.root)
    again.run(landing, **BACKLOG)
    assert finished == {f: os.stat(f).st_mtime_ns for f in data_files(f"{broken.root}/trips_raw")}
    check_same(one, again)

    def crash_early(at_step, batch_id):
        if (at_step, batch_id) == ("tallies", 3):
            raise RuntimeError("crash")

    broken = new_stream(spark, after_step=crash_early)
    with pytest.raises(Exception, match="crash"):
        broken.run(landing, **BACKLOG)
    again = CountingStream(spark, broken.root, cell_rows=5)  # now every batch is worked on by itself
    again.run(landing, **BACKLOG)
    check_same(one, again)


def test_runs_and_folders_side_by_side(spark):
    trips = make_trips(56)
    landing, stream = land(spark, trips[:28]), new_stream(spark)
    stream.run(landing, **BACKLOG)
    write_arrivals(frame(spark, trips[28:42]), landing, files=1)
    stream.run(landing)
    with pytest.raises(ValueError, match="cannot be repeated alone"):
        stream.apply(frame(spark, trips[7:14]), 2)
    stream.apply(frame(spark, trips[42:]), 6)
    check_equals_model(stream, trips)
    assert stream.trips(upto=2).count() == 14 and stream.summary().count() == 6
    seen = {t.trip_seq: i for i, t in enumerate(trips)}
    assert all(seen[s] // 7 + 1 == b for s, b in rows(stream.trips(upto=4), "trip_seq", "batch_id"))
    left = stream.open_windows(upto=2).where(F.col("clock") == "processing")
    assert set(rows(left, "zone", "window_start", "trip_count")) == expected(trips[:14])["processing_open"]
    root = new_dir(spark, "native")
    ArrivalCounts(spark, f"{stream.root}/trips_raw", root).run()
    closed = rows(ArrivalCounts(spark, f"{stream.root}/trips_raw", root).closed(), "zone", "window_start", "trip_count")
    assert sorted(closed) == sorted(w[:3] for w in expected(trips)["processing"])
