"""Bounded micro-batches in arrival order, whatever the files' names and modification times."""

import os
import random
import time

import pytest
from model import at, expected, frame, rows, trip
from pyspark.sql import functions as F
from test_stream import check_equals_model, make_trips

from tallyward.operators.arrival import number_arrivals
from tallyward.policy import LatenessPolicy
from tallyward.session import new_dir
from tallyward.sources.landing import index_of, publish
from tallyward.sources.trips import write_arrivals, write_batches
from tallyward.streaming.ingest import CountingStream
from tallyward.streaming.live import LiveFigures


def micros(spark, text):
    return spark.range(1).select(F.unix_micros(F.lit(text).cast("timestamp"))).first()[0]


def local(path):
    return path.removeprefix("file:")


def shuffle_times(folder, seed):
    """Give all files of a folder modification times in random order."""
    names = [f for f in os.listdir(folder) if os.path.isfile(f"{folder}/{f}")]
    random.Random(seed).shuffle(names)
    for i, name in enumerate(names):
        os.utime(f"{folder}/{name}", (time.time() - 9000 + 60 * i,) * 2)
    return len(names)


def emitted(stream):
    columns = ("zone", "window_start", "trip_count", "batch_id")
    return {clock: set(rows(stream.zone_counts(clock), *columns)) for clock in ("event", "processing")}


def test_one_file_per_batch_in_shuffled_order_of_modification(spark):
    trips = make_trips(240)
    landing, root = new_dir(spark, "landing"), new_dir(spark, "stream")
    write_batches(number_arrivals(frame(spark, trips).repartition(5), LatenessPolicy(), 10), landing, 10)
    publish(spark, landing)
    assert shuffle_times(local(landing), 1) > 24 and shuffle_times(f"{local(landing)}/_index", 2) > 24
    live = LiveFigures()
    spark.streams.addListener(live)
    try:
        stream = CountingStream(spark, root)
        stream.run(landing, files_per_batch=1)
        deadline = time.time() + 20
        while len(live.seen) < 24 and time.time() < deadline:
            time.sleep(0.1)  # progress events come a little after the batch
    finally:
        spark.streams.removeListener(live)
    want = expected(trips, batch_size=10)
    assert emitted(stream) == {clock: want[clock] for clock in ("event", "processing")}
    check_equals_model(stream, trips)
    assert rows(stream.progress().orderBy("batch_id"), "total_rows") == [(10 * i,) for i in range(1, 25)]
    assert [f["batch_id"] for f in live.seen] == list(range(1, 25)) and {(f["files"], f["rows"]) for f in live.seen} == {(1, 10)}


def test_figures_of_each_batch(spark):
    trips = make_trips(200)
    stream, told = CountingStream(spark, new_dir(spark, "stream"), on_batch=lambda i, f: told.append((i, f))), []
    for i in range(4):
        stream.apply(frame(spark, trips[i * 50 : i * 50 + 50]), i + 1)
    want = expected(trips, batch_size=50)
    late = [t for t in trips if t.trip_seq in want["late"]]
    place = {t.trip_seq: i // 50 + 1 for i, t in enumerate(trips)}
    assert [(i, f["late"]) for i, f in told] == [(b, sum(place[t.trip_seq] == b for t in late)) for b in (1, 2, 3, 4)]
    totals = {(r[0], r[1]): r[2:] for r in rows(stream.batch_zone_totals(), "batch_id", "zone", "event_trips", "processing_trips")}
    for batch in (1, 2, 3, 4):
        closed = [sum(w[2] for w in want[clock] if w[3] == batch) for clock in ("event", "processing")]
        assert totals.get((batch, "TOTAL"), (0, 0)) == tuple(closed)
    by_zone = {(r[0], r[1]): r[2] for r in rows(stream.late_by_batch(), "batch_id", "zone", "late")}
    assert by_zone == {k: v for k in {(place[t.trip_seq], t.zone) for t in late} if (v := sum((place[t.trip_seq], t.zone) == k for t in late))}
    examples = {(r[0], r[1]): r[2:] for r in rows(stream.late_examples(2), "batch_id", "place", "trip_seq", "more")}
    for batch in (1, 2, 3, 4):
        mine = [t.trip_seq for t in late if place[t.trip_seq] == batch]
        assert [examples.get((batch, p)) for p in (1, 2)] == [(mine[p], max(len(mine) - 2, 0)) if p < len(mine) else None for p in (0, 1)]


def test_jobs_of_a_batch_do_not_grow(spark):
    """The same number of Spark jobs for batch 9 as for batch 3: nothing that earlier batches wrote is listed."""
    trips = make_trips(90)
    stream, jobs = CountingStream(spark, new_dir(spark, "stream")), []
    for i in range(9):
        spark.sparkContext.setJobGroup(f"batch {i}", "")
        stream.apply(frame(spark, trips[i * 10 : i * 10 + 10]), i + 1)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch {i}")))
    spark.sparkContext._jsc.clearJobGroup()
    late = [r[0] for r in rows(stream.progress().orderBy("batch_id"), "late")]
    assert len({j - (n > 0) for j, n in zip(jobs[2:], late[2:])}) == 1 and max(jobs) <= 16


def test_files_that_overlap_are_taken_together(spark):
    trips = make_trips(60)
    landing = new_dir(spark, "landing")
    for part in (trips[0:30:2], trips[1:30:2], trips[30:50], trips[50:]):
        write_arrivals(frame(spark, part), landing, files=1)
    stream = CountingStream(spark, new_dir(spark, "stream"))
    stream.run(landing, files_per_batch=1)
    check_equals_model(stream, trips)
    ends = sorted({r[0] for r in rows(stream.progress(), "total_rows")})
    assert ends == [30, 50, 60]


def test_nothing_landed_yet(spark):
    landing = new_dir(spark, "landing")
    os.makedirs(local(landing))
    stream = CountingStream(spark, new_dir(spark, "stream"))
    stream.run(landing)
    write_arrivals(frame(spark, make_trips(20)), landing, files=1)
    stream.run(landing)
    assert stream.last_batch() == 1 and stream.trips().count() == 20


def test_a_file_from_the_past_is_refused(spark):
    trips = make_trips(60)
    landing, root = new_dir(spark, "landing"), new_dir(spark, "stream")
    write_arrivals(frame(spark, trips[20:40]), landing, files=1)
    CountingStream(spark, root).run(landing)
    write_arrivals(frame(spark, trips[:20]), landing, files=1)
    with pytest.raises(Exception, match="out of order"):
        CountingStream(spark, root).run(landing)
    assert CountingStream(spark, root).trips().count() == 20


def test_publishing_again_changes_nothing(spark):
    landing = new_dir(spark, "landing")
    write_arrivals(frame(spark, make_trips(40)), landing, files=4)
    first = publish(spark, landing)
    assert first > 1 and publish(spark, landing) == 0 and index_of(spark, landing).count() == first
    lost = sorted(f for f in os.listdir(f"{local(landing)}/_index") if f.endswith(".json"))[0]
    kept = index_of(spark, landing).collect()
    os.rename(f"{local(landing)}/_index/{lost}", f"{local(landing)}/_index/_{lost}")  # a call that failed half way
    assert publish(spark, landing) == 1
    assert sorted(index_of(spark, landing).collect()) == sorted(kept)


def test_rows_without_a_time_are_refused_before_publishing(spark):
    landing = new_dir(spark, "landing")
    write_arrivals(frame(spark, [trip(1, "10:00:00", "10:00:01"), trip(2, None, "10:00:02")]), landing, files=1)
    with pytest.raises(ValueError, match="1 trips without event_time"):
        publish(spark, landing)
    assert index_of(spark, landing).count() == 0


@pytest.mark.parametrize("crash_in", [None, ("tallies", 1), ("window_state", 2), ("zone_counts_event_time", 2)])
def test_stop_inside_a_file_and_go_on(spark, crash_in):
    trips = make_trips(120, surge_from=at("05:00"))
    landing, root = new_dir(spark, "landing"), new_dir(spark, "stream")
    write_arrivals(frame(spark, trips), landing, files=1)
    stop = micros(spark, "2024-01-01 04:30:00")
    early = [t for t in trips if t.processing_time < at("04:30:00")]
    assert 0 < len(early) < 120

    def fail(step, batch_id):
        if (step, batch_id) == crash_in:
            raise RuntimeError("crash")

    for stop_us, seen in ((stop, early), (stop, early), (None, trips)):
        try:
            CountingStream(spark, root, after_step=fail).run(landing, stop_us=stop_us)
        except Exception:
            assert crash_in
            CountingStream(spark, root).run(landing, stop_us=stop_us)
            crash_in = None
        check_equals_model(CountingStream(spark, root), seen)
    assert rows(CountingStream(spark, root).progress().orderBy("batch_id"), "total_rows") == [(len(early),), (120,)]


def test_a_batch_larger_than_a_cell(spark):
    trips = make_trips(150)
    stream = CountingStream(spark, new_dir(spark, "stream"), cell_rows=20)
    for i in range(3):
        stream.apply(frame(spark, trips[i * 50 : i * 50 + 50]), i + 1)
    check_equals_model(stream, trips)


def test_stored_tallies_equal_the_trips(spark):
    trips = make_trips(200)
    stream = CountingStream(spark, new_dir(spark, "stream"))
    for i in (1, 2, 2, 3, 4):  # batch 2 is replayed
        stream.apply(frame(spark, trips[i * 50 - 50 : i * 50]), i)
    want = expected(trips)
    late = {t.trip_seq for t in trips} & set(want["late"])
    zones = {z: (sum(t.zone == z for t in trips), sum(t.zone == z and t.trip_seq in late for t in trips)) for z in "ab"}
    assert {r[0]: r[1:] for r in rows(stream.late_by_zone(), "zone", "events", "late")} == zones
    tallied = {r[:2]: r[2] for r in rows(stream.window_tallies(), "zone", "window_start", "on_time")}
    assert {k: n for k, n in tallied.items() if n} == {w[:2]: w[2] for w in want["event"]}
