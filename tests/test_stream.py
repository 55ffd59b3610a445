import random
from datetime import timedelta

import pytest
from model import at, expected, frame, rows, trip
from pyspark.sql import functions as F

from tallyward.operators.schema import coverage_by_day, data_files, describe_columns, file_changes
from tallyward.session import new_dir
from tallyward.sources.trips import arrivals_between, read_arrivals, write_arrivals
from tallyward.streaming.ingest import CountingStream

STEPS = ["trips_raw", "late_events", "tallies", "window_state", "zone_counts_event_time", "zone_counts_processing_time", "progress"]


def make_trips(n=240, surge_from=None, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        event = at("00:00") + timedelta(seconds=rng.randrange(8 * 3600))
        delay = timedelta(seconds=rng.choice([2, 4, 300, 2000, 30000]))
        surge = 1.25 if surge_from is not None and event >= surge_from else None
        made.append(trip(i, event, event + delay, zone=rng.choice("ab"), surge=surge))
    return sorted(made, key=lambda t: (t.processing_time, t.trip_seq))


def check_equals_model(stream, trips, batch_ends=None):
    want = expected(trips)
    late = rows(stream.late_events(), "trip_seq", "watermark", "lateness_seconds")
    assert {r[0]: r[1:] for r in late} == want["late"] and len(late) == len(want["late"])
    for clock in ("event", "processing"):
        got = rows(stream.zone_counts(clock), "zone", "window_start", "trip_count")
        assert sorted(got) == sorted(w[:3] for w in want[clock])
        left = rows(stream.open_windows().where(F.col("clock") == clock), "zone", "window_start", "trip_count")
        assert set(left) == want[f"{clock}_open"]
    assert sorted(r[0] for r in rows(stream.trips(), "trip_seq")) == sorted(t.trip_seq for t in trips)


def test_json_lines_round_trip_keeps_microseconds_and_missing_keys(spark):
    trips = make_trips(20, surge_from=at("04:00"))
    trips[0] = trips[0]._replace(event_time=trips[0].event_time + timedelta(microseconds=7))
    path = new_dir(spark, "landing")
    write_arrivals(frame(spark, trips), path, files=3)
    assert sorted(rows(read_arrivals(spark, path))) == sorted(tuple(t) for t in trips)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert any("surge_multiplier" not in line for line in lines) and any("surge_multiplier" in line for line in lines)


def test_lines_without_a_sequence_get_one_from_the_trip_id(spark, tmp_path):
    line = '{"trip_id": "%s", "zone": "a", "event_time": "2026-01-01T10:00:00.123Z", "processing_time": "2026-01-01T10:00:02.000Z", "fare": 1.5}'
    (tmp_path / "x.json").write_text("\n".join(line % i for i in range(5)))
    got = rows(read_arrivals(spark, str(tmp_path)), "trip_seq", "event_time", "surge_multiplier")
    assert len({r[0] for r in got}) == 5 and None not in {r[0] for r in got}
    assert {r[1] for r in got} == {at("10:00:00.123000", "2026-01-01")} and {r[2] for r in got} == {None}


def test_files_follow_arrival_order(spark):
    path = new_dir(spark, "landing")
    write_arrivals(frame(spark, make_trips(60)).repartition(5), path, files=3)
    lines = read_arrivals(spark, path).withColumn("file", F.input_file_name())
    spans = rows(lines.groupBy("file").agg(F.min("processing_time"), F.max("processing_time")).orderBy("file"))
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_malformed_line_fails_loudly(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"trip_id": "1", "zone": \n')
    with pytest.raises(Exception):
        read_arrivals(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("step", STEPS)
def test_crash_after_any_step_then_replay(spark, step):
    trips = make_trips()
    root, broken = new_dir(spark, "stream"), []

    def fail_once(name, batch_id):
        if (name, batch_id) == (step, 2) and not broken:
            broken.append(name)
            raise RuntimeError("crash")

    stream = CountingStream(spark, root, after_step=fail_once)
    parts = [trips[:100], trips[100:]]
    for batch_id, part in enumerate(parts, start=1):
        try:
            stream.apply(frame(spark, part), batch_id)
        except RuntimeError:
            stream = CountingStream(spark, root)  # a new process
            check_equals_model(stream, trips if step == "progress" else parts[0])  # readers see whole batches only
            stream.apply(frame(spark, part), batch_id)
    assert broken == [step]
    check_equals_model(stream, trips)
    assert rows(stream.progress().orderBy("batch_id"), "batch_id", "total_rows") == [(1, 100), (2, 240)]


def test_summary_and_emission_batches(spark):
    trips = make_trips()
    stream = CountingStream(spark, new_dir(spark, "stream"))
    for i in range(3):
        stream.apply(frame(spark, trips[i * 80 : (i + 1) * 80]), i + 1)
    want = expected(trips, batch_size=80)
    for clock in ("event", "processing"):
        got = rows(stream.zone_counts(clock), "zone", "window_start", "trip_count", "batch_id")
        assert set(got) == want[clock]
    summary = rows(stream.summary().orderBy("batch_id"), "first_row", "last_row", "late", "event_windows", "event_trips")
    assert [r[:2] for r in summary] == [(1, 80), (81, 160), (161, 240)]
    assert sum(r[2] for r in summary) == len(want["late"])
    assert [r[3] for r in summary] == [sum(w[3] == b for w in want["event"]) for b in (1, 2, 3)]


def test_arrivals_going_back_are_refused_before_anything_is_written(spark):
    trips = make_trips(40)
    stream = CountingStream(spark, new_dir(spark, "stream"))
    stream.apply(frame(spark, trips[20:]), 1)
    with pytest.raises(ValueError, match="out of order"):
        stream.apply(frame(spark, trips[:20]), 2)
    with pytest.raises(ValueError, match="out of order"):  # the same instant, an earlier trip
        stream.apply(frame(spark, [trips[-1]._replace(trip_seq=-1)]), 2)
    with pytest.raises(ValueError, match="without event_time"):
        stream.apply(frame(spark, [trip(99, None, "23:59:59")]), 2)
    assert stream.trips().count() == 20


def test_empty_batches_keep_the_state(spark):
    trips = make_trips(60)
    stream = CountingStream(spark, new_dir(spark, "stream"))
    stream.apply(frame(spark, []), 1)
    stream.apply(frame(spark, trips[:30]), 2)
    stream.apply(frame(spark, []), 3)
    stream.apply(frame(spark, trips[30:]), 4)
    check_equals_model(stream, trips)


def test_stop_by_arrival_and_resume_over_files(spark):
    """A real streaming query over JSON files, stopped at a point of the arrival clock and resumed."""
    trips = make_trips(120, surge_from=at("05:00"))
    landing, root = new_dir(spark, "landing"), new_dir(spark, "stream")
    df = frame(spark, trips)
    stop = F.unix_micros(F.lit("2024-01-01 04:30:00").cast("timestamp"))
    stop = spark.range(1).select(stop).first()[0]
    write_arrivals(arrivals_between(df, None, stop), landing)
    stream = CountingStream(spark, root)
    stream.run(landing)
    early = [t for t in trips if t.processing_time < at("04:30:00")]
    check_equals_model(stream, early)
    old_trips, old_files = stream.trips(), data_files(stream.trips())
    assert "surge_multiplier" not in old_trips.columns
    old_files = spark.createDataFrame(old_files.collect(), old_files.schema)

    write_arrivals(arrivals_between(df, stop, None), landing)
    stream = CountingStream(spark, root)
    stream.run(landing)
    check_equals_model(stream, trips)
    # The column is new, old rows read as NULL, and no old file was touched.
    new_trips = stream.trips()
    described = {r[1]: r[3:] for r in rows(describe_columns(new_trips, old_trips))}
    assert described["surge_multiplier"] == (True, 120, sum(t.surge_multiplier is not None for t in trips))
    assert not described["fare"][0]
    changes = {r[0]: r[1:] for r in rows(file_changes(old_files, data_files(new_trips)))}
    assert set(changes) == {"kept", "added"}
    assert changes["kept"] == (old_files.count(), len(early)) and changes["added"][1] == 120 - len(early)
    assert rows(coverage_by_day(new_trips))[0][1:] == (120, described["surge_multiplier"][2], 120 - described["surge_multiplier"][2])
    early_rows = new_trips.where(F.col("batch_id") == 1)
    assert early_rows.where(F.col("surge_multiplier").isNotNull()).count() == 0
