"""One landed file of any size is sorted by all tasks, not by the one that writes it."""

from model import frame
from pyspark.sql import functions as F
from test_stream import make_trips

from tallyward.session import new_dir
from tallyward.sources import trips as module
from tallyward.sources.trips import read_arrivals, write_arrivals


def test_one_file_is_written_without_a_sort_in_its_task(spark, monkeypatch):
    write, plans = module._write_lines, []

    def watched(rows, path, **options):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path, **options)

    monkeypatch.setattr(module, "_write_lines", watched)
    made, path = make_trips(400), new_dir(spark, "landing")
    write_arrivals(frame(spark, made).repartition(5), path, files=1)
    writing = plans[0].split("InMemoryTableScan")[0]
    assert "Coalesce 1" in writing and "Sort" not in writing and "Exchange" not in writing
    lines = read_arrivals(spark, path).select("trip_seq", F.col("_metadata.file_path").alias("file"))
    got = lines.collect()
    assert len({r.file for r in got}) == 1
    assert [r.trip_seq for r in got] == [t.trip_seq for t in made]  # one file of one split comes as it was written
