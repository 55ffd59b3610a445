"""Fields that nobody declared: kept as they came, their schema per batch, promotion, schema differences."""

import json
import os

import pytest
from model import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.operators.schema import merged, schema_changes, type_changes
from tallyward.session import new_dir
from tallyward.sources.trips import read_arrivals
from tallyward.streaming.ingest import CountingStream

EXTRAS = [{}, {}, {"tip": {"cents": 5}, "n": 1}, {"tip": {"cents": 5.5, "who": "x"}, "n": None}, {"n": 7, "l": [1, None]}]


def lines(batch, extra, n=3):
    made = []
    for i in range(batch * n, batch * n + n):
        clock = f"2024-01-01T10:{i:02d}:0"
        trip = {"trip_seq": i, "trip_id": str(i), "zone": "a", "event_time": f"{clock}0Z", "processing_time": f"{clock}1Z", "fare": 2.5}
        made.append(json.dumps(trip | extra))
    return "\n".join(made) + "\n"


@pytest.fixture
def stream(spark):
    landing = new_dir(spark, "landing")
    os.makedirs(landing)
    made = CountingStream(spark, new_dir(spark, "stream"))
    for batch, extra in enumerate(EXTRAS):
        with open(f"{landing}/f{batch}.json", "w") as file:
            file.write(lines(batch, extra))
        made.run(landing)
    return made


def test_nothing_is_lost(spark, stream):
    got = {r[0]: json.loads(r[1]) for r in rows(stream.rest().select("trip_seq", F.to_json("rest")))}
    assert got == {i: extra for batch, extra in enumerate(EXTRAS) if extra for i in range(batch * 3, batch * 3 + 3)}
    assert "rest" not in stream.trips().columns and stream.trips().count() == 15
    assert rows(stream.progress().orderBy("batch_id"), "with_rest") == [(0,), (0,), (3,), (3,), (3,)]


def test_schema_of_each_batch(spark, stream):
    assert rows(stream.schema_history().orderBy("batch_id", "path")) == [
        (3, "n", "added", None, "bigint"),
        (3, "tip", "added", None, "struct<cents:bigint>"),
        (4, "tip.cents", "widened", "bigint", "decimal(20,1)"),
        (4, "tip.who", "added", None, "string"),
        (5, "l", "added", None, "array<bigint>"),
    ]


def test_promotion_reaches_all_batches_and_touches_no_file(spark, stream):
    folder = f"{stream.root}/trips_raw".removeprefix("file:")
    files = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}
    stream.promote("n", "int")
    stream.promote("cents", "decimal(10,1)", "$.tip.cents")
    stream.promote("n", "int")
    again = CountingStream(spark, stream.root)  # another process sees it too
    got = rows(again.trips().orderBy("trip_seq"), "n", F.col("cents").cast("double"))
    assert got == [(None, None)] * 6 + [(1, 5.0)] * 3 + [(None, 5.5)] * 3 + [(7, None)] * 3
    assert rows(again.trips(upto=3).select("n").distinct().orderBy("n")) == [(None,), (1,)]
    assert files == {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_promotion_that_would_lose_values_is_refused(spark, stream):
    with pytest.raises(ValueError, match="3 values of \\$.tip.who do not fit int"):
        stream.promote("who", "int", "$.tip.who")
    with pytest.raises(ValueError, match="a column already"):
        stream.promote("fare", "int")
    assert stream.promoted() == {}


def test_declared_fields_read_the_same_with_and_without_rest(spark, tmp_path):
    (tmp_path / "x.json").write_text(lines(0, {"n": 1}) + "\n" + lines(1, {}))
    plain, kept = read_arrivals(spark, str(tmp_path)), read_arrivals(spark, str(tmp_path), rest=True)
    assert sorted(rows(plain)) == sorted(rows(kept.drop("rest"))) and kept.where("rest IS NULL").count() == 3
    (tmp_path / "y.json").write_text('{"trip_id": "1", "zone": \n')
    with pytest.raises(Exception):
        read_arrivals(spark, str(tmp_path), rest=True).collect()


def changes(old, new):
    return sorted(type_changes(T.DataType.fromDDL(old), T.DataType.fromDDL(new)), key=str)


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("a INT, b STRING", "b STRING, a INT", []),
        ("a INT", "a BIGINT", [("a", "widened", "int", "bigint")]),
        ("a BIGINT", "a INT", [("a", "retyped", "bigint", "int")]),
        ("a INT", "a DOUBLE", [("a", "widened", "int", "double")]),
        ("a BIGINT", "a DOUBLE", [("a", "retyped", "bigint", "double")]),
        ("a DECIMAL(5,2)", "a DECIMAL(7,3)", [("a", "widened", "decimal(5,2)", "decimal(7,3)")]),
        ("a DECIMAL(5,2)", "a DECIMAL(6,4)", [("a", "retyped", "decimal(5,2)", "decimal(6,4)")]),
        ("a INT, b INT", "A INT, c DATE", [("A", "renamed_case", "a", "A"), ("b", "removed", "int", None), ("c", "added", None, "date")]),
        ("s STRUCT<x: INT, y: STRUCT<z: INT>>", "s STRUCT<x: STRING, y: STRUCT<z: BIGINT, w: INT>>", [("s.x", "retyped", "int", "string"), ("s.y.w", "added", None, "int"), ("s.y.z", "widened", "int", "bigint")]),
        ("l ARRAY<STRUCT<a: INT>>", "l ARRAY<STRUCT<b: INT>>", [("l[].a", "removed", "int", None), ("l[].b", "added", None, "int")]),
        ("m MAP<STRING, INT>", "m MAP<STRING, BIGINT>", [("m{}", "widened", "int", "bigint")]),
        ("a VOID", "a STRING", [("a", "widened", "void", "string")]),
        ("a INT", "a ARRAY<INT>", [("a", "retyped", "int", "array<int>")]),
    ],
)
def test_type_changes(spark, old, new, want):
    assert changes(old, new) == sorted(want, key=str)


def test_schema_changes_of_tables(spark):
    before, after = spark.range(1), spark.range(1).selectExpr("id", "1 AS n")
    assert rows(schema_changes(before, after)) == [("n", "added", None, "int")]
    assert rows(schema_changes(after, after)) == []


@pytest.mark.parametrize(
    "old, new, want",
    [("BIGINT", "DECIMAL(2,1)", "decimal(20,1)"), ("STRING", "INT", "string"), ("INT", "VOID", "int"), ("DECIMAL(38,0)", "DECIMAL(38,38)", "string"), ("STRUCT<a: INT>", "STRUCT<b: INT>", "struct<a:int,b:int>"), ("ARRAY<INT>", "ARRAY<BIGINT>", "array<bigint>")],
)
def test_merged_types(spark, old, new, want):
    assert merged(T.DataType.fromDDL(old), T.DataType.fromDDL(new)).simpleString() == want
