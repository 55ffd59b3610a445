import random
from collections import Counter

import pytest
from model import rows
from pyspark.sql import functions as F

from tallyward.session import new_dir
from tallyward.streaming.ingest import COUNT_SCHEMA
from tallyward.tables import corrections
from tallyward.tables.changelog import ChangeLog, commit_summary, repeat_rows, same_rows

DAY = "2024-01-02"


def counts(spark, cells):
    """cells: (zone, hour offset from 2024-01-01, count, batch)."""
    return spark.createDataFrame(
        cells, "zone STRING, h INT, trip_count BIGINT, batch_id BIGINT"
    ).select("zone", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours="h")).alias("window_start"), "trip_count", "batch_id")


@pytest.fixture
def log(spark):
    made = ChangeLog(spark, new_dir(spark, "log"), COUNT_SCHEMA)
    made.append(counts(spark, [("a", 1, 5, 1), ("b", 1, 4, 1)]), "app", 1)
    made.append(counts(spark, [("a", 30, 7, 2), ("a", 30, 7, 2), ("b", 31, 2, None)]), "app", 2)
    made.append(counts(spark, [("a", 60, 1, 3)]), "app", 3)
    return made


def content(df):
    return sorted(rows(df), key=str)


def test_empty_table(spark):
    empty = ChangeLog(spark, new_dir(spark, "log"), COUNT_SCHEMA)
    assert empty.version() is None and empty.latest() is None
    with pytest.raises(ValueError):
        empty.read()


def test_append_and_as_of(spark, log):
    assert log.version() == 2
    assert [log.as_of(v).count() for v in range(3)] == [2, 5, 6]
    with pytest.raises(ValueError, match="no version 3"):
        log.as_of(3)


def test_a_committed_batch_is_skipped(spark, log):
    again = counts(spark, [("a", 30, 7, 2)])
    assert log.append(again, "app", 2) is None and log.version() == 2
    assert log.append(again, "other-app", 2) == 3


def test_empty_append_commits_nothing(spark, log):
    assert log.append(log.read().limit(0), "app", 4) is None
    assert log.version() == 2


def test_replace_restore_round_trip_twice(spark, log):
    good_rows = content(log.read())
    late = counts(spark, [("a", 30, 1, 0), ("a", 30, 1, 0)])
    for _ in range(2):
        good, bad = corrections.apply_bad_correction(log, late, DAY)
        assert corrections.is_bad(log) and corrections.last_correction(log) == (good, bad)
        assert content(log.as_of(good)) == good_rows
        day = log.read().where(corrections.day_predicate(DAY))
        assert rows(day, "zone", "trip_count", "batch_id") == [("a", 2, None)]
        outside = f"NOT ({corrections.day_predicate(DAY)})"
        assert log.same(good, bad, outside) and not log.same(good, bad)
        restored = corrections.undo_correction(log)
        assert content(log.read()) == good_rows
        assert log.same(good, restored) and same_rows(log.as_of(good), log.read())
    assert log.version() == 6


def test_guards(spark, log):
    late = counts(spark, [("a", 30, 1, 0)])
    with pytest.raises(RuntimeError):
        corrections.undo_correction(log)
    corrections.apply_bad_correction(log, late, DAY)
    with pytest.raises(RuntimeError):
        corrections.apply_bad_correction(log, late, DAY)
    corrections.undo_correction(log)
    with pytest.raises(RuntimeError):
        corrections.undo_correction(log)


def test_new_rows_must_satisfy_the_predicate(spark, log):
    with pytest.raises(ValueError, match="satisfy"):
        log.replace_where("zone = 'a'", counts(spark, [("b", 1, 1, 9)]))
    with pytest.raises(ValueError, match="satisfy"):
        log.replace_where("batch_id = 1", counts(spark, [("b", 1, 1, None)]))


def test_predicates_that_change_with_time_are_refused(spark, log):
    with pytest.raises(ValueError, match="when it runs"):
        log.replace_where("window_start < current_timestamp()", log.read())


def test_replace_on_an_empty_range(spark, log):
    version = log.replace_where("zone = 'z'", counts(spark, [("z", 1, 1, 9)]))
    assert version == 3 and log.read().count() == 7
    assert log.replace_where("zone = 'nowhere'", log.read().limit(0)) is None


def test_rows_where_the_predicate_is_null_stay(spark, log):
    log.replace_where("batch_id = 2", log.read().limit(0))
    assert content(log.read().where("batch_id IS NULL")) == content(log.as_of(2).where("batch_id IS NULL"))
    assert log.read().count() == 4


def test_restore_undoes_appends(spark, log):
    assert log.restore(0) == 3
    assert content(log.read()) == content(log.as_of(0))
    assert log.append(counts(spark, [("c", 1, 1, 4)]), "app", 4) == 4
    assert log.read().count() == 3 and log.as_of(2).count() == 6
    log.restore(2)
    assert content(log.read()) == content(log.as_of(2))


def test_log_rows_without_a_commit_are_invisible_and_overwritten(spark, log):
    before = content(log.read())
    orphan = counts(spark, [("x", 1, 99, 9)] * 3).withColumn("delta", F.lit(1).cast("long"))
    orphan.write.parquet(f"{log.path}/log/version=3")
    assert content(log.read()) == before
    assert log.append(counts(spark, [("c", 1, 1, 4)])) == 3
    assert log.read().count() == 7 and log.read().where("zone = 'x'").count() == 0


def test_history_and_summary(spark, log):
    corrections.apply_bad_correction(log, counts(spark, [("a", 30, 1, 0)]), DAY)
    corrections.undo_correction(log)
    got = rows(log.history(), "version", "parent_version", "operation", "mode", "rows_added", "rows_removed")
    assert got == [
        (4, 3, "RESTORE", "", 3, 1),
        (3, 2, "WRITE", "Overwrite", 1, 3),
        (2, 1, "WRITE", "Append", 1, 0),
        (1, 0, "WRITE", "Append", 3, 0),
        (0, None, "WRITE", "Append", 2, 0),
    ]
    assert [r[0] for r in rows(log.history(2), "version")] == [4, 3]
    assert [r[0] for r in rows(log.commits_since(2), "version")] == [3, 4]
    summary = {r[:2]: r[2:] for r in rows(commit_summary(log.commits_since(-1)), "operation", "mode", "commits", "rows_added", "rows_removed")}
    assert summary[("WRITE", "Append")] == (3, 6, 0)
    assert log.files(2).count() < log.files(4).count()


def test_sql_over_a_version(spark, log):
    log.register("zone_counts", version=1)
    assert spark.sql("SELECT sum(trip_count) FROM zone_counts").first()[0] == 25


def test_many_copies_are_expanded_in_steps(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "k STRING, n BIGINT")
    got = repeat_rows(df, "n", step=10).groupBy("k").count()
    assert dict(rows(got)) == {"a": 25, "b": 1, "c": 10}


@pytest.mark.parametrize("n", [0, -1])
def test_a_net_count_below_one_is_refused(spark, n):
    with pytest.raises(Exception, match="damaged log"):
        repeat_rows(spark.createDataFrame([("a", n)], "k STRING, n BIGINT"), "n").collect()


def test_only_corrected_rows_are_added_up_on_read(spark, log):
    """A read after a correction shuffles the corrected range only; the rest is a plain scan."""
    corrections.apply_bad_correction(log, counts(spark, [("a", 30, 1, 0)]), DAY)
    plan = log.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
    scan_only = log.as_of(2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in scan_only


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_match_a_list_of_versions(spark, seed):
    rng = random.Random(seed)
    log = ChangeLog(spark, new_dir(spark, "log"), "k STRING, n BIGINT")

    def some(keys, most=4):
        return [(rng.choice(keys), rng.choice([1, 2, None])) for _ in range(rng.randint(1, most))]

    def table(cells):
        return spark.createDataFrame(cells, "k STRING, n BIGINT")

    first = some("abc")
    log.append(table(first))
    versions = [Counter(first)]
    for _ in range(6):
        now, action = versions[-1], rng.choice(["append", "replace", "replace", "restore"])
        if action == "append":
            cells = some("abcd")
            done, new = log.append(table(cells)), now + Counter(cells)
        elif action == "replace":
            key = rng.choice("abcd")
            cells = some(key)
            done = log.replace_where(f"k = '{key}'", table(cells))
            new = Counter({row: c for row, c in now.items() if row[0] != key}) + Counter(cells)
        else:
            target = rng.randrange(len(versions))
            done, new = log.restore(target), versions[target]
        if done is not None:
            versions.append(new)
        else:
            assert new == now
    assert log.version() == len(versions) - 1
    for version, want in enumerate(versions):
        assert Counter(rows(log.as_of(version))) == want
