"""The counting stream: JSON arrivals in, four tables out, safe to crash and replay at any point.

    trips_raw/batch_id=N/       every trip as received, with the verdict on it (position, max_before, window_start, is_late)
    late_events/batch_id=N/     trips that came after their window had closed
    tallies/batch_id=N/         trips and late trips of the batch per clock, zone and window
    window_state/batch_id=N/    counts still open, or closed by batch N, on both clocks
    zone_counts_event_time/batch_id=N/        windows closed by batch N
    zone_counts_processing_time/batch_id=N/
    progress/batch_id=N/        clocks and totals after batch N, written last
    triggers/trigger_id=N/      the last batch of trigger N, where a trigger has more than one

A backlog of small batches can be worked off many batches at a time. A run of batches then adds a few files to each table instead
of a folder per batch, batches-<first>-<last>-*, which have batch_id as a column and the rows that one batch after another
would write. progress has one row for all of them, under the last one, with that of each earlier one inside.

Batch N reads the state of batch N-1 and overwrites only its own partitions, so a replay of the same
files rewrites the same rows. Readers ignore batches above the newest one in progress. No step lists what
earlier batches wrote, so a batch costs the same however many came before it.
Files of runs are not overwritten: what an attempt that did not finish has left is deleted before the next one begins, and runs that
are finished are not repeated.

Files are admitted in arrival order by the landing index. A file that begins before what has been counted is refused.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.clock import minutes, window_start
from tallyward.operators import batches
from tallyward.operators.arrival import CELL_ROWS, judge_arrivals, with_lateness
from tallyward.operators.counts import both_clocks
from tallyward.operators.schema import CHANGES, merged, type_changes
from tallyward.policy import LATE_EXAMPLES, LatenessPolicy
from tallyward.session import CLEANUP, one_row, prepare, setting, stage
from tallyward.sources.landing import Admission, Admitted, index_of, most_together, publish, read_parts, stream_entries
from tallyward.sources.trips import OPTIONAL_COLUMNS, REST, TRIP_SCHEMA
from tallyward.streaming.live import LANDED

COUNT_SCHEMA = "zone STRING, window_start TIMESTAMP, trip_count BIGINT, batch_id BIGINT"
VERDICT = "position BIGINT, max_before TIMESTAMP, window_start TIMESTAMP, is_late BOOLEAN"
LATE_COLUMNS = "window_start TIMESTAMP, window_end TIMESTAMP, watermark TIMESTAMP, lateness_seconds DOUBLE"
TALLY_SCHEMA = "clock STRING, zone STRING, window_start TIMESTAMP, trips BIGINT, late BIGINT"
STATE_SCHEMA = "clock STRING, zone STRING, window_start TIMESTAMP, trip_count BIGINT, closed BOOLEAN"
COUNT_TABLES = {"event": "zone_counts_event_time", "processing": "zone_counts_processing_time"}
#: What is known of the windows a batch closes, per clock.
CLOSED = ("windows", "trips", "first_start_us", "last_start_us")
#: Tables that batches write before their progress.
TABLES = ("trips_raw", "late_events", "tallies", "window_state", *COUNT_TABLES.values())
#: Files of runs of batches.
RUNS = "batches-*"
PROGRESS_SCHEMA = (
    "rows BIGINT, total_rows BIGINT, late BIGINT, total_late BIGINT, entries BIGINT, "
    "min_processing_us BIGINT, max_event_us BIGINT, max_processing_us BIGINT, max_seq BIGINT, "
    "trip_columns STRING, late_columns STRING, with_rest BIGINT, rest_schema STRING, upto BIGINT, "
    + ", ".join(f"{clock}_{what} BIGINT" for clock in COUNT_TABLES for what in CLOSED)
)
PROGRESS = [field.split()[0] for field in PROGRESS_SCHEMA.split(", ")]


def _latest(a: int | None, b: int | None) -> int | None:
    return max((t for t in (a, b) if t is not None), default=None)


def _row(figures: dict) -> Row:
    return Row(**{name: figures.get(name) for name in PROGRESS})


def _progress_file() -> T.StructType:
    """Progress as it is written: that of earlier batches of a run is inside that of the last."""
    own = T.StructType.fromDDL(PROGRESS_SCHEMA)
    return T.StructType(list(own)).add("earlier", T.ArrayType(T.StructType([T.StructField("batch_id", T.LongType()), *own])))


def _run_name(first: int, last: int) -> str:
    return f"batches-{first:012d}-{last:012d}"


class CountingStream:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        policy: LatenessPolicy | None = None,
        after_step: Callable[[str, int], None] | None = None,
        on_batch: Callable[[int, dict], None] | None = None,
        cell_rows: int = CELL_ROWS,
    ):
        """root is the folder of all tables; after_step is called after each write of a batch, on_batch after the
        last with the batch's figures. cell_rows is the number of rows that one task scans."""
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.policy = policy or LatenessPolicy()
        self.after_step = after_step or (lambda step, batch_id: None)
        self.on_batch = on_batch or (lambda batch_id, figures: None)
        self.cell_rows = cell_rows
        self._newest: tuple[int, Row] | None = None
        self._runs: list[tuple[int, int]] | None = None

    # -- running ------------------------------------------------------------------------------

    def run(
        self, landing: str, files_per_batch: int | None = None, stop_us: int | None = None, batches_per_trigger: int = 1
    ) -> None:
        """Process everything that has landed and stop; a later run continues from there.

        With stop_us, trips from that instant of the arrival clock on are left for a later run, also those in a file that
        has earlier ones. With files_per_batch, a trigger takes the files of up to batches_per_trigger batches, which are
        worked on together.
        """
        # Where a batch is one file, a trigger is one file of the index: its number of entries has no part in any result.
        entries_per_file = batches_per_trigger if files_per_batch == 1 else 1
        if not publish(self.spark, landing, stop_us, entries_per_file) and not index_of(self.spark, landing).head(1):
            return
        admission, newest = None, 0
        per_trigger = files_per_batch and files_per_batch * batches_per_trigger
        if entries_per_file > 1:
            per_trigger = max(per_trigger // most_together(self.spark, landing), 1)

        def batch(entries: DataFrame, spark_id: int) -> None:
            nonlocal admission, newest
            if admission is None:
                newest = self._last_of_trigger(spark_id)
                before = self._progress_row(newest)
                key = before and before.max_processing_us is not None and (before.max_processing_us, before.max_seq)
                admission, resumed = Admission(self.spark, landing, key or None, before.entries if before else 0), True
            else:
                resumed = False
            left = entries.count()
            each = files_per_batch or max(left, 1)
            taken = [admission.take(min(each, left - at)) for at in range(0, max(left, 1), each)]
            todo, together = dict(enumerate(taken, newest + 1)), batches_per_trigger > 1 or len(taken) > 1
            for block in self._blocks(self._unfinished(todo, together) if resumed else todo):
                batch_id, admitted = next(iter(block.items()))
                if together:
                    self._apply_block(block)
                elif admitted.files:
                    self._apply(admitted.read(self.spark), batch_id, admitted.__dict__)
                else:
                    self.apply(self.spark.createDataFrame([], TRIP_SCHEMA), batch_id)
            newest += len(taken)
            if newest != spark_id + 1:
                row = one_row(self.spark, T.StructType.fromDDL("last_batch BIGINT"), {"last_batch": newest})
                row.write.mode("overwrite").parquet(self._trigger(spark_id + 1))

        landed = [
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
        ]
        query = (
            stream_entries(self.spark, landing, per_trigger)
            .observe(LANDED, *landed)
            .writeStream.foreachBatch(batch)
            .option("checkpointLocation", f"{self.root}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def _trigger(self, trigger_id: int) -> str:
        return f"{self.root}/triggers/trigger_id={trigger_id}"

    def _last_of_trigger(self, trigger_id: int) -> int:
        """The last batch of a finished trigger: its own number, if no trigger up to it had more than one batch."""
        try:
            return self.spark.read.schema("last_batch BIGINT").parquet(self._trigger(trigger_id)).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return trigger_id

    def _blocks(self, parts: dict[int, Admitted]) -> list[dict[int, Admitted]]:
        """Batches in the runs that can be worked on together: not empty, and within a cell."""
        blocks, joins = [], False
        for batch_id, a in parts.items():
            mine = 0 < a.rows <= self.cell_rows
            if not (mine and joins):
                blocks.append({})
            blocks[-1][batch_id], joins = a, mine
        return blocks

    # -- after a crash ------------------------------------------------------------------------------

    def _unfinished(self, parts: dict[int, Admitted], together: bool) -> dict[int, Admitted]:
        """Those batches of a trigger that are to be worked on, where it may be a repeated one. Finished batches in folders of
        their own are written over, if they are again to be. Others stay as they are, if they hold the same entries."""
        first, done = min(parts), self._finished()
        if done >= first and (together or self._in_run(done)):
            before, last = self._progress_row(first - 1), self._progress_row(done)
            entries = (before.entries if before else 0) + sum(a.entries for b, a in parts.items() if b <= done)
            keys = [a.last for b, a in parts.items() if b <= done and a.last]
            if entries == last.entries and (not keys or keys[-1] == (last.max_processing_us, last.max_seq)):
                parts = {b: a for b, a in parts.items() if b > done}
            else:
                for batch_id in range(done, first - 1, -1):
                    self._delete(f"progress/batch_id={batch_id}")
                self._newest, done = None, first - 1
        self._drop_unfinished(done)
        return parts

    def _finished(self) -> int:
        """The last finished batch, 0 if there is none."""
        try:
            return self.last_batch() or 0
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def _files(self, pattern: str) -> list:
        """Paths under root that fit a pattern."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
        return [status.getPath() for status in found or []]

    def _delete(self, pattern: str) -> bool:
        paths = self._files(pattern)
        for path in paths:
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return bool(paths)

    def _in_run(self, batch_id: int) -> bool:
        """Whether a batch is one of those that were worked on together. A run writes its window state in any case."""
        if self._runs is None:
            names = {path.getName() for path in self._files(f"window_state/{RUNS}")}
            self._runs = [tuple(map(int, name.split("-")[1:3])) for name in names]
        return any(first <= batch_id <= last for first, last in self._runs)

    def _drop_unfinished(self, done: int) -> None:
        """Delete what batches after the last finished one left behind. Runs are listed once for it, folders looked up."""
        for table in TABLES:
            for path in self._files(f"{table}/{RUNS}"):
                if int(path.getName().split("-")[1]) > done:
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        stray = done + 1
        while any([self._delete(f"{table}/batch_id={stray}") for table in TABLES]):
            stray += 1
        self._runs = None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of trips. Calling it again with the same rows leaves the same tables."""
        if self._runs is None and self._files(f"window_state/{RUNS}"):
            self._drop_unfinished(self._finished())
        if self._in_run(batch_id):
            raise ValueError(f"batch {batch_id} was worked on together with others and cannot be repeated alone")
        key = F.struct(F.unix_micros("processing_time").alias("us"), F.col("trip_seq").alias("seq"))
        stats = batch.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("event_time").isNull() | F.col("processing_time").isNull()).alias("untimed"),
            F.max(F.unix_micros("event_time")).alias("max_event_us"),
            F.min(key).alias("oldest"),
            F.max(key).alias("newest"),
            *[F.count(c).alias(c) for c in OPTIONAL_COLUMNS],
        ).first()
        before = self._progress_row(batch_id - 1)
        if stats.untimed:
            raise ValueError(f"batch {batch_id}: {stats.untimed} trips without event_time or processing_time")
        if before and before.max_processing_us is not None and stats.rows:
            # The whole pair must grow: equal instants over two batches have one order too.
            if tuple(stats.oldest) <= (before.max_processing_us, before.max_seq):
                raise ValueError(f"batch {batch_id} arrives out of order: (processing_time, trip_seq) goes back")
        facts = {
            "rows": stats.rows,
            "entries": 0,
            "first_us": stats.oldest.us if stats.rows else None,
            "last": tuple(stats.newest) if stats.rows else None,
            "max_event_us": stats.max_event_us,
            "optional": {c: stats[c] for c in OPTIONAL_COLUMNS},
        }
        self._apply(batch, batch_id, facts)

    def _apply(self, batch: DataFrame, batch_id: int, facts: dict) -> None:
        """A batch whose figures are known, so nothing has to be looked at before the first write."""
        before, rows = self._progress_row(batch_id - 1), facts["rows"]
        max_event = _latest(before and before.max_event_us, facts["max_event_us"])
        last_us, _ = facts["last"] or (before and (before.max_processing_us, before.max_seq)) or (None, None)
        seen, late_seen, closed = [c for c in OPTIONAL_COLUMNS if facts["optional"][c]], [], {}
        late, with_rest = 0, 0
        if rows:
            counted = self._write_trips(batch, batch_id, rows, seen, before and before.max_event_us)
            late, with_rest, late_seen = counted["late"], counted[REST], [c for c in OPTIONAL_COLUMNS if counted[c]]
            self.after_step("trips_raw", batch_id)
            self._write_late(batch_id, late, late_seen)
            self.after_step("late_events", batch_id)
            self._write_tallies(batch_id)
            self.after_step("tallies", batch_id)
        self._write_windows(batch_id, rows, max_event, last_us)
        self.after_step("window_state", batch_id)
        for clock, name in COUNT_TABLES.items():
            if rows:
                closed |= self._write_closed(clock, batch_id)
                self.after_step(name, batch_id)
        rest = self._rest_schema(batch_id) if with_rest else None
        figures = self._figures(before, batch_id, facts, seen, late, late_seen, with_rest, rest, closed)
        self._finish({batch_id: figures})

    def _figures(self, before, batch_id, facts, seen, late, late_seen, with_rest, rest_schema, closed) -> dict:
        """The progress of a batch, given that of the one before it."""
        last_us, last_seq = facts["last"] or (before and (before.max_processing_us, before.max_seq)) or (None, None)
        return {
            "rows": facts["rows"],
            "total_rows": (before.total_rows if before else 0) + facts["rows"],
            "late": late,
            "total_late": (before.total_late if before else 0) + late,
            "entries": (before.entries if before else 0) + facts["entries"],
            "min_processing_us": facts["first_us"],
            "max_event_us": _latest(before and before.max_event_us, facts["max_event_us"]),
            "max_processing_us": last_us,
            "max_seq": last_seq,
            "trip_columns": self._add_columns(before and before.trip_columns, seen),
            "late_columns": self._add_columns(before and before.late_columns, late_seen),
            "with_rest": with_rest,
            "rest_schema": rest_schema,
            "upto": batch_id,
            **closed,
        }

    def _finish(self, figures: dict[int, dict]) -> None:
        """Write the progress of batches that were worked on together: one row makes all of them visible."""
        last = max(figures)
        if len(figures) > 1:
            earlier = [(b, *_row(f)) for b, f in figures.items() if b != last]
            row = self.spark.createDataFrame([(*_row(figures[last]), earlier)], _progress_file()).coalesce(1)
        else:
            row = one_row(self.spark, T.StructType.fromDDL(PROGRESS_SCHEMA), figures[last])
        row.write.mode("overwrite").parquet(self._partition("progress", last))
        self._newest = last, _row(figures[last])
        self._after("progress", figures)
        for batch_id, mine in figures.items():
            self.on_batch(batch_id, mine)

    def _after(self, step: str, batch_ids) -> None:
        for batch_id in batch_ids:
            self.after_step(step, batch_id)

    # -- many batches at a time -------------------------------------------------------------------

    def _add(self, rows: DataFrame, table: str, batch_ids) -> DataFrame:
        """Add the files of a run of batches to a table, and return what was written."""
        cores, name = self.spark.sparkContext.defaultParallelism, _run_name(min(batch_ids), max(batch_ids))
        with setting(self.spark, CLEANUP, "true"):
            files = rows.coalesce(cores).write.mode("append").option("mapreduce.output.basename", name)
            files.parquet(f"{self.root}/{table}")
        self._after(table, batch_ids)
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{table}/{name}-*")

    def _apply_block(self, parts: dict[int, Admitted]) -> None:
        """A run of batches as _apply would leave them one by one: successive ones within a cell, or a single batch."""
        first, before = min(parts), self._progress_row(min(parts) - 1)
        carried, clocks = before and before.max_event_us, []
        for batch_id, a in parts.items():
            newest = _latest(carried, a.max_event_us)
            clocks.append((batch_id, carried, newest, a.last and a.last[0]))
            carried = newest
        schema = "batch_id BIGINT, carried_us BIGINT, max_event_us BIGINT, max_processing_us BIGINT"
        marks = self.spark.createDataFrame(clocks, schema)
        if parts[first].rows:
            counts, late_seen, rest, ended = self._write_block(parts, marks)
        else:
            left = self._state(first - 1).where(~F.col("closed")) if first > 1 else self.spark.createDataFrame([], STATE_SCHEMA)
            self._add(left.withColumn("batch_id", F.lit(first).cast("long")), "window_state", parts)
            counts, late_seen, rest, ended = {}, {}, {}, {}
        if self._runs is not None:
            self._runs.append((first, max(parts)))

        figures = {}
        for batch_id, a in parts.items():
            of_closed = {
                f"{clock}_{what}": value
                for clock in (COUNT_TABLES if a.rows else ())
                for what, value in zip(CLOSED, ended.get((batch_id, clock), (0, 0, None, None)))
            }
            mine, seen = counts.get(batch_id), [c for c in OPTIONAL_COLUMNS if a.optional[c]]
            late, with_rest = (mine.late, mine[REST]) if mine else (0, 0)
            figures[batch_id] = self._figures(
                before, batch_id, a.__dict__, seen, late, late_seen.get(batch_id, []), with_rest, rest.get(batch_id), of_closed
            )
            figures[batch_id]["upto"] = max(parts)
            before = _row(figures[batch_id])
        self._finish(figures)

    def _write_block(self, parts: dict[int, Admitted], marks: DataFrame) -> tuple[dict, dict, dict, dict]:
        """Write the tables of a run. Returns, per batch, its counts, the optional columns of its late trips and the type of its
        undeclared fields, and per batch and clock the figures of the windows it closed."""
        rows = read_parts(self.spark, parts).join(F.broadcast(marks.select("batch_id", "carried_us")), "batch_id")
        most = max(a.rows for a in parts.values())
        if most > self.cell_rows:
            rows = stage(rows, "arrivals", f"{self.root}/_work/arrivals")
        judged = judge_arrivals(rows, self.policy, F.timestamp_micros("carried_us"), most, self.cell_rows, "batch_id")
        unseen = [c for c in OPTIONAL_COLUMNS if not any(a.optional[c] for a in parts.values())]
        self._add(judged.drop("carried_us", *unseen), "trips_raw", parts)
        written = f"{self.root}/trips_raw/{_run_name(min(parts), max(parts))}-*"
        judged = self.spark.read.schema(f"{TRIP_SCHEMA}, {REST} VARIANT, {VERDICT}, batch_id BIGINT").parquet(written)
        counted = {"late": F.count_if("is_late"), REST: F.count_if(F.col(REST).isNotNull())}
        counted |= {c: F.count(F.when(F.col("is_late"), F.col(c))) for c in OPTIONAL_COLUMNS}
        found = judged.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counted.items()])
        counts = {r.batch_id: r for r in found.collect()}
        for batch_id, a in parts.items():
            if batch_id not in counts or counts[batch_id].rows != a.rows:
                raise ValueError(f"batch {batch_id}: files changed since they were published")
        late_seen = {b: [c for c in OPTIONAL_COLUMNS if r[c]] for b, r in counts.items()}
        rest = {}
        if any(r[REST] for r in counts.values()):
            types = judged.where(F.col(REST).isNotNull()).groupBy("batch_id").agg(F.schema_of_variant_agg(REST).alias("type"))
            rest = {r.batch_id: r.type.replace("OBJECT<", "STRUCT<") for r in types.collect()}

        if any(r.late for r in counts.values()):
            late = with_lateness(judged.where("is_late"), self.policy).drop("is_late", REST)
            never = [c for c in OPTIONAL_COLUMNS if not any(c in of_batch for of_batch in late_seen.values())]
            self._add(late.drop(*never), "late_events", parts)
        else:
            self._after("late_events", parts)
        tallies = self._add(self._tallied(judged, "batch_id"), "tallies", parts)
        states = self._add(self._states(tallies, marks, min(parts), max(parts)), "window_state", parts)
        closed, start = states.where("closed"), F.unix_micros("window_start")
        for clock, name in COUNT_TABLES.items():
            self._add(closed.where(F.col("clock") == clock).select("zone", "window_start", "trip_count", "batch_id"), name, parts)
        totals = closed.groupBy("batch_id", "clock").agg(F.count(F.lit(1)), F.sum("trip_count"), F.min(start), F.max(start))
        ended = {(b, clock): found for b, clock, *found in totals.collect()}
        return counts, late_seen, rest, ended

    def _states(self, tallies: DataFrame, marks: DataFrame, first: int, last: int) -> DataFrame:
        """Window state after each batch from first to last: a window is there from the first batch that counts a trip in it,
        or from the first of all if it was open before, up to the batch that closes it."""
        window = ["clock", "zone", "window_start"]
        added = tallies.where("trips > 0").select(*window, F.col("trips").alias("trip_count"), "batch_id")
        if first > 1:
            left = self._state(first - 1).where(~F.col("closed")).drop("closed")
            added = added.unionByName(left.withColumn("batch_id", F.lit(first - 1).cast("long")))
        order = W.partitionBy(*window).orderBy("batch_id")
        runs = added.withColumn("following", F.lead("batch_id").over(order)).withColumn(
            "trip_count", F.sum("trip_count").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        )
        # Both clocks only grow, so a window is closed by the first batch that reaches its mark.
        by_batch = F.array_sort(F.collect_list(F.struct("batch_id", "max_event_us", "max_processing_us")))
        reached = marks.agg(by_batch.alias("m")).select(
            F.col("m.max_event_us").alias("event_marks"), F.col("m.max_processing_us").alias("processing_marks")
        )

        def closes(marks_of: str, after: int) -> Column:
            mark = F.unix_micros(F.col("window_start") + minutes(after))
            return F.lit(first) + F.size(F.filter(marks_of, lambda us: us < mark))

        final = F.when(F.col("clock") == "event", closes("event_marks", self.policy.final_after)).otherwise(
            closes("processing_marks", self.policy.window_minutes)
        )
        ends = added.select("clock", "window_start").distinct().crossJoin(F.broadcast(reached))
        ends = ends.select("clock", "window_start", final.cast("long").alias("closing"))
        spans = (
            runs.join(ends, ["clock", "window_start"])
            .withColumn("since", F.greatest("batch_id", F.lit(first)))
            .withColumn("upto", F.least(F.coalesce("following", F.lit(last + 1)) - 1, "closing", F.lit(last)))
            .where("since <= upto")
        )
        each = spans.select(*window, "trip_count", "closing", F.explode(F.sequence("since", "upto")).alias("batch_id"))
        return each.select(*window, "trip_count", (F.col("batch_id") == F.col("closing")).alias("closed"), "batch_id")

    # -- writing ------------------------------------------------------------------------------

    def _partition(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def _write_trips(self, batch, batch_id, rows, seen, carried_us) -> dict[str, int]:
        """Judge and write the trips in one pass, and count late ones and undeclared fields on the way."""
        if REST not in batch.columns:
            batch = batch.withColumn(REST, F.lit(None).cast("variant"))
        if rows > self.cell_rows:
            # Cells are found by looks at all rows, which should not parse the lines each time.
            batch = stage(batch, "arrivals", f"{self.root}/_work/arrivals")
        carried = F.timestamp_micros(F.lit(carried_us).cast("long"))
        judged = judge_arrivals(batch, self.policy, carried, rows, self.cell_rows)
        observed = Observation(f"trips-{batch_id}")
        counted = {"late": F.count_if("is_late"), REST: F.count_if(F.col(REST).isNotNull())}
        counted |= {c: F.count(F.when(F.col("is_late"), F.col(c))) for c in OPTIONAL_COLUMNS}
        judged = judged.observe(observed, *[c.alias(name) for name, c in counted.items()])
        unseen = [c for c in OPTIONAL_COLUMNS if c not in seen]
        judged.drop(*unseen).write.mode("overwrite").parquet(self._partition("trips_raw", batch_id))
        return dict(observed.get)

    def _rest_schema(self, batch_id: int) -> str:
        """One type that holds the undeclared fields of all trips of a batch."""
        rest = self.spark.read.schema(f"{REST} VARIANT").parquet(self._partition("trips_raw", batch_id))
        found = rest.where(F.col(REST).isNotNull()).agg(F.schema_of_variant_agg(REST)).first()[0]
        return found.replace("OBJECT<", "STRUCT<")

    def _judged(self, batch_id: int) -> DataFrame:
        """The written trips of a batch: columnar, pruned, durable. Everything else derives from them."""
        return self.spark.read.schema(f"{TRIP_SCHEMA}, {VERDICT}").parquet(self._partition("trips_raw", batch_id))

    def _write_late(self, batch_id: int, late: int, seen: list[str]) -> None:
        if late:
            found = with_lateness(self._judged(batch_id).where("is_late"), self.policy).drop("is_late")
            unseen = [c for c in OPTIONAL_COLUMNS if c not in seen]
            found.drop(*unseen).write.mode("overwrite").parquet(self._partition("late_events", batch_id))

    def _write_tallies(self, batch_id: int) -> None:
        self._tallied(self._judged(batch_id)).write.mode("overwrite").parquet(self._partition("tallies", batch_id))

    def _tallied(self, judged: DataFrame, *part: str) -> DataFrame:
        """Both clocks in one grouping: a trip counts in its event window, on time or late, and in its arrival window."""
        own = F.struct(F.lit("event").alias("clock"), F.col("window_start"), F.col("is_late"))
        arrival = window_start(F.col("processing_time"), self.policy)
        other = F.struct(F.lit("processing").alias("clock"), arrival.alias("window_start"), F.lit(False).alias("is_late"))
        placed = judged.select(*part, "zone", F.explode(F.array(own, other)).alias("w")).select(*part, "zone", "w.*")
        return placed.groupBy(*part, "clock", "zone", "window_start").agg(
            F.count_if(~F.col("is_late")).alias("trips"), F.count_if("is_late").alias("late")
        )

    def _state(self, batch_id: int) -> DataFrame:
        """Window state after a batch, from its folder, or from the files of the run that it ended or was in."""
        folder = self._there(STATE_SCHEMA, self._partition("window_state", batch_id))
        if folder is not None:
            return folder
        schema, table = f"{STATE_SCHEMA}, batch_id BIGINT", f"{self.root}/window_state"
        of_run = self._there(schema, f"{table}/batches-*-{batch_id:012d}-*")
        of_run = self.spark.read.schema(schema).parquet(f"{table}/{RUNS}") if of_run is None else of_run
        return of_run.where(F.col("batch_id") == batch_id).drop("batch_id")

    def _write_windows(self, batch_id: int, rows: int, max_event: int | None, max_processing: int | None) -> None:
        """Windows the batch before left open, with what the batch adds, and whether they are final now."""
        if batch_id > 1:
            left = self._state(batch_id - 1).where(~F.col("closed"))
        else:
            left = self.spark.createDataFrame([], STATE_SCHEMA)
        path = self._partition("window_state", batch_id)
        if not rows:
            left.write.mode("overwrite").parquet(path)
            return
        tallies = self.spark.read.schema(TALLY_SCHEMA).parquet(self._partition("tallies", batch_id))
        added = tallies.where("trips > 0").select("clock", "zone", "window_start", F.col("trips").alias("trip_count"))

        def passed(after: int, clock_us: int) -> Column:
            return F.col("window_start") + minutes(after) <= F.timestamp_micros(F.lit(clock_us))

        final = F.when(F.col("clock") == "event", passed(self.policy.final_after, max_event)).otherwise(
            passed(self.policy.window_minutes, max_processing)
        )
        summed = left.drop("closed").unionByName(added).groupBy("clock", "zone", "window_start")
        counts = summed.agg(F.sum("trip_count").alias("trip_count")).withColumn("closed", final)
        counts.write.mode("overwrite").parquet(path)

    def _write_closed(self, clock: str, batch_id: int) -> dict[str, int]:
        """Windows that the batch closes on a clock, and figures about them taken from the write itself."""
        observed, start = Observation(f"{clock}-{batch_id}"), F.unix_micros("window_start")
        closed = self._state(batch_id).where((F.col("clock") == clock) & F.col("closed"))
        figures = [F.count(F.lit(1)), F.coalesce(F.sum("trip_count"), F.lit(0)), F.min(start), F.max(start)]
        closed = closed.select("zone", "window_start", "trip_count").observe(
            observed, *[f.alias(f"{clock}_{what}") for what, f in zip(CLOSED, figures)]
        )
        closed.write.mode("overwrite").parquet(self._partition(COUNT_TABLES[clock], batch_id))
        return dict(observed.get)

    @staticmethod
    def _add_columns(known: str | None, seen: list[str]) -> str:
        names = [c for c in (known or "").split(",") if c]
        return ",".join(names + [c for c in seen if c not in names])

    # -- reading ------------------------------------------------------------------------------

    def _progress_row(self, batch_id: int):
        if batch_id == 0:
            return None
        if self._newest and self._newest[0] == batch_id:
            return self._newest[1]
        alone = self._there(PROGRESS_SCHEMA, self._partition("progress", batch_id))
        return (self.progress().where(F.col("batch_id") == batch_id) if alone is None else alone).first()

    def progress(self) -> DataFrame:
        """One row per finished batch. Batches worked on together are finished when the last of them is."""
        schema = _progress_file()
        written = self.spark.read.schema(schema.add("batch_id", T.LongType())).parquet(f"{self.root}/progress")
        whole = written.where(F.coalesce("upto", "batch_id") == F.col("batch_id")).agg(F.max("batch_id")).scalar()
        own = F.array(F.struct("batch_id", *PROGRESS))
        each = F.explode(F.when(F.col("earlier").isNull(), own).otherwise(F.concat("earlier", own))).alias("p")
        return (
            written.where(F.col("batch_id") <= whole)
            .select(each)
            .select(*[f"p.{c}" for c in PROGRESS if c != "upto"], "p.batch_id")
            .withColumn("max_event_time", F.timestamp_micros("max_event_us"))
            .withColumn("max_processing_time", F.timestamp_micros("max_processing_us"))
            .withColumn("watermark", F.col("max_event_time") - minutes(self.policy.watermark_delay_minutes))
        )

    def summary(self) -> DataFrame:
        """Per finished batch: its rows and arrival range, the watermark at its end, late trips, and
        how many windows of each clock it closed over which span. Read from progress alone."""
        closed = []
        for clock in COUNT_TABLES:
            first, last = (F.timestamp_micros(f"{clock}_{end}_start_us") for end in ("first", "last"))
            closed += [
                *[F.coalesce(f"{clock}_{what}", F.lit(0)).alias(f"{clock}_{what}") for what in ("windows", "trips")],
                first.alias(f"{clock}_first_start"),
                (last + minutes(self.policy.window_minutes)).alias(f"{clock}_last_end"),
            ]
        return self.progress().select(
            "batch_id",
            (F.col("total_rows") - F.col("rows") + 1).alias("first_row"),
            F.col("total_rows").alias("last_row"),
            F.timestamp_micros("min_processing_us").alias("first_arrival"),
            F.col("max_processing_time").alias("last_arrival"),
            "max_event_time",
            "watermark",
            "late",
            *closed,
        )

    def batch_zone_totals(self) -> DataFrame:
        """Trips in windows that each batch closed, per zone and clock, with a total row per batch."""
        return batches.batch_zone_totals(both_clocks(self.zone_counts("event"), self.zone_counts("processing")))

    def late_by_batch(self) -> DataFrame:
        """Late trips per batch and zone, ranked most first, from the tallies."""
        late = self.tallies().where("late > 0").groupBy("batch_id", "zone").agg(F.sum("late").alias("late"))
        return batches.ranked_late(late)

    def late_examples(self, n: int = LATE_EXAMPLES) -> DataFrame:
        """First n late trips of each batch, and how many more there were, from progress."""
        first = batches.first_late(self.late_events().withColumn("is_late", F.lit(True)), n)
        more = self.progress().select("batch_id", F.greatest(F.col("late") - n, F.lit(0)).alias("more"))
        return first.join(more, "batch_id")

    def last_batch(self) -> int:
        return self.progress().agg(F.max("batch_id")).first()[0]

    def _table(self, name: str, schema: T.StructType, last: int) -> DataFrame:
        # The declared schema gives NULL for a column that older files lack; no footers are merged.
        schema = T.StructType(list(schema)).add("batch_id", T.LongType())
        return self._read_if_there(name, schema).where(F.col("batch_id") <= last)

    def _read_if_there(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        runs = self._there(schema, f"{path}/{RUNS}")
        if runs is None:
            folders = self._there(schema, path)
            return self.spark.createDataFrame([], schema) if folders is None else folders
        # Spark reads either the files in a folder or the partitions under it.
        folders = self._there(schema, f"{path}/batch_id=*", basePath=path)
        return runs if folders is None else runs.unionByName(folders)

    def _there(self, schema: T.StructType | str, path: str, **options) -> DataFrame | None:
        """A Parquet folder or the files that fit a pattern, None if there are none."""
        try:
            return self.spark.read.options(**options).schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _with_optional(self, name: str, ddl: str, added: str, upto: int | None) -> DataFrame:
        last = self.last_batch() if upto is None else upto
        optional = [c for c in (self._progress_row(last)[added] or "").split(",") if c]
        kept = [f for f in T.StructType.fromDDL(ddl) if f.name not in OPTIONAL_COLUMNS or f.name in optional]
        return self._table(name, T.StructType(kept), last)

    def trips(self, upto: int | None = None) -> DataFrame:
        """Every trip, with promoted fields as columns."""
        promoted = self.promoted()
        if not promoted:
            return self._with_optional("trips_raw", TRIP_SCHEMA, "trip_columns", upto)
        rows = self._with_optional("trips_raw", f"{TRIP_SCHEMA}, {REST} VARIANT", "trip_columns", upto)
        return rows.withColumns({name: F.try_variant_get(REST, path, kind) for name, (path, kind) in promoted.items()}).drop(REST)

    # -- fields nobody declared ---------------------------------------------------------------------

    def rest(self, upto: int | None = None) -> DataFrame:
        """trip_seq, batch_id and the undeclared fields of trips that have some, as they came."""
        rows = self._with_optional("trips_raw", f"trip_seq BIGINT, {REST} VARIANT", "trip_columns", upto)
        return rows.where(F.col(REST).isNotNull())

    def schemas(self) -> list[tuple[int, T.StructType]]:
        """(batch_id, undeclared fields) of each batch that has some, from progress."""
        found = self.progress().where("with_rest > 0").orderBy("batch_id").select("batch_id", "rest_schema").collect()
        return [(batch_id, T.DataType.fromDDL(ddl)) for batch_id, ddl in found]

    def schema_history(self) -> DataFrame:
        """What each batch changed about the undeclared fields against those before it: batch_id, path, change, types.

        A field that a batch does not send is not removed by that: known fields stay known.
        """
        known, found = T.StructType([]), []
        for batch_id, fields in self.schemas():
            together = merged(known, fields)
            found += [(batch_id, *c) for c in type_changes(known, together)]
            known = together
        return self.spark.createDataFrame(found, f"batch_id BIGINT, {CHANGES}")

    def promoted(self) -> dict[str, tuple[str, str]]:
        """Column name -> (path in the rest, type) of each promoted field."""
        rows = self._read_if_there("promotions", T.StructType.fromDDL("name STRING, path STRING, type STRING"))
        return {r.name: (r.path, r.type) for r in rows.orderBy("name").collect()}

    def promote(self, name: str, kind: str, path: str | None = None) -> None:
        """Make an undeclared field a column of trips(), over all batches and without touching a file.

        path is where it stands in the rest, `$.name` if not said. Refused if a value that some trip carries does not fit the
        type. Promoting the same field again changes nothing.
        """
        path, known = path or f"$.{name}", self.promoted()
        if known.get(name) == (path, kind):
            return
        if name in known or name in T.StructType.fromDDL(TRIP_SCHEMA).names:
            raise ValueError(f"{name} is a column already")
        there = F.variant_get(REST, path, "variant")
        lost = self.rest().where(there.isNotNull() & ~F.is_variant_null(there) & F.try_variant_get(REST, path, kind).isNull()).count()
        if lost:
            raise ValueError(f"{lost} values of {path} do not fit {kind}")
        row = one_row(self.spark, T.StructType.fromDDL("path STRING, type STRING"), {"path": path, "type": kind})
        row.write.mode("overwrite").parquet(f"{self.root}/promotions/name={name}")

    def late_events(self, upto: int | None = None) -> DataFrame:
        return self._with_optional("late_events", f"{TRIP_SCHEMA}, {LATE_COLUMNS}", "late_columns", upto)

    def tallies(self, upto: int | None = None) -> DataFrame:
        """What each batch added per clock, zone and window: trips that count, and late ones."""
        return self._table("tallies", T.StructType.fromDDL(TALLY_SCHEMA), self.last_batch() if upto is None else upto)

    def zone_counts(self, clock: str = "event", upto: int | None = None) -> DataFrame:
        """Counts of windows closed by finished batches."""
        schema = T.StructType(T.StructType.fromDDL(COUNT_SCHEMA).fields[:-1])
        return self._table(COUNT_TABLES[clock], schema, self.last_batch() if upto is None else upto)

    def open_windows(self, upto: int | None = None) -> DataFrame:
        last = self.last_batch() if upto is None else upto
        return self._state(last).where(~F.col("closed")).drop("closed")

    # -- health, kept up to date by each batch --------------------------------------------------

    def late_by_zone(self, upto: int | None = None) -> DataFrame:
        """Events and late events per zone, added up from the tallies: no trip is read."""
        mine = self.tallies(upto).where("clock = 'event'").groupBy("zone")
        return mine.agg(F.sum(F.col("trips") + F.col("late")).alias("events"), F.sum("late").alias("late"))

    def window_tallies(self, upto: int | None = None) -> DataFrame:
        """On-time and late trips per zone and closed window, added up from the tallies."""
        last = self.last_batch() if upto is None else upto
        final = F.timestamp_micros(F.lit(self._progress_row(last).max_event_us).cast("long"))
        closed = F.col("window_start") + minutes(self.policy.final_after) <= final
        mine = self.tallies(last).where("clock = 'event'").where(closed).groupBy("zone", "window_start")
        return mine.agg(F.sum("trips").alias("on_time"), F.sum("late").alias("late"))
