"""The landing index: which files hold which part of the arrival order.

`publish` looks at files that have landed since the last time and appends one entry for each to `_index` in the
landing folder, by default in a file of its own: the first and last (processing_time, trip_seq) of its rows, how many there are, and what a batch
needs to know before it writes anything. The stream admits files by these entries, in arrival order; when files
were modified, and in what order they are listed, does not matter.

A file can be published up to a stop instant. Its later rows become an entry of their own by a later call, so
a stream can stop in the middle of a file and go on there.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import LISTING, setting
from tallyward.sources.trips import ARRIVAL, OPTIONAL_COLUMNS, read_arrivals

INDEX = "_index"
ENTRY = (
    "file STRING, first_us BIGINT, first_seq BIGINT, last_us BIGINT, last_seq BIGINT, rows BIGINT, "
    "max_event_us BIGINT, complete BOOLEAN, " + ", ".join(f"n_{c} BIGINT" for c in OPTIONAL_COLUMNS)
)

Key = tuple[int, int]


def _key() -> Column:
    time, seq = ARRIVAL
    return F.struct(F.unix_micros(time).alias("us"), F.col(seq).alias("seq"))


def _mark(key: Key) -> Column:
    return F.struct(*[F.lit(part).cast("long").alias(name) for name, part in zip(("us", "seq"), key)])


def index_of(spark: SparkSession, landing: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(f"{landing}/{INDEX}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def stream_entries(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Entries as they are published; files_per_batch limits the index files of a trigger."""
    reader = spark.readStream.schema(ENTRY).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(f"{landing}/{INDEX}")


def most_together(spark: SparkSession, landing: str) -> int:
    """The largest number of entries in a file of the index."""
    sizes = index_of(spark, landing).groupBy(F.col("_metadata.file_path")).count()
    return sizes.agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]


def _listing(spark: SparkSession):
    """Many paths are looked up by a few tasks per core."""
    return setting(spark, LISTING, str(4 * spark.sparkContext.defaultParallelism))


def _landed(spark: SparkSession, landing: str) -> DataFrame:
    """Paths of all files in the folder. Only the listing is read."""
    return spark.read.format("binaryFile").load(landing).select(F.col("_metadata.file_path").alias("file"))


def publish(spark: SparkSession, landing: str, stop_us: int | None = None, together: int = 1) -> int:
    """Append entries for rows that have none yet and arrived before stop_us, and return how many. An index file holds
    `together` of them, in arrival order; the last one may hold less.

    Calling it again publishes nothing twice, also after a call that failed half way. Rows without a time are
    refused before anything is written.
    """
    known = index_of(spark, landing).groupBy("file").agg(
        F.max(F.struct(F.col("last_us").alias("us"), F.col("last_seq").alias("seq"))).alias("last"), F.bool_or("complete").alias("complete")
    )
    done, begun = known.where("complete").select("file"), known.where("NOT complete").select("file", "last")
    new = [r.file for r in _landed(spark, landing).join(done, "file", "left_anti").collect()]
    if not new:
        return 0
    time, key = ARRIVAL[0], _key()
    with _listing(spark):
        rows = read_arrivals(spark, new).withColumn("file", F.col("_metadata.file_path"))
    # A file never goes to one task for this: files that are published in part are few.
    rows = rows.join(F.broadcast(begun), "file", "left").where(F.col("last").isNull() | (key > F.col("last")) | F.col(time).isNull())
    before = F.lit(True) if stop_us is None else F.unix_micros(time) < F.lit(stop_us)
    inside = lambda c: F.when(before, c)
    found = rows.groupBy("file").agg(
        F.min(inside(key)).alias("first"),
        F.max(inside(key)).alias("last"),
        F.count_if(before).alias("rows"),
        F.max(inside(F.unix_micros("event_time"))).alias("max_event_us"),
        (F.count_if(before) == F.count(F.lit(1))).alias("complete"),
        *[F.count(inside(F.col(c))).alias(f"n_{c}") for c in OPTIONAL_COLUMNS],
        F.count_if(F.col("event_time").isNull() | F.col(time).isNull()).alias("untimed"),
    )
    found = found.persist()
    try:
        broken = found.where("untimed > 0").select("file", "untimed").first()
        if broken:
            raise ValueError(f"{broken.untimed} trips without event_time or processing_time in {broken.file}")
        entries = found.where("rows > 0").select(
            "file",
            F.col("first.us").alias("first_us"),
            F.col("first.seq").alias("first_seq"),
            F.col("last.us").alias("last_us"),
            F.col("last.seq").alias("last_seq"),
            "rows",
            "max_event_us",
            "complete",
            *[f"n_{c}" for c in OPTIONAL_COLUMNS],
        )
        published = entries.count()
        if published:
            # As many entries per file as asked for and, as the first range is never empty, no file without one. All cores
            # write, as small as the entries are.
            cores = spark.sparkContext.defaultParallelism
            if together == 1:
                ordered = entries.repartitionByRange(cores, "first_us", "first_seq").sortWithinPartitions("first_us", "first_seq")
            else:
                # One task numbers them, one row for each landed file. A range holds whole files of the index.
                number = F.row_number().over(W.orderBy("first_us", "first_seq", "file")) - 1
                numbered = entries.withColumn("number", number).withColumn("part", F.floor(F.col("number") / together))
                ordered = numbered.repartitionByRange(cores, "part").sortWithinPartitions("number").drop("number", "part")
            ordered.write.mode("append").option("maxRecordsPerFile", together).json(f"{landing}/{INDEX}")
        return published
    finally:
        found.unpersist()


@dataclass
class Admitted:
    """Entries of one batch: files, the keys their rows lie in, and figures over all of them."""

    files: list[str]
    after: Key | None
    last: Key | None
    entries: int
    rows: int
    first_us: int | None
    max_event_us: int | None
    optional: dict[str, int]

    def read(self, spark: SparkSession) -> DataFrame:
        # A file may hold rows of an earlier batch, or rows that are not published yet.
        rows = read_arrivals(spark, self.files, rest=True).where(_key() <= _mark(self.last))
        return rows if self.after is None else rows.where(_key() > _mark(self.after))


def read_parts(spark: SparkSession, parts: dict[int, Admitted]) -> DataFrame:
    """Rows of several batches in one read, with the batch_id of each. The list of their files goes to every task."""
    spans = [(file, batch_id, a.after, a.last) for batch_id, a in parts.items() for file in a.files]
    schema = "file STRING, batch_id BIGINT, after STRUCT<us: BIGINT, seq: BIGINT>, last STRUCT<us: BIGINT, seq: BIGINT>"
    files = sorted({file for a in parts.values() for file in a.files})
    with _listing(spark):
        rows = read_arrivals(spark, files, rest=True).withColumn("file", F.col("_metadata.file_path"))
    inside = (_key() <= F.col("last")) & (F.col("after").isNull() | (_key() > F.col("after")))
    return rows.join(F.broadcast(spark.createDataFrame(spans, schema)), "file").where(inside).drop("file", "after", "last")


class Admission:
    """Entries after a key, taken a number at a time in arrival order.

    Entries whose rows overlap are taken together. The list of pending files is held by the driver, as Spark's own file source
    holds it.
    """

    def __init__(self, spark: SparkSession, landing: str, after: Key | None, taken: int):
        """taken is the number of entries that batches up to the key `after` were made of."""
        index = index_of(spark, landing)
        first = F.struct(F.col("first_us").alias("us"), F.col("first_seq").alias("seq"))
        if after is not None:
            mark = _mark(after)
            earlier = index.where(first <= mark).count()
            if earlier > taken:
                raise ValueError(
                    f"{earlier - taken} files arrive out of order: they begin at or before {after}, up to which the stream has counted"
                )
            index = index.where(first > mark)
        self.after = after
        self._pending = index.orderBy("first_us", "first_seq", "file").collect()
        self._at = 0

    def take(self, entries: int) -> Admitted:
        start, self._at = self._at, min(self._at + entries, len(self._pending))
        chosen = self._pending[start : self._at]
        last = max(((e.last_us, e.last_seq) for e in chosen), default=None)
        while self._at < len(self._pending):
            following = self._pending[self._at]
            if last is None or (following.first_us, following.first_seq) > last:
                break
            chosen.append(following)
            last = max(last, (following.last_us, following.last_seq))
            self._at += 1
        after, self.after = self.after, last or self.after
        return Admitted(
            sorted({e.file for e in chosen}),
            after,
            last,
            len(chosen),
            sum(e.rows for e in chosen),
            min((e.first_us for e in chosen), default=None),
            max((e.max_event_us for e in chosen), default=None),
            {c: sum(e[f"n_{c}"] for e in chosen) for c in OPTIONAL_COLUMNS},
        )
