"""A versioned table as an append-only Parquet change log.

    <path>/log/version=N/       payload columns + delta (+n rows added, -n rows removed)
    <path>/commits/version=N/   one row, written after the log: the version exists from here on

The content as of version v is the sum of deltas up to v. One writer at a time. A crash between the
two writes leaves log rows of a version no commit names; readers skip them and the next commit
overwrites them. Old data files are never rewritten.

Every commit that is not a plain append records which rows it may have touched, as a predicate. A
read adds up deltas only under those predicates; all other rows are a plain scan without shuffle.
"""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.clock import fmt
from tallyward.operators.schema import data_files
from tallyward.policy import COPIES_PER_STEP
from tallyward.session import one_row

COMMIT_SCHEMA = (
    "parent_version BIGINT, committed_at TIMESTAMP, operation STRING, mode STRING, predicate STRING, "
    "touched STRING, app_id STRING, batch_id BIGINT, rows_added BIGINT, rows_removed BIGINT, "
    "files_added BIGINT, metadata MAP<STRING, STRING>"
)
EVERYTHING = "true"

# Predicates are evaluated again by later reads, so they must always mean the same rows.
_UNSTABLE = re.compile(r"\b(current_\w+|now|curdate|localtimestamp|rand|randn|random|uuid)\b", re.IGNORECASE)


def repeat_rows(df: DataFrame, times: str, step: int = COPIES_PER_STEP) -> DataFrame:
    """Each row as often as its `times` column says; a count below one is an error, as only a damaged log has it.

    Rows are first cut into steps that are spread over all tasks, so no task writes more than `step` copies
    of a row at a time.
    """
    columns = [c for c in df.columns if c != times]
    n = F.col(times)
    sound = df.withColumn(times, F.when(n >= 1, n).otherwise(F.raise_error(F.concat(F.lit("damaged log: a row with net count "), n.cast("string")))))
    steps = sound.withColumn("_step", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {step})")))
    dealt = steps.repartition(F.xxhash64(*columns), "_step")
    left = F.least(F.lit(step).cast("long"), n - F.col("_step") * step)
    copies = dealt.withColumn(times, left).withColumn("_copy", F.explode(F.expr(f"sequence(1L, {times})")))
    return copies.select(*columns)


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names

    # -- commits ------------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        schema = T.StructType.fromDDL(COMMIT_SCHEMA).add("version", T.LongType())
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], schema)
        return found.select("version", *[f.name for f in schema if f.name != "version"])

    def version(self) -> int | None:
        """Newest version; None for a table without commits."""
        return self.commits().agg(F.max("version")).first()[0]

    def latest(self):
        """The newest commit as a row, or None."""
        return self.history(1).first()

    def history(self, n: int | None = None) -> DataFrame:
        newest_first = self.commits().drop("touched").orderBy(F.desc("version"))
        return newest_first if n is None else newest_first.limit(n)

    def commits_since(self, version: int) -> DataFrame:
        return self.commits().drop("touched").where(F.col("version") > version).orderBy("version")

    def commits_of_job(self, job: str) -> DataFrame:
        return self.commits().where(F.col("metadata")["job"] == job)

    # -- reading ------------------------------------------------------------------------------

    def log(self, after: int | None, upto: int) -> DataFrame:
        """Raw deltas of the versions in (after, upto]; a partition filter, so nothing else is read."""
        schema = T.StructType(list(self.schema)).add("delta", T.LongType()).add("version", T.LongType())
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/log").where(F.col("version") <= upto)
        return rows if after is None else rows.where(F.col("version") > after)

    def _check_version(self, version: int | None) -> int:
        current = self.version()
        version = current if version is None else version
        if current is None or not 0 <= version <= current:
            raise ValueError(f"{self.path} has no version {version}; newest is {current}")
        return version

    def _touched(self, upto: int, after: int = -1) -> list[str]:
        """Predicates over the rows that commits in (after, upto] may have removed or re-added."""
        rows = (
            self.commits()
            .where((F.col("version") > after) & (F.col("version") <= upto) & F.col("touched").isNotNull())
            .select("touched")
            .distinct()
            .orderBy("touched")
            .collect()  # one short text per distinct correction
        )
        texts = [r.touched for r in rows]
        return [EVERYTHING] if EVERYTHING in texts else texts

    def _net(self, version: int, predicate: str | None = None) -> DataFrame:
        """Distinct rows with the number of copies in the given version, as delta."""
        rows = self.log(None, version)
        if predicate is not None:
            rows = rows.where(predicate)
        return rows.groupBy(*self.columns).agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)

    def as_of(self, version: int | None = None) -> DataFrame:
        """The table's rows at a version (newest when None)."""
        version = self._check_version(version)
        touched = self._touched(version)
        if not touched:
            return self.log(None, version).select(*self.columns)
        if touched == [EVERYTHING]:
            return repeat_rows(self._net(version), "delta")
        anywhere = " OR ".join(f"({text})" for text in touched)
        corrected = repeat_rows(self._net(version, anywhere), "delta")
        untouched = self.log(None, version).where(~F.coalesce(F.expr(anywhere), F.lit(False)))
        return untouched.select(*self.columns).unionByName(corrected)

    def read(self) -> DataFrame:
        return self.as_of()

    # -- writing ------------------------------------------------------------------------------

    def _commit(
        self, parent: int | None, changes: DataFrame, operation: str, mode: str, only: str | None = None, **details
    ) -> int | None:
        """Write the changes, then the commit. New rows and removed rows must satisfy `only`."""
        version = 0 if parent is None else parent + 1
        target = f"{self.path}/log/version={version}"
        changes.select(*self.columns, F.col("delta").cast("long").alias("delta")).write.mode("overwrite").parquet(target)
        written = self.spark.read.schema(T.StructType(list(self.schema)).add("delta", T.LongType())).parquet(target)
        allowed = F.lit(True) if only is None else F.coalesce(F.expr(only), F.lit(False))
        added, removed, outside = written.agg(
            F.coalesce(F.sum(F.greatest("delta", F.lit(0))), F.lit(0)),
            F.coalesce(-F.sum(F.least("delta", F.lit(0))), F.lit(0)),
            F.count_if(~allowed),
        ).first()
        if outside:
            raise ValueError(f"{outside} new rows do not satisfy {only}; nothing was committed")
        if not added and not removed:
            return None  # an empty version is never committed
        row = {
            "parent_version": parent,
            "operation": operation,
            "mode": mode,
            "rows_added": added,
            "rows_removed": removed,
            "files_added": len(written.inputFiles()),
            **details,
        }
        commit = one_row(self.spark, T.StructType.fromDDL(COMMIT_SCHEMA), row)
        commit = commit.withColumn("committed_at", F.current_timestamp())
        commit.write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")
        return version

    def append(
        self, rows: DataFrame, app_id: str | None = None, batch_id: int | None = None, metadata: dict | None = None
    ) -> int | None:
        """Add rows. Returns the new version, or None when there was nothing to do: no rows, or
        this application's batch is already in."""
        mine = F.when(F.col("app_id") == F.lit(app_id), F.col("batch_id"))
        parent, done = self.commits().agg(F.max("version"), F.max(mine)).first()
        if app_id is not None and done is not None and done >= batch_id:
            return None
        changes = rows.select(*self.columns, F.lit(1).alias("delta"))
        return self._commit(parent, changes, "WRITE", "Append", app_id=app_id, batch_id=batch_id, metadata=metadata)

    def replace_where(self, predicate: str, rows: DataFrame, metadata: dict | None = None) -> int | None:
        """Replace exactly the rows matching predicate; new rows outside of it are refused."""
        if _UNSTABLE.search(predicate):
            raise ValueError(f"a predicate must not depend on when it runs: {predicate}")
        changes = rows.select(*self.columns, F.lit(1).cast("long").alias("delta"))
        parent = self.version()
        if parent is not None:
            old = self._net(parent, predicate).withColumn("delta", -F.col("delta"))
            changes = changes.unionByName(old)
        return self._commit(
            parent, changes, "WRITE", "Overwrite", predicate, predicate=predicate, touched=predicate, metadata=metadata
        )

    def restore(self, version: int) -> int | None:
        """Bring an old version back as a new commit. Only versions after it are read."""
        version, current = self._check_version(version), self.version()
        undone = self.commits().where(F.col("version") > version)
        appends = undone.where(F.col("touched").isNull()).head(1)
        touched = [EVERYTHING] if appends else self._touched(current, after=version)
        changes = (
            self.log(version, current)
            .groupBy(*self.columns)
            .agg((-F.sum("delta")).alias("delta"))
            .where(F.col("delta") != 0)
        )
        return self._commit(
            current,
            changes,
            "RESTORE",
            "",
            touched=" OR ".join(f"({text})" for text in touched) if len(touched) > 1 else "".join(touched),
            metadata={"restored_version": str(version)},
        )

    # -- comparing ----------------------------------------------------------------------------

    def difference(self, before: int, after: int, predicate: str | None = None) -> DataFrame:
        """Rows gained (+) and lost (-) from one version to a later one, from the log between them."""
        if before > after:
            raise ValueError(f"version {before} is newer than {after}")
        rows = self.log(self._check_version(before), self._check_version(after))
        if predicate is not None:
            rows = rows.where(predicate)
        return rows.groupBy(*self.columns).agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)

    def same(self, before: int, after: int, predicate: str | None = None) -> bool:
        """Whether two versions hold the same rows, copies included, under a predicate."""
        return not self.difference(before, after, predicate).head(1)

    def files(self, version: int | None = None) -> DataFrame:
        """Data files of the log up to a version, with their rows."""
        version = self._check_version(version)
        return data_files(self.spark.read.parquet(f"{self.path}/log").where(F.col("version") <= version))

    def register(self, name: str, version: int | None = None) -> None:
        """Make a version queryable with spark.sql under a name."""
        self.as_of(version).createOrReplaceTempView(name)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equality of two tables whatever their row order, NULL-safe and counting copies."""
    columns = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
    return not both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0).head(1)


def commit_summary(commits: DataFrame) -> DataFrame:
    """Commits and rows per kind of operation."""
    return commits.groupBy("operation", "mode").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("files_added").alias("files_added"),
        F.sum("rows_added").alias("rows_added"),
        F.sum("rows_removed").alias("rows_removed"),
    )


def commit_report(commits: DataFrame) -> DataFrame:
    """History for reading: when, what, how much, and for marked jobs and restores why."""
    meta = F.col("metadata")
    details = F.when(F.col("operation") == "RESTORE", F.concat(F.lit("restored to "), meta["restored_version"])).when(
        meta["job"].isNotNull(), F.concat_ws(": ", meta["job"], meta["description"])
    )
    return commits.select(
        "version",
        fmt(F.col("committed_at")).alias("committed"),
        "operation",
        "mode",
        "files_added",
        "rows_added",
        "rows_removed",
        F.coalesce(details, F.lit("")).alias("details"),
    )
