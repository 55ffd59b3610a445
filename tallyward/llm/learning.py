"""What the operators share: batches of bounded size, folds, bounded samples of labelled rows, a logistic fit."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.session import stage

FOLDS = 5
#: Labels outside the held-out fold 0 that are not learned from, but calibrated on.
CALIBRATION_FOLD = 4
#: Labelled rows up to which they are sent to the documents instead of the documents to them (about 20 bytes each).
BROADCAST_LABELS = 1_000_000
SLICE_BYTES = 2 << 20
BATCH_BYTES = 8 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `most` bytes of the column (or one row), so that what a task makes of
    a batch stays small whatever the rows' lengths."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def small_batches(spark: SparkSession) -> None:
    """From now on Spark sends rows to Python workers in batches of at most BATCH_BYTES (or one row), not of 10,000 rows
    whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (one per word, with n) from a count on that at most `most` rows reach, without sorting them.
    Counts are compared on a logarithmic scale."""
    level = F.floor(8 * F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"))
    least, total = 1 << 20, 0
    for at, words in sorted(sizes.collect(), reverse=True):  # at most 8 * 63 levels
        total += words
        if total > most:
            break
        least = at
    return counts.where(level >= least)


def fold() -> Column:
    """Held out where 0. Depends on doc_id alone and is never an input of a score."""
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, label and fold of labels 0 and 1 outside the held-out fold; of several labels the largest counts."""
    valid = labels.where(F.col(name).isin(0, 1)).where(fold() != 0)
    one_each = valid.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    return stage(one_each.withColumn("fold", fold()), f"labels-{name}")


def sample(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, the same in every run: those with the smallest hash of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def with_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids, with the columns of ids."""
    ids = stage(ids, "chosen-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids, "doc_id")


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of a batch, and for each word of each text its place among them and its text."""
    lists = pc.split_pattern(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), " ")
    rows = pc.list_parent_indices(lists).to_numpy()
    parts = pc.ascii_split_whitespace(pc.list_flatten(lists))
    rows = rows[pc.list_parent_indices(parts).to_numpy()]
    words = pc.utf8_trim(pc.list_flatten(parts), PUNCTUATION)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), rows[full]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised columns, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = logistic(z @ w)
            slope = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(slope, z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.intercept = w[:-1], w[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Natural logarithm of the odds of label 1."""
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights + self.intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.odds(x))
