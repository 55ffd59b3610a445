"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a character model over words, with orders up to six. A word's
probability is interpolated Kneser-Ney: absolute discounting at each order, occurrences at the highest
order, continuation counts (distinct longer n-grams that end in it) below. The lowest orders are shared: both
classes back off to one pooled model, whose counts are those of the classes added up (a longer n-gram that both
have counts twice), so an expression that neither class has seen tells nothing, and a rare one only what the longer
contexts it shares with known expressions tell. A document's evidence is the
difference of its two log-likelihoods per word, the same for its most telling word, and the share of telling
words. A logistic curve, fitted on labelled rows of each class that the models have not seen (where the labels
allow that), turns it into a score.

Counts cover every labelled training row and grow with the input: words are counted per class with a
map-side combine, n-grams are counted from that word table, as they are, in Spark tables. They are joined to the
n-grams of the distinct words of all documents, and a word's evidence is added up once. The evidence of the
SENT_WORDS most frequent words goes to the documents; other words are joined per document and word. A long word that is frequent
all the same has many rows of one key there, but one row on the other side, so Spark splits it like any skewed key.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.learning import CALIBRATION_FOLD, FOLDS, Logistic, batch_words, bounded, fold, most_frequent, sample, small_batches, training_labels, with_rows
from tallyward.session import discard, release, stage

ORDERS = (2, 3, 4, 5, 6)
#: Orders up to this one are pooled over the classes.
SHARED_ORDER = 3
#: Words that are sent to the documents with their evidence, at most, and how long they may be.
SENT_WORDS, SENT_CHARACTERS = 2**19, 48
DISCOUNT = 0.75
#: Rows of each class that the logistic curve is fitted on, at most.
CALIBRATION_ROWS = 20_000
#: Evidence (natural logarithm of the odds) from which on a word is telling.
TELLING = 3.0
UNIFORM = 1e-4
#: Parts of the words whose n-grams are shuffled one after another, so that the disk holds the shuffle of one part.
PARTS = 4
#: N-grams that a task combines before they are shuffled.
GRAMS_AT_A_TIME = 100_000

START = "\1"


def _windows(word: str) -> Iterator[str]:
    """The n-gram of the highest order at every character and the end sign of a word."""
    top = ORDERS[-1]
    text = START * (top - 1) + word + "\n"  # words hold no white space
    return (text[at : at + top] for at in range(len(word) + 1))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        words, places, rows = batch_words(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[rows]
        for y in (0, 1):
            n = np.bincount(places[toxic == y], minlength=len(words))
            seen = pa.array(n > 0)
            of_class = pa.array(np.full(int((n > 0).sum()), y, np.int32))
            yield pa.RecordBatch.from_arrays([words.filter(seen), of_class, pa.array(n).filter(seen)], names=["word", "toxic", "n"])


def _window_counts(keys: tuple[str, ...]):
    """A function for mapInArrow: windows of the column word per value of the first key, with the sum of the
    second (without one: their number), combined over GRAMS_AT_A_TIME."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            weights = batch.column(keys[1]).to_pylist() if len(keys) > 1 else [1] * batch.num_rows
            for word, key, n in zip(batch.column("word").to_pylist(), batch.column(keys[0]).to_pylist(), weights):
                for window in _windows(word):
                    counts[window, key] = counts.get((window, key), 0) + n
                    if len(counts) >= GRAMS_AT_A_TIME:
                        yield _as_batch(counts)
                        counts = {}
        if counts:
            yield _as_batch(counts)

    def _as_batch(counts: dict) -> pa.RecordBatch:
        columns = [pa.array([g for g, _ in counts]), pa.array([k for _, k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "key", "n"])

    return count


WINDOWS = "gram STRING, key BIGINT, n BIGINT"


def _context(order: int) -> Column:
    return F.substring("gram", 1, order - 1)


@dataclass
class KneserNey:
    """Per order, counts of n-grams by class: gram, n0, n1. Pooled orders have all in n0."""

    counts: dict[int, DataFrame]
    #: Tables that the counts are read from.
    staged: list[DataFrame] = field(default_factory=list)

    def _contexts(self, order: int) -> DataFrame:
        """Per context and class its n-grams' counts and how many different ones there are."""
        kinds = [F.sum((F.col(f"n{y}") > 0).cast("long")).alias(f"kinds{y}") for y in (0, 1)]
        return self.counts[order].groupBy(_context(order).alias("context")).agg(*(F.sum(f"n{y}").alias(f"total{y}") for y in (0, 1)), *kinds)

    def gram_evidence(self, grams: DataFrame) -> DataFrame:
        """Per distinct n-gram of the highest order (column gram): toxic minus ordinary log-likelihood of its last sign."""
        below = None
        for order in ORDERS:
            wanted = grams.select(F.expr(f"right(gram, {order})").alias("gram")).distinct().withColumn("context", _context(order))
            rows = wanted.join(self.counts[order], "gram", "left").join(self._contexts(order), "context", "left")
            lower = [F.lit(UNIFORM)] * 2
            if below is not None:
                rows = rows.withColumn("shorter", F.expr(f"right(gram, {order - 1})")).join(below.withColumnRenamed("gram", "shorter"), "shorter")
                lower = [F.col("lower0"), F.col("lower1")]
            steps = []
            for y in (0, 1):
                own = y if order > SHARED_ORDER else 0
                total, n, kinds = (F.coalesce(F.col(f"{c}{own}"), F.lit(0)) for c in ("total", "n", "kinds"))
                seen = F.greatest(n - DISCOUNT, F.lit(0.0)) / F.greatest(total, F.lit(1))
                steps.append(F.when(total > 0, seen + DISCOUNT * kinds / F.greatest(total, F.lit(1)) * lower[y]).otherwise(lower[y]).alias(f"lower{y}"))
            shorter, below = below, stage(rows.select("gram", *steps), f"toxicity-order-{order}")
            release(grams.sparkSession)
            if shorter is not None:
                discard(shorter)
        return below.select("gram", (F.log("lower1") - F.log("lower0")).alias("evidence"))

    def evidence_of(self, words: DataFrame) -> DataFrame:
        """word, n and evidence of a table of distinct words with n. The counts are used up by it."""
        words = stage(words.select("word", "n").withColumn("word_id", F.monotonically_increasing_id()), "toxicity-vocabulary")
        windows = stage(words.select("word", "word_id").mapInArrow(_window_counts(("word_id",)), WINDOWS), "toxicity-windows")
        release(words.sparkSession)
        grams = stage(windows.select("gram").distinct(), "toxicity-grams")
        release(words.sparkSession)
        of_gram = self.gram_evidence(grams)
        discard(grams, *self.staged)
        parts = []
        for part in range(PARTS):
            found = windows.where(F.col("key") % PARTS == part).join(of_gram, "gram")
            summed = found.groupBy(F.col("key").alias("word_id")).agg(F.sum(F.col("n") * F.col("evidence")).alias("evidence"))
            parts.append(stage(summed, "toxicity-sums"))
        discard(windows, of_gram)
        summed = reduce(DataFrame.unionByName, parts)
        evidence = stage(words.join(summed, "word_id").select("word", "n", "evidence"), "toxicity-evidence")
        discard(words, *parts)
        return evidence


def fit_models(words: DataFrame) -> KneserNey:
    """words: word, toxic (0, 1) and n, one row per word and class."""
    found = words.mapInArrow(_window_counts(("toxic", "n")), WINDOWS)
    found = stage(found.groupBy("gram", F.col("key").alias("y")).agg(F.sum("n").alias("n")), f"toxicity-grams-{ORDERS[-1]}")
    counts, staged = {}, [found]
    for order in reversed(ORDERS):
        if order < ORDERS[-1]:  # different longer n-grams
            found = stage(found.groupBy(F.expr(f"right(gram, {order})").alias("gram"), "y").agg(F.count(F.lit(1)).alias("n")), f"toxicity-grams-{order}")
            staged.append(found)
            release(words.sparkSession)
        of_class = [F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (0, 1)]
        if order <= SHARED_ORDER:
            of_class = [F.sum("n"), F.sum(F.lit(0).cast("long"))]
        counts[order] = found.groupBy("gram").agg(*(c.alias(f"n{y}") for y, c in enumerate(of_class)))
    release(words.sparkSession)
    return KneserNey(counts, staged)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        words, places, _ = batch_words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(places, minlength=len(words)))], names=["word", "n"])


def _features(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """docs (text and another column, which stays): evidence per word (a), that of the most telling word (b),
    share of telling words (c). 0 without words."""
    name = next(c for c in docs.columns if c != "text")
    sent = stage(most_frequent(evidence.where(F.length("word") <= SENT_CHARACTERS), SENT_WORDS), "toxicity-sent")
    model = docs.sparkSession.sparkContext.broadcast(sent.select("word", "evidence").toArrow())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value.column("word").combine_chunks()
        values = np.append(model.value.column("evidence").to_numpy(), 0.0)
        for batch in bounded(batches):
            size = batch.num_rows
            words, places, rows = batch_words(batch.column("text"))
            at = pc.fill_null(pc.index_in(words.cast(known.type), value_set=known), len(known)).to_numpy()
            of = values[at][places]
            most = np.zeros(size)
            np.maximum.at(most, rows, of)
            rare = np.flatnonzero((at == len(known))[places])
            pairs, times = np.unique(rows[rare] * max(1, len(words)) + places[rare], return_counts=True)
            offsets = np.searchsorted(pairs // max(1, len(words)), np.arange(size + 1)).astype(np.int32)
            others = pa.StructArray.from_arrays([words.take(pa.array(pairs % max(1, len(words)))).cast(pa.string()), pa.array(times.astype(np.int64))], names=["word", "times"])
            # Without any word, bincount counts in whole numbers.
            sums = [np.bincount(rows, of, size).astype(float), most, np.bincount(rows, of > TELLING, size).astype(float)]
            columns = [batch.column(name), pa.array(np.bincount(rows, minlength=size)), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(offsets), others)]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "words", "total", "most", "telling", "rare"])

    schema = f"{name} {docs.schema[name].dataType.simpleString()}, words BIGINT, total DOUBLE, most DOUBLE, telling DOUBLE, rare ARRAY<STRUCT<word: STRING, times: BIGINT>>"
    rows = added = stage(docs.mapInArrow(add_up, schema).withColumn("row_id", F.monotonically_increasing_id()), "toxicity-rows")
    pairs = rows.select("row_id", F.explode("rare").alias("of")).select("row_id", "of.word", "of.times").join(evidence.select("word", "evidence"), "word")
    rest = pairs.groupBy("row_id").agg(
        F.sum(F.col("times") * F.col("evidence")).alias("more"),
        F.max("evidence").alias("top"),
        F.sum(F.when(F.col("evidence") > TELLING, F.col("times")).otherwise(0)).alias("also"),
    )
    n = F.greatest("words", F.lit(1))
    a, c = ((F.col(x) + F.coalesce(F.col(y), F.lit(0))) / n for x, y in (("total", "more"), ("telling", "also")))
    rows = rows.drop("rare").join(rest, "row_id", "left")
    features = stage(rows.select(name, a.alias("a"), F.greatest("most", F.coalesce("top", F.lit(0.0))).alias("b"), c.alias("c")), "toxicity-features")
    discard(added, sent)
    return features


def _held_apart(known: DataFrame) -> tuple[Column, Column, list[int]] | None:
    """Which rows of known the models learn from, which the curve is fitted on, and how many of those have
    label 0 and 1. None without both classes.

    A fold is held apart for the curve if both classes occur in it and outside of it, else all rows serve both.
    """
    found = np.zeros((FOLDS, 2), np.int64)
    for row in known.groupBy("fold", "label").count().collect():
        found[row["fold"], row["label"]] += row["count"]
    if not found.sum(axis=0).all():
        return None
    for held in (CALIBRATION_FOLD, *(f for f in range(1, FOLDS) if f != CALIBRATION_FOLD)):
        if found[held].all() and (found.sum(axis=0) - found[held]).all():
            return F.col("fold") != held, F.col("fold") == held, found[held].tolist()
    return F.lit(True), F.lit(True), found.sum(axis=0).tolist()


def _fit_curve(x: np.ndarray, y: np.ndarray, of_class: list[int]) -> Logistic:
    """Fitted on a sample per class; of_class rows of label 0 and 1 stand behind it."""
    curve = Logistic(x, y)
    shares = [n / min(n, CALIBRATION_ROWS) for n in of_class]
    curve.intercept += np.log(shares[1] / shares[0])
    return curve


def _scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash and score of every row of docs. Fitted on labelled rows of docs."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    known = training_labels(labels, "toxic")
    known = stage(with_rows(docs.select("doc_id"), known).distinct(), "labels-in-use")
    parts, keyed = _held_apart(known), docs.select(F.struct("doc_id", _text_hash().alias("text_hash")).alias("key"), "text")
    if parts is None:
        return keyed.select("key.*", F.lit(0.0).alias("score"))
    learned, held, of_class = parts
    counted = with_rows(texts, known.where(learned).select("doc_id", F.col("label").alias("toxic")))
    words = counted.select("text", "toxic").mapInArrow(_count_words, "word STRING, toxic INT, n BIGINT")
    models = fit_models(words.groupBy("word", "toxic").agg(F.sum("n").alias("n")))
    vocabulary = docs.select("text").mapInArrow(_vocabulary, "word STRING, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    evidence = models.evidence_of(vocabulary)
    features = _features(keyed, evidence).select("key.*", "a", "b", "c")
    discard(evidence)
    chosen = [sample(known.where(held & (F.col("label") == y)).select("doc_id", "label"), CALIBRATION_ROWS) for y in (0, 1)]
    measured = with_rows(features, chosen[0].union(chosen[1])).select("a", "b", "c", "label").toArrow()
    curve = _fit_curve(np.column_stack([measured.column(c).to_numpy() for c in "abc"]), measured.column("label").to_numpy(), of_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in "abc"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(curve.score(x))], names=["doc_id", "text_hash", "score"])

    return features.mapInArrow(score, "doc_id BIGINT, text_hash STRING, score DOUBLE")


def _text_hash() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. Only labels whose
    doc_id is outside the held-out fold are learned from; labels that are not 0 or 1, or without doc_id,
    are ignored. NULL texts count as empty; an empty text has no evidence and scores what the curve gives
    for that. Repeated rows are scored alike. A row without doc_id is scored and has held_out NULL. Without
    training labels of both classes every score is 0. An empty table gives an empty result.
    """
    rows = _scores(docs, labels)
    return rows.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5."""
    toxic = stage(_scores(docs, labels).where("score >= 0.5").select("text_hash").distinct(), "toxic-texts")
    hashed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), _text_hash().alias("text_hash"))
    return hashed.join(toxic, "text_hash", "left_anti").select("row.*")
