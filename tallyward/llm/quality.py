"""Document quality by co-training two views (Blum and Mitchell, 1998).

The text view looks at what is written: naive Bayes over hashed words and word endings, kinds of characters, word
lengths, repetition. The metadata view looks at what is known about the page: language, source, length, lines. Each
view has its own classifier. In every round each of them labels the unlabelled rows that it is most sure of, and
these pseudo-labels train the *other* view. After the rounds both views are combined and score all documents.

Naive Bayes is fitted from counts that Spark adds up over all labelled and pseudo-labelled rows, so the unlabelled
pool is every document without a label, however many there are. Texts are read once: rows carry their hashed
features (SLOTS different ones at most), a later pass reads those. Languages and sources are counted as they are and
joined, so their number is free and none shares a slot with another. The one bounded sample is CALIBRATION_ROWS labelled
rows that the counts have not seen; the curves that make evidence of both views comparable are fitted on it.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.learning import (
    BROADCAST_LABELS,
    CALIBRATION_FOLD,
    Logistic,
    batch_words,
    bounded,
    fold,
    small_batches,
    training_labels,
)
from tallyward.session import discard, stage

CALIBRATION_ROWS = 10_000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round: about this share of the pool, and only if this sure.
ROUND_SHARE = 0.05
SURE = 0.95
#: Different text features.
SLOTS = 1 << 18
ENDING = 3
SMOOTHING = 0.5
#: Steps that lengths are counted in, per doubling, and how many there are.
STEPS, BINS = 2, 64
#: Odds are compared in steps of a twentieth, between these bounds.
ODDS_STEPS, MOST_ODDS = 20, 30

COLUMNS = ("text", "lang", "source")
LENGTHS = ("size", "lines", "width")
#: Counted per character of the text.
CHARACTER_KINDS = (r"\p{L}", r"\p{Lu}", r"\p{Nd}", r"[#$%&*@^~=+<>{}\\_]", r"[|/]", r"!", r"[.,;:?]")

Words = tuple[pa.Array, np.ndarray, np.ndarray]
FEATURES = "doc_id BIGINT, lang STRING, source STRING, size INT, lines INT, width INT, kinds ARRAY<DOUBLE>, slots ARRAY<INT>"


def text_kinds(texts: pa.Array, found: Words) -> np.ndarray:
    """Shares of kinds of characters, word length, repetition. An empty text is all zeros."""
    size = np.maximum(pc.utf8_length(texts).to_numpy(), 1)
    columns = [pc.count_substring_regex(texts, kind).to_numpy() / size for kind in CHARACTER_KINDS]
    words, places, rows = found
    n = len(texts)
    total = np.bincount(rows, minlength=n)
    lengths = pc.utf8_length(words).to_numpy()
    pairs, times = np.unique(rows * max(1, len(words)) + places, return_counts=True)
    of = pairs // max(1, len(words))
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    share = 1 / np.maximum(total, 1)
    columns += [
        np.bincount(rows, lengths[places], n) * share,
        np.bincount(of, minlength=n) * share,
        most * share,
        np.log1p(total),
    ]
    return np.column_stack(columns)


def text_slots(n: int, found: Words, slots: int) -> pa.ListArray:
    """Per text the distinct slots of its words and of their last ENDING characters."""
    words, places, rows = found
    spelled, several = words.to_pylist(), max(1, len(words))
    own = np.fromiter((xxhash.xxh32_intdigest(w) % slots for w in spelled), np.int64, len(spelled))
    ends = np.fromiter((xxhash.xxh32_intdigest("$" + w[-ENDING:]) % slots for w in spelled), np.int64, len(spelled))
    pairs = np.unique(rows * several + places)
    of, place = pairs // several, pairs % several
    both = np.unique(np.concatenate([of * slots + own[place], of * slots + ends[place]]))
    cuts = np.searchsorted(both // slots, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array((both % slots).astype(np.int32)))


def _bins(values: np.ndarray) -> pa.Array:
    return pa.array(np.minimum(np.floor(STEPS * np.log2(1 + values)), BINS - 1).astype(np.int32))


def _extract(slots: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        found, n = batch_words(texts), batch.num_rows
        size = pc.utf8_length(texts).to_numpy()
        lines = pc.count_substring(texts, "\n").to_numpy() + 1
        kinds = text_kinds(texts, found)
        cuts = pa.array(np.arange(n + 1, dtype=np.int32) * kinds.shape[1])
        columns = [
            *(batch.column(c) for c in ("doc_id", "lang", "source")),
            *map(_bins, (size, lines, size / lines)),
            pa.ListArray.from_arrays(cuts, pa.array(kinds.ravel())),
            text_slots(n, found, slots),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "source", *LENGTHS, "kinds", "slots"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column, and the row of each."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def text_evidence(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """Per row the mean weight of its slots, and its kinds."""
    values, rows = _lists(batch.column("slots"))
    n = batch.num_rows
    mean = np.bincount(rows, weights[values], n) / np.maximum(np.bincount(rows, minlength=n), 1)
    return np.column_stack([mean, _lists(batch.column("kinds"))[0].reshape(n, -1)])


def _count_slots(slots: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, slots), np.int64)
    for batch in batches:
        values, rows = _lists(batch.column("slots"))
        label = batch.column("text_label").to_numpy()[rows]
        for y in (0, 1):
            counts[y] += np.bincount(values[label == y], minlength=slots)
    y, slot = np.nonzero(counts)
    columns = [pa.array(c) for c in (slot, y, counts[y, slot])]
    yield pa.RecordBatch.from_arrays(columns, names=["slot", "label", "n"])


def weights_of(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Naive Bayes: logarithm of how much likelier a feature is in rows of label 1. counts is per label and feature, rows the
    number of rows of each label."""
    shares = (counts + SMOOTHING) / (rows[:, None] + 2 * SMOOTHING)
    return np.where(counts.sum(axis=0) > 0, np.log(shares[1]) - np.log(shares[0]), 0.0)


def _weight() -> Column:
    """The same as a column, of n0 and n1 rows with a value among rows0 and rows1."""
    share = lambda y: (F.col(f"n{y}") + SMOOTHING) / (F.col(f"rows{y}") + 2 * SMOOTHING)
    return F.log(share(1)) - F.log(share(0))


@dataclass
class Model:
    """Both views and their combination after a round."""

    weights: np.ndarray
    text: Logistic
    #: A table of weights per language and source; weights per step of each length.
    langs: DataFrame
    sources: DataFrame
    lengths: dict[str, list[float]]
    metadata: Logistic | None = None
    combined: Logistic | None = None

    def with_metadata(self, rows: DataFrame) -> DataFrame:
        """rows with metadata_evidence. A value that no labelled row has tells nothing."""
        steps = [F.element_at(F.array(*map(F.lit, self.lengths[c])), F.col(c) + 1) for c in LENGTHS]
        for name, table in (("lang", self.langs), ("source", self.sources)):
            known = table.select(F.col(name).alias("known"), F.col("weight").alias(f"{name}_weight"))
            rows = rows.join(known, F.col(name).eqNullSafe(F.col("known")), "left").drop("known")
            steps.append(F.coalesce(f"{name}_weight", F.lit(0.0)))
        return rows.withColumn("metadata_evidence", sum(steps[1:], steps[0])).drop("lang_weight", "source_weight")

    def with_odds(self, rows: DataFrame) -> DataFrame:
        """rows with text_odds and metadata_odds in place of metadata_evidence."""
        weights, text, names = self.weights, self.text, rows.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                odds = np.clip(text.odds(text_evidence(batch, weights)), -MOST_ODDS, MOST_ODDS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], names=[*names, "text_odds"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", text_odds DOUBLE"
        curve = self.metadata
        evidence = (F.col("metadata_evidence") - float(curve.mean[0])) / float(curve.scale[0])
        odds = F.greatest(F.least(evidence, F.lit(20.0)), F.lit(-20.0)) * float(curve.weights[0]) + float(curve.intercept)
        scored = self.with_metadata(rows.mapInArrow(score, schema))
        return scored.withColumn("metadata_odds", F.greatest(F.least(odds, F.lit(float(MOST_ODDS))), F.lit(-float(MOST_ODDS)))).drop("metadata_evidence")


def _marked(docs: DataFrame, labels: DataFrame, slots: int) -> DataFrame:
    """Features of all rows with their label (NULL: none to learn from) and role: learn, calibrate, pool or other."""
    known = training_labels(labels, "quality")
    listed = labels.where("doc_id IS NOT NULL").select("doc_id").distinct().join(known, "doc_id", "left").withColumn("listed", F.lit(True))
    listed = stage(listed, "quality-labels")
    few = listed.count() <= BROADCAST_LABELS
    rows = docs.select("doc_id", *COLUMNS).mapInArrow(partial(_extract, slots), FEATURES)
    marked = rows.join(F.broadcast(listed) if few else listed, "doc_id", "left")
    role = (
        F.when(F.col("fold") == CALIBRATION_FOLD, "calibrate")
        .when(F.col("label").isNotNull(), "learn")
        .when(F.col("listed").isNull() & F.col("doc_id").isNotNull(), "pool")
        .otherwise("other")
    )
    given = [F.lit(None).cast("int").alias(f"{view}_given") for view in ("text", "metadata")]
    return stage(marked.withColumn("role", role).select("*", *given).drop("fold", "listed"), "quality-rows")


def _label_for(view: str, learned: list[str]) -> Column:
    return F.when(F.col("role").isin(learned), F.col("label")).otherwise(F.col(f"{view}_given"))


def fit_round(rows: DataFrame, learned: list[str], held: str, sample: pa.RecordBatch, slots: int) -> Model:
    """Both views from labelled rows and pseudo-labels, and their curves from the calibration sample."""
    texts = rows.withColumn("text_label", _label_for("text", learned)).where("text_label IS NOT NULL")
    counted = texts.select("slots", "text_label").mapInArrow(partial(_count_slots, slots), "slot BIGINT, label BIGINT, n BIGINT")
    found = counted.groupBy("slot", "label").agg(F.sum("n").alias("n")).toArrow()  # at most two rows per slot
    counts, of_label = np.zeros((2, slots), np.int64), np.zeros(2, np.int64)
    counts[found.column("label").to_numpy(), found.column("slot").to_numpy()] = found.column("n").to_numpy()
    for row in texts.groupBy("text_label").count().collect():
        of_label[row["text_label"]] = row["count"]
    weights = weights_of(counts, of_label)

    pages = rows.withColumn("y", _label_for("metadata", learned)).where("y IS NOT NULL")
    sides = [F.count_if(F.col("y") == y).alias(f"n{y}") for y in (0, 1)]
    totals = pages.agg(*[F.count_if(F.col("y") == y).alias(f"rows{y}") for y in (0, 1)]).first()
    rows_of = {f"rows{y}": F.lit(totals[f"rows{y}"]) for y in (0, 1)}
    tables = {c: pages.groupBy(c).agg(*sides).withColumns(rows_of).select(c, _weight().alias("weight")) for c in ("lang", "source", *LENGTHS)}
    lengths = {}
    for c in LENGTHS:
        lengths[c] = [0.0] * BINS
        for step, weight in tables[c].collect():  # at most BINS rows
            lengths[c][step] = weight
    y = sample.column("label").to_numpy()
    text = Logistic(text_evidence(sample, weights), y)
    model = Model(weights, text, stage(tables["lang"], "quality-langs"), stage(tables["source"], "quality-sources"), lengths)
    fitted = _sampled(model.with_metadata(_columns(rows, held, learned)))
    evidence = np.array(fitted.column("metadata_evidence").to_numpy())[:, None]
    model.metadata = Logistic(evidence, fitted.column("label").to_numpy())
    both = np.column_stack([model.text.odds(text_evidence(fitted, weights)), model.metadata.odds(evidence)])
    model.combined = Logistic(np.clip(both, -MOST_ODDS, MOST_ODDS), fitted.column("label").to_numpy())
    return model


def _columns(rows: DataFrame, held: str, learned: list[str]) -> DataFrame:
    return rows.where(F.col("role") == held).select("doc_id", "lang", "source", *LENGTHS, "kinds", "slots", "label")


def _sampled(rows: DataFrame) -> pa.RecordBatch:
    """At most CALIBRATION_ROWS rows, the same in every run, as one batch."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("slots", "lang", "source")]
    found = rows.orderBy(*order).limit(CALIBRATION_ROWS).toArrow().combine_chunks().to_batches()
    return found[0] if found else pa.RecordBatch.from_pylist([], schema=rows.limit(0).toArrow().schema)


def surest(odds: dict[int, int], most: int) -> int | None:
    """The step from which on rows are handed over: the highest steps that together have `most` rows, none below SURE.
    odds is the number of rows per step; None if no step is sure enough."""
    least = int(np.ceil(ODDS_STEPS * np.log(SURE / (1 - SURE))))
    cut, taken = None, 0
    for step in sorted((s for s in odds if s >= least), reverse=True):
        if taken >= most:
            break
        cut, taken = step, taken + odds[step]
    return cut


def hand_over(rows: DataFrame, share: float) -> tuple[DataFrame, int]:
    """rows (with odds) with new pseudo-labels: each view's surest pool rows of either label are given to the other.

    Returns how many are new as well. share is the share of label 1 that the pseudo-labels keep to.
    """
    pool = F.col("role") == "pool"
    size, given, new = rows.where(pool).count(), {}, 0
    for view, other in (("text", "metadata"), ("metadata", "text")):
        open_rows = pool & F.col(f"{other}_given").isNull()
        step = {1: F.floor(F.col(f"{view}_odds") * ODDS_STEPS), 0: F.floor(-F.col(f"{view}_odds") * ODDS_STEPS)}
        label = F.lit(None).cast("int")
        for y, part in ((1, share), (0, 1 - share)):
            steps = dict(rows.where(open_rows).groupBy(step[y].alias("step")).count().collect())  # bounded by MOST_ODDS
            cut = surest(steps, int(np.ceil(size * ROUND_SHARE * part)))
            if cut is not None:
                label = F.when(step[y] >= cut, y).otherwise(label)
                new += sum(n for s, n in steps.items() if s >= cut)
        given[f"{other}_given"] = F.coalesce(f"{other}_given", F.when(pool, label))
    return rows.withColumns(given), new


def quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher is better), predicted (score >= 0.5),
    text_score and metadata_score of the two views.

    docs needs doc_id, text, lang and source, labels doc_id and quality; other columns are ignored. Labels
    that are not 0 or 1, and those of the held-out fold, are not learned from. NULL texts count as empty;
    NULL languages and sources are a value of their own. Repeated rows are scored alike. A row without
    doc_id is scored and has held_out NULL. Without training labels of both classes all scores are 0.5. An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = _marked(docs, labels, slots)
    found = {(r["role"], r["label"]): r["count"] for r in rows.where("label IS NOT NULL").groupBy("role", "label").count().collect()}
    has = {role: all(found.get((role, y)) for y in (0, 1)) for role in ("learn", "calibrate")}
    held_out = (fold() == 0).alias("held_out")
    if not all(sum(found.get((role, y), 0) for role in has) for y in (0, 1)):
        none = [F.lit(0.5).alias(c) for c in ("text_score", "metadata_score")]
        return rows.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), *none)
    # The curves are fitted on rows that the counts have not seen, where the labels allow it.
    if has["learn"] and has["calibrate"]:
        learned, held = ["learn"], "calibrate"
    else:
        rows = rows.withColumn("role", F.when(F.col("role") == "calibrate", "learn").otherwise(F.col("role")))
        learned, held = ["learn"], "learn"
    ones = sum(found.get((role, 1), 0) for role in has)
    share, sample = ones / sum(found.values()), _sampled(_columns(rows, held, learned))
    staged, model = [rows], fit_round(rows, learned, held, sample, slots)
    for _ in range(rounds):
        scored = stage(model.with_odds(rows.drop("text_odds", "metadata_odds")), "quality-rows")
        rows, new = hand_over(scored, share)
        if not new:
            break
        discard(*[t for t in staged if t.inputFiles()])
        staged, model = [scored], fit_round(rows, learned, held, sample, slots)
    final = model.with_odds(rows.drop("text_odds", "metadata_odds", "text_given", "metadata_given", "label", "role"))
    both = [F.col("text_odds"), F.col("metadata_odds")]
    combined = model.combined
    standard = [F.greatest(F.least((o - float(m)) / float(s), F.lit(20.0)), F.lit(-20.0)) * float(w) for o, m, s, w in zip(both, combined.mean, combined.scale, combined.weights)]
    odds = F.greatest(F.least(standard[0] + standard[1] + float(combined.intercept), F.lit(30.0)), F.lit(-30.0))
    chance = lambda o: 1 / (1 + F.exp(-o))
    score = chance(odds)
    return final.select(
        "doc_id", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), chance(both[0]).alias("text_score"), chance(both[1]).alias("metadata_score")
    )
