import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyward.llm import learning, quality, toxicity

LABELS = "doc_id BIGINT, quality INT, toxic INT, text STRING, label INT, fold INT"
ORDINARY = ["house", "river", "walking", "stone", "seven", "under", "light", "garden", "morning", "people", "water", "never"]


def made(n=900, seed=1):
    """Toxic texts have made-up insults of one stem with ever new endings; bad texts are shouted or full of signs."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(ORDINARY) + rnd.choice(["", "s", "ed", "ly"]) for _ in range(rnd.randint(5, 60))]
        toxic, bad = rnd.random() < 0.2, rnd.random() < 0.3
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rnd.randint(0, len(words)), "zurg" + "".join(rnd.choice("aeiou") for _ in range(3)))
        if bad:
            words = [w.upper() + "!!" if rnd.random() < 0.9 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic), "x", 9, 9))
    return rows, labels


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("operator, place", [(toxicity.toxicity, 2), (quality.quality, 1)])
def test_held_out_accuracy(spark, docs, operator, place):
    rows, labels = made()
    got = {r.doc_id: r for r in operator(docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == is_held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [x for x in labels if is_held_out(x[0])]
    assert sum(got[x[0]].predicted == x[place] for x in held) / len(held) > 0.97


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_held_out_labels_are_not_read(spark, docs, operator):
    rows, labels = made(300)
    turned = [(i, 1 - q, 1 - t, *rest) if is_held_out(i) else (i, q, t, *rest) for i, q, t, *rest in labels]
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in operator(docs(rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("operator, default", [(toxicity.toxicity, 0.0), (quality.quality, 0.5)])
def test_edges(spark, docs, operator, default):
    rows, labels = made(300)
    odd = [(None, "walking"), (5000, None), (5001, ""), (5002, "  \n"), (5003, "word " * 100_000), (5003, "word " * 100_000)]
    odd_labels = [(None, 1, 1, "x", 1, 1), (5000, None, None, "x", 1, 1), (5001, 7, 7, "x", 1, 1), (1, 1, 1, "x", 1, 1)]
    got = operator(docs(rows + odd), spark.createDataFrame(labels + odd_labels, LABELS)).collect()
    assert len(got) == len(rows) + len(odd)
    scores = {}
    for r in got:
        assert 0 <= r.score <= 1 and (r.held_out is None) == (r.doc_id is None)
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[5003]) == 1 and scores[5000] == scores[5001]
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in operator(docs(rows[:5]), none).collect()} == {default}
    assert operator(docs([]), none).count() == 0


def test_without_toxic_keeps_columns_and_clean_rows(spark, docs):
    rows, labels = made()
    table = docs(rows)
    kept = toxicity.without_toxic(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {x[0] for x in labels if not x[2]}
    assert len(clean - ids) <= 0.01 * len(clean) and len(ids - clean) <= 0.05 * len(rows)


def plain_counts(words):
    """Per order and class the counts of n-grams, and per order the counts of a pooled model, one word after the other."""
    top = toxicity.ORDERS[-1]
    counts = {(order, y): {} for order in toxicity.ORDERS for y in (0, 1)}
    for word, y, n in words:
        text = toxicity.START * (top - 1) + word + "\n"
        for at in range(len(word) + 1):
            gram = text[at : at + top]
            counts[top, y][gram] = counts[top, y].get(gram, 0) + n
    for order in reversed(toxicity.ORDERS[:-1]):
        for y in (0, 1):
            for longer in counts[order + 1, y]:  # different ones
                counts[order, y][longer[1:]] = counts[order, y].get(longer[1:], 0) + 1
    for order in toxicity.ORDERS:
        if order <= toxicity.SHARED_ORDER:
            pooled = {g: sum(counts[order, y].get(g, 0) for y in (0, 1)) for y in (0, 1) for g in counts[order, y]}
            counts[order, 0] = counts[order, 1] = pooled
    return counts


def plain_probability(counts, y, gram, order=toxicity.ORDERS[-1]):
    """Interpolated Kneser-Ney by recursion."""
    if order < toxicity.ORDERS[0]:
        return toxicity.UNIFORM
    known = {g: n for g, n in counts[order, y].items() if g[:-1] == gram[-order:-1]}
    lower = plain_probability(counts, y, gram, order - 1)
    if not known:
        return lower
    total = sum(known.values())
    seen = max(known.get(gram[-order:], 0) - toxicity.DISCOUNT, 0) / total
    return seen + toxicity.DISCOUNT * len(known) / total * lower


def model_of(spark, words):
    return toxicity.fit_models(spark.createDataFrame(words, "word STRING, toxic INT, n BIGINT"))


WORDS = [("abcab", 1, 3), ("abc", 0, 2), ("x", 0, 1), ("abcd", 1, 1), ("abcab", 0, 7), ("dcba", 0, 1), ("abd", 1, 2), ("é", 1, 4)]


def test_n_gram_counts_against_plain_counting(spark):
    models, want = model_of(spark, WORDS), plain_counts(WORDS)
    for order in toxicity.ORDERS:
        got = {r.gram: (r.n0, r.n1) for r in models.counts[order].collect()}
        if order <= toxicity.SHARED_ORDER:
            assert got == {g: (n, 0) for g, n in want[order, 0].items()}
        else:
            assert got == {g: tuple(want[order, y].get(g, 0) for y in (0, 1)) for y in (0, 1) for g in want[order, y]}


def test_evidence_against_plain_recursion(spark):
    """Of n-grams and of words, seen, partly seen and never seen."""
    counts = plain_counts(WORDS)
    asked = ["abcab", "abcde", "xab", "zzz", "é", "d"]
    top = toxicity.ORDERS[-1]
    grams = {w: [(toxicity.START * (top - 1) + w + "\n")[at : at + top] for at in range(len(w) + 1)] for w in asked}
    plain = {g: np.log(plain_probability(counts, 1, g)) - np.log(plain_probability(counts, 0, g)) for of in grams.values() for g in of}
    found = model_of(spark, WORDS).gram_evidence(spark.createDataFrame([(g,) for g in plain], "gram STRING"))
    assert {r.gram: r.evidence for r in found.collect()} == pytest.approx(plain, abs=1e-9)
    words = model_of(spark, WORDS).evidence_of(spark.createDataFrame([(w, 1) for w in asked], "word STRING, n BIGINT"))
    assert {r.word: r.evidence for r in words.collect()} == pytest.approx({w: sum(plain[g] for g in of) for w, of in grams.items()}, abs=1e-9)


def test_document_features_against_plain_recursion(spark, docs, monkeypatch):
    """Frequent words are sent, others joined: both give a document the same evidence."""
    texts = ["abcab xab", "zzz abcde abcde d", "", "é " * 50 + "abcab"]
    counts = plain_counts(WORDS)
    top = toxicity.ORDERS[-1]

    def evidence(word):
        text = toxicity.START * (top - 1) + word + "\n"
        grams = [text[at : at + top] for at in range(len(word) + 1)]
        return sum(np.log(plain_probability(counts, 1, g)) - np.log(plain_probability(counts, 0, g)) for g in grams)

    vocabulary = sorted({w for t in texts for w in t.split()})
    for sent in (0, 2, 100):
        monkeypatch.setattr(toxicity, "SENT_WORDS", sent)
        words = model_of(spark, WORDS).evidence_of(spark.createDataFrame([(w, sum(t.split().count(w) for t in texts)) for w in vocabulary], "word STRING, n BIGINT"))
        got = toxicity._features(docs(list(enumerate(texts))).select("doc_id", "text"), words).orderBy("doc_id").collect()
        for row, text in zip(got, texts):
            of = [evidence(w) for w in text.split()]
            n = max(1, len(of))
            assert (row.a, row.b, row.c) == pytest.approx((sum(of) / n, max([0.0, *of]), sum(e > toxicity.TELLING for e in of) / n), abs=1e-9)


def test_words_alike_in_four_characters_are_told_apart(spark):
    """After abcde f is toxic, after xbcde g: contexts of four characters say the same of both."""
    words = [("abcdef", 1, 50), ("abcdeg", 0, 50), ("xbcdef", 0, 50), ("xbcdeg", 1, 50)]
    asked = spark.createDataFrame([("abcdef", 1), ("abcdeg", 1)], "word STRING, n BIGINT")
    evidence = {r.word: r.evidence for r in model_of(spark, words).evidence_of(asked).collect()}
    assert evidence["abcdef"] > 3 and evidence["abcdeg"] < -3


def test_n_grams_are_shuffled_a_part_of_the_words_at_a_time(spark, monkeypatch):
    """Every word has its evidence from one part, whatever their number."""
    asked = spark.createDataFrame([(w, 1) for w in ["walking", "zurgao", "x", *ORDINARY]], "word STRING, n BIGINT").distinct().repartition(1)
    sums, found = [], []

    def staged(df, label, **options):
        table = learning.stage(df, label, **options)
        if label == "toxicity-sums":
            sums.append(table.count())
        return table

    monkeypatch.setattr(toxicity, "stage", staged)
    for parts in (1, 4):
        monkeypatch.setattr(toxicity, "PARTS", parts)
        found.append({r.word: (r.n, round(r.evidence, 9)) for r in model_of(spark, WORDS).evidence_of(asked).collect()})
    assert found[0] == found[1] and len(found[0]) == asked.count()
    assert sums[0] == asked.count() == sum(sums[1:]) and len(sums) == 5 and max(sums[1:]) <= sums[0] // 4 + 1


def test_word_probabilities_sum_to_one():
    """Over all next characters, discounted counts and backoff weights of a context share out everything but the uniform part."""
    counts, y = plain_counts(WORDS), 1
    signs = {g[-1] for g in counts[2, y]}
    context = "\1\1\1ab"
    total = sum(plain_probability(counts, y, context + sign) for sign in signs)
    assert 0.9 < total <= 1 + 1e-9


def half_labelled(n=400):
    rows, labels = made(n, seed=3)
    return rows, [x for x in labels if x[0] % 2]


def plain_weights(rows, label, features):
    """Naive Bayes by counting rows one by one."""
    of_label = [sum(label(r) == y for r in rows) for y in (0, 1)]
    counts = {}
    for r in rows:
        if label(r) is not None:
            for f in features(r):
                counts.setdefault(f, [0, 0])[label(r)] += 1
    return {f: np.log((n[1] + 0.5) / (of_label[1] + 1)) - np.log((n[0] + 0.5) / (of_label[0] + 1)) for f, n in counts.items()}


def test_a_round_of_co_training_against_plain_counting(spark, docs):
    rows, labels = half_labelled()
    table = docs(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 7))
    marked = quality._marked(table, spark.createDataFrame(labels, LABELS), 512)
    sample = quality._sampled(quality._columns(marked, "calibrate", ["learn"]))
    model = quality.fit_round(marked, ["learn"], "calibrate", sample, 512)
    here = marked.collect()
    known = {i: q for i, q, *_ in labels if not is_held_out(i)}
    assert {r.doc_id: r.label for r in here if r.role in ("learn", "calibrate")} == known
    assert {r.doc_id for r in here if r.role == "pool"} == {i for i, _ in rows if i % 2 == 0}

    def learned(r):
        return r.label if r.role == "learn" else None

    want = plain_weights(here, learned, lambda r: r.slots)
    assert np.allclose(model.weights, [want.get(s, 0.0) for s in range(512)])
    for column, got in (("lang", model.langs), ("source", model.sources)):
        plain = plain_weights(here, learned, lambda r: [r[column]])
        assert {r[column]: r.weight for r in got.collect()} == pytest.approx(plain)

    # What each view is surest of goes to the other, whole steps at a time.
    scored = quality.stage(model.with_odds(marked), "test")
    given, new = quality.hand_over(scored, 0.7)
    after = given.collect()
    pool = [r for r in after if r.role == "pool"]
    handed = 0
    for view, other in (("text", "metadata"), ("metadata", "text")):
        odds = {r.doc_id: r[f"{view}_odds"] for r in pool}
        expected = {}
        for y, part in ((1, 0.7), (0, 1 - 0.7)):
            step = {i: int(np.floor((o if y else -o) * 20)) for i, o in odds.items()}
            most = int(np.ceil(len(pool) * 0.05 * part))
            for s in sorted({s for s in step.values() if s >= np.ceil(20 * np.log(19))}, reverse=True):
                if sum(v == y for v in expected.values()) >= most:
                    break
                expected |= {i: y for i, at in step.items() if at == s}
        assert {r.doc_id: r[f"{other}_given"] for r in pool if r[f"{other}_given"] is not None} == expected
        handed += len(expected)
    assert handed == new > 0 and all(r.text_given is None and r.metadata_given is None for r in after if r.role != "pool")

    # The next round counts what was handed over.
    again = quality.fit_round(given, ["learn"], "calibrate", sample, 512)
    want = plain_weights(after, lambda r: learned(r) if r.role == "learn" else r.text_given, lambda r: r.slots)
    assert np.allclose(again.weights, [want.get(s, 0.0) for s in range(512)])


def test_unlabelled_rows_teach(spark, docs):
    """With few labels, rounds over the unlabelled rows do not hurt, and every one of them may be labelled."""
    rows, labels = made(900, seed=5)
    few = [x for x in labels if x[0] % 12 == 1]
    got = {r.doc_id: r.predicted for r in quality.quality(docs(rows), spark.createDataFrame(few, LABELS)).collect()}
    rest = [x for x in labels if x[0] % 12 != 1]
    assert sum(got[x[0]] == x[1] for x in rest) / len(rest) > 0.9


def test_every_source_counts_for_itself(spark, docs):
    """Hundreds of sources, each all good or all bad, that say everything; texts say nothing."""
    rows = [(i, "the same words in every text") for i in range(3000)]
    table = docs(rows).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 300))
    labels = [(i, int(i % 300 < 150), 0, "x", 1, 1) for i in range(3000) if i // 300 % 3]
    got = quality.quality(table, spark.createDataFrame(labels, LABELS)).collect()
    assert sum(r.predicted == int(r.doc_id % 300 < 150) for r in got) > 0.99 * len(got)


@pytest.mark.parametrize("sampled, toxic_folds", [(20_000, (1, 2, 3)), (50, (1, 2, 3, 4))])
def test_few_toxic_labels_are_not_lost(spark, docs, monkeypatch, sampled, toxic_folds):
    """No toxic label in the calibration fold, or so few that a plain sample of it has none."""
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", sampled)
    rows, labels = made(1200)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    most = {f: 8 for f in toxic_folds}
    known = []
    for i, q, t, *rest in labels:
        if t and (most.get(fold[i], 0) == 0):
            continue
        most[fold[i]] = most.get(fold[i], 0) - t
        known.append((i, q, t, *rest))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs(rows), spark.createDataFrame(known, LABELS)).where("held_out").collect()}
    right = [got[x[0]] == x[2] for x in labels if x[0] in got]
    found = [got[x[0]] for x in labels if x[0] in got and x[2]]
    assert sum(right) > 0.9 * len(right) and sum(found) > 0.8 * len(found)


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 3, "d" * 9]})
    parts = list(learning.bounded(iter([batch, batch.slice(0, 0)]), most=12))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and [p.num_rows for p in parts] == [2, 1, 3]
