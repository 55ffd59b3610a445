import random
from fractions import Fraction

import pytest
from llm_helpers import rows_of

from tallyward.llm.decontaminate import contaminated, decontaminate, words_of

ITEMS = "item_id BIGINT, text STRING, doc_id BIGINT, shared STRING"


def brute_force(cases, items, share=Fraction(4, 5)):
    found = []
    for doc_id, text in cases:
        words = words_of(text)
        for item_id, item in items:
            of_item = words_of(item)
            width = min(5, len(of_item))
            cut = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
            if of_item and len(cut(words) & cut(of_item)) >= share * len(cut(of_item)):
                found.append((doc_id, item_id, len(cut(words) & cut(of_item)), len(cut(of_item))))
    return sorted(found, key=str)


def made(seed):
    """Documents around items that are whole, cut, altered in some words, or shuffled."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else f"w{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 5, 6, 12, 40])))) for i in range(20)] + [(90, None), (91, "?!")]
    cases = []
    for i in range(60):
        words = items[rnd.randrange(20)][1].split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            words[rnd.randrange(len(words))] = "changed"
        around = [word() for _ in range(rnd.choice([0, 10, 800]))]
        at = rnd.randint(0, len(around))
        cases.append((i, " ".join(around[:at] + words + around[at:])))
    return cases, items


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_against_brute_force(spark, docs, block_words):
    cases, items = made(4)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = contaminated(docs(cases), table, block_words=block_words)
    assert got.columns == ["doc_id", "item_id", "shared", "item_shingles", "containment"]
    want = brute_force(cases, items)
    assert want and sorted((tuple(r)[:4] for r in got.collect()), key=str) == want
    dirty = {d for d, *_ in want}
    clean = decontaminate(docs(cases), table, block_words=block_words)
    assert clean.columns == docs([]).columns
    assert {i for (i,) in rows_of(clean, "doc_id")} == {i for i, _ in cases} - dirty


def test_edges(spark, docs):
    items = spark.createDataFrame([(1, "One two THREE four five six", 1, "x"), (1, "a b", 1, "x")], ITEMS)
    cases = [(1, None), (2, ""), (None, "so: one, two\nthree - four five six!"), (4, "x " * 100_000 + "a B"), (4, "a b"), (5, "clean")]
    got = contaminated(docs(cases), items).collect()
    assert sorted((str(r.doc_id), r.item_shingles) for r in got) == [("4", 1), ("4", 1), ("None", 2)]
    assert sorted(str(i) for (i,) in rows_of(decontaminate(docs(cases), items), "doc_id")) == ["1", "2", "5"]


def test_empty(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    assert contaminated(docs([]), none).count() == 0 and contaminated(docs([(1, "a")]), none).count() == 0
    assert decontaminate(docs([(1, "a")]), none).count() == 1
