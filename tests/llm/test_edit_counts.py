import random

import pytest

from tallyward.llm import edit_counts as ec

PARTS = ["a", "b", "'s", "'", "re", "'re", " ", "  ", "\n", "\n\n", "1", "23", "!", "?!", "é", "ß", "\t", "😀", " the", " and"]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return ec.send_vocabulary(spark)


def text_of(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def test_edits_against_full_encoding(vocabulary):
    rnd, counter = random.Random(1), ec.Counter(vocabulary.value)
    for _ in range(800):
        text = text_of(rnd, rnd.choice([0, 1, 3, 30, 200, 900]))
        tree = ec.build(text, counter)
        for _ in range(rnd.randint(1, 5)):
            change = rnd.randint(0, len(text) + 2), rnd.choice([0, 1, 2, 5, 50, 1000]), text_of(rnd, rnd.choice([0, 1, 2, 10]))
            text, _ = ec.edit(text, tree, *change, counter)
            assert tree.tokens[1] == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
            assert tree.stored()[:2] == ec.build(text, counter).stored()[:2]
            tree = ec.Tree(*tree.stored())


def test_only_the_edited_region_is_encoded(vocabulary):
    counter = ec.Counter(vocabulary.value)
    text = "some words in a long text " * 20_000
    tree = ec.build(text, counter)
    _, again = ec.edit(text, tree, 300_001, 3, "xyz", counter)
    assert again <= 8


def test_rows(spark, docs, vocabulary):
    long = "word " * 50_000
    cases = [(1, "one two three"), (2, None), (3, ""), (None, "x y"), (1, "one two three"), (4, long)]
    edits = [(4, 3, "TWO or more"), (100, 5, " end"), (None, None, None)]
    trees = ec.token_trees(docs(cases), vocabulary)
    rows = trees.crossJoin(spark.createDataFrame([(edits,)], f"edits {ec.EDITS}"))
    counter = ec.Counter(vocabulary.value)
    for r in ec.recount(rows, vocabulary).collect():
        before = dict(cases)[r.doc_id] or ""
        after = before
        for s, d, t in ((4, 3, "TWO or more"), (100, 5, " end")):
            s = min(s, len(after))
            after = after[:s] + t + after[s + d :]
        assert r.text == after
        assert r.tokens_before == len(counter.encoding.encode_ordinary(before))
        assert r.tokens_after == len(counter.encoding.encode_ordinary(after)) == sum(r.tokens)
    assert ec.recount(rows.withColumn("edits", rows.edits).limit(0), vocabulary).count() == 0
    none = ec.recount(trees.selectExpr("*", f"cast(NULL AS {ec.EDITS}) AS edits"), vocabulary)
    assert all(r.tokens_before == r.tokens_after and r.reencoded == 0 for r in none.collect())
