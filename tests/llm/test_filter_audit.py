"""The filter audit against one loop over orders, steps and documents."""

import re
from collections import Counter
from itertools import permutations

import pytest
from llm_helpers import rows_of

from tallyward.llm import filter_audit
from tallyward.llm.filter_audit import ALONE, FIELDS, ROWS, audit_filters, packed_outcomes, unpack

LABELS = "doc_id BIGINT, quality INT, toxic INT, part STRING"
WORDS = " ".join(f"w{i}" for i in range(250))


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        name
        for name, failed in [
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", bool(re.search(r"[#$%&*|]", text))),
        ]
        if failed
    }


def brute_force(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    rated = []
    for i, text, lang in docs:
        failed = fails(text or "")
        if any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in docs):
            failed.add("E")
        mine = [label for label in labels if i is not None and label[0] == i]
        rated.append((lang or "", failed, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    got, shapley = {}, Counter()
    for part in {r[0] for r in rated}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rated if r[0] == part]
            for step, name in enumerate(order, 1):
                out = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                all_failing = [r for r in rated if r[0] == part and name in r[1]]
                alone = sum(r[1] == {name} for r in all_failing)
                shapley[part, name] += len(out)
                got[part, order, step] = [len(left), len(out), len(all_failing) - len(out), alone, sum(r[2] for r in out), sum(r[3] for r in out)]
    return sorted((part, order, step, *row, shapley[part, order[step - 1]]) for (part, order, step), row in got.items())


DOCS = [
    (1, WORDS, "en"),
    (2, WORDS, "de"),  # a copy in another part
    (2, WORDS, "de"),  # the same row again
    (3, "", None),
    (4, None, ""),  # equal to the empty text, in the same part as NULL
    (5, "short # text", "en"),
    (6, ("AB cd " * 200).strip(), "en"),
    (7, "\t\n \x0b", "de"),
    (8, "é" * 97 + "ABC", "fr"),  # exactly 3 of 100 characters
    (9, "é" * 96 + "ABCD", "fr"),
    (10, " ".join(f"w{i}" for i in range(100)) + " w1" * 100, "en"),  # exactly half distinct
    (11, WORDS + " |" * 20_000, "en"),
    (None, WORDS, "en"),
    (None, "short # text", None),
]
LABEL_ROWS = [(1, 1, 0), (2, 1, 1), (3, None, 1), (5, 0, 1), (5, 1, None), (6, 1, 0), (99, 1, 1), (None, 1, 1)]


def frames(spark, docs, labels):
    made = spark.createDataFrame([(i, t, g, "p", 1, True) for i, t, g in docs], "doc_id BIGINT, text STRING, lang STRING, part STRING, mask INT, good BOOLEAN")
    return made, spark.createDataFrame([(*row, "x") for row in labels], LABELS)


def test_against_brute_force(spark):
    got = audit_filters(*frames(spark, DOCS, LABEL_ROWS))
    assert [tuple(r) for r in got.orderBy("part", "filter_order", "step").collect()] == brute_force(DOCS, LABEL_ROWS)


def test_without_labels_and_without_documents(spark):
    docs, labels = frames(spark, DOCS, [])
    assert {(r.good_lost, r.toxic_lost) for r in audit_filters(docs, labels).collect()} == {(0, 0)}
    none, labels = frames(spark, [], LABEL_ROWS)
    assert audit_filters(none, labels).collect() == []


@pytest.mark.parametrize("held", [1, 3])
def test_more_parts_than_a_task_holds(spark, monkeypatch, held):
    docs = [(i, f"text {i % 4}", f"lang{i % 9}") for i in range(60)]
    want = brute_force(docs, [])
    monkeypatch.setattr(filter_audit, "PARTS_HELD", held)
    got = audit_filters(*frames(spark, docs, []))
    assert [tuple(r) for r in got.orderBy("part", "filter_order", "step").collect()] == want


def test_fields_do_not_run_into_each_other():
    most = (1 << 63) - 1
    for mask, packed in enumerate(packed_outcomes()):
        sums = unpack((most * packed).to_bytes(FIELDS * 8, "little"))
        assert set(sums.tolist()) <= {0, most} and sums[ROWS] == most
        # Every order removes a failing document exactly once.
        assert (sums[:ROWS].reshape(-1, 5) > 0).sum(axis=1).tolist() == [int(mask > 0)] * 120
        assert (sums[ALONE:] > 0).sum() == int(mask.bit_count() == 1)


def test_clashing_columns_are_ignored(spark):
    docs, labels = frames(spark, DOCS, LABEL_ROWS)
    assert rows_of(audit_filters(docs, labels)) == rows_of(audit_filters(docs.select("doc_id", "text", "lang"), labels.drop("part")))
