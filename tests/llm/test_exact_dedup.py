import hashlib

from llm_helpers import rows_of

from tallyward.llm.exact_dedup import deduplicate, exact_duplicates

CASES = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "x" * 300_000), (7, "x" * 300_000), (None, "a"), (None, "only"), (9, "r"), (9, "r"), (8, "A")]


def expected(cases):
    out = []
    for doc_id, text in cases:
        same = [i for i, t in cases if (t or "") == (text or "")]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    got = exact_duplicates(docs(CASES))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(CASES)


def test_salts_do_not_matter(docs):
    table = docs([(i, "same" if i % 3 else f"t{i}") for i in range(60)])
    assert rows_of(exact_duplicates(table, salts=1)) == rows_of(exact_duplicates(table, salts=7))


def test_one_row_of_each_text_with_all_columns(docs):
    table = docs(CASES)
    kept = deduplicate(table)
    assert kept.columns == table.columns
    assert sorted((t or "") for (t,) in rows_of(kept, "text")) == sorted({(t or "") for _, t in CASES})


def test_empty(docs):
    assert exact_duplicates(docs([])).count() == 0
    assert deduplicate(docs([])).count() == 0
