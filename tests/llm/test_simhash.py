import random
import re
from itertools import combinations

import numpy as np
import xxhash
from llm_helpers import rows_of

from tallyward.llm import simhash
from tallyward.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for text in (None, "", "  \n", "One", "One two", "A b C d É é", "x y z " * 200, "a\x0bb c d"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_text_in_steps(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=5000))
    monkeypatch.setattr(simhash, "HASHES_PER_STEP", 700)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near_prints(n, rnd):
    """Fingerprints in clusters of one to four changed bits, so that chains and misses occur."""
    out = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        value = rnd.choice(out)
        for _ in range(rnd.randint(1, 4)):
            value ^= 1 << rnd.randrange(64)
        out.append(value)
    return [int(v) for v in np.array(out, np.uint64).view(np.int64)]


def test_links_connect_what_all_pairs_connect(spark):
    values = sorted(set(near_prints(300, random.Random(5))))
    pairs = [(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    table = spark.createDataFrame([(v,) for v in values], "fp BIGINT")
    for crowd in (4096, 3):  # 3: almost every key is dealt anew by finer keys
        found = [(r.src, r.dst) for r in simhash.close_links(table, crowd).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)
        assert groups(values, found) == groups(values, pairs)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(60)] + [(7, 7), (3, 2)]
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(edges, "src BIGINT, dst BIGINT")).collect())
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == groups(nodes, edges)


def test_documents(docs):
    base = "the quick brown fox jumps over the lazy dog " * 30
    cases = [(4, base), (2, base + "."), (9, base), (5, None), (3, ""), (8, " \t"), (1, "something else entirely here"), (None, base), (6, "x"), (6, "x")]
    got = simhash.near_duplicates(docs(cases))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {(i, f"{plain_fingerprint(t):016x}") for i, t in cases}
    assert {(r.doc_id, r.fingerprint) for r in got.collect()} == prints and got.count() == len(cases)
    whole = {r.doc_id: r.component_id for r in got.collect()}
    assert whole[4] == whole[9] == whole[None] and whole[5] == whole[3] == whole[8] == 3 and whole[1] == 1 and whole[6] == 6


def test_one_of_each(docs):
    base = "the quick brown fox jumps over the lazy dog " * 30
    table = docs([(4, base), (9, base), (1, "something else entirely here"), (3, ""), (5, None)])
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns and rows_of(kept, "doc_id") == [(1,), (3,), (4,)]


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_component_with_repeated_and_missing_ids(spark, docs):
    """A row is known by its doc_id and text: neither another text of a doc_id that stays, nor a row without doc_id, slips
    through."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "red green blue white black")
    rows = [(3, a), (5, b), (5, a), (None, a), (None, c), (None, c), (3, a), (7, None), (8, "")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs(rows)).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (None, c), (7, None)], key=str)


def one_of_each_by_hand(rows):
    prints = [plain_fingerprint(t or "") for _, t in rows]
    linked = [(x, y) for x in range(len(rows)) for y in range(x) if (prints[x] ^ prints[y]).bit_count() <= 3]
    roots = groups(range(len(rows)), linked)
    best = {}
    for at, root in roots.items():
        i = rows[at][0]
        best.setdefault(root, []).append((i is None, i or 0))
    return sorted((min(ids) for ids in best.values()))


def test_one_of_each_against_brute_force(spark, docs):
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for n in range(80):
        words = list(rnd.choice(base))
        if rnd.random() < 0.3:
            words[rnd.randrange(60)] = f"x{n}"
        rows.append((rnd.choice([None, *range(40)]), " ".join(words)))
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(docs(rows)).collect())
    assert got == one_of_each_by_hand(rows)


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 3), (2, "a b c", "x", "y", 4)], "doc_id BIGINT, text STRING, _keep STRING, `key` STRING, best INT")
    assert [tuple(r) for r in simhash.one_of_each(docs).collect()] == [(1, "a b c", "x", "y", 3)]
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(docs.limit(0)).collect() == []

