"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest

from tallyward.llm import hard_negatives as module
from tallyward.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id BIGINT, label INT, embedding ARRAY<FLOAT>, vector STRING, v INT, rank STRING, score DOUBLE"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, None if x is None else [None if c is None else float(c) for c in x], "a", 1, "b", 0.5) for i, y, x in rows], SCHEMA)


def brute_force(rows):
    used = {}
    for i, y, x in rows:
        if i is None or y is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(c))) for c in x])
        used[i] = min(used.get(i, row), row)
    out = []
    for a, (label, vector) in used.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(vector, x)) for i, (_, x) in used.items()}
        ranked = sorted((i for i in used if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if used[i][0] == label][:5]:
            near = [i for i in ranked if used[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(near[:5], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(n=900, seed=1):
    """Clusters, one vector that a third of the rows share, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(n):
        x = centres[i % 12] + rng.normal(size=24) * 0.4 if i % 3 else centres[0]
        rows.append((i * 5, int(rng.integers(0, 10)), x.tolist()))
    rows += [(100_000, None, [1.0] * 24), (100_100, 1, None), (100_200, 1, [1.0, None]), (100_300, 2, [float("nan")]), (100_400, 3, [float("inf")])]
    rows += [(None, 1, [9.0] * 24), (200_000, 4, []), (200_100, 4, centres[1][:5].tolist()), (200_101, 4, [*centres[1], 1.0, 1.0])]
    rows += [(300, 2, (centres[2] * 2).tolist()), (300, 1, centres[3].tolist()), (300, 1, centres[3].tolist())]  # one vec_id, three rows
    return rows


@pytest.mark.parametrize("anchors, tile, few", [(8192, 1024, 0.04), (16, 64, 1.0), (1, 1024, 0.0)])
def test_against_all_pairs(spark, monkeypatch, anchors, tile, few):
    rows = corpus()
    for name, value in [("ANCHORS", anchors), ("ROW_TILE", tile), ("ANCHOR_TILE", 7), ("FEW", few)]:
        monkeypatch.setattr(module, name, value)
    got, want = result(hard_negatives(frame(spark, rows).repartition(3))), brute_force(rows)
    assert got == want and len(want) > 200


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 20, i % 3, (rng.normal(size=16) * 300_000).tolist()) for i in range(60)]
    want = brute_force(rows)
    assert result(hard_negatives(frame(spark, rows))) == want and max(r[4] for r in want) > 1 << 53


def test_too_large_components_are_an_error(spark):
    rows = [(i * 100, 0, [1e12] * 4) for i in range(4)]
    with pytest.raises(Exception, match="63 bits"):
        hard_negatives(frame(spark, rows)).collect()


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.0, 2.0]), (4, 2, [-1.0, 0.0]), (5, 3, [0.0, 0.0])]
    want = brute_force([(i, y, x) for i, y, x in rows])
    assert result(hard_negatives(frame(spark, rows))) == want
    assert want == [(0, 3, 1, 2, 0, 0), (0, 3, 2, 5, 0, 0)]  # anchor 0 has label 2; its other positive scores below 0


def test_empty_tables(spark):
    assert hard_negatives(frame(spark, [])).collect() == []
    assert hard_negatives(frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])])).collect() == []
    assert hard_negatives(frame(spark, [(100, 1, [1.0])])).collect() == []


def test_bounds_hold_and_drop_most_pairs_of_clusters():
    rng = np.random.default_rng(5)
    width, centres = 32, rng.normal(size=(20, 2)).repeat(16, axis=1) * 300
    vectors = np.rint(centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, width)) * 4).astype(np.int64)

    def packed(part):
        means, deviations = [], []
        for level in module.LEVELS:
            cut = part.reshape(len(part), level, -1)
            means.append(cut.mean(axis=2))
            deviations.append(np.sqrt(((cut - means[-1][:, :, None]) ** 2).sum(axis=2)))
        return np.arange(len(part)), np.zeros(len(part), np.int64), part, np.hstack(means), np.hstack(deviations)

    a, r = packed(vectors[:100]), packed(vectors)
    exact = vectors[:100] @ vectors.T
    fifth = np.sort(exact, axis=1)[:, -5, None]
    for level in range(len(module.LEVELS)):
        middle, spread = module._bounds(a, r, level, width)
        assert (middle - spread - 1e-3 <= exact).all() and (exact <= middle + spread + 1e-3).all()
        assert (middle + spread >= fifth).mean() < 0.2
