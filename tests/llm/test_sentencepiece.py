import random
from itertools import combinations

import pyarrow as pa
import pytest
import sentencepiece

from tallyward.llm import learning
from tallyward.llm import sentencepiece as sp

CASES = ["", " ", "a", "  a", "a  b ", "\n", "a\nb", "\ta", "<s>x", "<0x0A>", "\xa0x", "a\x00b", "\r\n", "日本語 テスト", "x" * 300, "ab" * 100, "\n\n a \n", "😀é̃", "the of and " * 20_000]


@pytest.fixture(scope="module")
def pieces():
    return sp.load_pieces()


def toy(kind="unigram", byte_ids=None):
    scores = {"a": -1.0, "b": -1.5, "ab": -1.9, "ba": -2.0, "aba": -4.6, "▁": -0.5, "▁a": -1.4, "bb": -4.0}
    return sp.Pieces(kind, {p: i + 10 for i, p in enumerate(scores)}, scores, byte_ids, 0, [])


def all_ways(word, pieces):
    """The best score over every way to cut a word."""
    best = -1e9
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in pieces.ids or len(p) == 1 for p in parts):
                best = max(best, sum(pieces.scores.get(p, pieces.penalty) for p in parts))
    return best


def test_library_gives_the_same_ids(spark, docs, pieces):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), random.Random(2)
    texts = CASES + ["".join(rnd.choice("abcdethin oserlyng  \n😀é_-(){}12.,") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    table = docs([*enumerate(texts), (None, None), (0, "")])
    for most in (sp.WORDS, 20):  # 20: most words are folded in place
        got = sp.decode(sp.encode(table, pieces, most), pieces)
        assert got.columns == [*table.columns, "ids", "n_tokens", "decoded"]
        rows = got.collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") and r.n_tokens == len(r.ids)


def test_lattice_against_library(spark, pieces):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), random.Random(6)
    words = {"".join(rnd.choice("theinganorstlyéß😀") for _ in range(rnd.randint(1, 14))) for _ in range(150)} | {"a" * 47, "\x01"}
    got = sp.encode_words(spark.createDataFrame([("▁" + w,) for w in words], "word STRING"), pieces).collect()
    assert {r.word: r.ids for r in got} == {"▁" + w: library.encode(w) for w in words}


def test_viterbi_against_every_cut(spark):
    rnd, pieces = random.Random(3), toy()
    words = sorted({"".join(rnd.choice("ab▁ac") for _ in range(rnd.randint(1, 9))) for _ in range(60)})
    names = {i: p for p, i in pieces.ids.items()}
    got = sp.encode_words(spark.createDataFrame([(w,) for w in words], "word STRING"), pieces).collect()
    assert len(got) == len(words)
    for r in got:
        for ids in (r.ids, pieces.fold(r.word)):
            assert abs(sum(pieces.scores[names[i]] if i in names else pieces.penalty for i in ids) - all_ways(r.word, pieces)) < 1e-9


def test_models_that_cross_words_are_refused():
    with pytest.raises(ValueError):
        sp.check_cuts(sp.Pieces("bpe", {"a▁b": 1}, {"a▁b": 0.0}, None, 0, []))


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + 100 // (i + 1)) for i in range(100)], "word STRING, n BIGINT")
    assert 0 < learning.most_frequent(counts, 10).count() <= 10
    assert learning.most_frequent(counts, 1000).count() == 100


def test_empty(docs, pieces):
    assert sp.decode(sp.encode(docs([]), pieces), pieces).count() == 0


def test_words_are_cut_as_by_the_expression():
    """Texts without runs of spaces are cut without the expression, one by one and a batch at a time."""
    rnd = random.Random(4)
    texts = CASES + [None, "▁", " \n", "a \n b"] + ["".join(rnd.choice(" \n▁ab\té\xa0") for _ in range(rnd.randint(0, 8))) for _ in range(20_000)]
    cut = [sp._WORD.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    assert [sp.words_of(t) for t in texts] == cut
    batch = pa.array([None, *texts])[1:]
    assert sorted(sp.batch_words(batch).to_pylist()) == sorted(w for words in cut for w in words)


def test_batches_of_ids_are_decoded_whole(pieces):
    """Slices of a batch, with NULL and empty lists, bytes that are no UTF-8 and ids that the model lacks."""
    table = pa.array(pieces.decoded, pa.large_binary())
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    ids = [[1] * 3, None, [], *map(library.encode, CASES), [pieces.byte_ids[200]]]
    texts = ["", "", *CASES, "�"]
    assert sp.decode_ids(pa.array(ids, pa.list_(pa.int32()))[1:], table) == texts
    for wrong in (10**6, -1, None):
        with pytest.raises((pa.ArrowIndexError, ValueError)):
            sp.decode_ids(pa.array([[wrong]], pa.list_(pa.int32())), table)
