"""Stages of the pipeline, each on its own input, against brute force or the operator's own accuracy tests."""

import corpus_pipeline
import pytest
import sentencepiece
from test_decontaminate import brute_force as leaks
from test_line_dedup import brute_force as without_repeated_lines
from test_simhash import groups, plain_fingerprint

from tallyward.llm.sentencepiece import MODEL
from tallyward.session import stage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        after = stage(apply(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == COLUMNS


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if not r.toxic]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and after.count() < before.count()


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = without_repeated_lines(list(texts(before).items()))
    assert texts(after) == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_simhash(stages):
    before, after = stages["simhash"]
    prints = {i: plain_fingerprint(t) for i, t in texts(before).items()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert set(texts(after)) == set(groups(list(prints), linked).values())


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, *_ in leaks(list(texts(before).items()), items)}
    assert set(texts(after)) == set(texts(before)) - dirty


def test_encoding(stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert after.columns == [*COLUMNS, "ids", "n_tokens"] and texts(after) == texts(before)
    assert all(r.ids == library.encode(r.text) for r in after.collect())


def test_run_gives_the_last_stage(spark, stages):
    got, want = corpus_pipeline.run(spark, SF), stages["sentencepiece"][1]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_tokens").collect())) == sorted(map(tuple, want.select("doc_id", "text", "n_tokens").collect()))
