"""Every registered query of the subpackage: its columns, and its SQL on the smallest data folder."""

import pytest
from compare import connect, entry, oracle_rows, spark_rows

from tallyward.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, SF))
    assert got[1] and got == oracle_rows(duck, ORACLE[name])


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("op2_sentencepiece", "documents", ["doc_id", "ids", "n_tokens", "round_trip"]),
        ("op4_toxicity", "documents", ["doc_id", "held_out", "score", "predicted"]),
        ("op5_quality", "documents", ["doc_id", "held_out", "score", "predicted", "text_score", "metadata_score"]),
        ("op6_html_text", "pages", ["page_id", "url", "text", "n_chars"]),
        ("op9_simhash", "documents", ["doc_id", "fingerprint", "component_id"]),
        ("op10_token_counts", "documents", ["doc_id", "tokens_before", "tokens_after", "reencoded", "pretokens", "edited_sha256"]),
    ],
)
def test_one_row_for_each_row_of_the_table(spark, name, table, columns):
    got = QUERIES[name](spark, SF)
    assert got.columns == columns
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_all_are_registered():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
