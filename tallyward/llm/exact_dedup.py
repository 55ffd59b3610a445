"""Exact deduplication that a hot text cannot skew.

Three combining steps, each with the full text in its grouping key, so equal digests alone never make
two texts equal:

1. locally: the map side of the first aggregation leaves one row per task, salt and distinct text;
2. per salted digest: at most `salts` rows are left of a text, however many copies it has;
3. globally: the salt winners of a digest meet, at most `salts` rows each.

Winners then go back to all rows by digest alone, in a narrow join without texts. That is exact because
step 3 has shown which digests belong to one text only; rows of a digest with several texts (never seen
for SHA-256, but not assumed) are attached by digest and text instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import stage

SALTS = 16

RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def text_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size."""
    salted = docs.select(
        _digest().alias("digest"),
        "text",
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    per_salt = salted.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Dealt by digest alone, which serves both this grouping and the look at texts per digest after it.
    return per_salt.repartition("digest").groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored. Texts are equal when identical without any
    change. Of equal texts the row with the largest doc_id stays. NULL texts count as empty and so are
    copies of each other and of empty texts. A row without doc_id is counted in group_size and stays only
    where no row of its text has a doc_id. Rows that repeat a doc_id with the same text are one document:
    group_size counts each of them and `kept` is the same for all (deduplicate() leaves one). An empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    groups = text_groups(docs, salts)
    # Texts are needed once more only where one digest has several of them.
    texts = F.count(F.lit(1)).over(W.partitionBy("digest"))
    winners = groups.withColumn("texts", texts)
    shared = F.when(F.col("texts") > 1, F.col("text"))
    winners = stage(winners.select("digest", shared.alias("shared_text"), "keep_id", "group_size"), "dedup-winners")

    one_text = winners.where(F.col("shared_text").isNull()).drop("shared_text")
    several = winners.where(F.col("shared_text").isNotNull())
    rows = docs.select("doc_id", _digest().alias("digest"))
    found = rows.join(one_text, "digest")
    if several.head(1):
        by_text = docs.select("doc_id", _digest().alias("digest"), F.col("text").alias("shared_text"))
        found = found.unionByName(by_text.join(several, ["digest", "shared_text"]).drop("shared_text"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.withColumn("kept", kept).withColumn("text_sha256", F.lower(F.hex("digest"))).select(*RESULT)


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs without the rows that exact_duplicates drops, one row for each text, all columns kept."""
    keep = exact_duplicates(docs.select("doc_id", "text"), salts).where("kept")
    keep = keep.select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (
        F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("_kept_sha")
    )
    first = W.partitionBy("_kept_id", "_kept_sha").orderBy(F.lit(1))
    return (
        docs.join(keep, same)
        .withColumn("_row", F.row_number().over(first))
        .where("_row = 1")
        .select(*docs.columns)
    )
