"""Whether two large tables hold the same rows, however often each, without sorting or joining them whole.

Rows are dealt into buckets by their hash. Each bucket has a fingerprint that does not depend on order: the number of its rows
and two sums of row hashes, added up where the rows are read. Buckets with equal fingerprints are done; only rows of
the others are compared, exactly.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import stage

BUCKETS = 1 << 16


def row_hash(df: DataFrame, salt: int) -> Column:
    """64-bit hash of a whole row. NULL has a place of its own, so (NULL, 1) and (1, NULL) differ."""
    parts = [part for c in df.columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(salt), *parts)


def fingerprints(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows and two sums of the row hashes of each bucket that has rows. Sums have 38 digits, so 64-bit hashes of
    2**62 rows fit."""
    bucket = F.pmod(row_hash(df, 0), F.lit(buckets))
    hashed = df.select(bucket.alias("bucket"), row_hash(df, 1).alias("a"), row_hash(df, 2).alias("b"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), wide("a").alias("sum_a"), wide("b").alias("sum_b"))


def differing_buckets(first: DataFrame, second: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Buckets whose fingerprints differ, with the rows of each side in them."""
    mine, other = (fingerprints(df, buckets).withColumn("side", F.lit(side)) for df, side in ((first, 1), (second, -1)))
    sides = mine.unionByName(other)
    signed = lambda c: F.sum(F.col(c) * F.col("side"))
    different = (signed("rows") != 0) | (signed("sum_a") != 0) | (signed("sum_b") != 0)
    rows_of = lambda side: F.sum(F.when(F.col("side") == side, F.col("rows")).otherwise(0))
    per_bucket = sides.groupBy("bucket").agg(
        rows_of(1).alias("first_rows"), rows_of(-1).alias("second_rows"), different.alias("different")
    )
    return per_bucket.where("different").drop("different")


def row_differences(first: DataFrame, second: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that one table holds more often than the other, with `surplus`: how many more the first holds (negative: the
    second). Empty if the tables are equal. Column names and types must agree.

    Only rows of differing buckets are shuffled, grouped and combined where they are read.
    """
    if first.schema.simpleString() != second.schema.simpleString():
        raise ValueError("tables of different columns have no common rows")
    found = stage(differing_buckets(first, second, buckets).select("bucket"), "differing-buckets")

    def of(df: DataFrame, count: int) -> DataFrame:
        bucketed = df.withColumn("bucket", F.pmod(row_hash(df, 0), F.lit(buckets)))
        return bucketed.join(found, "bucket", "left_semi").drop("bucket").withColumn("surplus", F.lit(count).cast("long"))

    both = of(first, 1).unionByName(of(second, -1))
    return both.groupBy(*first.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def same_rows(first: DataFrame, second: DataFrame, buckets: int = BUCKETS) -> bool:
    """Whether both tables hold the same rows equally often. Equal fingerprints decide where hashes agree in all three
    figures of every bucket; what differs is looked at row by row."""
    return not row_differences(first, second, buckets).head(1)
