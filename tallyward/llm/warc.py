"""WARC records and their fixity: Merkle trees over ordered offset ranges of an archive.

Each record of an archive is a leaf. Records whose offset lies in one range of RANGE_BYTES form a node: the SHA-256
of their offsets and hashes in order. FANOUT neighbouring ranges form the next node, and so on up to a
root per archive. Two replicas are compared from the roots down: only children of nodes that differ are
looked at, so sound archives cost one comparison, and a fault costs one path.

Ranges follow offsets, not record numbers, so a lost or added record disturbs its own range only. Trees
are built bottom up by grouping; a group has at most the records that start in one range, or FANOUT nodes.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import stage

RANGE_BYTES = 64 * 1024
FANOUT = 16
#: Pages of one archive file, so that offsets are summed within a bounded group.
PAGES_PER_ARCHIVE = 1000
NO_ID_ARCHIVES = 4096

CRLF = "\r\n"
RECORD = ("archive", "record_offset", "record_length", "record_id", "record_sha256")


def response_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record with its closing empty lines; NULL url and html count as empty."""
    body = F.coalesce(html, F.lit(""))
    header = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *header), F.lit(CRLF * 2), body, F.lit(CRLF * 2))


def warc_records(pages: DataFrame, pages_per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """archive, record_id, record_length, record_sha256, record: the pages as records of archives.

    An archive holds the pages of pages_per_archive consecutive ids. Pages without id are spread over
    negative archives by their content.
    """
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(NO_ID_ARCHIVES))
    archive = F.coalesce(F.floor(F.col("page_id") / pages_per_archive), spread).cast("long")
    record = response_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(archive.alias("archive"), F.col("page_id").alias("record_id"), record.alias("record"))
    return rows.select(
        "archive", "record_id", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"), "record"
    )


def with_offsets(records: DataFrame) -> DataFrame:
    """Add record_offset: records of an archive lie in the order of their ids, equal ids in that of hashes.

    Leave out the records themselves where they are not needed: the running sum then moves hashes only.
    """
    before = W.partitionBy("archive").orderBy("record_id", "record_sha256").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("record_offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)))


def write_warc(records: DataFrame, path: str) -> None:
    """Uncompressed WARC files, one folder per archive, records in offset order."""
    whole = F.expr("left(record, length(record) - 4)")  # the line separator closes the record
    ordered = records.repartition("archive").sortWithinPartitions("archive", "record_offset")
    ordered.select("archive", whole.alias("value")).write.partitionBy("archive").option("lineSep", CRLF * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, html of WARC files written by write_warc; a record of another length is an error."""
    start = "WARC/1.1" + CRLF
    pieces = spark.read.option("lineSep", CRLF * 2 + start).text(path)
    value = F.regexp_replace(F.regexp_replace("value", f"^{start}", ""), "\r\n\r\n$", "")
    cut = pieces.select(F.split(value, CRLF * 2, 2).alias("p"))
    header, body = F.get("p", F.lit(0)), F.coalesce(F.get("p", F.lit(1)), F.lit(""))

    def field(name: str) -> Column:
        return F.regexp_extract(header, rf"(?m)^{name}: *([^\r\n]*)", 1)

    sound = field("Content-Length").cast("long") == F.octet_length(body)
    html = F.when(sound, body).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), header)))
    page_id = F.regexp_extract(field("WARC-Record-ID"), r"<urn:page:([0-9-]+)>", 1).try_cast("long")
    return cut.select(page_id.alias("record_id"), field("WARC-Target-URI").alias("url"), html.alias("html"))


def _node(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(parts), "|"), 256)


def merkle_levels(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (archive, node, hash) of each level, ranges first, roots (node 0) last."""
    line = F.concat_ws(":", F.lpad(F.col("record_offset").cast("string"), 20, "0"), "record_length", "record_sha256")
    in_range = F.floor(F.col("record_offset") / RANGE_BYTES).alias("node")
    nodes = leaves.groupBy("archive", in_range).agg(_node(F.collect_list(line)).alias("hash"))
    built = [stage(nodes, "merkle-0")]
    for level in range(1, levels):
        child = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        up = F.lit(0) if level == levels - 1 else F.floor(F.col("node") / FANOUT)
        nodes = built[-1].groupBy("archive", up.cast("long").alias("node")).agg(_node(F.collect_list(child)).alias("hash"))
        built.append(stage(nodes, f"merkle-{level}"))
    return built


def level_count(*replicas: DataFrame) -> int:
    """Levels so that the root of the largest archive has at most FANOUT children."""
    most = max(r.agg(F.max("record_offset")).first()[0] or 0 for r in replicas)
    ranges, levels = most // RANGE_BYTES + 1, 2
    while ranges > FANOUT:
        ranges, levels = -(-ranges // FANOUT), levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """archive, node of nodes that one replica lacks or that have another hash there."""
    a, b = a.withColumnRenamed("hash", "hash_a"), b.withColumnRenamed("hash", "hash_b")
    joined = a.join(b, ["archive", "node"], "full")
    return joined.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("archive", "node")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replica b differs from replica a.

    a and b are leaves: archive, record_offset, record_length, record_id, record_sha256. Returns archive, record_offset, record_id, fault (changed,
    missing: not in b, added: only in b), sha256_a, sha256_b. A record is known by its archive and offset.
    Repeated rows of a replica are part of its tree: a record that b has twice is a fault of its range, and is
    reported as changed if it is otherwise equal. NULL archives and offsets are left out (such records
    have no place in a file). Empty replicas are allowed; two empty ones give an empty result.
    """
    placed = F.col("archive").isNotNull() & F.col("record_offset").isNotNull()
    a, b = (stage(r.where(placed).select(*RECORD), "warc-leaves") for r in (a, b))
    levels = level_count(a, b)
    trees = [merkle_levels(r, levels) for r in (a, b)]
    suspects = stage(_differing(trees[0][-1], trees[1][-1]), "merkle-differing")
    for level in range(levels - 2, -1, -1):
        up = F.lit(0) if level == levels - 2 else F.floor(F.col("node") / FANOUT)
        parent = suspects.withColumnRenamed("node", "parent")
        below = [
            tree[level].withColumn("parent", up.cast("long")).join(parent, ["archive", "parent"], "left_semi").drop("parent")
            for tree in trees
        ]
        suspects = stage(_differing(*below), "merkle-differing")
    in_range = F.floor(F.col("record_offset") / RANGE_BYTES)
    left = [r.withColumn("node", in_range).join(suspects, ["archive", "node"], "left_semi") for r in (a, b)]

    def named(r: DataFrame, s: str) -> DataFrame:
        whole = F.array_sort(F.collect_list(F.struct("record_sha256", "record_length")))
        return r.groupBy("archive", "record_offset").agg(
            F.min("record_id").alias(f"id_{s}"), F.min("record_sha256").alias(f"sha256_{s}"), whole.alias(f"all_{s}")
        )

    both = named(left[0], "a").join(named(left[1], "b"), ["archive", "record_offset"], "full")
    fault = F.when(F.col("all_b").isNull(), "missing").when(F.col("all_a").isNull(), "added").otherwise("changed")
    return both.where(~F.col("all_a").eqNullSafe(F.col("all_b"))).select(
        "archive", "record_offset", F.coalesce("id_a", "id_b").alias("record_id"), fault.alias("fault"), "sha256_a", "sha256_b"
    )


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves of the pages' archives and of a second replica, which the tables do not hold, with faults in it.

    Of every 97 record ids, number 13 has the last letter of its page overwritten; of every 211, number 5 is
    lost. All others keep their offsets, as in a copied file with bad sectors.
    """
    overwritten = F.expr("concat(left(record, length(record) - 5), '#', right(record, 4))")
    second = F.when(F.col("record_id") % 97 == 13, F.sha2(overwritten, 256)).otherwise(F.col("record_sha256"))
    lost = F.coalesce(F.col("record_id") % 211 == 5, F.lit(False))
    rows = warc_records(pages).withColumns({"second": second, "lost": lost}).drop("record")
    placed = stage(with_offsets(rows), "warc-replicas")
    damaged = placed.where(~F.col("lost")).withColumn("record_sha256", F.col("second"))
    return placed.select(*RECORD), damaged.select(*RECORD)
