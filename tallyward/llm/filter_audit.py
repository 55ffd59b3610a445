"""How five document filters interact over all orders in which they can be applied.

A document is fully described by its mask: the set of filters it fails. Five filters have 120 orders of five
steps, and a mask alone says at which step of an order a document goes. So every mask maps to one wide integer
of 600 fields, one per order and step, with a 1 where such a document is removed. The integers of all
documents of a part are added up, each task adding its own rows first, and one sum then holds all 600 counts.

Further fields hold the rows, the rows that fail each filter, and the rows that fail it alone; what is kept and
what fails redundantly follows from them. A field has 64 bits and no table has 2**63 rows, so no sum can carry
over into the next field, whatever the data.
"""

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import stage

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = len(FILTERS)
FIELD_BYTES = 8
#: Fields after those of the steps: rows, rows failing each filter, rows failing it alone.
ROWS = len(ORDERS) * STEPS
FAILS = ROWS + 1
ALONE = FAILS + STEPS
FIELDS = ALONE + STEPS
#: Sums of one part that meet in one task before the last addition.
FAN_IN = 64
#: Parts a task holds before it passes its sums on (some 15 KB each), so that endless parts need bounded memory.
PARTS_HELD = 1024

MIN_WORDS = 200
WHITE = " \t\n\v\f\r"
SYMBOLS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUMS = ("documents", "good", "toxic")
_SUM_SCHEMA = "part STRING, documents BINARY, good BINARY, toxic BINARY"


def packed_outcomes() -> list[int]:
    """The wide integer of each mask; filter number f is bit f of the mask."""
    table = []
    for mask in range(1 << STEPS):
        fields = []
        for at, order in enumerate(ORDERS):
            first = next((step for step, name in enumerate(order) if mask >> FILTERS.index(name) & 1), None)
            fields += [] if first is None else [at * STEPS + first]
        failed = [f for f in range(STEPS) if mask >> f & 1]
        fields += [ROWS] + [FAILS + f for f in failed]
        if len(failed) == 1:
            fields.append(ALONE + failed[0])
        table.append(sum(1 << 8 * FIELD_BYTES * field for field in fields))
    return table


def unpack(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, "<i8", FIELDS)


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text alone decides: A, B, C and D."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed != "", F.split(trimmed, f"[{WHITE}]+")).otherwise(F.array().cast("array<string>"))

    def bits(words: Column) -> Column:
        count = F.size(words)
        return (
            F.when(count < MIN_WORDS, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(words)) < 50 * count, 2).otherwise(0)
        )

    length, lower = F.length(text), F.length(F.translate(text, UPPER, ""))
    # The words are made once, whatever Catalyst does with a column that is used three times.
    return (
        F.element_at(F.transform(F.array(words), bits), 1)
        + F.when(100 * (length - lower).cast("long") > 3 * length.cast("long"), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    )


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, mask, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            F.coalesce("lang", F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            text_mask(F.col("text")).alias("mask"),
        ),
        "audit-rows",
    )
    # Only texts that occur more than once can fail E; one row of each goes back to its copies.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.where("copies > 1").drop("copies")
    marks = labels.groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    repeats = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return (
        rows.join(firsts, "digest", "left")
        .withColumn("mask", F.col("mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0))
        .join(marks, "doc_id", "left")
        .select(
            "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
        )
    )


def _held() -> tuple[dict, callable, callable]:
    """Sums by part: the dictionary, an addition, and a record batch of what it holds."""
    held = {}

    def add(part: str, sums: tuple[int, int, int]) -> None:
        known = held.get(part, (0, 0, 0))
        held[part] = tuple(a + b for a, b in zip(known, sums))

    def flush() -> pa.RecordBatch:
        columns = [[total.to_bytes(FIELDS * FIELD_BYTES, "little") for total in column] for column in zip(*held.values())]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), *[pa.array(c, pa.binary()) for c in columns or [[]] * len(SUMS)]],
            names=["part", *SUMS],
        )
        held.clear()
        return batch

    return held, add, flush


def _add_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packed = packed_outcomes()
    held, add, flush = _held()
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["part", "mask"])
        counted = table.aggregate([("good", "count"), ("good", "sum"), ("toxic", "sum")])
        rows, good, toxic = (counted.column(f"{c}").to_pylist() for c in ("good_count", "good_sum", "toxic_sum"))
        for part, mask, *counts in zip(counted.column("part").to_pylist(), counted.column("mask").to_pylist(), rows, good, toxic):
            add(part, tuple(n * packed[mask] for n in counts))
            if len(held) >= PARTS_HELD:
                yield flush()
    yield flush()


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, add, flush = _held()
    for batch in batches:
        for part, *sums in zip(*(batch.column(c).to_pylist() for c in ("part", *SUMS))):
            if part not in held and len(held) >= PARTS_HELD:
                yield flush()
            add(part, tuple(int.from_bytes(s, "little") for s in sums))
    yield flush()


def part_sums(rows: DataFrame) -> DataFrame:
    """The three sums of each part. Rows are added in their own task, then FAN_IN by FAN_IN, then per part, so a part
    with all rows of the table is spread like any other."""
    local = rows.select(
        "part", F.col("mask").cast("int"), F.col("good").cast("int"), F.col("toxic").cast("int")
    ).mapInArrow(_add_documents, _SUM_SCHEMA)
    local = stage(local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))), "audit-sums")
    # Rows of a part stand together, so a flush never splits it.
    salted = local.repartition("part", "salt").drop("salt").sortWithinPartitions("part").mapInArrow(_add_sums, _SUM_SCHEMA)
    return salted.repartition("part").sortWithinPartitions("part").mapInArrow(_add_sums, _SUM_SCHEMA)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part STRING, filter_order STRING, step INT, " + ", ".join(f"{c} BIGINT" for c in COUNTS)


def _unpack_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
    schema = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = ["part", "filter_order", "step", *COUNTS]
    for batch in batches:
        for part, *sums in zip(*(batch.column(c).to_pylist() for c in ("part", *SUMS))):
            documents, good, toxic = map(unpack, sums)
            removed = documents[:ROWS].reshape(-1, STEPS)
            shapley = np.array([removed[number == f].sum() for f in range(STEPS)])
            columns = [
                [part] * ROWS,
                np.repeat(ORDERS, STEPS),
                np.tile(np.arange(1, STEPS + 1), len(ORDERS)),
                documents[ROWS] - removed.cumsum(axis=1),
                removed,
                documents[FAILS:ALONE][number] - removed,
                documents[ALONE:][number],
                good[:ROWS],
                toxic[:ROWS],
                shapley[number],
            ]
            arrays = [pa.array(c if isinstance(c, list) else c.reshape(-1), t) for c, t in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step (RESULT): how many documents the step's filter keeps and removes there,
    how many it would have removed that were gone already (redundant), how many fail it alone, how many removed ones
    have quality 1 (good_lost) or toxic 1 (toxic_lost), and its removals over all orders (shapley).

    docs needs doc_id, text and lang; labels doc_id, quality and toxic; other columns are ignored. A part is a value
    of lang; NULL and empty are one part. A NULL text counts as empty: it fails A alone, and E if a smaller doc_id
    has an empty text. E compares SHA-256 digests of whole texts over all parts. Rows that repeat a doc_id are
    counted each and do not make each other fail E; a row without doc_id never fails E and makes no other fail it.
    Of several labels of a doc_id one with 1 is enough; labels without a document change nothing. An empty table
    gives an empty result.
    """
    return part_sums(masked(docs, labels)).mapInArrow(_unpack_parts, RESULT)
