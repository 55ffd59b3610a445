"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components.

Fingerprints of 64 bits are cut into six blocks. Two that differ in at most 3 bits agree on at least
three whole blocks, so they share the key of one of the 20 choices of three blocks (about 32 bits).

Only distinct fingerprints are joined. Rows of one key are compared inside one task, in blocks of bounded
size, and only a spanning forest of the links of a key leaves it, never all pairs. A key with more than
CROWD fingerprints is not compared as one group: its fingerprints get finer keys, 13 of 16 blocks of
4 bits (close pairs share one of these 560 choices too). Such a key leaves 12 bits free, so no group of
that kind can hold more than 4,096 distinct fingerprints.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.components import components
from tallyward.session import stage

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
CROWD = 4096
#: Hashes that are turned into bits at a time, whatever the length of a text.
HASHES_PER_STEP = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of one text: lower-cased A-Z, words between ASCII white space, word shingles."""
    words = (text or "").encode().lower().split()  # on bytes, both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - shingle_words + 1)
    ends = ends[-last:]
    ones, total = np.zeros(64, np.int64), last
    for at in range(0, last, HASHES_PER_STEP):
        spans = zip(starts[at : min(at + HASHES_PER_STEP, last)].tolist(), ends[at : at + HASHES_PER_STEP].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0]
    return int(value)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(values, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])


def _text_hash() -> Column:
    return F.xxhash64("text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed BIGINT; one row per input row."""
    rows = docs.select("doc_id", _text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id BIGINT, text_hash BIGINT, fp BIGINT")


def block_masks(blocks: int, differing: int = MAX_DISTANCE) -> list[int]:
    """Masks of all choices of `blocks - differing` whole blocks, as signed 64-bit values."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    spans = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(spans, blocks - differing)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame, blocks: int) -> DataFrame:
    """Each fingerprint once per mask: mask_no, key, fp."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(blocks)])
    keyed = prints.select("fp", F.posexplode(masks).alias("mask_no", "mask"))
    return keyed.select("mask_no", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what links of at most `distance` bits connect among the values.

    Breadth first; each value is compared once with all that are not reached yet.
    """
    bits, edges = values.view(np.uint64), []
    left = np.arange(len(values))
    while len(left):
        border, left = [int(left[0])], left[1:]
        while border and len(left):
            at = border.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= distance
            reached, left = left[near], left[~near]
            edges += [(int(values[at]), int(values[i])) for i in reached]
            border += reached.tolist()
    return edges


def _linker(distance: int):
    """Compare the fingerprints of each run of equal (mask_no, key) in rows sorted by them."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask_no", "key", "fp")])
            rows = rows if carried is None else np.concatenate([carried, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
            carried = rows[:, cuts[-1] :]  # its key may go on in the next batch
            yield _links(rows[2], cuts, distance)
        if carried is not None:
            yield _links(carried[2], np.array([0, carried.shape[1]]), distance)

    return link


def _links(values: np.ndarray, cuts: np.ndarray, distance: int) -> pa.RecordBatch:
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]  # by far the most common case, compared all at once
    a, b = values[two], values[two + 1]
    near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance
    src, dst = [a[near]], [b[near]]
    for i in np.flatnonzero(sizes > 2):
        if found := _forest(values[cuts[i] : cuts[i + 1]], distance):
            pairs = np.array(found, np.int64)
            src.append(pairs[:, 0])
            dst.append(pairs[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def _compare(keyed: DataFrame, distance: int) -> DataFrame:
    dealt = keyed.repartition("mask_no", "key").sortWithinPartitions("mask_no", "key")
    return dealt.mapInArrow(_linker(distance), "src BIGINT, dst BIGINT")


def close_links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges src, dst between distinct fingerprints that connect all pairs of at most 3 differing bits."""
    keyed = _keyed(prints, 6)
    sizes = keyed.groupBy("mask_no", "key").agg(F.count(F.lit(1)).alias("size"))
    crowded = stage(sizes.where(F.col("size") > crowd).select("mask_no", "key"), "crowded-keys")
    calm = keyed.join(crowded, ["mask_no", "key"], "left_anti")
    in_crowd = keyed.join(crowded, ["mask_no", "key"], "left_semi").select("fp").distinct()
    links = _compare(calm, MAX_DISTANCE)
    if crowded.head(1):
        links = links.unionByName(_compare(_keyed(in_crowd, 16), MAX_DISTANCE))
    return links


def _classed(docs: DataFrame, crowd: int) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fp, component (a fingerprint) and component_id."""
    printed = stage(fingerprints(docs), "fingerprints")
    distinct = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    linked = components(close_links(distinct.select("fp"), crowd), "fingerprint-links")
    whole = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    whole = whole.withColumn("component", F.coalesce("component", "fp"))
    named = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = stage(whole.join(named, "component").select("fp", "component", "component_id"), "fingerprint-classes")
    return printed.join(classes, "fp")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 3 differing bits, itself
    included. Equal fingerprints always link, so repeated rows and copies share a component. NULL and
    empty texts, and texts of white space, have fingerprint zero and link like any other. A row without
    doc_id takes part; it never names a component (NULL only if no row reached has a doc_id). Columns
    other than doc_id and text are ignored; an empty table gives an empty result.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _classed(docs, crowd).select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of several texts of that doc_id
    the one with the smallest hash. A row without doc_id stays only where its component has no doc_id.
    Of equal rows (the same doc_id and text) one stays. Columns of any name come through unchanged.
    """
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    rows = _classed(docs, crowd).groupBy("component", key.alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("component").agg(F.min(F.struct("key", "rows")).alias("best"))
    best = stage(best.select(F.col("best.key").alias("best"), F.col("best.rows").alias("rows")), "simhash-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", _text_hash().alias("text_hash"))
    keyed = docs.select(row, mine.alias("key"))

    def kept(chosen: DataFrame) -> DataFrame:
        return keyed.join(chosen.select("best"), F.col("key").eqNullSafe(F.col("best")), "left_semi")

    # Only rows that are there more than once are grouped with their texts.
    found = kept(best.where("rows = 1"))
    if best.where("rows > 1").head(1):
        found = found.unionByName(kept(best.where("rows > 1")).dropDuplicates(["key"]))
    return found.select("row.*")
