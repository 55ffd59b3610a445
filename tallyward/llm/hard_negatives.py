"""Hard negatives for anchors among vectors, with segment summaries in front of exact scores.

Every vector is stored with the mean and the deviation (root of the sum of squared differences from the mean) of its
segments, at two levels: 4 long segments and 16 short ones. With segments of n components, means m and deviations d,
an inner product lies within sum(n * m * m') plus or minus sum(d * d'), by Cauchy and Schwarz. Pairs whose upper
bound is below what an anchor already has, or whose bounds miss the band that is looked for, are dropped at the
long segments, then at the short ones; what is left is scored exactly on the integer components.

Anchors go to the tasks in blocks of about ANCHORS rows, a bounded number of bytes, and each block meets all rows, which
are read in tiles. Each task keeps the best TOP rows of each search, so what leaves it grows with the anchors of the
block and not with the rows, and a window over those gives the overall best. Only blocks of anchors and of their
positives pass the driver, never the rows.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import new_dir, stage

SCALE = 256
CLASSES = 10
MOVED_EVERY = 7
ANCHOR_EVERY = 100
TOP = 5
#: A negative's score is at least this share of the positive's, in percent.
LEAST_PERCENT = 80
#: Segments per vector, level by level.
LEVELS = (4, 16)
ANCHORS = 8192
ROW_TILE, ANCHOR_TILE = 1024, 1024
#: Up to this share of a tile's pairs, pairs are refined one by one instead of all together.
FEW = 0.04
_NONE = np.iinfo(np.int64).min

Vectors = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
RESULT = "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, positive_score BIGINT, negative_score BIGINT"
SUMMARY = "vec_id BIGINT, label BIGINT, vector ARRAY<BIGINT>, means ARRAY<DOUBLE>, deviations ARRAY<DOUBLE>"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector: integer components of the rows that take part, one row per vec_id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    said = F.struct(moved.cast("long").alias("label"), scaled.alias("vector"))
    rows = rows.where(sound).select(F.col("vec_id").cast("long"), said.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.vector")


def _padded(lists: pa.Array, width: int, dtype) -> np.ndarray:
    """Lists as rows of a matrix; missing components are 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _summaries(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _padded(batch.column("vector"), width, np.float64)
        means, deviations = [], []
        for level in LEVELS:
            parts = vectors.reshape(len(vectors), level, width // level)
            mean = parts.mean(axis=2)
            means.append(mean)
            deviations.append(np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2)))
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * sum(LEVELS))
        columns = [pa.ListArray.from_arrays(offsets, np.concatenate(c, axis=1).ravel()) for c in (means, deviations)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "means", "deviations"])


def summarise(vectors: DataFrame, width: int) -> DataFrame:
    """vectors with the means and deviations of their segments, the long ones first."""
    return vectors.mapInArrow(partial(_summaries, width), SUMMARY)


def _unpacked(batch: pa.RecordBatch, width: int) -> Vectors:
    """ids, labels, vectors, means, deviations."""
    return (
        batch.column("vec_id").to_numpy(),
        batch.column("label").to_numpy(),
        _padded(batch.column("vector"), width, np.int64),
        _padded(batch.column("means"), sum(LEVELS), np.float64),
        _padded(batch.column("deviations"), sum(LEVELS), np.float64),
    )


class Search:
    """The best TOP rows, higher scores first, then smaller ids, of each anchor and band seen so far.

    low and high are the bands, one row per anchor and one column per band of it, both ends included.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high
        self.scores = np.full((*low.shape, TOP), _NONE)
        self.ids = np.zeros((*low.shape, TOP), np.int64)

    def floor(self) -> np.ndarray:
        """Per anchor the least score that some band still takes."""
        return np.maximum(self.low, self.scores[:, :, -1]).min(axis=1)

    def ceiling(self) -> np.ndarray:
        return self.high.max(axis=1)

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for band in range(self.low.shape[1]):
            least = np.maximum(self.low[anchors, band], self.scores[anchors, band, -1])
            wanted = (scores >= least) & (scores <= self.high[anchors, band])
            if not wanted.any():
                continue
            a, s, i = anchors[wanted], scores[wanted], ids[wanted]
            held = np.unique(a)
            a = np.concatenate([np.repeat(held, TOP), a])
            s = np.concatenate([self.scores[held, band].ravel(), s])
            i = np.concatenate([self.ids[held, band].ravel(), i])
            order = np.lexsort((i, ~s, a))  # ~s falls as s grows, also at the least number
            a, s, i = a[order], s[order], i[order]
            first = np.searchsorted(a, held)
            for place in range(TOP):  # every held anchor has TOP entries at least
                self.scores[held, band, place], self.ids[held, band, place] = s[first + place], i[first + place]


def _bounds(a: Vectors, r: Vectors, level: int, width: int, pairs=None) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the range of scores, of all pairs as matrices or of some pairs one by one."""
    cut = slice(sum(LEVELS[:level]), sum(LEVELS[: level + 1]))
    (am, ad), (rm, rd) = ((t[3][:, cut], t[4][:, cut]) for t in (a, r))
    if pairs is None:
        return (width // LEVELS[level]) * (am @ rm.T), ad @ rd.T
    at, row = pairs
    return (width // LEVELS[level]) * np.einsum("ij,ij->i", am[at], rm[row]), np.einsum("ij,ij->i", ad[at], rd[row])


def _norms(t: Vectors, width: int) -> np.ndarray:
    long = slice(0, LEVELS[0])
    return np.sqrt((t[3][:, long] ** 2).sum(axis=1) * (width // LEVELS[0]) + (t[4][:, long] ** 2).sum(axis=1))


def _largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))


def search_tile(a: Vectors, r: Vectors, search: Search, start: int, same: bool, width: int) -> None:
    """Look through all pairs of an anchor tile, whose anchors stand at `start` in the search, and a row tile."""
    here = slice(start, start + len(a[0]))
    floor, ceiling = search.floor()[here, None], search.ceiling()[here, None]
    alive = (a[1][:, None] == r[1][None, :]) == same
    if same:
        alive &= a[0][:, None] != r[0][None, :]
    # More than rounding can do to a bound.
    slack = 1e-9 + 1e-12 * _norms(a, width).max(initial=0) * _norms(r, width).max(initial=0)
    pairs = None
    for level in range(len(LEVELS)):
        middle, spread = _bounds(a, r, level, width, pairs)
        spread += slack
        if pairs is None:
            if same and (search.scores[here, 0, -1] == _NONE).any() and len(r[0]) >= TOP:
                # Not all places are taken: the fifth best lower bound is as good as a fifth score.
                lower = np.where(alive, middle - spread, -np.inf)
                floor = np.maximum(floor, np.partition(lower, -TOP, axis=1)[:, -TOP, None])
            alive &= (middle + spread >= floor) & (middle - spread <= ceiling)
            if np.count_nonzero(alive) <= FEW * alive.size:
                pairs = np.nonzero(alive)
        else:
            keep = (middle + spread >= floor[pairs[0], 0]) & (middle - spread <= ceiling[pairs[0], 0])
            pairs = pairs[0][keep], pairs[1][keep]
    small = _largest(a[2]) * _largest(r[2]) * width
    if small >= 1 << 63:
        raise OverflowError("components whose scores need more than 63 bits")
    if pairs is None and small < 1 << 53:
        # Whole numbers below 2**53 stay exact in floating point.
        scores = a[2].astype(np.float64) @ r[2].astype(np.float64).T
        alive &= (scores >= floor) & (scores <= ceiling)
        pairs = np.nonzero(alive)
        scores = scores[pairs].astype(np.int64)
    else:
        pairs = np.nonzero(alive) if pairs is None else pairs
        scores = np.einsum("ij,ij->i", a[2][pairs[0]], r[2][pairs[1]])
    search.add(pairs[0] + start, scores, r[0][pairs[1]])


def _tiles(columns: Vectors, size: int) -> Iterator[tuple[int, Vectors]]:
    for start in range(0, len(columns[0]), size):
        yield start, tuple(c[start : start + size] for c in columns)


def _best(anchors: Vectors, low: np.ndarray, high: np.ndarray, same: bool, width: int, batches: Iterator[pa.RecordBatch]):
    """The best rows of this task for each anchor and band: anchor, band, id, score."""
    search = Search(low, high)
    anchor_tiles = list(_tiles(anchors, ANCHOR_TILE))
    for batch in batches:
        for _, rows in _tiles(_unpacked(batch, width), ROW_TILE):
            for start, tile in anchor_tiles:
                search_tile(tile, rows, search, start, same, width)
    at, band, place = np.nonzero(search.scores != _NONE)
    columns = [anchors[0][at], band, search.ids[at, band, place], search.scores[at, band, place]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "band", "id", "score"])


def best(rows: DataFrame, anchors: Vectors, low: np.ndarray, high: np.ndarray, same: bool, width: int) -> DataFrame:
    """anchor_id, band, id, score and place (from 1) of the best TOP rows of each anchor and band, with the anchor's label or
    with another."""
    found = rows.mapInArrow(
        partial(_best, anchors, low, high, same, width), "anchor_id BIGINT, band BIGINT, id BIGINT, score BIGINT"
    )
    order = W.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings needs vec_id, label and embedding; other columns are ignored. Rows without vec_id, label or embedding, and
    rows with a missing or non-finite component, take no part. Rows that repeat a vec_id are one row, the one with the
    smallest label, then the smallest vector. Vectors of different length are compared as if the shorter ended in
    zeros; an empty vector scores 0 with all. Equal scores go by the smaller vec_id. A positive of negative score has no
    negatives, as no score is both at least 80 % of it and at most it. Scores beyond 63 bits raise an error. An empty
    table gives an empty result.
    """
    spark = embeddings.sparkSession
    vectors = stage(usable(embeddings), "vectors")
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    facts = vectors.agg(F.max(F.size("vector")).alias("width"), F.count_if(is_anchor).alias("anchors")).first()
    width = max(LEVELS[-1], -(-(facts.width or 0) // LEVELS[-1]) * LEVELS[-1])
    rows = stage(summarise(vectors, width), "vector-summaries")
    result = spark.createDataFrame([], RESULT)
    out, blocks = new_dir(spark, "hard-negatives"), -(-facts.anchors // ANCHORS)
    for block in range(blocks):
        mine = rows.where(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block))
        sent = mine.toArrow().combine_chunks().to_batches()
        if not sent:
            continue
        anchors = _unpacked(sent[0], width)
        n = len(anchors[0])
        everything = np.full((n, 1), _NONE), np.full((n, 1), np.iinfo(np.int64).max)
        positives = stage(best(rows, anchors, *everything, True, width), "positives")
        near = positives.toArrow()  # at most TOP rows per anchor of the block

        # A band of each positive. Bands without a positive, or with a score below 0, are empty.
        position = {int(i): k for k, i in enumerate(anchors[0])}
        low, high = np.zeros((n, TOP), np.int64), np.full((n, TOP), -1)
        for anchor, place, score in zip(*(near.column(c).to_pylist() for c in ("anchor_id", "place", "score"))):
            if score >= 0:
                at = position[anchor], place - 1
                low[at], high[at] = -(-LEAST_PERCENT * score // 100), score
        negatives = best(rows, anchors, low, high, False, width).withColumnsRenamed(
            {"id": "negative_id", "score": "negative_score", "place": "rank"}
        )
        bands = positives.select(
            "anchor_id",
            (F.col("place") - 1).cast("long").alias("band"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        found = negatives.join(bands, ["anchor_id", "band"])
        found.select(*result.columns).write.mode("overwrite").parquet(f"{out}/block={block}")
    return spark.read.schema(result.schema).parquet(f"{out}/block=*") if blocks else result
