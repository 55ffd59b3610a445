"""Mixing sources to target weights, in blocks of words dealt to output shards.

1. Sources weigh 5, 2, 1, 5, 2, 1, ... by code point and share GROWTH times all words. A source gives at most
   MOST_REPEATS times its own words; what is above is shared by the others by weight (`source_targets`).
2. The texts of a source stand one behind the other in a pseudorandom order, cut into blocks of BLOCK_WORDS
   words (`pack`). Only the last block of a source is shorter.
3. The mix has one slot for each block it takes. Every output shard of SHARD_SLOTS slots draws from a multinomial
   distribution how many slots each source gets there (`draw`). Sources are drawn in at most BUNDLES bundles,
   then inside their bundle, so that what is sent to the tasks stays bounded.
4. Draws add up to a little more or less than what a source is to give. Surplus slots, chosen pseudorandomly, pass
   to the sources that lack some, rank by rank (`slots`), so totals are exact.
5. Slot numbers of a source map through a pseudorandom permutation of its block numbers, another for each pass over
   the source, and slots are joined to blocks by number. The last slot of a source takes the first words
   of its block only, so that a source gives its target to the word.

Permutations are Feistel networks with cycle walking and need no table, and no step sees a source in one task except
as one row per source or one per source and shard.
"""

from collections.abc import Iterator
from functools import partial
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import stage

WEIGHTS = (5, 2, 1)
#: Words of the mix for each two words of all sources.
WORDS_OF_TWO = 3
MOST_REPEATS = 2
BLOCK_WORDS = 512
SHARD_SLOTS = 8192
BUNDLES = 4096
SEED = 20240101
ROUNDS = 6
WHITE = " \t\n\v\f\r"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for NULL."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed != "", F.size(F.split(trimmed, f"[{WHITE}]+"))).otherwise(0).cast("long")


def _mixed(values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (multiply and shift)."""
    x = values + key
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index (0 to size - 1) under a pseudorandom permutation of its size and key."""
    x, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64))).astype(np.uint64), 1)
    half = (bits + np.uint64(2)) // np.uint64(2)  # one bit to spare for the rounding of the logarithm
    out, left = x.copy(), np.arange(len(x))
    while len(left):
        h, k = half[left], key[left]
        mask = (np.uint64(1) << h) - np.uint64(1)
        a, b = out[left] >> h, out[left] & mask
        for step in range(ROUNDS):
            a, b = b, a ^ (_mixed(b, k + np.uint64(0x9E3779B97F4A7C15 * (step + 1) & (1 << 64) - 1)) & mask)
        out[left] = a << h | b
        left = left[out[left] >= size[left]]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: s (its number, from 1), source, source_size, target (double), goal (target in whole words),
    blocks, slots.

    Passes over single sources, never documents. A source reaches its limit if the limit of it and of all
    sources that are sooner there, and their like for the others, add up to no more than the mix.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    numbered = totals.withColumn("s", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("s") - 1) % len(WEIGHTS) + 1).cast("int"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    sooner = W.orderBy(F.expr(f"source_size * {lcm(*WEIGHTS)} div weight"), "s")
    everywhere = W.partitionBy()
    full = (
        numbered.withColumn("weight", weight.cast("long"))
        .withColumn("limit", F.lit(MOST_REPEATS) * F.col("source_size"))
        .withColumn("double_mix", F.lit(WORDS_OF_TWO) * F.sum("source_size").over(everywhere))
        .withColumn("before", F.coalesce(F.sum("limit").over(sooner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(sooner.rowsBetween(0, W.unboundedFollowing)))
        .withColumn(
            "full",
            2 * (whole("before") * whole("weight") + whole("limit") * whole("open_weight"))
            <= whole("double_mix") * whole("weight"),
        )
        .withColumn("given", F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everywhere), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere))
    )
    shared = F.col("weight") * (F.col("double_mix") - 2 * F.col("given")).cast("double") / (2 * F.col("sharing"))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared)
    goal = F.least(F.col("limit"), F.floor(F.col("target") + 0.5))
    size = F.greatest("source_size", F.lit(1))
    return (
        full.withColumn("target", target)
        .withColumn("goal", goal)
        .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
        .withColumn("passes", F.expr("goal div greatest(source_size, 1)"))
        .withColumn("rest", F.col("goal") % size)
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK_WORDS))
        .select("s", "source", "source_size", "target", "goal", "blocks", "rest", "slots")
    )


def _running_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`before`: words of the same source earlier in this range of rows, which are sorted by source."""
    source, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        s, size = (batch.column(c).to_numpy() for c in ("s", "size"))
        before = np.concatenate(([0], np.cumsum(size)[:-1]))
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        base = before[starts].copy()
        if s[0] == source:
            base[0] -= total
        before = before - np.repeat(base, np.diff(np.append(starts, len(s))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "before"])
        source, total = s[-1], before[-1] + size[-1]


def pack(sized: DataFrame) -> DataFrame:
    """Add `first`, the place of a row's first word among the words of its source.

    sized has s, doc_id, size, row (unique) and whatever else is to be carried. Ranges of rows are cut by
    source, hash and row, so neither a hot source nor a repeated doc_id fills one of them.
    """
    keys = ("s", "place", "doc_id", "size", "row")
    ranged = (
        sized.withColumn("place", F.xxhash64("doc_id", F.lit(SEED)))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("range", F.spark_partition_id())
    )
    schema = T.StructType(list(ranged.schema)).add("before", T.LongType())
    scanned = stage(ranged.mapInArrow(_running_sizes, schema), "mix-ranges")
    totals = scanned.groupBy("s", "range").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("s").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("s", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carried"))
    return scanned.join(carry, ["s", "range"]).withColumn("first", F.col("carried") + F.col("before")).drop(
        "place", "range", "before", "carried"
    )


def blocks(packed: DataFrame) -> DataFrame:
    """One row for each block that a row with words reaches into: s, block, `at` (its place in the block), from_word (the
    first of its words there, from 0), words, and the columns of packed."""
    start = F.greatest("first", F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    numbers = F.sequence(F.expr(f"first div {BLOCK_WORDS}"), F.expr(f"(first + size - 1) div {BLOCK_WORDS}"))
    return (
        packed.where(F.col("size") > 0)
        .withColumn("block", F.explode(numbers))
        .withColumn("at", start - F.col("block") * BLOCK_WORDS)
        .withColumn("from_word", start - F.col("first"))
        .withColumn("words", end - start)
    )


def _draw_bundles(weights: np.ndarray, total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shares = weights / weights.sum()
    for batch in batches:
        for shard in batch.column("id").to_pylist():
            slots = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
            drawn = np.random.default_rng([SEED, shard]).multinomial(slots, shares)
            some = np.flatnonzero(drawn)
            columns = [np.full(len(some), shard), some, drawn[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "bundle", "drawn"])


def _draw_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "bundle", "drawn", "members")))
        out = []
        for shard, bundle, drawn, members in rows:
            weights = np.array([m["slots"] for m in members], np.float64)
            parts = np.random.default_rng([SEED, shard, bundle]).multinomial(drawn, weights / weights.sum())
            out += [(shard, members[i]["s"], int(parts[i])) for i in np.flatnonzero(parts)]
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "s", "drawn"])


def draw(targets: DataFrame) -> DataFrame:
    """Slots per shard and source: shard, s, drawn, drawn by each shard for itself."""
    spark = targets.sparkSession
    giving = targets.where("slots > 0")
    found = giving.agg(F.sum("slots").alias("total"), F.max("s").alias("sources")).first()
    if not found.total:
        return spark.createDataFrame([], "shard BIGINT, s BIGINT, drawn BIGINT")
    per_bundle = -(-found.sources // BUNDLES)
    member = F.struct("s", "slots")
    bundled = stage(
        giving.groupBy(F.expr(f"(s - 1) div {per_bundle}").alias("bundle")).agg(
            F.array_sort(F.collect_list(member)).alias("members"), F.sum("slots").alias("slots")
        ),
        "mix-bundles",
    )
    weights = np.zeros(BUNDLES)
    for row in bundled.select("bundle", "slots").collect():  # at most BUNDLES rows
        weights[row.bundle] = row.slots
    shards = spark.range(-(-found.total // SHARD_SLOTS))
    drawn = shards.mapInArrow(partial(_draw_bundles, weights, found.total), "shard BIGINT, bundle BIGINT, drawn BIGINT")
    return drawn.join(bundled.drop("slots"), "bundle").mapInArrow(_draw_sources, "shard BIGINT, s BIGINT, drawn BIGINT")


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`slot`: the number of a drawn slot in its source, in pseudorandom order, so that no shard holds all the surplus;
    `place`: its place in its shard."""
    for batch in batches:
        index, size, s, at, held, shard = (
            batch.column(c).to_numpy() for c in ("index", "all_drawn", "s", "at", "held", "shard")
        )
        slot = permuted(index, size, s * 2 + (SEED << 20))
        place = permuted(at, held, shard * 2 + 1)
        columns = [shard, place, s, slot]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "place", "s", "slot"])


def _block_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block of a slot and the words it takes. The short last block of a source keeps its number."""
    for batch in batches:
        s, slot, blocks, slots, size, rest = (
            batch.column(c).to_numpy() for c in ("s", "slot", "blocks", "slots", "source_size", "rest")
        )
        turn, number = slot // blocks, slot % blocks
        full = np.flatnonzero(number < blocks - 1)
        key = s * 64 + turn + (SEED << 24)
        number[full] = permuted(number[full], blocks[full] - 1, key[full])
        words = np.where(number < blocks - 1, BLOCK_WORDS, size - (blocks - 1) * BLOCK_WORDS)
        short = (slot == slots - 1) & (rest > 0)
        words = np.where(short, rest - (-(-rest // BLOCK_WORDS) - 1) * BLOCK_WORDS, words)
        columns = [batch.column("shard"), batch.column("place"), batch.column("s"), pa.array(number), pa.array(words)]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "s", "block", "takes"])


def slots(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per slot of the mix: shard, place, s, block, takes (words from the block's start)."""
    drawn = stage(drawn, "mix-draws")
    source, shard = W.partitionBy("s"), W.partitionBy("shard")
    upto = lambda w, by: w.orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    counted = (
        drawn.withColumn("offset", F.coalesce(F.sum("drawn").over(upto(source, "shard")), F.lit(0)))
        .withColumn("all_drawn", F.sum("drawn").over(source))
        .withColumn("start", F.coalesce(F.sum("drawn").over(upto(shard, "s")), F.lit(0)))
        .withColumn("held", F.sum("drawn").over(shard))
    )
    each = counted.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))  # at most SHARD_SLOTS
    index, at = F.col("offset") + F.col("i"), F.col("start") + F.col("i")
    each = each.select("shard", "s", "all_drawn", "held", index.alias("index"), at.alias("at"))
    numbered = stage(each.mapInArrow(_chosen, "shard BIGINT, place BIGINT, s BIGINT, slot BIGINT"), "mix-slots")

    # One row per source: where its surplus, or what it lacks, stands in the order of all of them.
    sums = targets.join(drawn.groupBy("s").agg(F.sum("drawn").alias("all_drawn")), "s", "left").withColumn(
        "all_drawn", F.coalesce("all_drawn", F.lit(0))
    )
    surplus = F.greatest(F.col("all_drawn") - F.col("slots"), F.lit(0))
    lack = F.greatest(F.col("slots") - F.col("all_drawn"), F.lit(0))
    before = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    plan = stage(
        sums.withColumn("surplus_from", F.coalesce(F.sum(surplus).over(before), F.lit(0)))
        .withColumn("lack_from", F.coalesce(F.sum(lack).over(before), F.lit(0)))
        .withColumn("lack", lack),
        "mix-plan",
    )
    facts = plan.select("s", "slots", "blocks", "source_size", "rest", "surplus_from")
    known = numbered.join(facts, "s")
    enough = F.col("slot") < F.col("slots")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1))
    open_slots = plan.where("lack > 0").withColumn("n", number).select(
        (F.col("lack_from") + F.col("n")).alias("rank"),
        "s",
        (F.col("all_drawn") + F.col("n")).alias("slot"),
        "slots",
        "blocks",
        "source_size",
        "rest",
    )
    rank = F.col("surplus_from") + F.col("slot") - F.col("slots")
    spare = known.where(~enough).select("shard", "place", rank.alias("rank"))
    settled = known.where(enough).drop("surplus_from").unionByName(spare.join(open_slots, "rank").drop("rank"))
    return settled.mapInArrow(_block_numbers, "shard BIGINT, place BIGINT, s BIGINT, block BIGINT, takes BIGINT")


def _prepared(docs: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their sizes and place in their source, and the sources."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried)
    sized = stage(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = stage(source_targets(sized), "mix-sources")
    number = targets.select("s", F.col("source").alias("of"))
    numbered = sized.join(number, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    return stage(pack(numbered), "mix-packed"), targets


def spans(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """The mix: one row per slot and document in it, with shard, place, `at` (place in the block), doc_id, from_word, words
    and the other columns of packed. Ordered by shard, place and at they are the mix itself."""
    dealt = slots(draw(targets), targets)
    taken = F.greatest(F.least(F.col("at") + F.col("words"), F.col("takes")) - F.col("at"), F.lit(0))
    return blocks(packed).join(dealt, ["s", "block"]).withColumn("words", taken).where("words > 0").drop("takes")


def mix_texts(docs: DataFrame) -> DataFrame:
    """The mix as text: shard, place, text. Words of a block are parted by one space; a block is at most
    BLOCK_WORDS words, so the rows gathered for one are bounded."""
    packed, targets = _prepared(docs, "text")
    words = F.split(F.btrim("text", F.lit(WHITE)), f"[{WHITE}]+")
    piece = F.array_join(F.slice(words, F.col("from_word").cast("int") + 1, F.col("words").cast("int")), " ")
    pieces = spans(packed, targets).select("shard", "place", F.struct("at", piece.alias("piece")).alias("p"))
    gathered = pieces.groupBy("shard", "place").agg(F.array_sort(F.collect_list("p")).alias("parts"))
    return gathered.select("shard", "place", F.array_join(F.col("parts.piece"), " ").alias("text"))


def mixture(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (of its source), taken (words the mix takes, repeats
    counted), source.

    docs needs doc_id, text and source; other columns are ignored. Each source gives its target rounded to a whole
    word; no row gives more than twice its size, and the same rows give the same result in any order. A NULL
    text has size 0, and so has one of white space alone; a source of such texts has target 0 and keeps its weight's
    turn. NULL is a source of its own, after all others; an empty source comes first. Rows that repeat a doc_id, or
    have none, are packed each for itself; equal ones may swap what is taken of them. An empty table gives an
    empty result.
    """
    packed, targets = _prepared(docs)
    of_row = spans(packed, targets).groupBy("row").agg(F.sum("words").alias("taken"))
    return (
        packed.join(of_row, "row", "left")
        .join(targets.select("s", "source", "source_size", "target"), "s")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")
    )
