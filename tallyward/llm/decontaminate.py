"""Benchmark decontamination: short test items inside documents of any length.

Containment (the share of an item's distinct word shingles that a document has) is searched by MinHash.
A fixed signature per document cannot work: a 40-word item inside a 20,000-word document has a Jaccard
similarity near 0.002, so even with size partitions most band schemes miss it. So the signature follows
the item's size: items are partitioned by their number of shingles q, and an item of size q is
represented by its floor((1 - t) q) + 1 smallest shingle hashes. A document that contains at least the
share t of the item lacks at most floor((1 - t) q) of its shingles, so it has at least one of these:
the search misses nothing. Candidates are verified by exact shingle containment, on the words themselves.

Items are taken in blocks of bounded size; a block travels to the tasks, and documents stay where they
are, so nothing is shuffled. One block holds about BLOCK_WORDS words, and benchmarks beyond that cost
another scan of the documents per block.
"""

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = Fraction(4, 5)
BLOCK_WORDS = 500_000

#: ASCII: letters in lower case, digits as they are, anything else a space. Other bytes stay.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass
class ItemBlock:
    """A bounded number of items, ready to be looked for. Plain containers only."""

    shares: Fraction
    ids: list = field(default_factory=list)
    sets: list[set[bytes]] = field(default_factory=list)
    vocabulary: set[bytes] = field(default_factory=set)
    #: Shingle width and size partition (q below a power of two) -> smallest hashes -> items.
    signatures: dict = field(default_factory=dict)
    #: Per width and size partition: the largest hash in any signature. Short items reach furthest, as they have
    #: few shingles to take the smallest of; larger document hashes are not looked up in a partition.
    reach: dict = field(default_factory=dict)

    def add(self, item_id, text: str | None) -> None:
        words = words_of(text)
        if not words:
            return
        width = min(SHINGLE_WORDS, len(words))
        own = _shingles(words, width)
        at = len(self.ids)
        self.ids.append(item_id)
        self.sets.append(own)
        self.vocabulary.update(words)
        smallest = sorted(xxhash.xxh64_intdigest(s) for s in own)[: math.floor((1 - self.shares) * len(own)) + 1]
        key = width, len(own).bit_length()
        partition = self.signatures.setdefault(key, defaultdict(list))
        for h in smallest:
            partition[h].append(at)
        self.reach[key] = max(self.reach.get(key, 0), smallest[-1])

    def found_in(self, text: str | None) -> list[tuple[int, int]]:
        """(item, number of its shingles in the text) of each item contained in the text."""
        words = words_of(text)
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        upto = np.concatenate(([0], np.cumsum(known)))
        hits = []
        for width in {width for width, _ in self.reach}:
            # A shingle of any item has only words of the items.
            starts = np.flatnonzero(upto[width:] - upto[:-width] == width)
            own = {b" ".join(words[i : i + width]) for i in starts.tolist()}
            hashes = sorted(map(xxhash.xxh64_intdigest, own))
            candidates = {
                item
                for key, partition in self.signatures.items()
                if key[0] == width
                for h in hashes[: bisect_right(hashes, self.reach[key])]
                for item in partition.get(h, ())
            }
            for item in candidates:
                shared = len(self.sets[item] & own)
                if shared >= self.shares * len(self.sets[item]):
                    hits.append((item, shared))
        return sorted(hits)


def item_blocks(items: DataFrame, share: Fraction, block_words: int = BLOCK_WORDS) -> Iterator[ItemBlock]:
    """The items in blocks of about block_words words, one block on the driver at a time."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        block = ItemBlock(share)
        for item_id, text in texts.where(number == k).toLocalIterator():
            block.add(item_id, text)
        yield block


def contaminated(
    docs: DataFrame, items: DataFrame, share: Fraction = CONTAINMENT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document row and item it contains: doc_id, item_id, shared, item_shingles, containment.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Words are runs of ASCII
    letters, digits and non-ASCII characters, letters A-Z in lower case; shingles are five words (an item of
    fewer words is one shingle). NULL and empty texts contain nothing, and items without a word are in no
    document. Repeated rows give repeated results; NULL ids are returned as they are. Empty tables give an
    empty result.
    """
    schema = f"doc_id BIGINT, item_id {items.schema['item_id'].dataType.simpleString()}, shared BIGINT, item_shingles BIGINT"
    context, found = docs.sparkSession.sparkContext, None
    for block in item_blocks(items, share, block_words):
        sent = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                hits = [(d.as_py(), h) for d, t in zip(*batch.columns) for h in block.found_in(t.as_py())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([d for d, _ in hits], pa.int64()),
                        "item_id": [block.ids[i] for _, (i, _) in hits],
                        "shared": pa.array([n for _, (_, n) in hits], pa.int64()),
                        "item_shingles": pa.array([len(block.sets[i]) for _, (i, _) in hits], pa.int64()),
                    }
                )

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def decontaminate(
    docs: DataFrame, items: DataFrame, share: Fraction = CONTAINMENT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item (see contaminated)."""
    context = docs.sparkSession.sparkContext
    for block in item_blocks(items, share, block_words):
        sent = context.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not sent.value.found_in(t.as_py()) for t in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
