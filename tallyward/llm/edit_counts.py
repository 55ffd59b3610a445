"""Token counts that follow edits: a segment tree of pre-tokens per document.

A byte-level BPE tokenizer cuts a text into pre-tokens by a pattern and encodes each on its own, so a
document's count is a sum over pre-tokens. The tree keeps the characters and tokens of each pre-token in blocks, and
sums over blocks above them. An edit is found by descending the character sums; only pre-tokens that it
touches, with boundary context, are cut and encoded again, and only sums above their blocks change.

Boundary context: the pattern looks at most two characters past a match and never back. So cutting starts two
pre-tokens before the edit, and stops at the first boundary after the edit that was a boundary before: from
there on the same text is cut in the same way.
"""

import base64
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.learning import bounded, small_batches

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTEXT = 2
BLOCK = 64
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000

EDITS = "array<struct<start:int,deleted:int,inserted:string>>"
NAMES = ("doc_id", "text", "chars", "tokens", "block_sizes", "sums")
TREE = "doc_id BIGINT, text STRING, chars ARRAY<INT>, tokens ARRAY<INT>, block_sizes ARRAY<INT>, sums ARRAY<BIGINT>"
RESULT = f"{TREE}, tokens_before BIGINT, tokens_after BIGINT, reencoded BIGINT"


def send_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """Ranks of a vocabulary file on the driver (some 50,000 entries of a few bytes) for all tasks."""
    with open(path, "rb") as lines:
        return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Counter:
    """Cuts text into pre-tokens and counts their tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.cut = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.earlier: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED // 2:
                # Two halves: what was not asked for while one filled up is forgotten with the other.
                self.known, self.earlier = {}, self.known
            n = self.earlier.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
            self.known[piece] = n
        return n


class Tree:
    """Segment tree over blocks of pre-tokens: two sums per node, characters and tokens."""

    def __init__(self, chars: list[int], tokens: list[int], block_sizes: list[int], sums: list[int] | None = None) -> None:
        cuts = [0, *accumulate(block_sizes)]
        self.blocks = [(chars[a:b], tokens[a:b]) for a, b in pairwise(cuts)]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        if sums is not None:
            self.chars, self.tokens = list(sums[: 2 * self.width]), list(sums[2 * self.width :])
            return
        self.chars, self.tokens = [0] * 2 * self.width, [0] * 2 * self.width
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(c), sum(t)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def stored(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """chars, tokens, block_sizes and sums, as the constructor takes them."""
        chars, tokens = ([x for block in self.blocks for x in block[k]] for k in (0, 1))
        return chars, tokens, [len(c) for c, _ in self.blocks], self.chars + self.tokens

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it and start of the pre-token that holds character `at`; the end comes after the last."""
        if at >= self.chars[1]:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), self.chars[1]
        node, start, place = 1, 0, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        sizes = self.blocks[node - self.width][0]
        while at >= start + sizes[place]:
            start += sizes[place]
            place += 1
        return node - self.width, place, start

    def back(self, block: int, place: int, start: int, steps: int) -> tuple[int, int, int]:
        while steps and (block or place):
            if not place:
                block -= 1
                place = len(self.blocks[block][0])
                continue
            place -= 1
            start -= self.blocks[block][0][place]
            steps -= 1
        return block, place, start

    def replace(self, block: int, place: int, old: int, chars: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in place of `old` ones from (block, place) on; update sums above."""
        changed = {block}
        c, t = self.blocks[block]
        here = min(old, len(c) - place)
        c[place : place + here] = chars
        t[place : place + here] = tokens
        old -= here
        while old:
            block += 1
            c, t = self.blocks[block]
            here = min(old, len(c))
            del c[:here], t[:here]
            changed.add(block)
            old -= here
        nodes = set()
        for b in changed:
            self.chars[self.width + b], self.tokens[self.width + b] = (sum(x) for x in self.blocks[b])
            nodes.add((self.width + b) // 2)
        while nodes - {0}:  # level by level, all on the same level
            for i in nodes:
                self._add_up(i)
            nodes = {i // 2 for i in nodes} - {0}

    def following(self, block: int, place: int) -> Iterator[int]:
        """Sizes of the pre-tokens from (block, place) on."""
        for b in range(block, len(self.blocks)):
            yield from self.blocks[b][0][place if b == block else 0 :]


def build(text: str, counter: Counter) -> Tree:
    pieces = counter.cut.findall(text)
    blocks = [min(BLOCK, len(pieces) - i) for i in range(0, len(pieces), BLOCK)] or [0]
    return Tree([len(p) for p in pieces], [counter.count(p) for p in pieces], blocks)


def edit(text: str, tree: Tree, start: int, deleted: int, inserted: str, counter: Counter) -> tuple[str, int]:
    """Apply one edit to text and tree; returns the new text and the number of pre-tokens encoded again."""
    start = min(max(start, 0), len(text))
    deleted = min(max(deleted, 0), len(text) - start)
    changed = text[:start] + inserted + text[start + deleted :]
    shift = len(inserted) - deleted
    block, place, at = tree.back(*tree.find(start), CONTEXT)
    sizes, old_end, old = tree.following(block, place), at, 0
    chars, tokens = [], []
    for match in counter.cut.finditer(changed, at):
        chars.append(match.end() - match.start())
        tokens.append(counter.count(match.group()))
        if match.end() < start + len(inserted):
            continue
        while old_end < max(match.end() - shift, start + deleted):
            old_end += next(sizes)
            old += 1
        if old_end + shift == match.end():
            break
    else:
        old += sum(1 for _ in sizes)
    tree.replace(block, place, old, chars, tokens)
    return changed, len(chars)


def _lists(column: pa.Array) -> list[list[int]]:
    """Lists of numbers as Python lists, by way of one flat array."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)).tolist()
    flat = column.flatten().to_numpy().tolist()
    return [flat[a:b] for a, b in pairwise([0, *ends])]


def _stored(trees: list[Tree]) -> list[pa.Array]:
    columns = zip(*(t.stored() for t in trees)) if trees else [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return [pa.array(c, pa.list_(kind)) for c, kind in zip(columns, kinds)]


def token_trees(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """One row per input row: doc_id, text, and its tree (chars and tokens of each pre-token, pre-tokens of each
    block, sums). NULL texts count as empty."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in bounded(batches):
            texts = [t.as_py() or "" for t in batch.column("text")]
            trees = [build(t, counter) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *_stored(trees)], names=NAMES)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(grow, TREE)


def recount(trees: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Apply the column `edits` to each row of trees (as of token_trees), in the order of the array.

    Returns the new text and tree, tokens_before, tokens_after and reencoded, the number of pre-tokens that were
    encoded again. Offsets count code points of the text as the edits before have left it; an edit past the
    end is moved to the end, NULL parts of an edit count as nothing. NULL texts count as empty, NULL edits as none.
    Repeated rows are edited alike; NULL ids are returned; an empty table gives an empty result. Columns other than
    those of token_trees and edits are ignored.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        for batch in bounded(batches):
            texts, trees, before, again = [], [], [], []
            kept = [_lists(batch.column(c)) for c in NAMES[2:]]
            for text, edits, *stored in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), *kept):
                tree, n = Tree(*stored), 0
                before.append(tree.tokens[1])
                for e in edits or ():
                    text, more = edit(text, tree, e["start"] or 0, e["deleted"] or 0, e["inserted"] or "", counter)
                    n += more
                texts.append(text)
                trees.append(tree)
                again.append(n)
            counts = (before, [t.tokens[1] for t in trees], again)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), *_stored(trees), *(pa.array(x, pa.int64()) for x in counts)],
                names=[*NAMES, "tokens_before", "tokens_after", "reencoded"],
            )

    return trees.select(*NAMES, "edits").mapInArrow(apply, RESULT)


def derived_edits() -> Column:
    """Three edits per document, made from the document itself as the tables hold no edits: a replacement by a passage of
    the same text, an insertion, a deletion, at places that follow from hashes."""
    size = F.length(F.coalesce("text", F.lit("")))

    def place(salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), size + 1).cast("int")

    def passage(salt: int, length: int) -> Column:
        return F.substring(F.coalesce("text", F.lit("")), place(salt) + 1, F.lit(length))

    def one(start: Column, deleted: int, inserted: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))

    return F.array(one(place(1), 7, passage(2, 12)), one(place(3), 0, passage(4, 5)), one(place(5), 9, F.lit("")))
