"""SentencePiece encoding and decoding with a given model.

Encoding is relational. Texts are cut into words (a run of spaces with what follows it; no piece crosses such a
cut). Distinct words are counted, and for the frequent ones a lattice is built: every substring of bounded
length is exploded and equi-joined to the piece table, and the edges found are grouped by word. A word is then
folded over its edges by Spark's higher-order `aggregate`:

* unigram models: Viterbi, from left to right the best score of each position;
* BPE models: merges, in each step the adjacent pair whose joined piece has the best score, the leftmost first.

For a BPE model Viterbi would give other ids than the model's own encoding, as its scores only rank
merges (README has a figure); so the model's kind decides the fold.

The frequent words with their ids, at most WORDS, travel to the documents, so texts are not shuffled. Words beyond them,
and words of more than LATTICE_CHARS characters, are folded in place by the same rule; a third of all rows in one word
or one endless word changes nothing.
"""

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, pairwise, repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.learning import bounded, most_frequent, small_batches
from tallyward.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Frequent words whose ids are sent to all tasks (some 200 bytes each in a worker).
WORDS = 1 << 17
LATTICE_CHARS = 48
#: Other words that a worker remembers.
REMEMBERED = 1 << 16
#: Below every score of a piece: what a character without a piece costs in Viterbi.
UNKNOWN_PENALTY = 10.0
#: Characters up to which a word's merges are looked up in a list instead of a heap.
SHORT = 64

# A run of spaces belongs to the word after it. A line break stands alone.
_WORD = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")


@dataclass
class Pieces:
    """A model's pieces for text, and the ids of its byte pieces (None: unknown characters become unk_id)."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unk_id: int
    decoded: list[bytes]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unk_id]

    def fold(self, word: str) -> list[int]:
        """The ids of one word, by the model's rule."""
        spans = _merge(word, self.scores) if self.kind == "bpe" else _viterbi(word, self.scores, self.longest, self.penalty)
        try:
            return list(map(self.ids.__getitem__, spans))
        except KeyError:  # some character is no piece
            return [i for span in spans for i in ([self.ids[span]] if span in self.ids else self.unknown(span))]


def _merge(word: str, scores: dict[str, float]) -> list[str]:
    """Merge adjacent parts, best score first, then leftmost, until no joined part is a piece."""
    return _merge_long(word, scores) if len(word) > SHORT else _merge_short(word, scores)


def _merge_short(word: str, scores: dict[str, float]) -> list[str]:
    """With the scores of all neighbours in one list, which is faster than a heap while it is short."""
    parts, none, score = list(word), float("-inf"), scores.get
    joined = list(map(score, map(add, word, word[1:]), repeat(none)))
    while joined and (best := max(joined)) > none:
        i = joined.index(best)
        del joined[i]
        parts[i] = part = parts[i] + parts.pop(i + 1)
        if i < len(joined):
            joined[i] = score(part + parts[i + 1], none)
        if i:
            joined[i - 1] = score(parts[i - 1] + part, none)
    return parts


def _merge_long(word: str, scores: dict[str, float]) -> list[str]:
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (score := scores.get(parts[i] + parts[j])) is not None:
            heapq.heappush(waiting, (-score, i, j, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while waiting:
        _, i, j, joined = heapq.heappop(waiting)
        if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p is not None]


def _viterbi(word: str, scores: dict[str, float], longest: int, penalty: float) -> list[str]:
    best, start = [0.0] + [-np.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        for at in range(max(0, end - longest), end):
            score = scores.get(word[at:end], penalty if end - at == 1 else None)
            if score is not None and best[at] + score > best[end]:
                best[end], start[end] = best[at] + score, at
    cuts = [len(word)]
    while cuts[-1]:
        cuts.append(start[cuts[-1]])
    return [word[a:b] for b, a in pairwise(cuts)][::-1]


def load_pieces(path: str = MODEL, kind: str = "bpe") -> Pieces:
    """Read a model file on the driver. kind: bpe or unigram, as the model was trained."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, decoded, byte_ids = {}, {}, [], [0] * 256
    has_bytes = False
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value], has_bytes = i, True
            decoded.append(bytes([value]))
        elif model.is_control(i) or model.is_unused(i):
            decoded.append(b"")
        elif model.is_unknown(i):
            decoded.append(" ⁇ ".encode())
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            decoded.append(piece.replace(SPACE, " ").encode())
    pieces = Pieces(kind, ids, scores, byte_ids if has_bytes else None, model.unk_id(), decoded)
    check_cuts(pieces)
    return pieces


def check_cuts(pieces: Pieces) -> None:
    """Words can only be encoded one by one if no piece reaches over a cut between them."""
    for piece in pieces.ids:
        if len(piece) > 1 and ("\n" in piece or SPACE in piece.lstrip(SPACE)):
            raise ValueError(f"piece {piece!r} crosses words; this model can't be encoded word by word")


def words_of(text: str | None) -> list[str]:
    """Words of a text in the model's writing: spaces are a visible sign, and one stands before the text."""
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text:
        return _WORD.findall(SPACE + text.replace(" ", SPACE))
    # Each space stands alone, so it is a cut with the sign after it, which is found faster than the expression.
    cut = text.replace(" ", f" {SPACE}").replace("\n", " \n ")
    return list(filter(None, f"{SPACE}{cut}".split(" ")))


def batch_words(texts: pa.Array) -> pa.Array:
    """Words of all texts by the rule of words_of, which serves texts with runs of spaces; the others are cut in Arrow."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    runs = reduce(pc.or_, [pc.starts_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)])
    plain = texts.filter(pc.and_not(pc.not_equal(texts, ""), runs))
    cut = pc.replace_substring(pc.replace_substring(plain, " ", f" {SPACE}"), "\n", " \n ")
    words = pc.list_flatten(pc.split_pattern(pc.binary_join_element_wise(pa.scalar(SPACE, cut.type), cut, pa.scalar("", cut.type)), " "))
    others = chain.from_iterable(map(words_of, texts.filter(runs).to_pylist()))
    return pa.concat_arrays([words.filter(pc.not_equal(words, "")), pa.array(list(others), pa.large_string())])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: distinct words of all texts with their number; combined in each batch, task and the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = batch_words(batch.column("text")).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word STRING, n BIGINT")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, id, score: the model's vocabulary as a table, of a size the model fixes."""
    rows = pa.table({"piece": list(pieces.ids), "id": pa.array(pieces.ids.values(), pa.int32()), "score": [pieces.scores[p] for p in pieces.ids]})
    return spark.createDataFrame(rows)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word and edges, the pieces in it: key (of start and end), piece (score, id; NULL for a character that is
    none). words has one row per word.

    The words are dealt by word before they are exploded, so grouping their edges moves nothing.
    """
    # A stated number of partitions, as words are few bytes until they are exploded and would be put together.
    here = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    start = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start")
    spans = here.select("word", start)
    longest = F.least(F.lit(pieces.longest), F.length("word") - F.col("start"))
    spans = spans.select("word", "start", F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    spans = spans.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("size")))
    table = F.broadcast(piece_table(words.sparkSession, pieces))
    edges = spans.join(table, "piece", "left").where("id IS NOT NULL OR size = 1")
    key = _key(F.col("start"), F.col("start") + F.col("size"))
    edge = F.struct(key.alias("key"), F.struct(F.col("score").cast("double").alias("score"), "id").alias("piece"))
    return edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def _key(start: Column, end: Column) -> Column:
    return (start * (LATTICE_CHARS + 1) + end).cast("int")


# In the folds below, what a step needs besides its own state is carried in the state: an expression from outside
# would be evaluated again in every step.


def _merge_fold(edges: Column, n: Column, finish) -> Column:
    """Start with a cut between all characters; each step takes out the cut whose joined parts score best."""
    state = F.struct(F.sequence(F.lit(0), n).alias("cuts"), F.map_from_entries(edges).alias("pieces"))

    def step(at: Column, _: Column) -> Column:
        cuts = at["cuts"]

        def joined(i: Column) -> Column:
            score = F.element_at(at["pieces"], _key(F.get(cuts, i - 1), F.get(cuts, i + 1)))["score"]
            return F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("score"), (-i).alias("leftmost"), F.get(cuts, i).alias("cut"))

        def take_out(best: Column) -> Column:
            return F.when(best["score"] > F.lit(float("-inf")), F.array_remove(cuts, best["cut"])).otherwise(cuts)

        best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(cuts) - 2), joined))
        after = F.get(F.transform(F.array(best), take_out), F.lit(0))
        return F.struct(F.when(F.size(cuts) <= 2, cuts).otherwise(after).alias("cuts"), at["pieces"].alias("pieces"))

    return F.aggregate(F.sequence(F.lit(1), n), state, step, finish)


def _viterbi_fold(edges: Column, n: Column, finish, penalty: float) -> Column:
    """Left to right, the best score of each position and the start of the edge into it; then back from the end."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("start")))
    state = F.struct(first.alias("best"), edges.alias("edges"))

    def step(at: Column, end: Column) -> Column:
        def over(e: Column) -> Column:
            start = F.floor(e["key"] / (LATTICE_CHARS + 1)).cast("int")
            score = F.get(at["best"], start)["score"] + F.coalesce(e["piece"]["score"], F.lit(penalty))
            return F.struct(score.alias("score"), (-start).alias("start"))

        into = F.filter(at["edges"], lambda e: e["key"] % (LATTICE_CHARS + 1) == end)
        best = F.transform(F.array(F.array_max(F.transform(into, over))), lambda b: F.struct(b["score"].alias("score"), (-b["start"]).alias("start")))
        return F.struct(F.concat(at["best"], best).alias("best"), at["edges"].alias("edges"))

    def back(at: Column, _: Column) -> Column:
        start = F.get(at["best"], F.get(at["cuts"], F.lit(0)))["start"]
        return F.struct(F.when(start < 0, at["cuts"]).otherwise(F.concat(F.array(start), at["cuts"])).alias("cuts"), at["best"].alias("best"), at["pieces"].alias("pieces"))

    def walk_back(at: Column) -> Column:
        end = F.size(at["best"]) - 1
        path = F.struct(F.array(end).alias("cuts"), at["best"].alias("best"), F.map_from_entries(at["edges"]).alias("pieces"))
        return F.aggregate(F.sequence(F.lit(1), end), path, back, finish)

    return F.aggregate(F.sequence(F.lit(1), n), state, step, walk_back)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids of words of at most LATTICE_CHARS characters, by the lattice."""
    edged = lattice(words.where(F.length("word").between(1, LATTICE_CHARS)), pieces)
    known = F.split(F.lit(",".join(map(str, pieces.byte_ids or [pieces.unk_id]))), ",").cast("array<int>")

    def unknown(char: Column) -> Column:
        if not pieces.byte_ids:
            return known
        digits = F.hex(F.encode(char, "UTF-8"))

        def byte(k: Column) -> Column:
            return F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("int")

        return F.transform(F.sequence(F.lit(1), F.floor(F.length(digits) / 2).cast("int")), lambda k: F.get(known, byte(k)))

    def ids(at: Column) -> Column:
        def of_part(i: Column) -> Column:
            start, end = F.get(at["cuts"], i - 1), F.get(at["cuts"], i)
            found = F.element_at(at["pieces"], _key(start, end))["id"]
            return F.when(found.isNotNull(), F.array(found)).otherwise(unknown(F.substring("word", start + 1, end - start)))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(at["cuts"]) - 1), of_part))

    n, edges = F.length("word"), F.col("edges")
    folded = _merge_fold(edges, n, ids) if pieces.kind == "bpe" else _viterbi_fold(edges, n, ids, pieces.penalty)
    return edged.select("word", folded.alias("ids"))


class Encoder(dict):
    """word -> its ids as int32 bytes; words that were not sent are folded when they come."""

    def __init__(self, words: dict[str, bytes], pieces: Pieces) -> None:
        super().__init__(words)
        self.pieces, self.other, self.earlier = pieces, {}, {}

    def __missing__(self, word: str) -> bytes:
        found = self.other.get(word)
        if found is None:
            if len(self.other) >= REMEMBERED // 2:
                self.other, self.earlier = {}, self.other
            found = self.earlier.get(word)
            if found is None:
                found = array("i", self.pieces.fold(word)).tobytes()
            self.other[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words_of(text))), np.int32)


def send_encoder(docs: DataFrame, pieces: Pieces, most: int = WORDS) -> Broadcast:
    """Encode the frequent words of docs by the lattice and send them to all tasks."""
    counts = stage(word_counts(docs), "words")
    encoded = encode_words(most_frequent(counts, most), pieces).toArrow()  # at most `most` rows
    ids = encoded.column("ids").combine_chunks()
    flat, cuts = ids.values.to_numpy().astype(np.int32).tobytes(), (ids.offsets.to_numpy() * 4).tolist()
    words = {w: flat[a:b] for w, (a, b) in zip(encoded.column("word").to_pylist(), pairwise(cuts))}
    return docs.sparkSession.sparkContext.broadcast((words, pieces))


def encode(docs: DataFrame, pieces: Pieces, most: int = WORDS) -> DataFrame:
    """docs with the columns ids (array of int) and n_tokens, one row per input row; columns of these names
    are replaced.

    The ids are those of the model's own encoding without start and end signs. NULL and empty texts have no ids.
    Repeated rows are encoded alike; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sent = send_encoder(docs.select("text"), pieces, most)
    kept = docs.drop("ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in bounded(batches):
            found = [encoder.encode(t.as_py()) for t in batch.column("text")]
            sizes = np.array([len(f) for f in found], np.int64)
            cuts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            ids = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(sizes)], names=[*batch.schema.names, "ids", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, ids ARRAY<INT>, n_tokens BIGINT")


def decode_ids(ids: pa.ListArray, decoded: pa.Array) -> list[str]:
    """The texts of all lists of a batch. The pieces' bytes stand one after another, so a text is one slice of them."""
    flat = ids.flatten()
    if flat.null_count:
        raise ValueError("an id is NULL")
    found = decoded.take(flat)

    def starts(sizes: pa.Array) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64))))

    cuts = starts(pc.binary_length(found))[starts(pc.list_value_length(ids))].tolist()
    spelled = memoryview(found.buffers()[2] or b"")
    return [str(spelled[a:b], "utf-8", "replace").removeprefix(" ") for a, b in pairwise(cuts)]


def decode(rows: DataFrame, pieces: Pieces, column: str = "ids") -> DataFrame:
    """rows with the column decoded: the text that the ids stand for; NULL and empty ids give an empty text.

    Ids that are not the model's are an error, bytes that are not UTF-8 become replacement characters.
    """
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pa.array(pieces.decoded, pa.large_binary()))
    kept = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = decode_ids(batch.column(column), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded STRING")
