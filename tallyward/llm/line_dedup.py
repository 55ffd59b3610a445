"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. It is removed when an earlier line (by doc_id, then line number, over all
documents) has a Jaccard similarity of at least 0.8 with it.

1. Texts are cut into words once, and each line is staged as the sorted hashes of its words. Words are ordered by
   rarity. Their frequencies are counted over all lines into a fixed number of hash buckets, so the order is an array
   inside the expression instead of a join of all words. Any total order gives the same result; a rarer start only gives
   fewer candidates. A word that is alone in its bucket and occurs once can't be shared, and starts no candidate.
2. Lines with the same words form a class (a map-side combined minimum finds its first line), so copies
   never meet in a join, however many there are.
3. Prefix filter: two classes can only match if they share one of their rarest n - ceil(0.8 n) + 1 words.
4. Length filter; positional filter: from the places of the shared word, enough words must be left to reach
   the needed overlap; and parities of each class's words bound the difference of two sets: 64 of them, or 256 for
   lines of WIDE words, where 64 parities are as good as random and would let through most pairs that share a word.
5. It is enough to know one earlier match. So a class is first compared with the leader of each of its prefix
   words, the earliest class that has it, which takes one candidate per prefix word even among thousands of
   variants of a line. Only classes that do not resemble the leader are compared with all others of the word.
   A class whose leaders all fail verification is compared with all others in a second round.
6. Words are read again for candidate lines only, with a sketch of more parities. Pairs that its sketches still allow
   are verified on their words, the likeliest of each class first.
"""

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import discard, release, stage

#: Jaccard similarity as a fraction, kept in integers so that both sides of 0.8 are exact.
NEED, OF = 4, 5
#: Hash buckets that word frequencies are kept in (a byte or two each in the expression that orders words).
BUCKETS = 1 << 17
RUN = 1 << 10
#: Bits of a word's hash in the number that orders words, below its step, and steps that double the frequency.
HASH_BITS, OCTAVE = 55, 4
#: Words from which a line has 64 parities of each quarter of its words instead of 64 of all.
WIDE = 48
#: Parts of the prefix words, and of the pairs to be verified, that are shuffled one after another, so that the disk
#: holds the shuffle of one part.
PARTS = 4
#: Words of 64 parities in the sketch of a candidate.
SKETCHES = 3
#: Rows up to which positions of lines, or lists of lost lines, are sent to the documents (about 60 bytes each); beyond
#: that the join shuffles.
BROADCAST_ROWS = 1_000_000

POSITION = ("doc_id", "row_key", "line_no")
CLASS = ("set_hash", "set_check")
BITS = ("bits0", "bits1", "bits2", "bits3")


def line_words(line: Column) -> Column:
    """Words in lower case, in the order of the line."""
    return F.array_remove(F.split(F.lower(line), " "), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, line_no, line: one row per line; rows with the same doc_id and text are one document."""
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Per line with a word: position; hashes, its distinct words as sorted 64-bit hashes; and ends, their _quarters. Texts
    are cut and hashed only here: a word is 8 bytes from here on."""
    hashes = F.sort_array(F.array_distinct(F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w))))
    hashed = lines_of(docs).where(F.trim("line") != "").select(*POSITION, hashes.alias("hashes"))
    return hashed.withColumn("ends", _quarters(F.col("hashes")))


def _steps(hashed: DataFrame) -> Column:
    """Array of BUCKETS steps: how many lines have the words of a bucket, on a logarithmic scale."""
    words = hashed.select(F.explode("hashes").alias("h"))
    counts = words.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    step = F.least(F.floor(F.log2("n") * OCTAVE), F.lit((1 << (63 - HASH_BITS)) - 1)).cast("int")
    # Buckets without a word have no count; each run gets a row of all its places.
    unseen = hashed.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(0).alias("step"))
    every = counts.select("bucket", step.alias("step")).unionByName(unseen)
    places = every.groupBy("bucket").agg(F.max("step").alias("step"))
    run = F.floor(F.col("bucket") / RUN).cast("int").alias("run")
    listed = F.sort_array(F.collect_list(F.struct("bucket", "step")))
    runs = places.groupBy(run).agg(F.array_join(F.transform(listed, lambda x: x["step"].cast("string")), ",").alias("steps"))
    found = dict(runs.collect())  # BUCKETS / RUN rows
    return F.split(F.lit(",".join(found[run] for run in range(BUCKETS // RUN))), ",").cast("array<bigint>")


def rarity(docs: DataFrame) -> Column:
    """The steps that order the words of all lines."""
    return _steps(hashed_lines(docs))


def _number(h: Column, rare: Column) -> Column:
    """A word's hash as a number in the order (how common, hash). It is never NULL; coalesce says so to Spark, which sorts
    arrays as primitives only if they can't hold a NULL, and takes any column of a file for one that can."""
    step = F.get(rare, h.bitwiseAND(BUCKETS - 1))
    number = F.shiftleft(step, HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    return F.coalesce(number, F.lit(0).cast("long"))


def _parities(hashes: Column) -> Column:
    """64 parities of hashes, by their lowest six bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int")))
    )


def _quarters(hashes: Column) -> Column:
    """Where the quarters of all hashes begin and end in sorted ones; NULL for lines that are not WIDE.

    The bounds of the quarters are sorted in among the hashes, so that their places are found without a lambda function.
    """
    bounds = [F.lit(quarter << 62).cast("long") for quarter in (-1, 0, 1)]
    among = F.sort_array(F.concat(hashes, F.array(*bounds)))
    ends = [(F.array_position(among, bound) - (i + 1)).cast("int") for i, bound in enumerate(bounds)]
    return F.when(F.size(hashes) >= WIDE, F.array(F.lit(0), *ends, F.size(hashes)))


def _bits(hashes: Column, ends: Column) -> list[Column]:
    """BITS of a line: parities of each quarter of its words, or of all of them."""
    starts = [F.get(ends, F.lit(i)) for i in range(len(BITS) + 1)]
    slices = [F.slice(hashes, start + 1, end - start) for start, end in pairwise(starts)]
    narrow = [_parities(hashes), *[F.lit(0).cast("long")] * (len(BITS) - 1)]
    return [F.when(ends.isNotNull(), _parities(part)).otherwise(all_of_it) for part, all_of_it in zip(slices, narrow)]


def _sets(hashed: DataFrame, rare: Column) -> DataFrame:
    """line_sets from hashed_lines."""
    size = F.size("hashes")
    several = size > 3  # Up to three words, 0.8 needs the same words.
    prefix_length = F.expr(f"size(hashes) - (size(hashes) * {NEED} + {OF - 1}) div {OF} + 1").cast("int")
    numbers = F.sort_array(F.transform("hashes", lambda h: _number(h, rare)))
    return hashed.select(
        *POSITION,
        F.xxhash64("hashes").alias("set_hash"),
        F.hash("hashes").alias("set_check"),
        size.alias("n"),
        F.when(several, F.slice(numbers, F.lit(1), prefix_length)).alias("prefix"),
        *[F.when(several, bits).alias(name) for name, bits in zip(BITS, _bits(F.col("hashes"), F.col("ends")))],
    )


def line_sets(docs: DataFrame, rare: Column) -> DataFrame:
    """Per line with a word: position, class (set_hash and set_check, 96 bits), n (distinct words), prefix
    and BITS (parities of the words, by their hash: each differing word turns one of them).

    Prefix words are numbers with HASH_BITS of the hash: different words with the same number only add candidates.
    """
    return _sets(hashed_lines(docs), rare)


def line_classes(sets: DataFrame) -> DataFrame:
    """One row per class, with the position of its first line."""
    # Lines of a class have the same n, prefix and BITS, so the position decides which is the minimum.
    first = F.min(F.struct(*POSITION, "n", "prefix", *BITS)).alias("first")
    return sets.groupBy(*CLASS).agg(first).select(*CLASS, "first.*")


def _alike(a: str, b: str) -> Column:
    """Length filter, and parities: the bits that differ are at most |A - B| + |B - A|, and |A - B| + |B - A| can be at most (n_a + n_b) / 9 at 0.8.

    The parities of all words are those of the quarters joined by XOR, so a wide line is comparable to a narrow one.
    """
    n_a, n_b = f"{a}n", f"{b}n"
    sizes = f"least({n_a}, {n_b}) * {OF} >= greatest({n_a}, {n_b}) * {NEED}"
    wide = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in BITS)
    narrow = f"bit_count({' ^ '.join(f'{side}{c}' for side in (a, b) for c in BITS)})"
    differ = f"CASE WHEN least({n_a}, {n_b}) >= {WIDE} THEN {wide} ELSE {narrow} END"
    return F.expr(f"{sizes} AND ({differ}) * {NEED + OF} <= ({n_a} + {n_b}) * {OF - NEED}")


def _starts(classes: DataFrame, side: str) -> DataFrame:
    """word, and doc, set_hash, n, BITS and place of each class that has it in its prefix, named by side."""
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias(f"{side}_doc")  # without id comes first
    of_class = [doc, *[F.col(c).alias(f"{side}_{c}") for c in ("set_hash", "n", *BITS)]]
    rows = classes.where("prefix IS NOT NULL").select(*of_class, F.posexplode("prefix").alias(f"{side}_place", "word"))
    # A word of the lowest step, alone in its bucket, occurs once in all lines and is shared with none.
    return rows.where(F.col("word") >= 1 << HASH_BITS)


def _earlier_and_alike() -> Column:
    """All filters for rows a and b of a word, b not in a later document.

    In place: overlap needed is ceil(t / (1 + t) * (n_a + n_b)); the shared word and what follows it on both
    sides must be able to give it.
    """
    in_place = F.expr(f"least(a_n - a_place, b_n - b_place) * {NEED + OF} >= (a_n + b_n) * {NEED}")
    other = F.col("a_set_hash") != F.col("b_set_hash")
    return (F.col("b_doc") <= F.col("a_doc")) & in_place & other & _alike("a_", "b_")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("a_set_hash").alias("a"), F.col("b_set_hash").alias("b"))


def _in_part(key: str, part: int) -> Column:
    return F.pmod(key, F.lit(PARTS)) == part


def _candidates_of(classes: DataFrame, part: int) -> DataFrame:
    """first_candidates by the words of one part.

    Both sides of the join have the same rows and columns before the leader is added, so Spark deals them by word once. A
    filter that Spark could move to one side would end that, so all of them are in one CASE.
    """
    a, b = (_starts(classes, side).where(_in_part("word", part)) for side in "ab")
    # Plain columns only, as an expression in the window would be worked out before the rows are dealt.
    earliest = W.partitionBy("word").orderBy("a_doc", "a_set_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    leader = {f"leader_{c}": F.first(f"a_{c}").over(earliest) for c in ("set_hash", "n", *BITS)}
    led = a.withColumns(leader).where("leader_set_hash <> a_set_hash")
    led = led.select(*a.columns, _alike("a_", "leader_").alias("by_leader"), F.col("leader_set_hash").alias("leader"))
    chosen = F.when(F.col("by_leader"), F.col("b_set_hash") == F.col("leader")).otherwise(_earlier_and_alike())
    found = led.join(b, (led["word"] == b["word"]) & chosen)
    return found.groupBy(F.col("a_set_hash").alias("a"), F.col("b_set_hash").alias("b")).agg(F.bool_or("by_leader").alias("by_leader"))


def first_candidates(classes: DataFrame) -> DataFrame:
    """a, b, by_leader: each class with the leaders it resembles, and, for words whose leader it does not resemble, with
    all earlier classes that pass the filters. One row per a and b.
    """
    parts = [stage(_candidates_of(classes, part), "line-candidates-part") for part in range(PARTS)]
    found = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.bool_or("by_leader").alias("by_leader"))
    found = stage(found, "line-candidates")
    discard(*parts)
    return found


def _few(rows: DataFrame) -> bool:
    return rows.count() <= BROADCAST_ROWS


def _small(rows: DataFrame) -> DataFrame:
    """Staged rows, marked to be sent to the other side of a join if there are few enough."""
    return F.broadcast(rows) if _few(rows) else rows


def _sketch(hashes: Column) -> Column:
    """SKETCHES times 64 parities of the words, each time by other bits of their hashes."""

    def parities(shift: int) -> Column:
        def add(bits: Column, h: Column) -> Column:
            place = F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int")
            return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))

        return F.aggregate(hashes, F.lit(0).cast("long"), add)

    return F.struct(*[parities(6 * i).alias(f"s{i}") for i in range(SKETCHES)])


def candidate_words(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes of candidate pairs with the words of their first line, read again from the documents, and a sketch of
    them."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    release(docs.sparkSession)
    wanted = classes.select(*CLASS, *POSITION).join(named, "set_hash", "left_semi")
    line = F.struct("line_no", *CLASS).alias("line")
    wanted = _small(stage(wanted.groupBy("doc_id", "row_key").agg(F.collect_list(line).alias("wanted")), "line-wanted"))
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    here = [keyed[c].eqNullSafe(wanted[c]) for c in ("doc_id", "row_key")]
    # Only the wanted lines of a document leave its row.
    whole = keyed.join(wanted, here).select(keyed["doc_id"], keyed["row_key"], F.split("text", "\n").alias("lines"), "wanted")
    taken = F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get(F.col("lines"), w["line_no"]).alias("text")))
    rows = whole.select("doc_id", "row_key", F.explode(taken).alias("t"))
    first = F.struct("doc_id", "row_key", "t.w.line_no").alias("first")
    words = F.array_distinct(line_words(F.col("t.text"))).alias("words")
    read = rows.select(*[F.col(f"t.w.{c}") for c in CLASS], first, words)
    hashed = read.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return stage(hashed.withColumn("sketch", _sketch(F.col("hashes"))).drop("hashes"), "line-words")


def likely(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """Pairs, the later class as a, whose sketches allow a Jaccard similarity of 0.8, with the difference they show.

    Words stay where they are: what is shuffled here is a sketch and a position for each class.
    """
    a, b = (read.select(*[F.col(c).alias(f"{s}_{c}") for c in (*CLASS, "first", "n", "sketch")]) for s in "ab")
    both = pairs.select("a", "b").join(a, F.col("a") == F.col("a_set_hash")).join(b, F.col("b") == F.col("b_set_hash"))
    shown = F.greatest(*[F.expr(f"bit_count(a_sketch.s{i} ^ b_sketch.s{i})") for i in range(SKETCHES)])
    alike = shown * (NEED + OF) <= (F.col("a_n") + F.col("b_n")) * (OF - NEED)
    later_is_a = F.col("a_first") > F.col("b_first")
    ends = {"later": later_is_a, "earlier": ~later_is_a}
    named = [F.when(is_a, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{end}_{c}") for end, is_a in ends.items() for c in CLASS]
    return both.where(alike).select(*named, shown.alias("shown")).distinct()


def _matches(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """CLASS of later classes with a Jaccard similarity of 0.8 to the earlier one of a pair, by their words."""
    sides = {end: read.select(*[F.col(c).alias(f"{end}_{c}") for c in (*CLASS, "words")]) for end in ("later", "earlier")}
    both = pairs
    for end, side in sides.items():
        both = both.join(side, [f"{end}_{c}" for c in CLASS])
    overlap = F.size(F.array_intersect("later_words", "earlier_words"))
    union = F.size("later_words") + F.size("earlier_words") - overlap
    found = both.where(overlap * OF >= union * NEED)
    return found.select(*[F.col(f"later_{c}").alias(c) for c in CLASS]).distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """set_hash and set_check of classes with a Jaccard similarity of 0.8 to one whose first line is earlier.

    One match is enough. So each class is first compared with the candidate whose sketch differs least, and only classes that
    this does not settle are compared with their others.
    """
    read = candidate_words(docs, classes, pairs)
    chances = stage(likely(pairs, read), "line-likely")
    later = [f"later_{c}" for c in CLASS]
    other = [f"earlier_{c}" for c in CLASS]
    best = chances.groupBy(*later).agg(F.min(F.struct("shown", *other)).alias("best")).select(*later, *[f"best.{c}" for c in other])
    best = stage(best, "line-best")
    near = stage(_matches(best, read), "line-near")
    settled = near.withColumnsRenamed({c: f"later_{c}" for c in CLASS})
    left = stage(chances.drop("shown").join(settled, later, "left_anti").join(best, [*later, *other], "left_anti"), "line-left")
    discard(chances, best)
    # Few pairs are left, so most classes need not be dealt out again with their words.
    ends = F.explode(F.array(*[F.struct(*[F.col(f"{end}_{c}").alias(c) for c in CLASS]) for end in ("later", "earlier")])).alias("end")
    named = stage(left.select(ends).select("end.*").distinct(), "line-left-classes")
    words = stage(read.join(_small(named), list(CLASS), "left_semi"), "line-left-words")
    discard(read)
    parts = [stage(_matches(left.where(_in_part("later_set_hash", part)), words), "line-matches-part") for part in range(PARTS)]
    found = stage(reduce(DataFrame.unionByName, parts, near).distinct(), "line-matches")
    discard(left, named, words, near, *parts)
    return found


def near_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """set_hash and set_check of classes that match a class with an earlier first line."""
    pairs = first_candidates(classes)
    near = verified(docs, classes, pairs.select("a", "b"))
    # Compared with leaders instead of all others, and not found near.
    open_classes = pairs.where("by_leader").select(F.col("a").alias("set_hash")).distinct().join(near, "set_hash", "left_anti")
    open_classes = stage(open_classes, "line-open")
    again = stage(classes.join(_small(open_classes), "set_hash", "left_semi"), "line-again")
    if not again.head(1):
        return near
    rows, others = stage(_starts(again, "a"), "line-again-words"), _starts(classes, "b")
    few, parts = _few(rows), []
    if few:  # nothing is shuffled, so all words are read at once
        rows = F.broadcast(rows)
    for part in range(1 if few else PARTS):
        some = others if few else others.where(_in_part("word", part))
        found = _pairs(some.join(rows, (rows["word"] == some["word"]) & _earlier_and_alike()))
        parts.append(stage(found.distinct(), "line-again-part"))
    rest = reduce(DataFrame.unionByName, parts).distinct()
    rest = stage(rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "line-candidates")
    discard(*parts)
    more = verified(docs, classes, rest)
    discard(pairs, open_classes, again, rest)
    return near.unionByName(more).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, removed: the sorted numbers of removed lines of each document that loses any."""
    hashed = stage(hashed_lines(docs), "line-hashes")
    sets = stage(_sets(hashed, _steps(hashed)), "line-sets")
    discard(hashed)
    classes = stage(line_classes(sets), "line-classes")
    release(docs.sparkSession)
    near = near_classes(docs, classes).withColumn("near", F.lit(True))
    first = F.struct(*POSITION).alias("first")
    judged = classes.select(*CLASS, first).join(near, list(CLASS), "left")
    rows = sets.select(*POSITION, *CLASS).join(judged, list(CLASS))
    lost = rows.where(F.col("near").isNotNull() | ~F.struct(*POSITION).eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` freed of repeated lines, and removed_lines, the numbers (from 0) of lost lines.

    docs needs doc_id and text; other columns stay as they are, whatever their names (a column named removed_lines is
    replaced). Words are runs between spaces, in lower case. Lines without a word stay, and do not match anything. NULL
    texts stay NULL, empty texts empty; a document may lose all its lines and is then empty. Rows with the
    same doc_id and text are one document and come out alike. Among rows with the same doc_id and different
    texts a hash of the text decides which is earlier; rows without doc_id come first. An empty table gives an
    empty result. Equality of word sets is decided by 96-bit hashes of them; all other matches by the words.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lost = removed_lines(source).select(F.struct("doc_id", "row_key").alias("lost_key"), "removed")
    lost = _small(stage(lost, "line-lost"))
    # The row goes through as one value, so that no name in it can clash.
    key = F.struct("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    joined = rows.join(lost, F.col("key").eqNullSafe(F.col("lost_key")), "left")
    left = F.filter(F.split(F.col("row.text"), "\n"), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text")
    kept = [text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "removed_lines"]
    return joined.select(*kept, F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
