"""The operators as queries over whole tables, by name, and their SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.decontaminate import contaminated
from tallyward.llm.edit_counts import derived_edits, recount, send_vocabulary, token_trees
from tallyward.llm.exact_dedup import exact_duplicates
from tallyward.llm.filter_audit import audit_filters
from tallyward.llm.hard_negatives import hard_negatives
from tallyward.llm.html_text import extract_text
from tallyward.llm.line_dedup import dedup_lines
from tallyward.llm.mixing import mixture
from tallyward.llm.quality import quality
from tallyward.llm.sentencepiece import decode, encode, load_pieces
from tallyward.llm.simhash import near_duplicates
from tallyward.llm.toxicity import toxicity
from tallyward.llm.warc import audit, replicas

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    pieces = load_pieces()
    decoded = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces), pieces)
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return decoded.select("doc_id", "ids", "n_tokens", same.alias("round_trip"))


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(*replicas(_table(spark, sf_dir, "pages")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after the edits; pretokens are those of the edited text."""
    vocabulary = send_vocabulary(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = token_trees(docs, vocabulary).withColumn("edits", derived_edits())
    return recount(trees, vocabulary).select(
        "doc_id", "tokens_before", "tokens_after", "reencoded", F.size("tokens").alias("pretokens"), F.sha2("text", 256).alias("edited_sha256")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc_audit": op3_warc_audit,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html_text,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {
    "op3_warc_audit": """
        WITH r AS (
            SELECT page_id, page_id // 1000 AS archive, concat(
                'WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
                'WARC-Target-URI: ', url, chr(13), chr(10), 'WARC-Date: 2024-01-01T00:00:00Z', chr(13), chr(10),
                'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')),
                chr(13), chr(10), chr(13), chr(10), html) AS head
            FROM pages
        ), placed AS (
            SELECT *, coalesce(sum(strlen(head) + 4) OVER (PARTITION BY archive ORDER BY page_id
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset
            FROM r
        )
        SELECT archive, CAST(record_offset AS BIGINT) AS record_offset, page_id AS record_id,
               CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS fault,
               sha256(concat(head, chr(13), chr(10), chr(13), chr(10))) AS sha256_a,
               CASE WHEN page_id % 211 <> 5 THEN
                    sha256(concat(head[:length(head) - 1], '#', chr(13), chr(10), chr(13), chr(10))) END AS sha256_b
        FROM placed WHERE page_id % 211 = 5 OR page_id % 97 = 13
    """,
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line_no
            FROM documents
        ), words AS (
            SELECT DISTINCT doc_id, line_no, unnest([w FOR w IN string_split(lower(line), ' ') IF w <> '']) AS word FROM lines
        ), counted AS (SELECT *, count(*) OVER (PARTITION BY word) AS freq FROM words
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY freq, word) AS place,
                   count(*) OVER (PARTITION BY doc_id, line_no) AS n
            FROM counted
        ), sets AS (
            SELECT doc_id, line_no, n, list(word ORDER BY word) AS words, list(word ORDER BY place) AS by_rarity FROM placed GROUP BY ALL
        ), classes AS (
            SELECT words, n, any_value(by_rarity) AS by_rarity, min((doc_id, line_no)) AS first FROM sets GROUP BY words, n
        ), prefixes AS (
            SELECT first, words, n, unnest(by_rarity[:n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1]) AS word FROM classes
        ), near AS (
            SELECT DISTINCT b.words FROM prefixes a JOIN prefixes b ON a.word = b.word AND a.first < b.first
             AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
            WHERE len(list_intersect(a.words, b.words)) * 9 >= (a.n + b.n) * 4
        ), lost AS (
            SELECT s.doc_id, s.line_no FROM sets s JOIN classes c ON s.words = c.words
            WHERE (s.doc_id, s.line_no) <> c.first OR s.words IN (SELECT words FROM near)
        ), kept AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (x.line_no IS NULL) AS text,
                   list(x.line_no ORDER BY x.line_no) FILTER (x.line_no IS NOT NULL) AS removed
            FROM lines l LEFT JOIN lost x ON l.doc_id = x.doc_id AND l.line_no = x.line_no GROUP BY l.doc_id
        )
        SELECT d.doc_id, CASE WHEN removed IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
               CAST(coalesce(removed, []) AS INT[]) AS removed_lines
        FROM documents d JOIN kept k USING (doc_id)
    """,
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(text) AS text_sha256
        FROM d
        WINDOW same AS (PARTITION BY text)
    """,
    "op8_decontamination": """
        WITH folded AS (
            SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), worded AS (
            SELECT side, id, [w FOR w IN regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> ''] AS words
            FROM folded
        ), widths AS (SELECT DISTINCT least(5, len(words)) AS width FROM worded WHERE side = 1 AND len(words) > 0
        ), shingles AS (
            SELECT DISTINCT side, id, width,
                   unnest([array_to_string(words[i:i + width - 1], ' ') FOR i IN range(1, len(words) - width + 2)]) AS shingle
            FROM worded JOIN widths ON len(words) >= width AND (side = 0 OR width = least(5, len(words)))
        ), sizes AS (SELECT id, width, count(*) AS item_shingles FROM shingles WHERE side = 1 GROUP BY ALL)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
        FROM shingles d JOIN shingles i ON d.side = 0 AND i.side = 1 AND d.shingle = i.shingle AND d.width = i.width
        JOIN sizes s ON s.id = i.id
        GROUP BY d.id, i.id, item_shingles
        HAVING count(*) * 5 >= item_shingles * 4
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.x, b.x)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT * FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5
    """,
    "op13_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), rated AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM texts t LEFT JOIN marks m ON t.doc_id = m.doc_id
        ), counted AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rated GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders
        ), told AS (
            SELECT part, filter_order, step, n, good, toxic, filter_order[step] AS filter,
                   contains(fails, filter_order[step]) AS here, fails = filter_order[step] AS alone,
                   step > 1 AND regexp_matches(fails, '[' || rpad(filter_order[:step - 1], 5, '_') || ']') AS gone
            FROM counted, steps
        ), summed AS (
            SELECT part, filter_order, step, filter,
                   coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept,
                   coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
                   coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
                   coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost
            FROM told GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
        FROM summed
    """,
}
