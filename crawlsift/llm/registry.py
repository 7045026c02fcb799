"""Registered queries over the corpus operators, and the SQL twins of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlsift.llm import (
    common, decontamination, forest, hard_negatives, jaccard, line_dedup, pieces, quality, scoring, token_files, toxicity, warc, whitening,
    winnowing)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC, converted to WARC and read back."""
    return warc.report(common.read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and their decoding."""
    return pieces.report(common.read(spark, sf_dir, "documents"), PIECES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from toxic and unlabelled texts."""
    return toxicity.report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    return decontamination.report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that five documents repeat stay only in the last of them."""
    return line_dedup.report(common.read(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnowing.report(common.read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with their posterior."""
    docs = common.read(spark, sf_dir, "documents")
    kept = quality.keep(docs, common.read(spark, sf_dir, "labels"))
    return kept.selectExpr("doc_id", f"`{common.fresh('__quality', docs)}` AS quality", "true AS keep")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are alike."""
    return jaccard.report(common.read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document through ORC files."""
    return token_files.report(common.read(spark, sf_dir, "documents"), WORDS)


def op10_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention scores of every document."""
    return scoring.report(common.read(spark, sf_dir, "documents"), PIECES)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are alike, from an LSH forest, and which document of each stays."""
    return forest.report(common.read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading principal components, whitened."""
    return whitening.report(common.read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, from all of them."""
    return hard_negatives.report(common.read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {f.__name__: f for f in (
        op1_warc, op2_pieces, op3_toxicity, op4_decontamination, op5_line_dedup, op6_winnowing, op7_quality, op8_jaccard,
        op9_token_files, op10_scoring, op11_minhash, op12_whitening, op13_hard_negatives)}


WARC_SQL = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
        (CAST('0x' || substr(h, CAST(i * 5 // 4 AS INT) + 1, 2) AS INT) >> CAST(3 - (i * 5) % 4 AS INT)) & 31), 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS keeper
    FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d"""

LINE_SQL = r"""
WITH l AS (
    SELECT doc_id, pos, line, lower_ascii AS key FROM (
        SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))
), k AS (
    SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


NEGATIVES_SQL = """
WITH e AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5"""

# Components by recursion over the distinct sets; {k} words a shingle.
COPIES_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k} - 1], ' ')) END)) AS s FROM w
), d AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
g AS MATERIALIZED (SELECT id, n, unnest(s) AS gram FROM d),
links AS MATERIALIZED (
    SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT id, id AS root FROM d UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.id = l.a WHERE r.root < l.b
), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
named AS (SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
    FROM sets s LEFT JOIN d ON s.s = d.s LEFT JOIN roots r ON d.id = r.id)
SELECT {columns} FROM named"""
JACCARD_SQL = COPIES_SQL.replace("{k}", "5").replace("{columns}", "*")
MINHASH_SQL = COPIES_SQL.replace("{k}", "4").replace("{columns}", "*, doc_id = component_id AS kept")


def oracle_sql() -> dict[str, str]:
    """SQL twins by name."""
    return {
        "op1_warc": WARC_SQL, "op5_line_dedup": LINE_SQL, "op8_jaccard": JACCARD_SQL, "op11_minhash": MINHASH_SQL,
        "op13_hard_negatives": NEGATIVES_SQL}
