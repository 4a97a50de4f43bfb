"""Registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpack.llm import bpe, embedding_dedup, kneser_ney, line_dedup, packing, quality_rules, secret_scan, simhash, suffix_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place. Null texts are empty, null and repeated ids documents of their own."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank, its first like, and whether it goes. Null texts have no lines; a null id comes first; rows of one id are one document."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"), least=1)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those that are not held out. Null texts are empty; a null id counts as empty text in the fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return kneser_ney.score_documents(docs, held_out)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets. Null texts have none; ids play no part."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component. Vectors that are null, empty, zero or not finite, or without a label or id, link with nothing."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict. Null texts have no words; ids play no part."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stop_words", "n_lines", "ellipsis_line_share", "bullet_line_share",
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and digests. Null texts are empty; ids play no part."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repeats of earlier ones. Null texts are empty; rows without an id, or of one id, take nothing from each other."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. Texts without words have fingerprint zero; rows without an id link nothing."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each length that occurs. Null texts have none of its tokens, length 0; ids play no part."""
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


#: cosines of all pairs of a label, and all that links reach
OP5_SQL = """
WITH RECURSIVE fine AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT links.a, reach.other FROM links JOIN reach ON links.b = reach.node
), heads AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN heads ON node = vec_id
"""

#: every measure of the quality rules, by lists of words and lines
OP6_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM texts
), windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), often AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM often) GROUP BY doc_id
), measured AS (
    SELECT split.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))}], lower(x))))::BIGINT AS stop_words,
        len(l)::BIGINT AS n_lines,
        CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) / len(l)::DOUBLE ELSE 0.0 END AS ellipsis_line_share,
        CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•', '‣', '·'))) / len(l)::DOUBLE ELSE 0.0 END AS bullet_line_share
    FROM split LEFT JOIN covered ON covered.doc_id = split.doc_id
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2.5 AND 12 AND n_symbols / n_words::DOUBLE <= 0.1 AND stop_words >= 2
        AND n_dup_lines / n_lines::DOUBLE <= 0.5 AND ellipsis_line_share <= 0.3 AND bullet_line_share <= 0.9 AS kept,
    stop_words, n_lines, ellipsis_line_share, bullet_line_share
FROM judged
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_lm_scoring, op4_secret_scan, op5_embedding_dedup, op6_quality_rules, op7_bpe, op8_suffix_dedup, op9_simhash, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; tests hold the others against plain versions."""
    return {"op5_embedding_dedup": OP5_SQL, "op6_quality_rules": OP6_SQL}
