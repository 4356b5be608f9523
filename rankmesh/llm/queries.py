"""The corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmesh.llm import chat, embeddings, fingerprints, lattice, mixing, packing, quality, simhash, spm, toxicity
from rankmesh.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, votes, posterior, score, kept of every document; a null text counts as empty, repeats and null ids stay. No labels are used."""
    return quality.judged(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids, round_trip of every document; all but doc_id are null for a null text, an empty text has no ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.char_length("text").alias("n_chars"))
    coded = spm.encode(docs, out="ids", check="round_trip")
    return coded.select("doc_id", "n_chars", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), "ids", "round_trip")


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each packed row of every document's tokens, with digests of its arrays; null and empty texts have no tokens and are in no row."""
    return packing.digests(packing.packed(read_table(spark, sf_dir, "documents")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract; see ``fingerprints.edited_against_next``."""
    return fingerprints.edited_against_next(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract; see ``toxicity.judged`` and ``toxicity.train``."""
    return toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract; see ``embeddings.linked``."""
    return embeddings.linked(read_table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract, with source and copies; see ``mixing.plan``."""
    plan = mixing.plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract; see ``simhash.groups``."""
    return simhash.groups(read_table(spark, sf_dir, "documents"))


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation, as the chosen one, against itself with a foreign last reply; see ``chat.preferences``."""
    return chat.foreign_reply_preferences(read_table(spark, sf_dir, "conversations"))


def op10_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By contract; see ``lattice.score``."""
    return lattice.score(read_table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7's plan that SQL can express: each source's size and target, rounded to a millionth."""
    return mixing.source_targets(read_table(spark, sf_dir, "documents")).select("source", "source_size", F.round("target", 6).alias("target"))


def lattice_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10's result that SQL can express, the base score rounded to a millionth."""
    rows = lattice.score(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


#: The same in DuckDB. Words are runs of anything but six ASCII characters.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
MIXING_TARGETS_SQL = f"""
WITH s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY source),
o AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(size) OVER () AS total FROM s),
-- sources reach their limit in order of limit over weight: the rest shares what those before leave
p AS (SELECT *, 3.0 * size / weight AS full_at,
        coalesce(sum(3.0 * size) OVER before, 0.0) AS given,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
      FROM o WINDOW before AS (ORDER BY 3.0 * size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((total - given) / rest) AS level FROM p WHERE (total - given) / rest <= full_at)
SELECT source, size AS source_size, round(CAST(least(3.0 * size, coalesce(level, 0.0) * weight) AS DOUBLE), 6) AS target FROM p, l
"""
LATTICE_BASE_SQL = f"""
WITH step AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS t(i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, text,
    coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10 = 0, false) AS held_out
  FROM documents, step),
w AS (SELECT r, held_out, unnest({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
e AS (SELECT count(*) AS ends FROM d WHERE NOT held_out),
n AS (SELECT coalesce(sum(c), 0) + any_value(ends) AS n, count(c) + any_value(ends > 0)::INT AS v, any_value(ends) AS ends FROM e LEFT JOIN c ON true),
t AS (SELECT w.r, count(*) AS tokens, count(c.c) AS known, sum(log10(coalesce(c.c, 0) + 0.1)) AS own FROM w LEFT JOIN c USING (word) GROUP BY w.r)
SELECT d.doc_id, d.held_out, CAST(coalesce(tokens, 0) + 1 AS BIGINT) AS n_tokens, CAST(coalesce(known, 0) + (ends > 0)::INT AS BIGINT) AS n_known, CAST(n AS BIGINT) AS train_tokens,
  round(coalesce(own, 0) + log10(ends + 0.1) - (coalesce(tokens, 0) + 1) * log10(n + 0.1 * (v + 1)), 6) AS base_score
FROM d LEFT JOIN t USING (r) CROSS JOIN n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_token_packing": op3_token_packing,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_source_mixing": op7_source_mixing,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_preference_formatting": op9_preference_formatting,
        "op10_lattice_scoring": op10_lattice_scoring,
        "mixing_targets": mixing_targets,
        "lattice_base_scores": lattice_base_scores,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; the rest of the operators trains, draws, hashes or tokenizes, which SQL can't express."""
    return {"op9_preference_formatting": chat.FOREIGN_REPLY_SQL, "mixing_targets": MIXING_TARGETS_SQL, "lattice_base_scores": LATTICE_BASE_SQL}
