"""The corpus pipeline: toxicity, quality, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's rows to the shared folder and reads them again as the next one's
documents, so that a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmesh.llm import mixing, nearcopies, quality, spm, toxicity
from rankmesh.llm.common import read_table, small_batches, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the folder's labels, doesn't reject; same columns.

    A null text counts as empty, which the model gives the score of its offset; a null
    doc_id is scored and never confirmed. Texts are scored whole, however long.
    Repeated rows share their text's score, a score just at the threshold is rejected.
    No documents give none; no labels reject none. Columns of any name stay as they are.
    """
    small_batches(spark)
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality scorer keeps; same columns.

    A null text counts as empty; such texts are flagged by one labeller and judged by
    the scorer's offset. A null doc_id is an id like any other. Texts are judged
    whole, however long. Repeated rows share their text's score, a score just at the
    threshold is kept. No documents give none. Columns of any name stay as they are.
    """
    small_batches(spark)
    return quality.reject(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: runs of five words in common, at a Jaccard likeness of 0.8 or more; same columns.

    By SimHash fingerprints and pivot distance tables, as op8, with wider fingerprints,
    a radius for that likeness and a count of the runs themselves.
    Texts without words, null ones among them, are copies of one another; a text of
    fewer than five words is one run. Texts are compared whole, however long. Of a
    group the row with the smallest doc_id stays, null ids last, of several rows with
    that id the one with the smallest hash of the text, and of equal ones any single
    one. No documents give none. Columns of any name stay as they are.
    """
    small_batches(spark)
    return nearcopies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, twice or thrice; same columns.

    Sources by code point, null last, weigh 1, 2, 3 in turn. A null or empty text has
    no words and is drawn on its own. Sizes are of whole texts. Rows that agree in
    doc_id, text and source share their copies evenly; a null doc_id is an id like any
    other. Ties fall by doc_id and a hash of the text, so reruns agree. No documents
    give none. Columns of any name stay as they are.
    """
    small_batches(spark)
    return mixing.apply(docs, mixing.plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids, round_trip of each row: its ids, their number, and whether decoding gives the text again.

    A null text has null ids, n_ids and round_trip; an empty text has no ids.
    Texts are encoded whole, however long; repeated rows stay, in any order. No
    documents give none. Other columns are left out, whatever their names.
    """
    small_batches(spark)
    coded = spm.encode(docs.select("doc_id", "lang", "source", "text"), out="ids", check="round_trip")
    return coded.select("doc_id", "lang", "source", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: The stages train models and draw at random; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
