"""The corpus pipeline: five stages, each over all documents that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the documents are written as Parquet and read again, so a stage's input never depends on an earlier plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import jaccard, langid, packing, pii, substring
from quillon.runtime import Scratch, load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language holds this share of its letters, or if it has no letter.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which some learned language holds the larger part; lang becomes the language found.

    The model learns from the labelled documents of this input that are not held out.
    """
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, spans=False, keep=tuple(COLUMNS))
    kept = found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near duplicates (five words, similarity 0.8).

    Of rows that share a doc_id the one with the smallest text stays; rows without a doc_id go.
    """
    classes = jaccard.near_duplicates(docs, jaccard.Rule(k=5, num=80, den=100))
    first = classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    rows = docs.join(first, "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars"))
    return rows.withColumn("place", place).filter("place = 1").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that an earlier document has; a document that loses all its words goes."""
    rows = substring.dedup(docs, keep=tuple(COLUMNS)).filter("kept is null or kept <> ''")
    size = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long"))
    return rows.withColumn("n_chars", size).withColumn("text", F.coalesce("kept", "text")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data with its kind; every document stays."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", packing_plan),
]

#: SQL has no tokenizer, EM or Viterbi; tests hold run() against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
