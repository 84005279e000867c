"""The queries of this subpackage, each one thin call of its operator over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import jaccard, langid, multiindex, oracles, packing, pieces, pii, secrets, substring, topk, warc
from quillon.runtime import Scratch, load


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(load(spark, sf_dir, "documents")))


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(load(spark, sf_dir, "embeddings"))


def op4_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(load(spark, sf_dir, "documents"), texts=False)


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"), jaccard.Rule(k=4, num=85, den=100))


def op6_warc_sharded_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(load(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(load(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, Scratch(spark, "secrets").path("ledger"))  # a new one: the query scans every blob
    return secrets.digest(secrets.scan_versions(load(spark, sf_dir, "documents").select("doc_id", "text"), ledger))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out(F.col("doc_id"))
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~out))
    found = langid.identify(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = [op1_best_fit_packing, op2_pii_weak_supervision, op3_inverted_multi_index, op4_fixed_block_anchors, op5_grouped_prefix_join, op6_warc_sharded_writer, op7_suffix_array_pieces, op8_exact_top_k, op9_secret_scan, op10_language_id]
ORACLES = {
    "op3_inverted_multi_index": oracles.MULTI_INDEX,
    "op4_fixed_block_anchors": oracles.ANCHORS,
    "op5_grouped_prefix_join": oracles.PREFIX_JOIN,
    "op6_warc_sharded_writer": oracles.WARC,
    "op8_exact_top_k": oracles.TOP_K,
    "op9_secret_scan": oracles.SECRETS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Operators of the list, in order."""
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the query."""
    return dict(ORACLES)
