"""Sources: folders of text documents, dictionary files, and tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import morphology
from quillon.runtime import running_sum


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of every file below path; ids number the paths in order, from 0."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.join(running_sum(rows.select("path"), ["path"], F.lit(1), "doc_id"), "path").select("doc_id", "path", "text")


def _lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of one dictionary source; such files are read whole on the driver."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return text.split("\n")


def tabs(spark: SparkSession, path: str, language: str) -> dict[str, int]:
    """Packed attributes by code from a tab file."""
    return morphology.parse_tabs(_lines(spark, path), language)


def dictionary(spark: SparkSession, path: str, tab_path: str, language: str) -> morphology.Dictionary:
    """Compile a dictionary source and its tab file."""
    return morphology.compile_dictionary(spark, language, tabs(spark, tab_path, language), _lines(spark, path))


def runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Written key-value runs, read as one log."""
    return spark.read.parquet(*paths)
