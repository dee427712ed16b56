"""The given tables as the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.storage import spread, stored

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, every second one taken for a pdf."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_key"), "doc_id", F.col("source").alias("source_name"), F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("text").alias("source_type"), "text")


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown: the source as title, every line after the first as a section's heading and text."""
    text = F.concat(F.lit("# "), "source", F.lit("\nPreface\n"), F.regexp_replace("text", "\n", "\n## "))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_key"), F.lit("text").alias("source_type"), text.alias("text"))


def pages_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the pages of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))


_kept: dict[tuple[str, str, str, int], object] = {}


def _state(spark: SparkSession, sf_dir: str) -> int:
    """What changes when a file of the given tables does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for entry in fs.listStatus(path):
        for file in fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]:
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hash(tuple(sorted(found)))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What the first query of a session that needs it makes of the given tables.

    Tables that were written anew since then (by their files' names, sizes and times) get it anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def maintained(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the index over the given tables: built and stored by the first query of a session that needs it."""
    return kept(spark, sf_dir, name, lambda: stored(build(), name))
