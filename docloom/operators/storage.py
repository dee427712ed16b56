"""Tables of the engine's own, in folders that driver and executors share, and their published versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import registry
from docloom.operators.joins import is_small, side
from docloom.operators.versions import VersionedTables


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or where that is unset in the warehouse; both are shared.

    On a local master, as in tests, driver and executors are one machine and its /tmp serves.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (master == "local" or master.startswith("local[")):
        base = "file:///tmp/checkpoints"
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, as the maintained index has it, for what reads it several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: work on texts is heavier than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def publish(tables: dict[str, DataFrame], root: str, expected: int | None = None) -> int:
    """Write the tables as one version under root; its number.

    Readers see all of a version or nothing of it, and of several writers none hides another's version unseen: with
    expected (the number the tables were made from) a writer who was overtaken gets a Conflict.
    """
    return VersionedTables(next(iter(tables.values())).sparkSession, root).publish(tables, expected)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    return VersionedTables(spark, root).table(name)


def publish_index(chunks: DataFrame, postings: DataFrame, vectors: DataFrame, root: str) -> int:
    """Publish chunks (chunk_id ...), their postings and vectors together; chunks without a vector are quarantined instead.

    postings may be token rows or chunks' texts (chunk_id, tokens or text): only those of chunks that are kept are split into terms.
    """
    from docloom.operators import search

    found = vectors.where("vector is not null")
    ids = stored(chunks.select("chunk_id").join(found.select("chunk_id").distinct().hint("merge"), "chunk_id", "left_semi"), "kept-ids")
    few = is_small(ids)
    mine = lambda df: df.join(side(ids, few), "chunk_id", "left_semi")
    if "term" not in postings.columns:
        # Stored, so that the ids are met by rows of chunks rather than by each of their words.
        postings = search.postings(stored(mine(postings), "kept-tokens"))
    else:
        postings = mine(postings)
    return publish({"chunks": mine(chunks), "postings": postings, "vectors": mine(found), "quarantine": registry.quarantine(chunks, vectors)}, root)
