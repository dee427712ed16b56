"""Incremental ingest, content states, task states and suppressed repeats as Structured Streaming jobs."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.text import content_hash
from docloom.operators import chunking, registry, storage

#: How long an upload in flight suppresses its repeats.
IN_FLIGHT = "10 minutes"
#: Batches after which the states of tasks are merged.
COMPACT = 50
#: Parts of the registry of contents, by hash: a batch reads those of its own contents.
BUCKETS = 64


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder or file of Parquet as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def run(stream: DataFrame, each, checkpoint: str) -> None:
    """Process what is there, batch by batch, and stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(docs: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Chunks of contents that no earlier batch brought, under out/chunks; their hashes under out/registry, by bucket.

    A batch writes its own folders, so a repeated one replaces what it wrote. Of the registry it reads only the buckets of
    its contents. Of rows with equal contents the one with the smallest source_key is taken, once.
    """
    spark = docs.sparkSession
    known_as = "content_hash string, batch int, bucket int"

    def batch(rows: DataFrame, number: int) -> None:
        hashed = rows.withColumn("content_hash", content_hash(F.col("text")))
        first = hashed.groupBy("content_hash").agg(F.min("source_key").alias("source_key")).withColumn("bucket", F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int"))
        known = spark.createDataFrame([], known_as)
        if number:
            first = storage.stored(first, "contents")
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most `buckets`
            known = spark.read.option("basePath", f"{out}/registry").schema(known_as).parquet(f"{out}/registry").where((F.col("batch") < number) & F.col("bucket").isin(touched))
        new = first.join(known.select("content_hash").hint("merge"), "content_hash", "left_anti")
        fresh = hashed.join(new.select("content_hash", "source_key").hint("merge"), ["content_hash", "source_key"], "left_semi").dropDuplicates(["content_hash", "source_key"])
        chunking.chunk_documents(fresh.select("source_key", "source_type", "text")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        new.select("content_hash", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/registry/batch={number}")

    run(docs, batch, checkpoint)


def content_states(events: DataFrame) -> DataFrame:
    """Uploads and outcomes by content (content_hash, seq, kind) to what each upload met: the registry as keyed state.

    kind: upload, or the outcome of the one in flight (indexed, failed, review_required, version_conflict). Columns
    review_retry and version_retry, where events have them, let an upload try again after a review or a conflict.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for seq, kind, review, version in zip(rows["seq"].tolist(), rows["kind"], rows["review_retry"], rows["version_retry"], strict=True):
            if kind != "upload":
                status = kind if status == "processing" else status
            elif status in (None, "failed") or status == "review_required" and review or status == "version_conflict" and version:
                out.append((key[0], seq, "reserved"))
                status = "processing"
            else:
                out.append((key[0], seq, {"indexed": "duplicate", "processing": "duplicate_pending"}.get(status, status)))
        if status is not None:
            state.update((status,))
        yield pd.DataFrame(out, columns=["content_hash", "seq", "outcome"])

    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in events.columns else F.lit(False) for c in ("review_retry", "version_retry")}
    rows = events.select("content_hash", "seq", "kind", *(v.alias(c) for c, v in flags.items()))
    return rows.groupBy("content_hash").applyInPandasWithState(step, "content_hash string, seq long, outcome string", "status string", "append", GroupStateTimeout.NoTimeout)


def task_states(events: DataFrame, out: str, checkpoint: str, compact: int = COMPACT) -> None:
    """The latest state of each task: every batch writes those of its own tasks, and every `compact` batches all are merged.

    A repeated batch replaces what it wrote. What is merged is published as a version (storage.publish) with the number
    of the last batch in it; read_task_states joins it with the batches after that. Older batches and versions can be
    removed at any time.
    """
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy("task_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("last")).select("task_id", "last.*")
        latest.write.mode("overwrite").parquet(f"{out}/batches/batch={number}")
        if (number + 1) % compact == 0:
            storage.publish({"tasks": read_task_states(spark, out), "upto": spark.createDataFrame([(number,)], "batch int")}, f"{out}/merged")

    run(events, batch, checkpoint)


def read_task_states(spark: SparkSession, out: str) -> DataFrame:
    """task_id, status, ts and seq of every task, from the last merged version and the batches after it."""
    batches = spark.read.option("basePath", f"{out}/batches").parquet(f"{out}/batches")
    try:
        upto = storage.published(spark, f"{out}/merged", "upto").collect()[0]["batch"]
    except ValueError:
        return registry_latest(batches.drop("batch"))
    return registry_latest(storage.published(spark, f"{out}/merged", "tasks").unionByName(batches.where(F.col("batch") > upto).drop("batch")))


def registry_latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id").agg(F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("last")).select("task_id", "last.*")


def first_uploads(events: DataFrame, within: str = IN_FLIGHT) -> DataFrame:
    """Uploads (content_hash, ts) without repeats of the same content in flight.

    An upload is accepted if the last accepted one of its content is more than `within` older; repeats don't prolong
    it. Within a micro-batch uploads are taken in order of ts. No upload is dropped for being late: one that comes
    after a newer one of its content was accepted, in an earlier batch, is a repeat if at most `within` lies between it and
    an accepted one, before or after. Uploads without a ts are all accepted. The times accepted are kept for each
    content (at most one for each `within`) and never expire. Where batches come in order of time, the result is that
    of one batch over all.
    """
    gap = int(pd.Timedelta(within) / pd.Timedelta(microseconds=1))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = list(state.get[0]) if state.exists else []
        new, untimed = [], 0
        for frame in frames:
            new.extend(frame["at"][frame["timed"]].tolist())
            untimed += int((~frame["timed"]).sum())
        out = []
        for at in sorted(new):
            k = bisect.bisect_left(taken, at)
            if (k == 0 or at - taken[k - 1] > gap) and (k == len(taken) or taken[k] - at > gap):
                taken.insert(k, at)
                out.append(at)
        state.update((taken,))
        n = len(out) + untimed
        yield pd.DataFrame({"content_hash": pd.Series([key[0]] * n, dtype="object"), "at": pd.Series(out + [0] * untimed, dtype="int64"), "timed": pd.Series([True] * len(out) + [False] * untimed, dtype="bool")})

    rows = events.select("content_hash", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).alias("at"), F.col("ts").isNotNull().alias("timed"))
    kept = rows.groupBy("content_hash").applyInPandasWithState(step, "content_hash string, at long, timed boolean", "taken array<long>", "append", GroupStateTimeout.NoTimeout)
    return kept.select("content_hash", F.when(F.col("timed"), F.timestamp_micros("at")).alias("ts"))


def latest_tasks(events: DataFrame) -> DataFrame:
    """The batch form of task_states."""
    return registry.latest_tasks(events)
