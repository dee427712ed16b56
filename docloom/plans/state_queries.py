"""Queries over streams with keyed state: from a registry on, with expiry, and read back from the state itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.operators.storage import scratch
from docloom.plans.layout_queries import ORACLE as STREAMS
from docloom.streaming import jobs, state


def _kind():
    return F.when(F.col("doc_id") % 3 == 0, "failed").when(F.col("doc_id") % 3 == 1, "indexed").otherwise("review_required")


def stream_registry_states(spark, d):
    """The later half of the documents, each uploaded twice with an outcome in between, after a registry of the first half."""
    at = scratch(spark, "stream")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(content_hash(F.col("text")).alias("content_hash"), "doc_id")
    half = (docs.agg(F.max("doc_id")).collect()[0][0] or 0) // 2
    # Of the first half, the first outcome that isn't a failure stays; after failures alone the last upload is in flight.
    known = docs.where(F.col("doc_id") <= half).groupBy("content_hash").agg(F.coalesce(F.min_by(F.when(_kind() != "failed", _kind()), F.when(_kind() != "failed", F.col("doc_id"))), F.lit("processing")).alias("status"))
    later = jobs.read(spark, f"{d}/documents.parquet").where(F.col("doc_id") > half).select(content_hash(F.col("text")).alias("content_hash"), "doc_id")
    events = later.select("content_hash", "doc_id", F.posexplode(F.array(F.lit("upload"), _kind(), F.lit("upload"))).alias("k", "kind")).select("content_hash", (F.col("doc_id") * 3 + F.col("k")).alias("seq"), "kind")
    state.content_states_after(events, known).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string, seq long, outcome string").parquet(f"{at}/out").select("seq", "outcome")


def stream_uploads_in_time(spark, d):
    """Uploads without repeats in flight, whose state expires."""
    at = scratch(spark, "stream")
    events = jobs.read(spark, f"{d}/events.parquet").select(F.concat_ws("-", "user_id", "event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    state.first_uploads_in_time(events).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string, ts timestamp").parquet(f"{at}/out").groupBy("content_hash").agg(F.count("*").alias("n"))


def stream_latest_state(spark, d):
    """Every task's latest event, read from the state of an aggregate in update mode."""
    at = scratch(spark, "stream")
    events = jobs.read(spark, f"{d}/events.parquet").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    state.keep_latest(events, f"{at}/checkpoint")
    return state.read_latest(spark, f"{at}/checkpoint").select("task_id", "status", "ts")


QUERIES = {f.__name__: f for f in (stream_registry_states, stream_uploads_in_time, stream_latest_state)}
ORACLE = {
    "stream_registry_states": f"SELECT * FROM ({STREAMS['stream_content_states']}) WHERE seq // 3 > (SELECT max(doc_id) // 2 FROM documents)",
    "stream_uploads_in_time": STREAMS["stream_first_uploads"],
    "stream_latest_state": STREAMS["stream_task_state"],
}
