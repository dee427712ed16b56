"""Registries of contents and sources, maintained index tables, and their health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = "indexed"
#: Hashes that a sketch of sources holds.
SKETCH = 65_536


def duplicates(docs: DataFrame, content_hash: Column, order: str) -> DataFrame:
    """docs with the survivor of their content: the first by order."""
    hashed = docs.withColumn("content_hash", content_hash)
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("survivor"))
    return hashed.join(first.hint("merge"), "content_hash")


def reserve(incoming: DataFrame, registry: DataFrame, review_retry: Column | None = None, version_retry: Column | None = None) -> DataFrame:
    """incoming (content_hash, seq) with its outcome by the registry (content_hash, status) and earlier rows of the batch."""
    review_retry, version_retry = (F.lit(False) if x is None else x for x in (review_retry, version_retry))
    first = incoming.groupBy("content_hash").agg(F.min("seq").alias("first_seq"))
    rows = incoming.join(first.hint("merge"), "content_hash").join(registry.select("content_hash", F.col("status").alias("known")).hint("merge"), "content_hash", "left")
    kept = (
        F.when(F.col("known") == "indexed", "duplicate").when(F.col("known") == "processing", "duplicate_pending").when((F.col("known") == "review_required") & ~review_retry, "review_required")
        .when((F.col("known") == "version_conflict") & ~version_retry, "version_conflict").when(F.col("seq") > F.col("first_seq"), "duplicate_pending").otherwise("reserved")
    )
    return rows.withColumn("outcome", kept).drop("known", "first_seq")


def latest_active(sources: DataFrame) -> DataFrame:
    """The newest indexed source of each original name."""
    order = Window.partitionBy("original_name").orderBy(F.desc("created_at"), F.desc("source_id"))
    return sources.where(F.col("status") == ACTIVE).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def listed(sources: DataFrame) -> DataFrame:
    """Sources that can be seen, newest first."""
    return sources.where(F.col("status").isin(ACTIVE, "delete_failed")).orderBy(F.desc("created_at"), F.desc("source_id"))


def version_conflicts(reserved: DataFrame, sources: DataFrame) -> DataFrame:
    """Reserved uploads with the active source of the same name, if its content differs and no policy decides."""
    active = latest_active(sources).select("original_name", F.col("source_id").alias("active_id"), F.col("content_hash").alias("active_hash"))
    rows = reserved.join(active.hint("merge"), "original_name", "left")
    conflict = (F.col("outcome") == "reserved") & F.col("active_id").isNotNull() & (F.col("active_hash") != F.col("content_hash"))
    decided = F.coalesce(F.col("version_policy"), F.lit("")).isin("replace", "keep")
    replaced = conflict & (F.col("version_policy") == "replace")
    return rows.withColumn("outcome", F.when(conflict & ~decided, "version_conflict").otherwise(F.col("outcome"))).withColumn("replaces", F.when(replaced, F.col("active_id"))).drop("active_id", "active_hash")


def replace_versions(sources: DataFrame, replaced: DataFrame, failed: DataFrame) -> DataFrame:
    """sources after replacement: replaced ids (source_id) go, but for those whose removal failed; these are marked."""
    marked = replaced.select("source_id").distinct().join(failed.select("source_id").distinct().withColumn("failed", F.lit(True)).hint("merge"), "source_id", "left")
    rows = sources.join(marked.withColumn("hit", F.lit(True)).hint("merge"), "source_id", "left")
    return rows.where(F.col("hit").isNull() | F.col("failed").isNotNull()).withColumn("status", F.when(F.col("failed"), "delete_failed").otherwise(F.col("status"))).drop("hit", "failed")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those with their keys."""
    return table.join(new.select(key).distinct().hint("merge"), key, "left_anti").unionByName(new)


def quarantine(chunks: DataFrame, vectors: DataFrame, reason: str = "no vector") -> DataFrame:
    """Chunks without a vector: they are kept out of both indexes."""
    return chunks.join(vectors.where("vector is not null").select("chunk_id").hint("merge"), "chunk_id", "left_anti").select("chunk_id", F.lit(reason).alias("reason"))


def without(rows: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.join(gone.select(key).distinct().hint("merge"), key, "left_anti")


def delete_sources(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks without those of gone (source_id, source_name); the name counts where no chunk has the id."""
    by_id = gone.join(chunks.select("source_id").distinct().hint("merge"), "source_id", "left_semi")
    by_name = gone.join(by_id.select("source_id").hint("merge"), "source_id", "left_anti").select("source_name").distinct()
    kept = chunks.join(by_id.select("source_id").distinct().hint("merge"), "source_id", "left_anti")
    return kept.join(by_name.hint("merge"), "source_name", "left_anti")


def backfill_sources(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Source rows from chunks (source_id, source_name, raw_path, chunk_index) for ids that known lacks."""
    legacy = F.concat(F.lit("legacy_"), F.substring(F.sha2(F.concat("source_name", F.lit("\n"), "raw_path"), 256), 1, 24))
    rows = chunks.withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), legacy))
    found = rows.groupBy("source_id").agg(F.count("*").alias("chunk_count"), F.min_by("source_name", "chunk_index").alias("source_name"))
    return found.join(known.select("source_id").hint("merge"), "source_id", "left_anti")


def backfill_hashes(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows for indexed files (content_hash, source_name, chunk_count) it doesn't know, the first of each content."""
    first = files.groupBy("content_hash").agg(F.min_by(F.struct("source_name", "chunk_count"), F.struct("source_name", "chunk_count")).alias("f"))
    return first.join(registry.select("content_hash").hint("merge"), "content_hash", "left_anti").select("content_hash", "f.source_name", "f.chunk_count", F.lit(ACTIVE).alias("status"))


def lookup(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """refs (ref) with their chunk; a reference without an index means the first chunk."""
    keyed = refs.withColumn("chunk_id", F.when(F.contains("ref", F.lit("#")), F.col("ref")).otherwise(F.concat("ref", F.lit("#0"))))
    return keyed.join(chunks.hint("merge"), "chunk_id")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_type").agg(F.count_distinct("source_key").alias("sources"), F.count("*").alias("chunks"))


def stat_sketches(chunks: DataFrame, by: list[str]) -> DataFrame:
    """What corpus_stats needs of each part of the chunks (by: say, the day they came), as mergeable sketches to be stored.

    A sketch is the SKETCH smallest hashes (52 bits of an MD5) of the sources' keys, in `sources`.
    """
    keys = [*by, "source_type"]
    number = F.conv(F.substring(F.md5("source_key"), 1, 13), 16, 10).cast("long").alias("hash")
    counted = chunks.groupBy(*keys).agg(F.count("*").alias("chunks"))
    smallest = Window.partitionBy(*keys).orderBy("hash")
    first = chunks.where("source_key is not null").select(*keys, number).distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= SKETCH)
    held = first.groupBy(*keys).agg(F.collect_list("hash").alias("sources"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    return counted.alias("c").join(held.alias("h").hint("merge"), same, "left").select("c.*", "h.sources")


def merged_stats(sketches: DataFrame) -> DataFrame:
    """corpus_stats from stored sketches of any parts, without the chunks: sources within about 0.4 %, exact while there are fewer than SKETCH."""
    smallest = Window.partitionBy("source_type").orderBy("hash")
    hashes = sketches.select("source_type", F.explode("sources").alias("hash")).distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= SKETCH)
    estimate = F.when(F.count("*") < SKETCH, F.count("*")).otherwise(F.floor(F.lit((SKETCH - 1) * 2.0**52) / (F.max("hash") + 1).cast("double")))
    sources = hashes.groupBy("source_type").agg(estimate.alias("sources"))
    chunks = sketches.groupBy("source_type").agg(F.sum("chunks").alias("chunks"))
    rows = chunks.alias("c").join(sources.alias("s").hint("merge"), F.col("c.source_type").eqNullSafe(F.col("s.source_type")), "left")
    return rows.select("c.source_type", F.coalesce("s.sources", F.lit(0)).alias("sources"), "c.chunks")


def index_difference(chunks: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids that one of the tables lacks, with what lacks them."""
    every = chunks.select("chunk_id").unionByName(postings.select("chunk_id")).unionByName(vectors.select("chunk_id")).distinct()
    out = None
    for name, table in (("chunks", chunks), ("postings", postings), ("vectors", vectors)):
        more = every.join(table.select("chunk_id").distinct().hint("merge"), "chunk_id", "left_anti").withColumn("missing_in", F.lit(name))
        out = more if out is None else out.unionByName(more)
    return out


def latest_tasks(events: DataFrame) -> DataFrame:
    """The last state of each task (task_id, status, ts, seq)."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("last")).select("task_id", "last.status", "last.ts")


def task_health(tasks: DataFrame) -> DataFrame:
    """Tasks by status and, where they have one, by the quality action of their result: measure, value, n."""
    rows = tasks if "quality_action" in tasks.columns else tasks.withColumn("quality_action", F.lit(None).cast("string"))
    pairs = F.array(F.struct(F.lit("status").alias("measure"), F.coalesce("status", F.lit("unknown")).alias("value")), F.struct(F.lit("quality_action").alias("measure"), F.coalesce("quality_action", F.lit("")).alias("value")))
    counted = rows.select(F.explode(pairs).alias("x")).select("x.measure", "x.value").groupBy("measure", "value").agg(F.count("*").alias("n"))
    return counted.where("measure = 'status' or value <> ''")


def knowledge_health(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """task_health with the corpus beside it: sources and chunks in all, and sources by type."""
    whole = chunks.agg(F.count_distinct("source_key").alias("indexed_sources"), F.count("*").alias("total_chunks"))
    totals = whole.select(F.explode(F.array(*(F.struct(F.lit(x).alias("measure"), F.lit("").alias("value"), F.col(x).alias("n")) for x in ("indexed_sources", "total_chunks")))).alias("x")).select("x.*")
    kinds = corpus_stats(chunks).select(F.lit("source_type").alias("measure"), F.col("source_type").alias("value"), F.col("sources").alias("n"))
    return task_health(tasks).unionByName(totals).unionByName(kinds)


def batch_rollup(uploads: DataFrame) -> DataFrame:
    """Per batch (batch_id, status, chunks): counts by outcome, chunks, and the batch's own status."""
    kinds = {"succeeded": ["ok"], "accepted": ["accepted", "queued"], "duplicate": ["duplicate", "duplicate_pending"], "review": ["review_required"], "conflict": ["version_conflict"], "skipped": ["skipped"], "failed": ["failed"]}
    counted = uploads.groupBy("batch_id").agg(F.count("*").alias("files"), *(F.count_if(F.col("status").isin(names)).alias(kind) for kind, names in kinds.items()), F.sum("chunks").alias("chunks"))
    done = F.col("succeeded") + F.col("duplicate")
    return counted.withColumn("status", F.when(done == F.col("files"), "ok").when((F.col("accepted") > 0) & (done + F.col("accepted") == F.col("files")), "accepted").otherwise("partial"))


def recover_tasks(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Open tasks (task_id, status, raw_file_path) after a restart: requeued if their file is there, else failed."""
    open_ = tasks.where(F.col("status").isin("queued", "processing")).join(files.select("raw_file_path").distinct().withColumn("there", F.lit(True)).hint("merge"), "raw_file_path", "left")
    return open_.select("task_id", F.when(F.col("there"), "requeued").otherwise("failed").alias("outcome"))
