"""Saved answers: idempotent saving, by day on disk too, maintenance, paging, exports, rendering, promotion into the corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import collapse, strip
from docloom.operators import chunking
from docloom.operators.joins import small
from docloom.operators.storage import stored

PAGE, MAX_PAGE, EXPORTS, TITLE = 50, 200, 5, 40
GENERATED = "generated_asset"
#: Parts of the assets and of their keys: a batch touches those of its keys.
BUCKETS = 16
KEY_FIELDS = ["question", "answer", "sources", "source_status", "evidence", "language", "answer_mode", "model_route"]


def operation_key(columns: list[str] = KEY_FIELDS) -> Column:
    """What makes two savings the same: a hash of their stripped fields, by name."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u001f", *(F.concat(F.lit(f"{c}="), strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in sorted(columns))), 256))


def save(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """payloads (asset_id, created_at, fields) with operation_key and outcome by stored keys and earlier payloads."""
    keyed = payloads.withColumn("operation_key", operation_key([c for c in KEY_FIELDS if c in payloads.columns]))
    first = keyed.groupBy("operation_key").agg(F.min_by("asset_id", F.struct("created_at", "asset_id")).alias("first_id"))
    rows = keyed.join(first.hint("merge"), "operation_key").join(stored.select("operation_key", F.col("asset_id").alias("stored_id")).hint("merge"), "operation_key", "left")
    kept = F.coalesce("stored_id", "first_id")
    return rows.withColumn("kept_id", kept).withColumn("outcome", F.when(F.col("stored_id").isNull() & (F.col("asset_id") == F.col("first_id")), "created").otherwise("idempotent_reuse")).withColumn("day", F.to_date("created_at")).drop("first_id", "stored_id")


def save_by_day(payloads: DataFrame, root: str, buckets: int = BUCKETS) -> DataFrame:
    """Save payloads (asset_id, created_at, fields) under root by bucket of their key, within a bucket in order of days; the rows
    that were new.

    A batch adds files to the buckets of its keys, as many however many days it has; a day is found by the files' least and
    greatest days. A payload whose key is stored, on whatever day, isn't written again. Assets are written before keys: what a
    batch that failed in between has left is taken up by the next one that holds it, so a batch that is repeated leaves one
    copy. One writer at a time.
    """
    keyed = payloads.withColumn("operation_key", operation_key([c for c in KEY_FIELDS if c in payloads.columns]))
    first = keyed.groupBy("operation_key").agg(F.min_by(F.struct(*payloads.columns), F.struct("created_at", "asset_id")).alias("row"))
    rows = first.select("row.*", "operation_key").withColumns({"day": F.to_date("created_at"), "bucket": F.pmod(F.xxhash64("operation_key"), F.lit(buckets)).cast("int")})
    rows = stored(rows, "batch")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
    ids = rows.select("operation_key", "asset_id", "bucket")
    known = _saved(f"{root}/keys", ids).where(F.col("bucket").isin(touched))
    missing = stored(ids.join(known.select("operation_key").hint("merge"), "operation_key", "left_anti"), "missing-keys")
    saved = _saved(f"{root}/assets", rows).where(F.col("bucket").isin(touched))
    left = stored(saved.select(ids.columns).join(missing.select("operation_key").hint("merge"), "operation_key", "left_semi"), "left-assets")
    fresh = stored(rows.join(missing.select("operation_key").hint("merge"), "operation_key", "left_semi").join(small(left.select("operation_key")), "operation_key", "left_anti").select(rows.columns), "new-assets")
    new = fresh.unionByName(saved.join(small(left.select("operation_key")), "operation_key", "left_semi").select(rows.columns))
    new = stored(new, "new-and-left-assets") if is_some(left) else fresh
    _append(fresh, f"{root}/assets", "day")
    _append(new.select(ids.columns), f"{root}/keys", "operation_key")
    return new


def is_some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _saved(path: str, like: DataFrame) -> DataFrame:
    """The table at path with the columns of like; empty before the first batch."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path).select(like.columns)
    except AnalysisException:
        return like.limit(0)


def _append(rows: DataFrame, path: str, order: str) -> None:
    """Add rows to their buckets, a file each, in order."""
    rows.repartition("bucket").sortWithinPartitions("bucket", order).write.mode("append").partitionBy("bucket").parquet(path)


def patch(assets: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """assets with the newer statuses of changes (asset_id, rag_status, publication_status; null: unchanged)."""
    new = changes.select("asset_id", F.col("rag_status").alias("new_rag"), F.col("publication_status").alias("new_publication"), F.lit(True).alias("hit"))
    rows = assets.join(new.hint("merge"), "asset_id", "left")
    return rows.withColumns({"rag_status": F.coalesce("new_rag", "rag_status"), "publication_status": F.coalesce("new_publication", "publication_status"), "updated_at": F.when(F.col("hit"), now).otherwise(F.col("updated_at"))}).drop("new_rag", "new_publication", "hit")


def page(assets: DataFrame, limit: int = PAGE, before: str | None = None) -> DataFrame:
    """The newest assets before a time, at most MAX_PAGE."""
    rows = assets.where(F.col("created_at") < F.lit(before).cast("timestamp")) if before else assets
    return rows.orderBy(F.desc("created_at"), F.desc("asset_id")).limit(min(max(0, limit), MAX_PAGE))


def retain_exports(exports: DataFrame, keep: int = EXPORTS) -> DataFrame:
    """Exports (asset_id, path, created_at) with whether they are kept: the newest few of each asset."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("created_at"), F.desc("path"))
    return exports.withColumn("kept", F.row_number().over(newest) <= keep)


def title_of(question: Column) -> Column:
    return F.substring(collapse(question), 1, TITLE)


def render(assets: DataFrame) -> DataFrame:
    """(asset_id, markdown) of assets with question, answer, sources (array of source_name, chunk_index) and language."""
    listed = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s["source_name"], F.lit("#"), s["chunk_index"].cast("string"))), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("# "), title_of(F.col("question"))), F.lit(""), F.lit("## Question"), strip(F.col("question")), F.lit(""), F.lit("## Answer"), strip(F.col("answer")), F.lit(""), F.lit("## Sources"), listed, F.lit(""), F.lit("## Metadata"), F.concat(F.lit("- language: "), "language"))
    return assets.select("asset_id", body.alias("markdown"))


def promote(assets: DataFrame, promoted: DataFrame) -> DataFrame:
    """Chunks of saved answers that aren't promoted yet, with what they derive from; refusals stay out."""
    todo = assets.where("source_status <> 'no_answer'").join(promoted.select("asset_id").hint("merge"), "asset_id", "left_anti")
    header = F.concat(F.lit("---\nsource_type: generated_asset\ngenerated: true\nasset_id: "), "asset_id", F.lit("\n---\n"))
    docs = render(todo).select(F.concat(F.lit("generated_"), "asset_id").alias("source_key"), F.lit(GENERATED).alias("source_type"), F.concat(header, "markdown").alias("text"))
    about = todo.select(F.concat(F.lit("generated_"), "asset_id").alias("source_key"), "asset_id", F.transform("sources", lambda s: F.concat_ws("#", s["source_name"], s["chunk_index"].cast("string"))).alias("derived_chunks"), F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["source_name"]))).alias("derived_sources"), F.col("source_status").alias("coverage_status"))
    return chunking.chunk_documents(docs).join(about.hint("merge"), "source_key")
