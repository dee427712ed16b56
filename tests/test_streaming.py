import random

from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.streaming import jobs


def test_ingest_equals_batch_without_repeats(spark, tmp_path):
    rows = [(str(i), "text", f"document {i % 7} " + "x" * 50) for i in range(20)]
    docs = spark.createDataFrame(rows, "source_key string, source_type string, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = jobs.read(spark, str(tmp_path / "in"), 2)
    jobs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert got.count() == 7
    want = chunking.chunk_documents(docs).select(F.md5("text").alias("h")).distinct()
    assert {r["h"] for r in got.select(F.md5("text").alias("h")).collect()} == {r["h"] for r in want.collect()}
    assert spark.read.parquet(str(tmp_path / "out" / "registry")).count() == 7
    # The same rows again bring nothing, nor does a repeated row of one key.
    docs.unionByName(docs).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("k", "text", "new content")] * 3, docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.ingest(jobs.read(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == 8


def test_content_states(spark, tmp_path):
    events = [("a", 1, "upload"), ("a", 2, "upload"), ("a", 3, "failed"), ("a", 4, "upload"), ("a", 5, "indexed"), ("a", 6, "upload"), ("b", 1, "upload"), ("b", 2, "review_required"), ("b", 3, "upload")]
    spark.createDataFrame(events, "content_hash string, seq long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.content_states(jobs.read(spark, str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["content_hash"], r["seq"]): r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): "reserved", ("a", 2): "duplicate_pending", ("a", 4): "reserved", ("a", 6): "duplicate", ("b", 1): "reserved", ("b", 3): "review_required"}


def test_content_states_equal_a_fold(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["upload", "upload", "upload", "indexed", "failed", "review_required", "version_conflict"]
    events = [(f"h{rng.randrange(12)}", i, rng.choice(kinds), rng.choice([True, False, None]), rng.choice([True, False, None])) for i in range(400)]
    want, status = {}, {}
    for h, i, kind, review, version in events:
        now = status.get(h)
        if kind != "upload":
            status[h] = kind if now == "processing" else now
        elif now in (None, "failed") or (now == "review_required" and review) or (now == "version_conflict" and version):
            want[i], status[h] = "reserved", "processing"
        else:
            want[i] = {"indexed": "duplicate", "processing": "duplicate_pending"}.get(now, now)
    for k in range(4):  # four files, four batches
        spark.createDataFrame(events[k * 100 : k * 100 + 100], "content_hash string, seq long, kind string, review_retry boolean, version_retry boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = jobs.content_states(jobs.read(spark, str(tmp_path / "in"), 1))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["seq"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_task_states_equal_batch(spark, tmp_path):
    rows = [(i % 3, ("queued", "done", "failed")[i % 3 if i < 6 else 1], i) for i in range(9)]
    events = spark.createDataFrame(rows, "task_id int, status string, seq int").withColumn("ts", F.timestamp_seconds(F.lit(0) + F.col("seq")))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    for compact in (2, 100):  # merged on the way, never merged
        out = str(tmp_path / f"out{compact}")
        jobs.task_states(jobs.read(spark, str(tmp_path / "in"), 1), out, str(tmp_path / f"c{compact}"), compact)
        assert {r["task_id"]: r["seq"] for r in jobs.read_task_states(spark, out).collect()} == {0: 6, 1: 7, 2: 8}
    # A batch holds its own tasks alone, not all.
    assert spark.read.parquet(str(tmp_path / "out100" / "batches")).groupBy("batch").count().agg(F.max("count")).collect()[0][0] <= 3


def test_repeats_in_flight(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 30)]
    spark.createDataFrame(rows, "content_hash string, s int").select("content_hash", F.timestamp_seconds(F.col("s")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.first_uploads(jobs.read(spark, str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["content_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_repeats_are_suppressed_for_ten_minutes_only(spark, tmp_path):
    rows = sorted([(s, "ab"[s % 7 % 2]) for s in range(0, 7200, 97)] + [(0, "a"), (600, "c"), (1200, "c"), (1201, "c")])
    want, last = [], {}
    for s, content in rows:
        if content not in last or s - last[content] > 600:
            want.append((content, s))
            last[content] = s

    def first(name, parts):
        for part in parts:
            spark.createDataFrame(part, "s int, content_hash string").select("content_hash", F.timestamp_seconds(F.col("s")).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        out = jobs.first_uploads(jobs.read(spark, str(tmp_path / f"{name}-in"), 1))
        out.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["content_hash"], r["s"]) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).select("content_hash", F.unix_timestamp("ts").alias("s")).collect()), key=str)

    assert len(want) > 20
    for n in (1, 2, 5):
        assert first(f"split{n}", [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]) == sorted(want, key=str)
    assert first("late", [[(5000, "a"), (None, "a")], [(100, "a"), (4500, "a"), (5500, "a"), (200, "a"), (None, "a")]]) == [("a", 100), ("a", 5000), ("a", None), ("a", None)]
