"""State that starts from a table, expires, and is read back."""

import random

from pyspark.sql import functions as F

from docloom.streaming import jobs, state


def finish(out, folder):
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{folder}/out")


def test_stream_from_a_registry_equals_the_fold(spark, tmp_path):
    rng = random.Random(6)
    kinds = ["upload", "upload", "upload", "indexed", "failed", "review_required", "version_conflict"]
    events = [(f"h{rng.randrange(9)}", i, rng.choice(kinds), rng.choice([True, False, None])) for i in range(300)]
    want, status, known = {}, {}, {}
    for h, i, kind, review in events:
        if i == 100:
            known = dict(status)
        now = status.get(h)
        if kind != "upload":
            status[h] = kind if now == "processing" else now
        elif now in (None, "failed") or (now == "review_required" and review):
            want[i], status[h] = "reserved", "processing"
        else:
            want[i] = {"indexed": "duplicate", "processing": "duplicate_pending"}.get(now, now)
    registry = spark.createDataFrame([(h, s) for h, s in known.items() if s] + [(None, "indexed")], "content_hash string, status string")
    for k in (100, 200):
        spark.createDataFrame(events[k : k + 100], "content_hash string, seq long, kind string, review_retry boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = finish(state.content_states_after(jobs.read(spark, f"{tmp_path}/in", 1), registry), tmp_path)
    assert {r["seq"]: r["outcome"] for r in got.collect()} == {i: x for i, x in want.items() if i >= 100}
    kept = {r["key"]["content_hash"]: r["value"]["status"] for r in state.state_rows(spark, f"{tmp_path}/c", "status").collect()}
    assert kept == {h: s for h, s in status.items() if s}


def test_uploads_in_flight_expire(spark, tmp_path):
    rows = sorted((10**9 + s, f"c{s % 11 % 5}") for s in range(0, 14400, 53))
    rows += [(10**9 + 20000, "c0")]
    want, last = [], {}
    for s, content in rows:
        if content not in last or s - last[content] > 600:
            want.append((content, s))
            last[content] = s
    for k in range(4):
        part = rows[k * 80 : k * 80 + 80]
        spark.createDataFrame(part, "s int, content_hash string").select("content_hash", F.timestamp_seconds(F.col("s")).alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = finish(state.first_uploads_in_time(jobs.read(spark, f"{tmp_path}/in", 1)), tmp_path)
    assert sorted((r["content_hash"], r["s"]) for r in got.select("content_hash", F.unix_timestamp("ts").alias("s")).collect()) == sorted(want)
    # After the last batch the watermark has passed all but the last upload, whose state alone remains.
    left = [r["key"]["content_hash"] for r in state.state_rows(spark, f"{tmp_path}/c", "taken").collect()]
    assert left == ["c0"] and len(last) == 5


def test_latest_events_by_their_state(spark, tmp_path):
    rows = [(i % 3, ("queued", "done", "failed")[i % 3 if i < 6 else 1], i) for i in range(9)]
    events = spark.createDataFrame(rows, "task_id int, status string, seq int").withColumn("ts", F.timestamp_seconds(F.lit(0) + F.col("seq")))
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    state.keep_latest(jobs.read(spark, f"{tmp_path}/in", 1), f"{tmp_path}/c")
    found = state.read_latest(spark, f"{tmp_path}/c")
    assert {r["task_id"]: (r["seq"], r["status"]) for r in found.collect()} == {0: (6, "done"), 1: (7, "done"), 2: (8, "done")}
    assert state.read_latest(spark, f"{tmp_path}/c", 0).count() <= 3


def test_a_content_costs_few_calls_to_the_state():
    class Value:
        def __init__(self, calls):
            self.calls, self.at = calls, None

        def exists(self):
            self.calls.append("exists")
            return self.at is not None

        def get(self):
            self.calls.append("get")
            return self.at

        def update(self, at):
            self.calls.append("update")
            self.at = at

        def clear(self):
            self.calls.append("clear")
            self.at = None

    class Handle:
        def __init__(self):
            self.calls = []

        def getValueState(self, name, schema):
            return Value(self.calls)

        def registerTimer(self, at):
            self.calls.append("timer")

    class Expired:
        def getExpiryTimeInMs(self):
            return 10**9

    handle, flight = Handle(), state.InFlight(100)
    flight.init(handle)
    got = flight.handleInputRows(("c",), iter([{"at": 350}, {"at": 0}, {"at": 100}, {"at": 101}]), None)
    assert [(r["content_hash"], r["at"]) for r in got] == [("c", 0), ("c", 101), ("c", 350)]
    assert handle.calls == ["get", "update", "timer"]
    assert not list(flight.handleInputRows(("c",), iter([{"at": 450}]), None)) and handle.calls[3:] == ["get"]
    assert not list(flight.handleExpiredTimer(("c",), None, Expired())) and handle.calls[4:] == ["get", "clear"]
