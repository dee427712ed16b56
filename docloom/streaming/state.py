"""Keyed state of streams by the state API: it starts from tables, expires by timers, and is read back as a table.

The state store is RocksDB, on the executors' disks and in the checkpoint folder, so state isn't bounded by memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.jobs import IN_FLIGHT

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Let streams that this session starts keep their state in RocksDB, which the state API needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class ContentStatus(StatefulProcessor):
    """The registry's status of a content, and what each upload of it meets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        # The registry has one row for a content; of several the last in order of names counts.
        self.status.update((initialState["status"].max(),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else None
        met = []
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, kind, review, version in zip(events["seq"].tolist(), events["kind"], events["review_retry"], events["version_retry"], strict=True):
            if kind != "upload":
                if status == "processing":
                    status = kind
                continue
            again = {"failed": True, "review_required": bool(review), "version_conflict": bool(version)}
            if status is None or again.get(status, False):
                met.append((key[0], seq, "reserved"))
                status = "processing"
            else:
                met.append((key[0], seq, {"indexed": "duplicate", "processing": "duplicate_pending"}.get(status, status)))
        if status is not None:
            self.status.update((status,))
        yield pd.DataFrame(met, columns=["content_hash", "seq", "outcome"])

    def close(self) -> None:
        pass


def content_states_after(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads and outcomes (content_hash, seq, kind) to what each upload met, where registry (content_hash, status) is what came before.

    The registry is loaded into the state when the stream first starts; later starts go on with the checkpoint.
    """
    use_store(events.sparkSession)
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in events.columns else F.lit(False) for c in ("review_retry", "version_retry")}
    rows = events.select("content_hash", "seq", "kind", *(v.alias(c) for c, v in flags.items()))
    known = registry.where(F.col("content_hash").isNotNull() & F.col("status").isNotNull()).select("content_hash", "status").groupBy("content_hash")
    return rows.groupBy("content_hash").transformWithStateInPandas(ContentStatus(), "content_hash string, seq long, outcome string", "append", "none", known)


class InFlight(StatefulProcessor):
    """Accepts an upload if none of its content was accepted `gap` microseconds before; forgets contents by a timer."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.taken = handle, handle.getValueState("taken", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Every call to the state is a message to the JVM and back.
        found = self.taken.get()
        before = last = found[0] if found else None
        out = []
        for at in sorted(row["at"] for row in rows):
            if last is None or at - last > self.gap:
                out.append(at)
                last = at
        if last != before:
            self.taken.update((last,))
            self.handle.registerTimer(self._end(last))
        return iter([Row(content_hash=key[0], at=at) for at in out])

    def _end(self, at: int) -> int:
        """The first millisecond at which an upload is more than the gap after this one."""
        return (at + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A later upload set a timer of its own.
        found = self.taken.get()
        if found and self._end(found[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.taken.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_uploads_in_time(events: DataFrame, within: str = IN_FLIGHT, late: str = IN_FLIGHT) -> DataFrame:
    """Uploads (content_hash, ts) without repeats of the same content in flight, with state only for what is in flight.

    An upload is accepted if the last accepted one of its content is more than `within` older. Uploads that come more than
    `late` behind the newest of earlier batches are dropped. A content's state is one time, which a timer removes once the
    watermark has passed it by `within`: no upload that isn't too late can then be its repeat. Uploads without a ts are none,
    nor are those of 1970-01-01 00:00 and before, where watermarks begin.
    Where no upload is too late and a batch brings none from before an earlier batch's, the result is that of one batch.
    """
    use_store(events.sparkSession)
    gap = int(pd.Timedelta(within) / pd.Timedelta(microseconds=1))
    rows = events.where("ts is not null").select("content_hash", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withWatermark("ts", late)
    kept = rows.groupBy("content_hash").transformWithState(InFlight(gap), "content_hash string, at long", "append", "eventtime")
    return kept.select("content_hash", F.timestamp_micros("at").alias("ts"))


def keep_latest(events: DataFrame, checkpoint: str) -> None:
    """Keep the latest event (status, ts, seq) of each task as a stream's aggregate in update mode; its state is the result."""
    use_store(events.sparkSession)
    last = events.groupBy("task_id").agg(F.max(F.struct("ts", "seq", "status")).alias("last"))
    last.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """task_id, status, ts and seq from the state that keep_latest left, after that batch or the last."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load().select("key.task_id", F.col("value.max").alias("last")).select("task_id", "last.status", "last.ts", "last.seq")


def state_rows(spark: SparkSession, checkpoint: str, name: str | None = None, batch: int | None = None) -> DataFrame:
    """The rows of a stream's state (key, value), of the state variable of that name if it has several."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    for option, value in (("stateVarName", name), ("batchId", batch)):
        if value is not None:
            reader = reader.option(option, value)
    return reader.load()
