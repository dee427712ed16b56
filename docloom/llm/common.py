"""Shared by the operators: scratch tables, columns by name, whole-text access from Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds in NumPy arrays at a time; one longer document is a chunk of its own. Where a chunk's
#: texts needn't share work, a half of that is held.
CHUNK_BYTES = 4 << 20
HALF_CHUNK = CHUNK_BYTES // 2
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let the session send Python at most BATCH_BYTES at a time: its default of 64 MB is held several times over."""
    if spark.conf.get(_BATCH_SETTING, "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, over as many partitions as there are cores where its files give fewer: texts are heavy work."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def id_kind(docs: DataFrame, name: str = "doc_id") -> str:
    """The type in which operators carry that id: strings and binaries as they are, all others as whole numbers."""
    kind = docs.schema[name].dataType.simpleString()
    return kind if kind in ("string", "binary") else "bigint"


def id_column(docs: DataFrame, name: str = "doc_id") -> Column:
    return F.col(name).cast(id_kind(docs, name)).alias(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or where that is unset in the warehouse.

    On a local master, as in tests, driver and executors are one machine and its /tmp serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        base = "file:///tmp/checkpoints"
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: it cuts the lineage, and lost executors cost no recomputation of it."""
    bound_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a Python worker, that waits for its next task, gives back the memory it no longer uses."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets (len + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, but for single longer rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first `keys` columns (numbers without nulls), across batches."""
    held, last = [], None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        if not batch.num_rows:
            continue
        change = np.ones(batch.num_rows, bool)
        change[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
        bounds = np.append(np.flatnonzero(change), batch.num_rows).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            key = tuple(x[a] for x in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def put_file(folder: str, name: str, content: bytes) -> str:
    """Write under another name first, so a lost or repeated task never leaves half a file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def get_file(path: str) -> bytes:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def added(rows: DataFrame, size: int) -> np.ndarray:
    """Rows (k, v: doubles) summed by k, for k below a fixed bound; a task holds a batch and the sum of one k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(0)
        for batch in batches:
            keys, (data, off) = batch.column(0).to_numpy(), utf8_column(batch.column(1))
            bounds = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            for a, b in zip(bounds.tolist(), np.append(bounds[1:], len(keys)).tolist(), strict=True):
                if key is not None and keys[a] != key:
                    yield pa.RecordBatch.from_pydict({"k": pa.array([key], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})
                part = data[off[a] : off[b]].view(np.float64).reshape(b - a, -1).sum(axis=0)
                key, total = keys[a], total + part if key == keys[a] else part
        if key is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array([key], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    found = rows.repartition("k").sortWithinPartitions("k").mapInArrow(lean(run), "k int, v binary").collect()
    out = np.zeros((size, len(found[0]["v"]) // 8 if found else 1))
    for r in found:
        out[r["k"]] = np.frombuffer(r["v"])
    return out
