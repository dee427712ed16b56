"""Operator 7: token ids of documents in patched frame-of-reference files.

A file holds ids of consecutive documents in blocks of 256. A block stores its minimum, a bit width that suits
PERCENTILE of its values, the packed low bits of all values, and a list of exceptions (place, high bits) for the
rest. The file ends with the starts of all blocks, so any range of ids is read by decoding its blocks alone.

Defined results: null and empty texts have only the end id; a null doc_id sorts first; rows that share a doc_id lie
in the order of a hash of their texts (xxhash64), equal rows side by side; texts of any length are encoded whole; an
empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import lean, put_file, row_chunks, scratch, table, utf8_column, written
from docloom.llm.tokens import encoder

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 0.9
#: Ids, and documents, a file holds before the next one is begun.
FILE_TOKENS, FILE_DOCS = 2_000_000, 200_000
#: Bytes of text in a partition, and partitions at most; beyond that partitions grow, and sort on disk.
PART_BYTES, MAX_PARTS = 16 << 20, 200_000
_HEAD = struct.Struct("<4sIQQQQQ")  # magic, block size, ids, documents, places of: block starts, document table, end


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed blocks of uint32 ids, and where each begins (blocks + 1)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1, initial=0xFFFFFFFF)
    rest = full - low[:, None]
    at = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))] if blocks else low
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    high = rest >> width[:, None].astype(np.uint32) if blocks else rest
    high[width == 32] = 0
    out = high > 0
    exceptions = out.sum(axis=1)
    size = 7 + width.astype(np.int64) * (BLOCK // 8) + exceptions * 5
    starts = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        for some in np.array_split(mine, -(-len(mine) // 1024)):
            place = starts[some][:, None]
            data[place + np.arange(4)] = low[some].astype("<u4").view(np.uint8).reshape(-1, 4)
            data[place[:, 0] + 4] = w
            data[place + np.arange(5, 7)] = exceptions[some].astype("<u2").view(np.uint8).reshape(-1, 2)
            values = rest[some].astype(np.uint16 if w <= 16 else np.uint32)
            for bit in range(w):
                data[place + np.arange(7 + bit * 32, 7 + bit * 32 + 32)] = np.packbits((values >> bit).astype(np.uint8) & 1, axis=1, bitorder="little")
    block, where = np.nonzero(out)
    if len(block):
        first = np.cumsum(exceptions) - exceptions
        k = np.arange(len(block)) - first[block]
        base = starts[block] + 7 + width[block].astype(np.int64) * 32
        data[base + k] = where.astype(np.uint8)
        data[(base + exceptions[block] + 4 * k)[:, None] + np.arange(4)] = high[block, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    return data.tobytes(), starts


def decode_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of blocks that begin at starts within data (uint8)."""
    blocks = len(starts)
    out = np.zeros((blocks, BLOCK), np.uint32)
    starts = starts.astype(np.int64)
    low = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4")[:, 0] if blocks else np.zeros(0, np.uint32)
    width = data[starts + 4]
    exceptions = np.ascontiguousarray(data[starts[:, None] + np.arange(5, 7)]).view("<u2")[:, 0].astype(np.int64) if blocks else np.zeros(0, np.int64)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        for some in np.array_split(mine, -(-len(mine) // 1024)):
            values = np.zeros((len(some), BLOCK), np.uint16 if w <= 16 else np.uint32)
            for bit in range(w):
                plane = np.unpackbits(data[starts[some][:, None] + np.arange(7 + bit * 32, 7 + bit * 32 + 32)], axis=1, bitorder="little")
                values |= plane.astype(values.dtype) << bit
            out[some] = values
    total = int(exceptions.sum())
    if total:
        block = np.repeat(np.arange(blocks), exceptions)
        k = np.arange(total) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = starts[block] + 7 + width[block].astype(np.int64) * 32
        high = np.ascontiguousarray(data[(base + exceptions[block] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[block, data[base + k]] |= high << width[block].astype(np.uint32)
    return (out + low[:, None]).ravel()[:n]


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One file: head, blocks, block starts, then each document's id, whether it has one, and the end of its ids."""
    body, starts = encode_blocks(ids)
    index = starts[:-1].astype("<u8").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.asarray(ends, "<u8").tobytes()
    at = _HEAD.size + len(body)
    return _HEAD.pack(MAGIC, BLOCK, len(ids), len(doc_ids), at, at + len(index), at + len(index) + len(docs)) + body + index + docs


def open_file(content: bytes) -> tuple[np.ndarray, np.ndarray, list[int | None], np.ndarray]:
    """A file's bytes, its block starts (within the bytes), its documents' ids and the ends of their token ids."""
    magic, block, n, docs, index, table_at, end = _HEAD.unpack_from(content)
    if magic != MAGIC or block != BLOCK or end != len(content):
        raise ValueError("not a whole token file")
    data = np.frombuffer(content, np.uint8)
    starts = np.frombuffer(content, "<u8", -(-n // BLOCK), index).astype(np.int64) + _HEAD.size
    ids = np.frombuffer(content, "<i8", docs, table_at)
    has = np.frombuffer(content, np.uint8, docs, table_at + 8 * docs)
    return data, starts, [int(x) if y else None for x, y in zip(ids, has, strict=True)], np.frombuffer(content, "<u8", docs, table_at + 9 * docs).astype(np.int64)


def read_range(content: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a file, from their blocks alone."""
    data, starts, _, _ = open_file(content)
    a, b = start // BLOCK, -(-stop // BLOCK)
    return decode_blocks(data, starts[a:b], (b - a) * BLOCK)[start - a * BLOCK : stop - a * BLOCK]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write (doc_id, text) rows in ascending doc_id order; return the files: part, seq, path, n_docs, n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, names, ends, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            path = put_file(folder, f"part-{part:06d}-{seq:06d}.pfr", file_bytes(np.concatenate(held), names, np.array(ends)))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [path], "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

        for batch in batches:
            data, off = utf8_column(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in row_chunks(off):
                ids, at = encoder(tokenizer).encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                stops = at[1:] + np.arange(1, j - i + 1)
                held.append(ids)
                names.extend(keys[i:j])
                ends.extend((stops + n).tolist())
                n += len(ids)
                if n >= FILE_TOKENS or len(names) >= FILE_DOCS:
                    yield flush()
                    seq, held, names, ends, n = seq + 1, [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    # A small input goes to all cores.
    parts = max(1, min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20), min(MAX_PARTS, -(-size // PART_BYTES)))
    # The hash parts rows that share a doc_id (nulls too) and bounds what the ranges' sample holds.
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(lean(write), "part int, seq int, path string, n_docs long, n_tokens long"), "op7-manifest")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, starts, names, ends = open_file(content.as_py())
                ids = decode_blocks(data, starts, int(ends[-1])).astype("<u4")
                begins = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"name": pa.array([path.rsplit("/", 1)[1]] * len(names)), "doc_id": pa.array(names, pa.int64()), "begin": pa.array(begins), "n_tokens": pa.array(ends - begins), "ids_crc32": pa.array(crc, pa.int64())})

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, of which the session's setting bounds the number.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = files.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals.hint("merge"), "part").select(F.element_at(F.split("path", "/"), -1).alias("name"), (F.col("base") + F.col("inner")).alias("file_start"))
    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder).select("path", "content").mapInArrow(lean(read), "name string, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return docs.join(places.hint("merge"), "name").select("doc_id", (F.col("file_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to a new scratch folder and read them back."""
    folder = scratch(docs.sparkSession, "op7-files")
    files = write_token_files(docs, folder, tokenizer, end_id)
    if not files.take(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(docs.sparkSession, folder, files)


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


QUERIES = {"op7_token_blocks": op7_token_blocks}
ORACLE: dict[str, str] = {}
