"""Operator 2: pack documents into fixed-length sequences by minimum bin slack.

The lengths' histogram (at most `capacity` rows, whatever the input) goes to the driver, where each step takes the
longest piece left and finds, by subset sums in a bitset over the lengths still there, the fullest sequence with it.
That combination is removed as often as its lengths last, so there are about as many steps as lengths. Pieces
then find their places by their rank among those of their length: no piece leaves the executors.

Defined results: null and empty texts are one piece of the end id; rows are packed one by one, repeated doc_ids too;
a very long text gives as many pieces as it takes; of pieces of equal length any may take a place; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import HALF_CHUNK, lean, row_chunks, table, utf8_column, written
from docloom.llm.tokens import encoder


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The (length, copies) of a subset of the pieces with the largest sum of at most room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in (np.flatnonzero(counts[1 : room + 1])[::-1] + 1).tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left, copies = left - copies, 2 * copies
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return list(chosen.items())


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, copies, sequence, offset): the pieces of a length from first_rank on, `copies` to each sequence."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        bins = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        bins[longest] = bins.get(longest, 0) + 1
        times, offset = min(int(counts[x]) // c for x, c in bins.items()), 0
        for length, copies in sorted(bins.items(), reverse=True):
            rows.append((length, int(used[length]), copies, sequence, offset))
            used[length] += times * copies
            counts[length] -= times * copies
            offset += length * copies
        sequence += times
    return rows


def _pieces(capacity: int, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, HALF_CHUNK):
                ids, at = encoder(tokenizer).encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                first = at + np.arange(j - i + 1)
                n = np.diff(first)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - capacity * (pieces - 1))[row]
                start = np.where(piece == 0, 0, head + capacity * (piece - 1))
                length = np.where(piece == 0, head, capacity)
                begin = first[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                values, counts = np.unique(length, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
                rank += seen[length]
                seen[values] += counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(row), part), pa.int32()), "local_rank": pa.array(rank),
                })

    return run


def _placed(plan: list[tuple[int, int, int, int, int]]):
    """Places of (length, rank) by a search in the plan; the plan's rows are about as many as there are lengths."""
    rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
    keys = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            nth = rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows[at, 3] + nth // rows[at, 2]), pa.array(rows[at, 4] + nth % rows[at, 2] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Spans of documents' ids and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document of more than capacity ids is cut so that all its pieces but the first are full.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(capacity, tokenizer, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"), "op2-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def materialize_sequences(docs: DataFrame, spans: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The sequences' ids (sequence_id, ids array<int>) for docs with unique doc_ids; each sequence is at most its capacity long."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, HALF_CHUNK):
                got, at = encoder(tokenizer).encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "ids": pa.array([[*got[a:b].tolist(), end_id] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))})

    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(ids), "doc_id long, ids array<int>")
    cut = spans.join(tokens.hint("merge"), "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE: dict[str, str] = {}
