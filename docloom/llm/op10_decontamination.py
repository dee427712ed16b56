"""Operator 10: find benchmark passages in documents with a positional inverted index.

The index is split by documents and written once: each segment (up to SEGMENT_BYTES of text; a longer document alone) is
one row with the sorted terms of its words (64-bit hashes of their bytes), how often each occurs, and the ascending
places of every term, as differences in four byte planes, which Parquet packs. The benchmark's words go to files of
about BLOCK_WORDS words with their windows as flat arrays; only the files' paths pass the driver. A task reads its
segments once, in groups of GROUP_BYTES, and meets every group with one file at a time: what it holds is bounded for
any benchmark. A window's start places are found by intersecting offset-adjusted postings, the segment's rarest term
first; with a slop, terms may lie up to that many places off (proximity).

Defined results: null and empty texts have no words and are clean; null and wordless items match nothing; equal item
ids count once; rows are judged one by one, repeated doc_ids too; windows don't cross documents; texts of any length are
indexed whole; an empty table gives no rows; with an empty benchmark all documents are clean; further columns are
ignored.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import HALF_CHUNK, get_file, id_column, id_kind, lean, put_file, row_chunks, scratch, table, utf8_column, written
from docloom.llm.hashing import FOLD, span_hashes, word_spans

SEGMENT_BYTES = 1 << 20
BLOCK_WORDS = 500_000
#: Bytes of stored postings that meet each of several blocks of the benchmark at a time; one larger segment meets them alone.
GROUP_BYTES = 8 << 20
WINDOW = 10
#: Windows, and start places of windows, that a step holds at a time.
_STEP = 100_000
#: Letters a-z, digits and every byte beyond ASCII, after A-Z were lower-cased.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
_SEGMENT = "n_words array<long>, terms binary, counts binary, postings binary"
_FOUND = "n_words long, items array<string>, spans array<struct<start:long,stop:long>>"


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, and each row's first word (rows + 1)."""
    folded = FOLD[data]
    starts, ends, first = word_spans(folded, off, WORD_BYTE)
    return span_hashes(folded, starts, ends), first


@dataclass
class Block:
    """Words of test items: sorted vocabulary, each word's place in it, and each window's first word, length and item."""

    names: list[str]
    vocabulary: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    item: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]], size: int) -> Block:
        sizes = np.array([len(h) for _, h in items], np.int64)
        first = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - size + 1, 1)
        item = np.repeat(np.arange(len(items), dtype=np.int32), n)
        begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[item]
        vocabulary, word = np.unique(np.concatenate([h for _, h in items]), return_inverse=True)
        return cls([name for name, _ in items], vocabulary, word.astype(np.int32), begin, np.minimum(sizes, size)[item], item)

    def content(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.frombuffer(json.dumps(self.names).encode(), np.uint8), **{k: getattr(self, k) for k in ("vocabulary", "word", "begin", "length", "item")})
        return out.getvalue()

    @classmethod
    def read(cls, content: bytes) -> Block:
        with np.load(io.BytesIO(content)) as f:
            return cls(json.loads(f["names"].tobytes()), *(f[k] for k in ("vocabulary", "word", "begin", "length", "item")))


def write_blocks(benchmark: DataFrame, size: int = WINDOW) -> list[str]:
    """The items (item_id, text) as files of blocks; their paths."""
    folder = scratch(benchmark.sparkSession, "op10-blocks")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, HALF_CHUNK):
                h, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_pydict({"item": batch.column(0).slice(i, j - i), "words": pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")
    items = written(items.mapInArrow(lean(hashed), "item string, words binary"), "op10-items").where("length(words) > 0")
    total = (items.agg(F.sum(F.length("words"))).collect()[0][0] or 0) // 8

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for name, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((name, np.frombuffer(h.as_py(), np.uint64)))
                n += len(held[-1][1])
                if n >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_pydict({"path": [put_file(folder, f"part-{part:06d}-{seq:06d}.npz", Block.of(held, size).content())]})
                    seq, held, n = seq + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"path": [put_file(folder, f"part-{part:06d}-{seq:06d}.npz", Block.of(held, size).content())]})

    return sorted(r["path"] for r in written(items.coalesce(1 + total // BLOCK_WORDS).mapInArrow(lean(write), "path string"), "op10-paths").collect())


def build_index(docs: DataFrame) -> DataFrame:
    """Segments over whole texts (doc_id, text): every document's word count, and all terms' postings."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, SEGMENT_BYTES):
                h, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                order = np.argsort(h, kind="stable")
                h = h[order]
                begin = np.flatnonzero(np.concatenate(([len(h) > 0], h[1:] != h[:-1])))
                steps = np.diff(order.astype("<u4"), prepend=np.uint32(0))  # modulo 2**32 where a term's list begins
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([segment]), "doc_ids": pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(batch.column(0).type)), "n_words": pa.array([np.diff(first)], pa.list_(pa.int64())),
                    "terms": pa.array([h[begin].tobytes()], pa.binary()), "counts": pa.array([np.diff(np.append(begin, len(h))).astype("<u4").tobytes()], pa.binary()),
                    "postings": pa.array([np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary()),
                })
                segment += 1

    rows = docs.select(id_column(docs), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(lean(segments), f"segment long, doc_ids array<{id_kind(docs)}>, {_SEGMENT}"), "op10-index")


class Segment:
    """A stored segment: keys are (number of the term << 32 | place of a word in the segment), ascending."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)))  # of each document, its first word
        self.terms, self.counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], "<u4").astype(np.int64)
        steps = np.ascontiguousarray(np.frombuffer(row["postings"], np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
        self.begin = np.cumsum(self.counts) - self.counts
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, self.counts) | np.cumsum(steps, dtype=np.uint32).astype(np.int64)

    def occurrences(self, block: Block, size: int, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Occurring windows: document, first and last place in it (exclusive), item; in parts."""
        if not len(self.keys):
            return
        number = np.minimum(np.searchsorted(self.terms, block.vocabulary), len(self.terms) - 1)
        number[self.terms[number] != block.vocabulary] = -1
        word = number[block.word]
        missing = np.concatenate(([0], np.cumsum(word < 0)))
        here = np.flatnonzero(missing[block.begin + block.length] == missing[block.begin])
        for some in np.array_split(here, 1 + len(here) // _STEP):
            # Short windows repeat their last word, which changes nothing.
            at = np.minimum(np.arange(size), block.length[some, None] - 1)
            term = word[block.begin[some, None] + at]
            rarest = np.argsort(self.counts[term], axis=1, kind="stable")
            term, at = np.take_along_axis(term, rarest, 1), np.take_along_axis(at, rarest, 1)
            many = self.counts[term[:, 0]] * (2 * slop + 1)
            # A step has at most _STEP start places and those of one window more.
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // _STEP)) + 1
            for part in np.split(np.arange(len(some)), cuts):
                yield from self._intersect(block, some[part], term[part], at[part], slop)

    def _intersect(self, block: Block, some: np.ndarray, term: np.ndarray, at: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        if not len(some):
            return
        n = self.counts[term[:, 0]]
        row = np.repeat(np.arange(len(some)), n)
        place = self.keys[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.begin[term[row, 0]]] & 0xFFFFFFFF
        doc = np.searchsorted(self.first, place, "right") - 1
        start = place - at[row, 0]
        if slop:
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            row, doc = np.repeat(row, 2 * slop + 1), np.repeat(doc, 2 * slop + 1)
        for k in range(1, term.shape[1]):
            low = np.maximum(start + at[row, k] - slop, self.first[doc])
            high = np.minimum(start + at[row, k] + slop, self.first[doc + 1] - 1)
            own = term[row, k] << 32
            near = np.minimum(np.searchsorted(self.keys, own | low), len(self.keys) - 1)
            ok = (low <= high) & (self.keys[near] >= own | low) & (self.keys[near] <= own | high)
            row, doc, start = row[ok], doc[ok], start[ok]
            if not len(row):
                return
        start = start - self.first[doc]
        stop = np.minimum(start + block.length[some[row]], self.n_words[doc])
        yield doc, np.maximum(start, 0), stop, block.item[some[row]]


_last: dict[str, Block] = {}


def _block(path: str) -> Block:
    """The block of a file; a worker keeps the last one."""
    if path not in _last:
        _last.clear()
        _last[path] = Block.read(get_file(path))
    return _last[path]


def find_windows(index: DataFrame, paths: list[str], size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every document of the index: doc_id, n_words, items (sorted ids of items with occurring windows), spans of hit words."""

    def search(group: list[Segment]) -> Iterator[pa.RecordBatch]:
        items: list[dict[int, set[str]]] = [{} for _ in group]
        spans: list[dict[int, set[tuple[int, int]]]] = [{} for _ in group]
        for path in paths:
            block = _block(path)
            for k, segment in enumerate(group):
                for doc, start, stop, item in segment.occurrences(block, size, slop):
                    for d, a, b, i in zip(doc.tolist(), start.tolist(), stop.tolist(), item.tolist(), strict=True):
                        items[k].setdefault(d, set()).add(block.names[i])
                        spans[k].setdefault(d, set()).add((a, b))
        for segment, held, places in zip(group, items, spans, strict=True):
            docs = range(len(segment.doc_ids))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(segment.doc_ids, kind), "n_words": pa.array(segment.n_words), "items": pa.array([sorted(held.get(d, ())) for d in docs], pa.list_(pa.string())),
                "spans": pa.array([[{"start": a, "stop": b} for a, b in merged(places.get(d, ()))] for d in docs], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            })

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                # A single block stays in the worker, so segments needn't meet it together.
                if group and (held + len(row["postings"]) > GROUP_BYTES or len(paths) < 2):
                    yield from search(group)
                    group, held = [], 0
                group.append(Segment(row))
                held += len(row["postings"])
        if group:
            yield from search(group)

    id_type = index.schema["doc_ids"].dataType.elementType
    kind = to_arrow_type(id_type)
    return index.select("doc_ids", "n_words", "terms", "counts", "postings").mapInArrow(lean(match), f"doc_id {id_type.simpleString()}, {_FOUND}")


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every row of docs: doc_id, n_words, items (sorted ids of items with occurring windows), spans of hit words."""
    return find_windows(build_index(docs), write_blocks(benchmark, size), size, slop)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLE: dict[str, str] = {}
