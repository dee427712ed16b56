"""Operator 11: scores of documents by a Brown class-based trigram model, whose classes exchange clustering finds.

Whole texts become segments once: packed token numbers and the segment's dictionary of 64-bit word hashes. Words with at
least one in HEAD of all training tokens, of which there can't be more than HEAD, are the head. They are clustered by
exchange: each round, executors sum every head word's counts of left and right neighbours' classes, and some of the words
move to the class that raises the likelihood of the class bigrams most, by the exact gain of the move. The most frequent
words seed the classes. Words outside the head that occur at least twice then take, in one shuffle, the class with the
highest gain to first order, which is exact as their counts become small against the classes'. Words seen once form the
class of rare words, which also emits unseen ones: as often as seen ones, as good as Good-Turing estimates it.

A token's probability is that of its class after the two classes before it (trigrams, bigrams and single classes
interpolated by Witten-Bell) times that of the word in its class. It sums to one over known words, one unseen word and the
end. Only class tables and the head, whose sizes are fixed, are broadcast; all other words' counts and classes come back
to a segment by a shuffle of its dictionary, as a file of its own.

Defined results: null and empty texts are one end token; a null doc_id is not held out and is learnt from; rows are
counted and scored one by one, repeated doc_ids and texts too; words of equal count are ordered by hash; of equal gains
the lower class wins; texts of any length are scored whole; without training texts every word is unseen; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import added, get_file, lean, put_file, row_chunks, runs, scratch, table, utf8_column, written
from docloom.llm.hashing import FOLD, span_hashes, word_spans

#: Words with at least one in so many training tokens are clustered by exchange; there are at most so many.
HEAD = 1 << 16
#: Classes that words are moved between; RARE and ENDS come before them.
CLASSES = 62
RARE, ENDS, FIRST = 0, 1, 2
#: Rounds of exchange: in the first all words without a class move, then some of them by turns.
ROUNDS = 7
#: Text bytes, and documents, of a segment; a longer text is a segment of its own.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 1 << 16
#: Segments that a task reads, one after another.
TASK_SEGMENTS = 8
#: Text bytes that are tokenised at a time, and rows of words that are handed on together.
_CHUNK, _ROWS = 1 << 20, 1 << 14
#: The hash of the end token; no word has it but by chance.
END = np.uint64(0)
#: Words of the head in a block of counts.
_BLOCK = 64
#: Words outside the head whose classes are chosen at a time, and answers held before they are handed on.
_WORDS, _ANSWERS = 20_000, 1 << 19
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ROW = np.dtype([("seg", "<i8"), ("i", "<u4"), ("n", "<u4")])
_ENTRY = np.dtype([("at", "u1"), ("n", "<u4")])
_ANSWER = np.dtype([("i", "<u4"), ("n", "<u4"), ("cls", "u1")])
_SEGMENT = ["seg", "doc_ids", "named", "held", "first", "tokens", "words", "counts"]


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's words and of its end, and each row's first (rows + 1)."""
    starts, ends, first = word_spans(data, off, _WORD)
    hashes = span_hashes(FOLD[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def write_segments(docs: DataFrame, held: str) -> DataFrame:
    """The table of segments (seg, path) of docs (doc_id, text, and held: whether a row isn't learnt from).

    A segment is a file of its own: its arrays go to Python alone, not as large values through the rows of Spark.
    """
    folder = scratch(docs.sparkSession, "op11-segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows, size, docs_held = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, rows, size, docs_held
            words, place = np.unique(np.concatenate([w for _, _, _, w, _, _ in rows]), return_inverse=True)
            tokens, first, at, base = [], [np.zeros(1, np.int64)], 0, 0
            for _, _, _, w, local, starts in rows:
                tokens.append(place[at : at + len(w)][local])
                first.append(starts[1:] + base)
                at, base = at + len(w), base + len(local)
            tokens, first = np.concatenate(tokens), np.concatenate(first)
            held_out = np.concatenate([h for _, _, h, _, _, _ in rows])
            learnt = tokens[np.repeat(~held_out, np.diff(first))]
            values = [
                np.concatenate([k for k, _, _, _, _, _ in rows]), np.concatenate([k for _, k, _, _, _, _ in rows]), held_out, first.astype("<i8"), tokens.astype("<u2" if len(words) <= 1 << 16 else "<u4"), words,
                np.bincount(learnt, minlength=len(words)).astype("<u4"),
            ]
            number = pa.array([part << 32 | seq], pa.int64())
            out = pa.RecordBatch.from_arrays([number, *(pa.array([v.tobytes()], pa.large_binary()) for v in values)], names=_SEGMENT)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(out)
            # Of a repeated task each attempt has its own name; the table has that of the one that counts.
            path = put_file(folder, f"{part}-{seq}-{uuid.uuid4().hex}.segment", sink.getvalue())
            seq, rows, size, docs_held = seq + 1, [], 0, 0
            return pa.RecordBatch.from_pydict({"seg": number, "path": [path]})

        for batch in batches:
            data, off = utf8_column(batch.column(1))
            ids = batch.column(0)
            named, ids, out = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy().astype("<i8"), batch.column(2).to_numpy(False).astype(bool)
            for i, j in row_chunks(off, _CHUNK):
                hashes, first = tokens_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
                words, local = np.unique(hashes, return_inverse=True)
                if rows and (size + int(off[j] - off[i]) > SEGMENT_BYTES or docs_held + j - i > SEGMENT_DOCS):
                    yield flush()
                rows.append((ids[i:j], named[i:j], out[i:j], words, local.astype(np.uint32), first))
                size, docs_held = size + int(off[j] - off[i]), docs_held + j - i
        if rows:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held"))
    segments = written(rows.mapInArrow(lean(run), "seg long, path string"), "op11-paths")
    return segments.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-segments.count() // TASK_SEGMENTS)))


class Segment:
    """One segment's arrays."""

    def __init__(self, row: pa.RecordBatch):
        def column(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(row.column(name)[0].as_buffer(), kind)

        self.seg = row.column("seg")[0].as_py()
        self.words, self.counts, self.first, self.held = column("words", "<u8"), column("counts", "<u4"), column("first", "<i8"), column("held", "?")
        self.tokens = column("tokens", "<u2" if len(self.words) <= 1 << 16 else "<u4")
        self.doc_ids, self.named = column("doc_ids", "<i8"), column("named", "?")

    def learnt(self) -> tuple[np.ndarray, np.ndarray]:
        """The training tokens, one document after another, each with the token before it: the first follows an end."""
        after = self.tokens[np.repeat(~self.held, np.diff(self.first))]
        before = np.roll(after, 1)  # the last is an end, as is what stands before the first
        return before, after


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with pa.ipc.open_stream(get_file(path)) as stream:
                yield Segment(stream.read_next_batch())


def word_counts(segments: DataFrame) -> DataFrame:
    """How often every training token occurs: word (its hash as long), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches):
            seen = s.counts > 0
            yield pa.RecordBatch.from_pydict({"word": pa.array(s.words[seen].view(np.int64)), "n": pa.array(s.counts[seen].astype(np.int64))})

    return written(segments.mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "op11-counts")


@dataclass
class Classes:
    """Words of the head, ascending by hash, with their counts and classes; totals of the corpus."""

    words: np.ndarray
    counts: np.ndarray
    of: np.ndarray  # uint8
    total: int  # training tokens
    distinct: int
    once: int
    used: int  # classes that words are moved between

    @property
    def number(self) -> int:
        return FIRST + CLASSES

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the head, or -1."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        return np.where(self.words[at] == words, at, -1) if len(self.words) else np.full(len(words), -1)


def seeded(counts: DataFrame) -> Classes:
    """The head, of which the CLASSES most frequent words have classes of their own and the others none (RARE) yet."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(((F.col("n") == 1) & (F.col("word") != int(END))).cast("long")).alias("once")).collect()[0]
    total = sums["n"] or 0
    # At most HEAD words can have that share.
    head = counts.where((F.col("n") >= 2) & (F.col("n") * HEAD >= total)).toArrow()
    words, n = head.column("word").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    of = np.full(len(words), RARE, np.uint8)
    rank = np.lexsort((words, -n))
    rank = rank[words[rank] != END][:CLASSES]
    of[rank] = FIRST + np.arange(len(rank))
    of[words == END] = ENDS
    return Classes(words, n, of, total, sums["v"], sums["once"] or 0, len(rank))


def neighbour_counts(segments: DataFrame, classes: Classes) -> DataFrame:
    """Blocks of the head (block, data): per word its right and left neighbours' counts by class, then its own after itself."""
    shared, k = segments.sparkSession.sparkContext.broadcast(classes), classes.number
    width = 2 * k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        size = len(classes.words) * width
        total = None
        for s in _segments(batches):
            place = classes.places(s.words)
            of = np.where(place >= 0, classes.of[place] if len(classes.of) else RARE, RARE).astype(np.int64)
            before, after = s.learnt()
            a, b = place[before], place[after]
            mine, other = a >= 0, b >= 0
            part = np.bincount(a[mine] * width + of[after[mine]], minlength=size)
            part += np.bincount(b[other] * width + k + of[before[other]], minlength=size)
            part += np.bincount(a[mine & (a == b)] * width + 2 * k, minlength=size)
            total = part if total is None else total + part
        if total is not None:
            rows = total.reshape(-1, width)
            starts = [p for p in range(0, len(rows), _BLOCK) if rows[p : p + _BLOCK].any()]
            yield pa.RecordBatch.from_pydict({"block": pa.array([p // _BLOCK for p in starts], pa.int32()), "data": pa.array([zlib.compress(rows[p : p + _BLOCK].astype("<i8").tobytes(), 1) for p in starts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in runs(batches, 1):
            total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in mine.column(1))
            yield pa.RecordBatch.from_pydict({"block": pa.array([mine.column(0)[0].as_py()], pa.int32()), "data": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    parts = segments.mapInArrow(lean(count), "block int, data binary")
    return written(parts.repartition("block").sortWithinPartitions("block").mapInArrow(lean(add), "block int, data binary"), "op11-neighbours")


def class_bigrams(neighbours: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of neighbouring classes; those of two words outside the head, which no gain needs, are left out."""
    shared, k = neighbours.sparkSession.sparkContext.broadcast(classes), classes.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value.of, np.zeros((k, 2 * k))
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(data.as_py(), "<i8").reshape(-1, 2 * k + 1)[:, : 2 * k]
                np.add.at(total, of[block * _BLOCK : block * _BLOCK + len(rows)], rows)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), pa.int32()), "v": pa.array([row.tobytes() for row in total], pa.binary())})

    both = added(neighbours.mapInArrow(lean(run), "k int, v binary"), k)
    if both.shape[1] < 2 * k:
        return np.zeros((k, k))
    right, left = both[:, :k], both[:, k:]
    # Rows of words outside the head are known from their right neighbours' side alone.
    out = right.copy()
    out[RARE] = right[RARE] + np.maximum(left[:, RARE] - right[RARE], 0)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def log_likelihood(bigrams: np.ndarray) -> float:
    """Of the class bigrams, but for what no assignment changes."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(0)).sum() - _xlogx(bigrams.sum(1)).sum())


def gains(bigrams: np.ndarray, right: np.ndarray, left: np.ndarray, itself: int, own: int) -> np.ndarray:
    """What the likelihood gains if a word of class own, with these neighbours' counts, joins each class instead of none."""
    right, left, m = right.astype(float), left.astype(float), bigrams.copy()
    rows, columns = bigrams.sum(1), bigrams.sum(0)
    n_right, n_left = right.sum(), left.sum()
    right[own] -= itself
    left[own] -= itself
    m[own] -= right
    m[:, own] -= left
    m[own, own] -= itself
    np.maximum(m, 0, out=m)
    rows[own] -= n_right
    columns[own] -= n_left
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    found = (_xlogx(m[:, r] + right[r]) - _xlogx(m[:, r])).sum(1) + (_xlogx(m[c] + left[c][:, None]) - _xlogx(m[c])).sum(0)
    d = np.diag(m)
    found += _xlogx(d + right + left + itself) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    return found - (_xlogx(rows + n_right) - _xlogx(rows)) - (_xlogx(columns + n_left) - _xlogx(columns))


def exchanged(neighbours: DataFrame, classes: Classes, bigrams: np.ndarray, parts: int, turn: int) -> Classes:
    """classes with every parts-th word (by turn), and all that have none, moved to the best class."""
    shared, k = neighbours.sparkSession.sparkContext.broadcast((classes, bigrams)), classes.number
    last = FIRST + classes.used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bigrams = shared.value
        for batch in batches:
            word, cls = [], []
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for at, row in enumerate(np.frombuffer(data.as_py(), "<i8").reshape(-1, 2 * k + 1), block * _BLOCK):
                    own = int(classes.of[at])
                    if own != ENDS and (own == RARE or at % parts == turn % parts):
                        word.append(at)
                        cls.append(FIRST + int(np.argmax(gains(bigrams, row[:k], row[k : 2 * k], int(row[2 * k]), own)[FIRST:last])))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word, pa.int32()), "cls": pa.array(cls, pa.int32())})

    moved = neighbours.mapInArrow(lean(run), "word int, cls int").toArrow()
    of = classes.of.copy()
    of[moved.column("word").to_numpy()] = moved.column("cls").to_numpy()
    return replace(classes, of=of)


def cluster(segments: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Classes, np.ndarray, list[float]]:
    """The head's classes, the class bigrams with them, and the likelihood after every round.

    Words that move at the same time don't see each other's moves. A round that lowers the likelihood is undone, and from
    then on half as many words move in a round; so the likelihood never falls.
    """
    classes, history, parts = seeded(counts), [], 2
    neighbours = neighbour_counts(segments, classes)
    bigrams = class_bigrams(neighbours, classes)
    for turn in range(rounds if classes.used else 0):
        moved = exchanged(neighbours, classes, bigrams, parts if turn else len(classes.words) + 1, turn or len(classes.words))
        after = neighbour_counts(segments, moved)
        found = class_bigrams(after, moved)
        likelihood = log_likelihood(found)
        if not history or likelihood > history[-1]:
            classes, neighbours, bigrams = moved, after, found
        else:
            parts *= 2
        history.append(max([likelihood, *history[-1:]]))
    return classes, bigrams, history


def _rest_rows(s: Segment, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the segment outside the head, and per word its packed place, count and neighbours' classes (bytes, offsets)."""
    k = classes.number
    place = classes.places(s.words)
    rest = np.flatnonzero(place < 0)
    of = np.where(place >= 0, classes.of[place] if len(classes.of) else RARE, RARE).astype(np.int64)
    number = np.full(len(s.words), -1)
    number[rest] = np.arange(len(rest))
    before, after = s.learnt()
    a, b = number[before], number[after]
    mine, other = a >= 0, b >= 0
    keys, times = np.unique(np.concatenate((a[mine] * 2 * k + of[after[mine]], b[other] * 2 * k + k + of[before[other]])), return_counts=True)
    each = np.bincount(keys // (2 * k), minlength=len(rest))
    off = np.concatenate(([0], np.cumsum(_ROW.itemsize + _ENTRY.itemsize * each)))
    head, entry = np.zeros(len(rest), _ROW), np.zeros(len(keys), _ENTRY)
    head["seg"], head["i"], head["n"] = s.seg, rest, s.counts[rest]
    entry["at"], entry["n"] = keys % (2 * k), times
    data = np.zeros(int(off[-1]), np.uint8)
    data[off[:-1, None] + np.arange(_ROW.itemsize)] = head.view(np.uint8).reshape(-1, _ROW.itemsize)
    within = np.arange(len(keys)) - np.repeat(np.cumsum(each) - each, each)
    data[(np.repeat(off[:-1] + _ROW.itemsize, each) + _ENTRY.itemsize * within)[:, None] + np.arange(_ENTRY.itemsize)] = entry.view(np.uint8).reshape(-1, _ENTRY.itemsize)
    return s.words[rest], data, off


def _binaries(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def rest_classes(segments: DataFrame, classes: Classes, bigrams: np.ndarray, folder: str) -> DataFrame:
    """Write for every segment a file of its words outside the head: place, count in all training tokens, class."""
    shared, k = segments.sparkSession.sparkContext.broadcast(classes), classes.number
    last = FIRST + classes.used
    smooth = bigrams + 0.5
    # To first order, a word gains from class c as much as its neighbours' classes are likely beside c.
    weights = np.concatenate((np.log(smooth / smooth.sum(1, keepdims=True)).T, np.log(smooth / smooth.sum(0, keepdims=True)))).astype(np.float32)
    beside = segments.sparkSession.sparkContext.broadcast(weights[:, FIRST:last])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches):
            words, data, off = _rest_rows(s, shared.value)
            for i in range(0, len(words), _ROWS):
                at = off[i : i + _ROWS + 1]
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + _ROWS].view(np.int64)), _binaries(data[at[0] : at[-1]], at - at[0])], names=["word", "row"])

    def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows again, cut only between words."""
        carry: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_numpy()
            if carry and carry[-1].column(0)[-1].as_py() != words[0]:
                yield pa.Table.from_batches(carry)
                carry = []
            if words[0] == words[-1]:
                carry.append(batch)
                continue
            cut = int(np.flatnonzero(words[1:] != words[:-1])[-1]) + 1
            yield pa.Table.from_batches([*carry, batch.slice(0, cut)])
            carry = [batch.slice(cut)]
        if carry:
            yield pa.Table.from_batches(carry)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            seg, answer = np.concatenate([s for s, _ in held]), np.concatenate([a for _, a in held])
            order = np.argsort(seg, kind="stable")
            seg, answer = seg[order], answer[order]
            at = np.append(np.flatnonzero(np.append(True, seg[1:] != seg[:-1])), len(seg))
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"seg": pa.array(seg[at[:-1]], pa.int64()), "answers": pa.array([answer[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

        for rows in whole_words(batches):
            words, (data, off) = rows.column(0).to_numpy(), utf8_column(rows.column(1))
            head = np.ascontiguousarray(data[off[:-1, None] + np.arange(_ROW.itemsize)]).view(_ROW)[:, 0]
            each = (np.diff(off) - _ROW.itemsize) // _ENTRY.itemsize
            body = np.ones(len(data), bool)
            body[off[:-1, None] + np.arange(_ROW.itemsize)] = False
            entry = data[body].view(_ENTRY)
            start = np.append(True, words[1:] != words[:-1])
            word = np.cumsum(start) - 1
            n = np.bincount(word, head["n"].astype(float)).astype(np.int64)
            of, owner = np.zeros(len(n), np.uint8), np.repeat(word, each)
            for i in range(0, len(n) if last > FIRST else 0, _WORDS):
                j = min(i + _WORDS, len(n))
                a, b = np.searchsorted(owner, (i, j))
                profile = np.bincount((owner[a:b] - i) * 2 * k + entry["at"][a:b], entry["n"][a:b], (j - i) * 2 * k).reshape(j - i, 2 * k).astype(np.float32)
                of[i:j] = np.where(n[i:j] >= 2, FIRST + np.argmax(profile @ beside.value, axis=1), RARE)
            answer = np.zeros(len(words), _ANSWER)
            answer["i"], answer["n"], answer["cls"] = head["i"], n[word], of[word]
            held.append((head["seg"], answer))
            size += len(answer)
            if size >= _ANSWERS:
                yield flush()
        if held:
            yield flush()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in runs(batches, 1):
            seg = mine.column(0)[0].as_py()
            path = put_file(folder, f"{seg}.rest", b"".join(x.as_py() for x in mine.column(1)))
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int64()), "path": [path]})

    rows = segments.mapInArrow(lean(emit), "word long, row binary")
    answers = rows.repartition("word").sortWithinPartitions("word").mapInArrow(lean(choose), "seg long, answers binary")
    return written(answers.repartition("seg").sortWithinPartitions("seg").mapInArrow(lean(put), "seg long, path string"), "op11-files")


def _resolved(s: Segment, classes: Classes, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of the segment its count in all training tokens and its class."""
    place = classes.places(s.words)
    n, of = np.zeros(len(s.words), np.int64), np.zeros(len(s.words), np.int64)
    inside = place >= 0
    n[inside], of[inside] = classes.counts[place[inside]], classes.of[place[inside]]
    if not inside.all():
        rest = np.frombuffer(get_file(f"{folder}/{s.seg}.rest"), _ANSWER)
        n[rest["i"]], of[rest["i"]] = rest["n"], rest["cls"]
        of[s.words == END] = ENDS
    return n, of


def _histories(of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes before each token, and before these; a document follows ends."""
    one = np.roll(of, 1)
    two = np.roll(of, 2)
    two[first[:-1]] = ENDS
    return one, two


def class_trigrams(segments: DataFrame, classes: Classes, folder: str) -> np.ndarray:
    """Counts of three classes in the training tokens (number x number x number)."""
    shared, k = segments.sparkSession.sparkContext.broadcast(classes), classes.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k**3)
        for s in _segments(batches):
            of = _resolved(s, shared.value, folder)[1][s.tokens]
            one, two = _histories(of, s.first)
            keep = np.repeat(~s.held, np.diff(s.first))
            total += np.bincount(((two * k + one) * k + of)[keep], minlength=k**3)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(k), pa.int32()), "v": pa.array([row.tobytes() for row in total.reshape(k, k * k)], pa.binary())})

    found = added(segments.mapInArrow(lean(run), "k int, v binary"), k)
    return found.reshape(k, k, k) if found.shape[1] == k * k else np.zeros((k, k, k))


def transitions(trigrams: np.ndarray) -> np.ndarray:
    """P(class | two classes before): trigrams, bigrams and single classes interpolated by Witten-Bell."""
    bigrams = trigrams.sum(0)
    single = bigrams.sum(0)
    active = single > 0
    active[[RARE, ENDS]] = True
    low = np.where(active, single + 1, 0) / (single.sum() + active.sum())
    for counts in (bigrams, trigrams):
        kinds = np.maximum((counts > 0).sum(-1, keepdims=True), 1)
        low = (counts + kinds * low) / (counts.sum(-1, keepdims=True) + kinds)
    return low


@dataclass
class Model:
    classes: Classes
    log_transition: np.ndarray  # log10
    class_tokens: np.ndarray  # training tokens of each class
    folder: str

    def emissions(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in its class, given its count; n = 0: of any unseen word."""
        once = self.classes.once
        with np.errstate(divide="ignore"):
            rare = np.where(n > 0, n, once + 1) / (self.class_tokens[RARE] + once + 1)
            p = np.where(of == RARE, rare, np.where(of == ENDS, 1.0, n / np.maximum(self.class_tokens[of], 1)))
            return np.log10(p)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.classes.total + 0.5 * (self.classes.distinct + 1)))


def train(segments: DataFrame, rounds: int = ROUNDS) -> Model:
    folder = scratch(segments.sparkSession, "op11-rest")
    classes, bigrams, _ = cluster(segments, word_counts(segments), rounds)
    rest_classes(segments, classes, bigrams, folder)
    trigrams = class_trigrams(segments, classes, folder)
    with np.errstate(divide="ignore"):
        return Model(classes, np.log10(transitions(trigrams)), trigrams.sum((0, 1)), folder)


def score_segments(segments: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for s in _segments(batches):
            n, of = _resolved(s, model.classes, model.folder)
            word, base, known = model.emissions(n, of), model.base(n), n > 0
            cls = of[s.tokens]
            one, two = _histories(cls, s.first)
            sums = [np.add.reduceat(x, s.first[:-1]) for x in (known[s.tokens].astype(np.int64), base[s.tokens], word[s.tokens] + model.log_transition[two, one, cls])]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(s.doc_ids, pa.int64(), mask=~s.named), "held_out": pa.array(s.held), "n_tokens": pa.array(np.diff(s.first), pa.int64()), "n_known": pa.array(sums[0]),
                "train_tokens": pa.array(np.full(len(s.doc_ids), model.classes.total), pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
            })

    return segments.mapInArrow(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """Per held_out the perplexity of all tokens by that column."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))


def language_scores(docs: DataFrame, held: str, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) for which the boolean column held isn't true, and score all of them."""
    segments = write_segments(docs, held)
    return score_segments(segments, train(segments, rounds))


def op11_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return language_scores(table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held")), "held")


QUERIES = {"op11_brown_lm": op11_brown_lm}
ORACLE: dict[str, str] = {}
