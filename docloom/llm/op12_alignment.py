"""Operator 12: alignment of two tokenizers' tokens over the same bytes, and how often their ids end together.

Tokenizer A (tokenizers, byte-level) reads a space and the text, B (sentencepiece, byte fallback) the text, to which it
adds that space itself. The libraries' own spans are coarse cuts: A's are character offsets, which all tokens of a split
character share, and B's are byte spans, which byte-fallback tokens leave empty but for the last. Where a span holds
several tokens, or not as many bytes as its token decodes to, the decoded bytes' lengths refine it; the bytes of all
tokens must then be the text's.

Texts are cut into units over which neither tokenizer joins characters; each distinct unit is encoded once per worker.
Byte places where tokens of both end are cuts; they part the tokens into groups, and the two tokens that end there are
linked. Linked tokens end at the same byte, so the bytes of one end with those of the other: pairs of ids are at most as
many as the vocabularies have bytes, whatever the corpus. So the pairs' counts may be broadcast.

Defined results: null and empty texts, and texts whose tokens' bytes differ from a space and the text (B normalises
some characters), have no tokens; rows are aligned one by one, repeated doc_ids too; texts of any length are aligned
whole; the strings of special tokens are ordinary text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import lean, row_chunks, table, utf8_column, written
from docloom.llm.hashing import span_hashes
from docloom.llm.tokens import unit_starts

#: Text bytes whose tokens a task holds at a time; a longer text is a chunk of its own.
_CHUNK = 1 << 20
#: Pairs of ids a task counts before it hands them on.
_PAIRS = 1 << 20
#: Units that are encoded in one call, and distinct units a worker keeps of each tokenizer; beyond that it keeps those that came again.
_BATCH, CACHE_UNITS = 2048, 800_000
_DIGITS = 10


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def refined(spans: list[tuple[int, int]], sizes: list[int]) -> list[int] | None:
    """The end of each token: its span's, where the span alone is as long as the token's bytes, else by these lengths.

    spans: ascending coarse byte spans. None where the lengths contradict a cut that stands between two spans.
    """
    ends, at, k, n = [], 0, 0, len(spans)
    while k < n:
        # Tokens up to the next clean cut: where a span ends that none of the following reaches into.
        j, stop = k, spans[k][1]
        while j + 1 < n and (spans[j + 1][0] < stop or stop <= at):
            j += 1
            stop = max(stop, spans[j][1])
        for size in sizes[k : j + 1]:
            at += size
            ends.append(at)
        if at != stop:
            return None
        k = j + 1
    return ends


def _ends(unit: bytes, parts: list[bytes], spans: list[tuple[int, int]]) -> list[int] | None:
    """Ends of a unit's tokens by their coarse spans and decoded bytes; None where these aren't the unit's bytes."""
    if b"".join(parts) != unit:
        return None
    sizes = list(map(len, parts))
    coarse = [b for _, b in spans]
    # Where every span is as long as its token, the coarse cuts are the tokens' ends.
    return coarse if coarse == list(itertools.accumulate(sizes)) else refined(spans, sizes)


class SpanEncoder:
    """Ids and byte ends of whole texts' tokens, each distinct unit encoded once; a unit that can't be aligned has none."""

    def __init__(self, encode: Callable[[list[bytes]], Iterator[tuple[list[int], list[int] | None]]], starts: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self._encode, self._starts = encode, starts
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.length = np.zeros(0, np.int64)
        self.good = self.again = np.zeros(0, bool)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Keep only units that came again since the last time, or none if these are too many."""
        keep = np.flatnonzero(self.again)
        if len(keep) > CACHE_UNITS // 2:
            return self.clear()
        length = self.length[keep]
        at = np.cumsum(length) - length
        source = np.repeat(self.at[keep] - at, length) + np.arange(int(length.sum()))
        self.keys, self.at, self.length, self.good = self.keys[keep], at, length, self.good[keep]
        self.ids, self.ends, self.again = self.ids[source], self.ends[source], np.zeros(len(keep), bool)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (uint32) and ends (places in data) of all rows' tokens, and which rows can be aligned; others have none."""
        rows = len(off) - 1
        good = np.ones(rows, bool)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), good
        starts = self._starts(data, off)
        stops = np.append(starts[1:], len(data))
        keys, first, inverse = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self._thin()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != keys[inside]
        self.again[place[~new]] = True
        if new.any():
            self._learn(data, keys[new], place[new], starts[first[new]], stops[first[new]])
            place = np.searchsorted(self.keys, keys)
        place = place[inverse]
        bad = np.searchsorted(off, starts[~self.good[place]], "right") - 1
        good[bad] = False
        row = np.searchsorted(off, starts, "right") - 1
        length = np.where(good[row], self.length[place], 0)
        run = np.cumsum(length) - length
        source = np.repeat(self.at[place] - run, length) + np.arange(int(length.sum()))
        return self.ids[source], self.ends[source] + np.repeat(starts, length), good

    def _learn(self, data: np.ndarray, keys: np.ndarray, place: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        whole = data.tobytes()
        units = [whole[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
        ids, ends, length, good = [self.ids], [self.ends], [], []
        for k in range(0, len(units), _BATCH):
            found = [(x, places) if places is not None else ((), None) for x, places in self._encode(units[k : k + _BATCH])]
            good += [places is not None for _, places in found]
            length += [len(x) for x, _ in found]
            ids.append(np.fromiter(itertools.chain.from_iterable(x for x, _ in found), np.uint32))
            ends.append(np.fromiter(itertools.chain.from_iterable(places or () for _, places in found), np.int32))
        size = np.array(length, np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.keys, self.at = np.insert(self.keys, place, keys), np.insert(self.at, place, at)
        self.length, self.good, self.again = np.insert(self.length, place, size), np.insert(self.good, place, good), np.insert(self.again, place, False)
        self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)


def byte_level_encoder(path: str) -> SpanEncoder:
    """Of a tokenizers file with a byte-level pre-tokenizer that adds no space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    spec = json.loads(tokenizer.to_str())
    if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("the first tokenizer must be byte-level, without a normalizer or added space")
    alphabet = byte_alphabet()
    entries = {i: bytes(alphabet[c] for c in piece) if set(piece) <= alphabet.keys() else piece.encode() for piece, i in tokenizer.get_vocab().items()}

    def encode(units: list[bytes]) -> Iterator[tuple[list[int], list[int] | None]]:
        texts = [u.decode() for u in units]
        for unit, text, found in zip(units, texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            ids, spans = found.ids, found.offsets
            if len(text) != len(unit):  # characters to bytes
                place = [0, *itertools.accumulate(1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in text)]
                spans = [(place[a], place[b]) for a, b in spans]
            yield ids, _ends(unit, [entries[i] for i in ids], spans)

    return SpanEncoder(encode, unit_starts)


def _space_runs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of rows and of the runs of spaces in them."""
    space = data == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _row_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.unique(off[:-1][off[:-1] < len(data)])


def piece_encoder(path: str) -> SpanEncoder:
    """Of a sentencepiece model that adds a space in front; units begin with that space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    space = model.piece_to_id("▁")
    byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
    entries = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) and model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(units: list[bytes]) -> Iterator[tuple[list[int], list[int] | None]]:
        protos = model.encode([u[1:].decode() for u in units], return_type="proto")
        for unit, proto in zip(units, protos, strict=True):
            if unit == b" ":  # the model adds no space to an empty text; as the last of a text it is a token
                yield [space], [1]
                continue
            found = [(p.id, p.begin + 1, p.end + 1) for p in proto.pieces]
            # Spans are those of the unit without its first space, which the first token has.
            yield [i for i, _, _ in found], _ends(unit, [entries[i] for i, _, _ in found], [(a if k else 0, b) for k, (_, a, b) in enumerate(found)])

    # Where no piece goes on with a space after anything else, and spaces are kept as they are, no token crosses into a run of spaces.
    apart = not any(a != "▁" and b == "▁" for p in pieces for a, b in itertools.pairwise(p))
    kept = b"".join(entries[i] for i in model.encode(" a  b ")) == b"  a  b "
    return SpanEncoder(encode, _space_runs if apart and kept else _row_starts)


_encoders: dict[tuple[str, str], tuple[SpanEncoder, SpanEncoder]] = {}


def _both(path_a: str, path_b: str) -> tuple[SpanEncoder, SpanEncoder]:
    """This worker's encoders."""
    if (path_a, path_b) not in _encoders:
        _encoders[path_a, path_b] = byte_level_encoder(path_a), piece_encoder(path_b)
    return _encoders[path_a, path_b]


def _aligner(tokenizer_a: str, model_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b = _both(tokenizer_a, model_b)
        for batch in batches:
            all_data, all_off = utf8_column(batch.column(1))
            for i, j in row_chunks(all_off, _CHUNK):
                off = all_off[i : j + 1] - all_off[i]
                filled = np.diff(off) > 0
                data = np.insert(all_data[all_off[i] : all_off[j]], off[:-1][filled], np.uint8(32))
                off = off + np.concatenate(([0], np.cumsum(filled)))
                (ids_a, ends_a, good_a), (ids_b, ends_b, good_b) = encode_a(data, off), encode_b(data, off)
                good = good_a & good_b
                columns = []
                for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)):
                    first = np.searchsorted(ends, off, "right")
                    local = (ends - np.repeat(off[:-1], np.diff(first))).astype("<u4")
                    for values in (ids.astype("<u4"), local):
                        columns.append(pa.array([values[a:b].tobytes() if ok else b"" for a, b, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align_texts(docs: DataFrame, tokenizer_a: str, model_b: str) -> DataFrame:
    """doc_id, and as packed little-endian unsigned 32-bit integers the tokens of every text: a_ids, a_ends, b_ids, b_ends.

    Ends are byte places in a space and the text. A text that can't be aligned has no tokens.
    """
    return _rows(docs).mapInArrow(lean(_aligner(tokenizer_a, model_b)), "doc_id long, a_ids binary, a_ends binary, b_ids binary, b_ends binary")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8_column(column)
    return np.frombuffer(data.tobytes(), "<u4"), off >> 2


class Groups:
    """Tokens of several texts (ids, ends and each text's first token, for A and B) parted where both end."""

    def __init__(self, a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]):
        (self.ids_a, ends_a, self.first_a), (self.ids_b, ends_b, self.first_b) = a, b
        row_a, row_b = (np.repeat(np.arange(len(f) - 1, dtype=np.int64), np.diff(f)) for f in (self.first_a, self.first_b))
        place_a, place_b = row_a << 32 | ends_a, row_b << 32 | ends_b
        near = np.searchsorted(place_b, place_a)
        inside = near < len(place_b)
        self.last_a = np.zeros(len(place_a), bool)
        self.last_a[inside] = place_b[near[inside]] == place_a[inside]
        #: Of each group, in order: its last tokens, which are linked, and its text.
        self.link_a = np.flatnonzero(self.last_a)
        self.link_b = near[self.link_a]
        self.row = row_a[self.link_a]
        self.first = np.searchsorted(self.row, np.arange(len(self.first_a)))

    def digests(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3` in decimal, hashed; empty without tokens."""
        groups = len(self.link_a)
        sizes_a, sizes_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        before_a, before_b = np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a), np.repeat(np.cumsum(sizes_a), sizes_b)
        total = len(self.ids_a) + len(self.ids_b)
        order_a, order_b = np.arange(len(self.ids_a)) + before_a, np.arange(len(self.ids_b)) + before_b
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[order_a], ids[order_b] = self.ids_a, self.ids_b
        mark[order_a[self.link_a]], mark[order_b[self.link_b]] = ord("|"), ord(";")
        width = np.ones(total, np.int64)
        for k in range(1, _DIGITS):
            if not (more := ids >= 10**k).any():
                break
            width += more
        ends = np.cumsum(width + 1)
        out = np.empty(int(ends[-1]) if total else 0, np.uint8)
        if total:
            out[ends - 1] = mark
            rest = ids
            for k in range(int(width.max())):
                has = width > k
                out[(ends - 2 - k)[has]] = 48 + rest[has] % 10
                rest = rest // 10
        stop = np.concatenate(([0], ends))[np.append(order_b[self.link_b] + 1, 0)] if groups else np.zeros(1, np.int64)
        text, found = memoryview(out), []
        for g, h in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            found.append(hashlib.sha256(text[stop[g - 1] if g else 0 : stop[h - 1] - 1]).hexdigest() if h > g else "")
        return found


def _groups(batch: pa.RecordBatch) -> Groups:
    sides = []
    for k in (1, 3):
        (ids, first), (ends, _) = _packed(batch.column(k)), _packed(batch.column(k + 1))
        sides.append((ids, ends.astype(np.int64), first))
    return Groups(*sides)


def document_links(docs: DataFrame, tokenizer_a: str, model_b: str) -> DataFrame:
    """Of every text doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and packed its distinct linked pairs: pairs, times."""
    align = _aligner(tokenizer_a, model_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in align(batches):
            g = _groups(batch)
            key = g.ids_a[g.link_a].astype(np.int64) << 32 | g.ids_b[g.link_b]
            order = np.lexsort((key, g.row))
            key, row = key[order], g.row[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(head)
            times, first = np.diff(np.append(at, len(key))).astype("<u4"), np.searchsorted(row[at], np.arange(batch.num_rows + 1)).tolist()
            pairs = key[at].astype("<i8")
            links = pa.array(np.diff(g.first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(g.first_a), pa.int64()), pa.array(np.diff(g.first_b), pa.int64()), links, links, pa.array(g.digests()), *(pa.array([x[a:b].tobytes() for a, b in itertools.pairwise(first)], pa.binary()) for x in (pairs, times))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    return _rows(docs).mapInArrow(lean(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(links: DataFrame) -> DataFrame:
    """Of every linked pair of ids (a_id, b_id) how many links hold it, and whether no id of A has more with b_id (best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(n)], names=["a_id", "b_id", "n"])

        for batch in batches:
            keys, n = np.frombuffer(utf8_column(batch.column(0))[0].tobytes(), "<i8"), np.frombuffer(utf8_column(batch.column(1))[0].tobytes(), "<u4")
            if len(keys):
                held.append((keys, n.astype(np.int64)))
                size += len(keys)
            if size > 4 * _PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > _PAIRS:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merged())

    counts = links.select("pairs", "times").mapInArrow(lean(run), "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("links"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b_id")))


def with_counts(links: DataFrame, counts: DataFrame) -> DataFrame:
    """links with n_best and count_sum. counts has at most as many rows as the vocabularies have bytes."""
    found = counts.select("a_id", "b_id", "links", "best").toArrow()
    keys = found.column("a_id").to_numpy() << 32 | found.column("b_id").to_numpy()
    order = np.argsort(keys)
    shared = links.sparkSession.sparkContext.broadcast((keys[order], found.column("links").to_numpy()[order], found.column("best").to_numpy()[order]))
    names = [c for c in links.columns if c not in ("pairs", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            (data, off), (times, _) = utf8_column(batch.column("pairs")), _packed(batch.column("times"))
            place = np.searchsorted(known, np.frombuffer(data.tobytes(), "<i8"))
            n = times.astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (n * best[place], n * count[place])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s[off[1:] >> 3] - s[off[:-1] >> 3], pa.int64()) for s in sums)], names=[*names, "n_best", "count_sum"])

    return links.mapInArrow(lean(run), links.select(*names, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).schema)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    links = written(document_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "op12-links")
    return with_counts(links, pair_counts(links)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE: dict[str, str] = {}
