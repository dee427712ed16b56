"""Operator 5: near-duplicate documents by SetSketch registers.

Every element of a document's shingle set draws one point in each of M strata of an exponential variable, in an
order of registers of its own; a register keeps its smallest point x, truncated to floor(1 - log_B(x)). Registers of
a union are the maxima of both sides' registers. Bands of ROWS registers are bucket keys. From two sketches and the
sets' sizes the likelihood of the counts of larger, smaller and equal registers is maximised for the similarity;
pairs whose estimate is far below the threshold go no further; the rest is verified on full shingle sets.

Equal sets are one class from the start. Within a bucket, members are first compared with its smallest class only.
Buckets whose members are then linked already are done; in the others, only classes outside the bucket's largest
component are compared with the rest, in blocks and by their registers alone. Only classes with a likely partner in
a block then come with their full sets, to tasks that return a spanning forest of the links they verify. So no bucket's
pairs are emitted, unlike classes ship no full sets, and no link between different components is lost but for the
chance that two linked sets share no band or that their estimate is CUT below the threshold (over four standard
deviations). For sets of tens of shingles and more the former is below 1e-8 at similarity 0.85 and below 1e-5 at 0.8; it
is larger for a few shingles, whose registers repeat elements. Sets of at most TINY shingles are linked at 0.8 and above
only if one is the other less an element; these pairs are found exactly, by a join of signatures.

Defined results: documents without words have n_shingles 0, a component of their own and are kept; rows that share
a doc_id are judged row by row; a null doc_id never represents others if one with an id is in the group; equal sets
are one class whatever their number; texts of any length count whole; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.llm.common import HALF_CHUNK, id_column, id_kind, lean, row_chunks, runs, table, utf8_column, written
from docloom.llm.graph import components
from docloom.llm.hashing import FOLD, U64, mix, span_hashes, word_spans

SHINGLE = 5
M = 256
ROWS = 6
BANDS = M // ROWS
B, RATE = 1.08, 20.0
CUT = 0.11
#: Classes of a bucket that are compared in one block: by registers (256 bytes each), then the likely ones with full sets.
BLOCK = 1000
#: Of sets of so many shingles at most, each linked pair differs by one shingle (at 0.8: 7 / 9 is too little).
TINY = 8
_WORD = np.ones(256, bool)
_WORD[0x20] = False
_WORD[0x09:0x0E] = False
_WEIGHTS = mix(np.arange(11, 11 + SHINGLE, dtype=U64)) | U64(1)
_EMPTY = np.zeros(0, U64)
_SIGN = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    folded = FOLD[data]
    starts, ends, first = word_spans(folded, off, _WORD)
    h = span_hashes(folded, starts, ends)
    n = len(h) - SHINGLE + 1
    runs = mix(sum(h[k : k + n] * _WEIGHTS[k] for k in range(SHINGLE))) if n > 0 else _EMPTY
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(np.array([(h[a:b] * _WEIGHTS[: b - a]).sum() + U64(b - a)], U64))
        else:
            yield _EMPTY


def registers(values: np.ndarray) -> np.ndarray:
    """The M registers (uint8) of a set of hashes."""
    least, filled = np.full(M, 1.0), np.zeros(M, bool)
    base = mix(values ^ U64(0x5851F42D4C957F2D))
    first, step = (base & U64(M - 1)).astype(np.int64), (base >> U64(32) & U64(M - 1) | U64(1)).astype(np.int64)
    for k in range(M):
        to = (first + k * step) & (M - 1)
        open_ = ~filled[to]
        if open_.any():
            to = to[open_]
            point = (mix(values[open_] + U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) * (2.0**-53 / M) + k / M
            np.minimum.at(least, to, point)
            filled[to] = True
            if filled.all():
                break
    x = -np.log1p(-np.minimum(least, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B)), 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)


def likelihood(j: np.ndarray, up: np.ndarray, down: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The log-likelihood of similarity j: `up` registers of a are larger than b's, `down` smaller; u, v: shares of the sizes."""
    a, b = _p(u - v * j), _p(v - u * j)
    return up * np.log(np.maximum(a, 1e-12)) + down * np.log(np.maximum(b, 1e-12)) + (M - up - down) * np.log(np.maximum(1 - a - b, 1e-12))


def estimate(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity under which `up` registers of a larger than b's, and `down` smaller, are likeliest."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(25):  # the likelihood is concave
        third = (high - low) / 3
        left = likelihood(low + third, up, down, u, v) < likelihood(high - third, up, down, u, v)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def reaches(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the estimate is at least that: the likelihood, which is concave, still rises there."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    step = 1e-4
    return (np.minimum(u / v, v / u) >= least) & (likelihood(least + step, up, down, u, v) >= likelihood(least - step, up, down, u, v))


def deletions(s: np.ndarray, percent: int) -> list[bytes] | None:
    """Of a tiny set, the signatures of the sets that lack one of its elements, if those are linked with it."""
    if len(s) > TINY or 100 * (len(s) - 1) < percent * len(s):
        return None
    parts = [mix(s ^ _SIGN[0]), mix(s + _SIGN[1])]
    return [np.array(x, U64).tobytes() for x in zip(*(p.sum() - p for p in parts), strict=True)]


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n (set size), sig (128-bit sum of the set, null when empty), regs and less (tiny sets: signatures of sets with one shingle less) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, HALF_CHUNK):
                n, sig, regs, less = [], [], [], []
                for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                    n.append(len(s))
                    sig.append(signature(s) if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
                    less.append(deletions(s, percent) if len(s) else None)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary()), "regs": pa.array(regs, pa.binary()), "less": pa.array(less, pa.list_(pa.binary()))})

    return _texts(docs).mapInArrow(lean(run), f"doc_id {id_kind(docs)}, n long, sig binary, regs binary, less array<binary>")


def signature(s: np.ndarray) -> bytes:
    return np.array([mix(s ^ _SIGN[0]).sum(), mix(s + _SIGN[1]).sum()], U64).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(id_column(docs), F.col("text").cast("string").alias("text"))


def equal_registers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many registers of each row agree; eight at a time, as counts up to M / 8 fit their bytes."""
    return (x == y).view(U64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def likely(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of registers may be of linked sets: fit sizes, and an estimate not far below the threshold."""
    threshold = percent / 100
    ok = 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
    # A share of equal registers so far below is over seven standard deviations off; it spares the estimate.
    ok &= equal_registers(x, y) >= M * (threshold - CUT - 0.1)
    at = np.flatnonzero(ok)
    if len(at):
        y = np.broadcast_to(y, x.shape)
        up, down = (x[at] > y[at]).sum(axis=1), (x[at] < y[at]).sum(axis=1)
        ok[at] = reaches(up, down, n_x[at].astype(float), n_y[at].astype(float), threshold - CUT)
    return ok


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose estimated similarity is not far below the threshold."""
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (utf8_column(batch.column(k))[0].reshape(-1, M) for k in (3, 5))
            yield batch.select([0, 1]).filter(pa.array(likely(x, y, batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent)))

    joined = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return joined.select("a", "b", "n_a", "regs_a", "n_b", "regs_b").mapInArrow(lean(run), "a binary, b binary")


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, members: sorted hashes) of the wanted classes, from their first documents' whole texts."""
    wanted = written(wanted.distinct().join(classes.hint("merge"), "sig").select("sig", "rep"), "op5-wanted")
    words = bloom.build(wanted, "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.probe(words, batch.column(2).to_numpy())))
            data, off = utf8_column(batch.column(1))
            for i, j in row_chunks(off, HALF_CHUNK):
                found = [s for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i]) if len(s)]
                yield pa.RecordBatch.from_pydict({"sig": pa.array([signature(s) for s in found], pa.binary()), "members": pa.array([s.tobytes() for s in found], pa.binary())})

    # The filter passes few other documents; the join with the wanted classes removes them. A class without an id in
    # its first document is sought by the hash of a null, which is in the filter as any other.
    full = _texts(docs).withColumn("h", bloom.key_hash("doc_id")).mapInArrow(lean(sets), "sig binary, members binary")
    return written(full.join(wanted.select("sig").hint("merge"), "sig", "left_semi").dropDuplicates(["sig"]), "op5-sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets satisfy 100 * intersection >= percent * union."""
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("sig")), docs, classes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(full.select(F.col("sig").alias("a"), F.col("members").alias("x")).hint("merge"), "a").join(full.select(F.col("sig").alias("b"), F.col("members").alias("y")).hint("merge"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(lean(compare), "a binary, b binary")


class _Part:
    """Rows of a slot as arrays."""

    def __init__(self, group: pa.Table):
        self.sig = [x.as_py() for x in group.column("sig")]
        self.comp = mix(np.ascontiguousarray(utf8_column(group.column("comp"))[0].reshape(-1, 16)).view(U64) * _WEIGHTS[:2]).sum(axis=1)
        self.regs = np.ascontiguousarray(utf8_column(group.column("regs"))[0].reshape(-1, M))
        self.bands = self.regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)  # looked at for likely pairs alone
        self.n, self.minor = group.column("n").to_numpy(), group.column("minor").to_numpy()
        self.band = group.column("band")[0].as_py()
        self.found = np.zeros(len(self.n), bool)
        self.group = group
        if "members" in group.column_names:
            self.data, self.off = utf8_column(group.column("members"))

    def members(self, i: int) -> np.ndarray:
        return self.data[self.off[i] : self.off[i + 1]].view(U64)

    def partners(self, i: int, home: _Part, percent: int) -> np.ndarray:
        """Classes of home, of other components, that may be linked with class i; each pair in the first of its common bands alone."""
        other = home.comp != self.comp[i]
        if self is home:
            other &= ~home.minor | (np.arange(len(other)) > i)
        other = np.flatnonzero(other & (100 * np.minimum(home.n, self.n[i]) >= percent * np.maximum(home.n, self.n[i])))
        if len(other):
            other = other[likely(home.regs[other], self.regs[i], home.n[other], np.full(len(other), self.n[i]), percent)]
        return other[(home.bands[other] == self.bands[i]).all(axis=2).argmax(axis=1) == self.band] if len(other) else other


def _by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Part, _Part, bool]]:
    """A block's classes, then each slice of its visitors beside them; whether the block begins."""
    at, home = None, None
    for group in runs(batches, 3):
        key, part = (group.column("key")[0].as_py(), group.column("block")[0].as_py()), _Part(group)
        fresh = key != at
        if fresh:
            at, home = key, part if group.column("slot")[0].as_py() == 0 else None
        if home is not None:
            yield part, home, fresh


_SLOT_KEYS = ["key", "block", "slot"]
_SLOT = [*_SLOT_KEYS, "band", "sig", "comp", "n", "regs", "minor"]


def _likely_rows(rows: DataFrame, percent: int) -> DataFrame:
    """Of the rows in blocks of buckets, those of classes with a likely partner of another component in their block.

    rows: key, block, slot (0: those that live in the block, then the visitors in slices), band, sig, comp, n, regs, minor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for part, home, fresh in _by_slot(batches):
            if fresh and before is not None:
                yield from before.group.filter(pa.array(before.found)).to_batches()
            before = home
            for i in np.flatnonzero(part.minor).tolist():
                others = part.partners(i, home, percent)
                if len(others):
                    part.found[i] = True
                    home.found[others] = True
            if part is not home:
                yield from part.group.filter(pa.array(part.found)).to_batches()
        if before is not None:
            yield from before.group.filter(pa.array(before.found)).to_batches()

    rows = rows.select(*_SLOT)
    return rows.repartition("key", "block").sortWithinPartitions(*_SLOT_KEYS).mapInArrow(lean(run), rows.schema)


def _cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between components within blocks of buckets, verified on full sets (members), as spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for part, home, fresh in _by_slot(batches):
            if fresh:
                parent.clear()
            left, right = [], []
            for i in np.flatnonzero(part.minor).tolist():
                for k in part.partners(i, home, percent).tolist():
                    a, b = find(int(part.comp[i])), find(int(home.comp[k]))
                    if a != b and _similar(part.members(i), home.members(k), percent):
                        parent[a] = b
                        left.append(part.sig[i])
                        right.append(home.sig[k])
            if left:
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return rows.repartition("key", "block").sortWithinPartitions(*_SLOT_KEYS).select(*_SLOT, "members").mapInArrow(lean(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    rows = written(sketches(docs, percent), "op5-sketches")
    first = [F.first(c).alias(c) for c in ("n", "regs", "less")]
    classes = written(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), *first), "op5-classes")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("regs", b * ROWS + 1, F.lit(ROWS))).alias("key")))
    banded = classes.select("sig", F.explode(keys).alias("x")).select("sig", "x.band", "x.key")
    full = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("sig").alias("pivot")).where("size > 1")
    bucketed = written(banded.join(full.hint("merge"), "key"), "op5-buckets")
    stars = bucketed.where("sig <> pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b")).distinct()
    tiny = classes.select(F.col("sig").alias("b"), F.explode("less").alias("a")).join(classes.select(F.col("sig").alias("a")).hint("merge"), "a", "left_semi")
    stars = written(_likely(stars, classes, percent).unionByName(tiny).distinct(), "op5-stars")
    links = written(_verified(stars, docs, classes, percent), "op5-links")
    comps = components(links)

    # Buckets that still hold classes of several components; a bucket of two was decided above.
    labelled = bucketed.where("size > 2").join(comps.hint("merge"), bucketed["sig"] == comps["node"], "left").select("key", "band", "sig", "size", F.coalesce("component", "sig").alias("comp"))
    labelled = written(labelled, "op5-labelled")
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("n_comp"))
    major = parts.groupBy("key").agg(F.max(F.struct("n_comp", "comp"))["comp"].alias("major"), F.count("*").alias("comps")).where("comps > 1")
    mixed = labelled.join(major.hint("merge"), "key").withColumn("minor", F.expr("comp <> major"))
    mixed = mixed.join(classes.select("sig", "n", "regs").hint("merge"), "sig")
    # A class lives in one block of its bucket; those outside the major component visit the other blocks too.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    placed = mixed.withColumn("own", own).withColumn("block", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    slot = F.when(F.col("own") == F.col("block"), 0).otherwise(1 + F.pmod(F.xxhash64("sig", F.lit(1)), blocks)).cast("int")
    near = written(_likely_rows(placed.withColumn("slot", slot), percent), "op5-near")
    more = written(_cross_links(near.join(_full_sets(near.select("sig"), docs, classes).hint("merge"), "sig"), percent), "op5-cross")
    if more.take(1):
        links = links.unionByName(more)
        comps = components(links)
    named = comps.join(classes.select(F.col("sig").alias("node"), "rep").hint("merge"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    member = named.join(least.hint("merge"), "component").select(F.col("node").alias("sig"), "least")
    member = classes.select("sig", "rep").join(member.hint("merge"), "sig", "left").select("sig", F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "sig").join(member.hint("merge"), "sig", "left")
    found = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


QUERIES = {"op5_minhash_dedup": op5_minhash_dedup}
ORACLE: dict[str, str] = {}
