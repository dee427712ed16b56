"""A stored vector index: inverted lists by centroid, queries routed to them by a join, exact neighbours.

Vectors lie in the list of their nearest centroid, packed in blocks of about BLOCK, so a list that holds a third of all
rows is many rows of the table. Each list has a radius: its farthest vector's distance from the centroid. A search has two
rounds. First every query meets its FIRST nearest lists, which gives a k-th distance that the answer can't exceed. Then it
meets the lists that are not farther than that, by the triangle inequality (distance of the centroid less the radius); in
all others nothing can be among the first k. So the answer is exact whatever the lists are; good lists make it cheap.

Queries stay a table: they are gathered by list and joined with the blocks, a task meets one block and at most about CHUNK
queries at a time, and hands on each query's first k of the block. Only centroids and radii, at most LISTS of them, pass the
driver. Centroids are trained on at most SAMPLE vectors; all are indexed.

Vectors that are null, of another length than the index's (that of the most vectors) or hold null or non-finite numbers are
no neighbours and, as queries, have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.arrow import matrix, runs
from docloom.operators.storage import stored
from docloom.operators.versions import VersionedTables

#: Lists at most, vectors they are trained on at most, vectors of a block, queries that meet a block at a time.
LISTS, SAMPLE, BLOCK, CHUNK = 4096, 20_000, 4096, 1024
#: Lists a query meets in the first round.
FIRST = 3
#: Places after the point to which distances and scores count.
DIGITS = 6
#: Numbers of a distance matrix computed at a time.
_STEP = 1 << 22


@dataclass
class VectorIndex:
    centres: np.ndarray  # lists x width
    radius: np.ndarray  # -1: an empty list
    blocks: DataFrame  # list, block, ids, matrix: packed little-endian doubles
    sizes: np.ndarray  # blocks of each list

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _steps(rows: int, other: int) -> Iterator[slice]:
    step = max(1, _STEP // max(1, other))
    return (slice(k, k + step) for k in range(0, rows, step))


def centroids(sample: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(number, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(sample[s], centres).argmin(1) for s in _steps(len(sample), len(centres))])
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def build(vectors: DataFrame, root: str | None = None) -> VectorIndex | None:
    """Index vectors (chunk_id, vector), published under root if it is given; None if there is no vector at all."""
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return None
    width, total = lengths[0]["d"], lengths[0]["n"]
    # A window over hashes takes about as many rows as are wanted; the limit makes it a bound.
    share = min(1.0, 1.2 * SAMPLE / total)
    picked = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").limit(SAMPLE).toArrow()
    _, sample = matrix(picked.column("vector"), width)
    if not len(sample):
        return None
    shared = spark.sparkContext.broadcast(centroids(sample, int(np.clip(np.sqrt(total), 1, LISTS))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), width)
            for s in _steps(len(at), len(centres)):
                squares = _squares(x[s], centres)
                near = squares.argmin(1)
                out = np.sqrt(((x[s] - centres[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[s])), pa.array(near.astype(np.int32)), pa.array(out), pa.array([v.tobytes() for v in x[s]], pa.binary())], names=["chunk_id", "list", "out", "vector"])

    kind = dict(rows.dtypes)["chunk_id"]
    assigned = stored(rows.mapInArrow(assign, f"chunk_id {kind}, list int, out double, vector binary"), "vector-lists")
    lists = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("out").alias("radius"))  # at most LISTS rows
    lists = stored(lists.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "vector-sizes")
    placed = assigned.join(F.broadcast(lists.select("list", "blocks")), "list").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine in runs(batches, ["list", "block"]):
            yield pa.RecordBatch.from_arrays(
                [mine.column("list").slice(0, 1).combine_chunks(), mine.column("block").slice(0, 1).combine_chunks(), pa.array([mine.column("chunk_id").to_pylist()], pa.list_(mine.schema.field("chunk_id").type)), pa.array([b"".join(x.as_py() for x in mine.column("vector"))], pa.binary())],
                names=["list", "block", "ids", "matrix"],
            )

    order = ["list", "block"]
    blocks = placed.select(*order, "chunk_id", "vector").repartition(*order).sortWithinPartitions(*order, "chunk_id").mapInArrow(pack, f"list int, block int, ids array<{kind}>, matrix binary")
    centres = shared.value
    table = spark.createDataFrame([(k, c.tobytes()) for k, c in enumerate(centres)], "list int, centre binary").join(F.broadcast(lists), "list", "left")
    if root is None:
        return _opened(table, stored(blocks, "vector-blocks"))
    VersionedTables(spark, root, "list").publish({"lists": table, "blocks": blocks})
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    """The index that was published last under root."""
    tables = VersionedTables(spark, root, "list")
    number = tables.manifest().number
    return _opened(tables.table("lists", number), tables.table("blocks", number))


def _opened(lists: DataFrame, blocks: DataFrame) -> VectorIndex:
    found = lists.select("list", "centre", "radius", "blocks").orderBy("list").collect()
    return VectorIndex(np.stack([np.frombuffer(r["centre"]) for r in found]), np.array([-1.0 if r["radius"] is None else r["radius"] for r in found]), blocks, np.array([r["blocks"] or 0 for r in found]))


def _routed(asked: DataFrame, index: VectorIndex, first: int, rest: bool) -> DataFrame:
    """(qid, list): the first nearest lists of every query, or all others that its bound doesn't exclude."""
    centres, radius = index.centres, index.radius
    shared = asked.sparkSession.sparkContext.broadcast((centres, radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = shared.value
        used = np.flatnonzero(radius >= 0)
        for batch in batches:
            x = np.frombuffer(b"".join(v.as_py() for v in batch.column(1))).reshape(batch.num_rows, -1)
            for s in _steps(len(x), len(used)):
                squares = _squares(x[s], centres[used])
                order = np.argsort(squares, axis=1, kind="stable")
                near = np.zeros(squares.shape, bool)
                np.put_along_axis(near, order[:, :first], True, axis=1)
                if rest:
                    # What the sums of squares may be off by, and what rounding may hide.
                    slack = 1e-9 * (1 + (x[s] ** 2).sum(1)[:, None] + (centres[used] ** 2).sum(1)) + 10.0**-DIGITS
                    least = np.maximum(np.sqrt(squares) - radius[used] - np.sqrt(slack) * 1e-3, 0) ** 2
                    near = ~near & (least <= batch.column(2).to_numpy()[s][:, None] + slack)
                q, at = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q + s.start)), pa.array(used[at].astype(np.int32))], names=["qid", "list"])

    columns = ["qid", "vector", "bound"] if rest else ["qid", "vector"]
    return stored(asked.select(columns).mapInArrow(route, f"qid {dict(asked.dtypes)['qid']}, list int"), "vector-probes")


def _met(index: VectorIndex, asked: DataFrame, probes: DataFrame, top: int, chunk: int | None) -> DataFrame:
    """(qid, chunk_id, distance): the first of every block that a query meets."""
    spark = asked.sparkSession
    counts = spark.createDataFrame([(k, int(n)) for k, n in enumerate(index.sizes) if n], "list int, blocks int").join(F.broadcast(probes.groupBy("list").agg(F.count("*").alias("asked"))), "list")
    probes = probes.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("qid", F.lit(2)), F.ceil(F.col("asked") / (chunk or CHUNK))))
    gathered = probes.join(asked.select("qid", "vector").hint("merge"), "qid").groupBy("list", "part", "blocks").agg(F.collect_list(F.struct("qid", "vector")).alias("queries"))
    spread = gathered.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "queries")
    joined = index.blocks.join(spread.hint("merge"), ["list", "block"]).select("ids", "matrix", "queries")
    width = index.width

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, y = batch.column(0)[k].values, np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, width)
                order = np.argsort(np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable"), kind="stable")
                qids, packed = batch.column(2)[k].values.flatten()
                x = np.frombuffer(b"".join(v.as_py() for v in packed)).reshape(-1, width)
                for s in _steps(len(x), len(y)):
                    rough = _squares(x[s], y)
                    kept = min(top, len(y))
                    last = np.partition(rough, kept - 1, axis=1)[:, kept - 1]
                    slack = 1e-9 * (1 + (x[s] ** 2).sum(1) + (y * y).sum(1).max()) + 10.0**-DIGITS
                    q, at = np.nonzero(rough <= (last + slack)[:, None])
                    distance = np.round(((x[s][q] - y[at]) ** 2).sum(1), DIGITS)
                    best = np.lexsort((order[at], distance, q))
                    q, at, distance = q[best], at[best], distance[best]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    q, at, distance = q[place < top], at[place < top], distance[place < top]
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q + s.start)), names.take(pa.array(at)), pa.array(distance)], names=["qid", "chunk_id", "distance"])

    kind = dict(index.blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return joined.mapInArrow(match, f"qid {dict(asked.dtypes)['qid']}, chunk_id {kind}, distance double")


def _first(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _asked(queries: DataFrame, width: int) -> DataFrame:
    """Queries that can have neighbours, with packed vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["qid", "vector"])

    rows = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    return stored(rows.mapInArrow(pack, f"qid {dict(rows.dtypes)['qid']}, vector binary"), "vector-queries")


def probes_of(index: VectorIndex, queries: DataFrame, top: int = 10, first: int = FIRST, chunk: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Packed queries, the lists each meets in both rounds, and what the first round found."""
    asked = _asked(queries, index.width)
    near = _routed(asked, index, first, rest=False)
    found = stored(_first(_met(index, asked, near, top, chunk), top), "vector-first")
    bound = found.groupBy("qid").agg(F.when(F.count("*") >= top, F.max("distance")).alias("bound"))
    bounded = asked.join(bound.hint("merge"), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return asked, near, _routed(bounded, index, first, rest=True), found


def search(index: VectorIndex, queries: DataFrame, top: int = 10, first: int = FIRST, chunk: int | None = None) -> DataFrame:
    """Exact neighbours of queries (qid, vector) by squared distance: qid, chunk_id, score = 1 / (1 + distance), rank. Ties go by chunk_id.

    About chunk queries (CHUNK if it isn't given) meet a block at a time.
    """
    asked, _, more, found = probes_of(index, queries, top, first, chunk)
    rows = found.select("qid", "chunk_id", "distance").unionByName(_met(index, asked, more, top, chunk))
    return _first(rows, top).select("qid", "chunk_id", F.round(1 / (1 + F.col("distance")), DIGITS).alias("score"), "rank")


def probed_lists(index: VectorIndex, queries: DataFrame, top: int = 10, first: int = FIRST) -> DataFrame:
    """How many lists each query meets in both rounds, of how many: qid, met, lists."""
    _, near, more, _ = probes_of(index, queries, top, first)
    return near.unionByName(more).groupBy("qid").agg(F.count("*").alias("met")).withColumn("lists", F.lit(int((index.radius >= 0).sum())))
