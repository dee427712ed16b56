"""Operator 4: near-duplicate embeddings with product quantisation.

Unit vectors are assigned to coarse lists; what is left after the list's centre is coded in SUBSPACES by the nearest
of CODEWORDS. Within a label, the lists are laid out one after another and cut into blocks of about BLOCK vectors. Each
vector is a query too: it probes every list that a linked vector can be in, by two exact bounds: the list's border
lies within the linked vectors' distance, and its centre within that and the list's radius. It is sent to the blocks of
those lists alone, in chunks of CHUNK; a task meets one chunk and one block. There its distances to the lists' codes
are sums from lookup tables; a vector is out if its code is farther than the linked distance plus its own coding error
(triangle inequality). What remains is decided by the exact cosine in double precision. So neither the probes nor the
codes lose links, and recall is 1 by construction.

Equal vectors of a label are one class that counts its members. A task returns each class's number of links and
a spanning forest of the links, never the pairs.

The quantisers are trained on the classes with the smallest hashes, at most TRAIN and TRAIN_BYTES; all are indexed.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without a label, have
no links, a component of their own and are kept; vectors of different lengths never link (each length has quantisers of
its own), of any length up to what one row can hold; labels are of any type that can be grouped, and equal only within it; rows are counted one by one, repeated vec_ids too; a null vec_id
never represents others if one with an id is in the component; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import lean, runs, table, utf8_column, written
from docloom.llm.graph import components

#: Classes the quantisers are trained on at most, and their bytes.
TRAIN, TRAIN_BYTES = 20_000, 64 << 20
SUBSPACES, CODEWORDS = 8, 64
BLOCK, CHUNK = 2048, 8192
#: Labels up to which a list of them is sent to all executors.
BROADCAST_LABELS = 100_000
#: Query x list entries that a step computes at a time.
_STEP = 1 << 21


@dataclass
class Quantiser:
    centres: np.ndarray  # lists x d
    words: np.ndarray  # SUBSPACES x CODEWORDS x part

    def residual(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SUBSPACES
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), SUBSPACES, (x.shape[1] + pad) // SUBSPACES)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list, and squared distances to all."""
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1), 0)
        return d.argmin(1), d

    def codes(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the vectors' residuals in their lists, and the exact coding errors."""
        r = self.residual(x - self.centres[of])
        code = np.empty((len(x), SUBSPACES), np.uint8)
        left = np.zeros(len(x))
        for s in range(SUBSPACES):
            code[:, s] = ((self.words[s] ** 2).sum(1) - 2 * r[:, s] @ self.words[s].T).argmin(1)
            left += ((r[:, s] - self.words[s][code[:, s]]) ** 2).sum(1)
        return code, np.sqrt(left)


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, -(-len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def train(sample: np.ndarray, total: int) -> Quantiser:
    """Lists grow with the square root of the number of classes."""
    centres = k_means(sample, int(np.clip(np.sqrt(total), 1, 4096)))
    q = Quantiser(centres, np.zeros((SUBSPACES, 1, -(-sample.shape[1] // SUBSPACES))))
    r = q.residual(sample - centres[q.lists(sample)[0]])
    q.words = np.stack([np.resize(k_means(np.ascontiguousarray(r[:, s]), CODEWORDS), (CODEWORDS, r.shape[2])) for s in range(SUBSPACES)])
    return q


def _vectors(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return utf8_column(column)[0].view(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _classes(vectors: DataFrame) -> DataFrame:
    """Linkable rows by equal vectors of a label: node, label, d, v (doubles), n, least (vec_id); rows keep their node."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, valid = batch.column(2), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            begin, size = column.offsets.to_numpy()[:-1].astype(np.int64), np.where(valid, np.diff(column.offsets.to_numpy()), 0)
            values, labelled = column.values.to_numpy(zero_copy_only=False).astype(float), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            d, v = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for n in np.unique(size[labelled]).tolist():
                rows = np.flatnonzero((size == n) & labelled)
                for some in np.array_split(rows, 1 + len(rows) * n // _STEP) if n else ():
                    x = values[begin[some, None] + np.arange(n)]
                    with np.errstate(invalid="ignore"):
                        top = np.abs(x).max(axis=1)
                    ok = np.isfinite(top) & (top > 0)
                    # Very large and very small vectors would overflow in squares; a power of two changes no cosine.
                    scaled = np.ldexp(x[ok], -np.frexp(top[ok])[1][:, None])
                    d[some[ok]] = n
                    for i, row in zip(some[ok].tolist(), scaled, strict=True):
                        v[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, mask=d == 0), pa.array(v, pa.binary())], names=["vec_id", "label", "d", "v"])

    kind = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(lean(packed), f"vec_id long, label {kind}, d int, v binary")
    return rows.withColumn("node", F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.concat(F.md5(F.col("label").cast("string").cast("binary")).cast("binary"), "v")))))


def _numbered(classes: DataFrame) -> DataFrame:
    """classes with a number in place of each label, whatever its type."""
    labels = written(classes.select("label").distinct().select("label", F.monotonically_increasing_id().alias("number")), "op4-labels")
    few = labels.count() <= BROADCAST_LABELS
    return classes.join(F.broadcast(labels) if few else labels.hint("merge"), "label").drop("label").withColumnRenamed("number", "label")


def _probes(q: Quantiser, x: np.ndarray, own: np.ndarray, lists: np.ndarray, radius: np.ndarray, far: float) -> np.ndarray:
    """Which of the lists (with their radii) each unit vector, whose own list is known, must probe: a matrix."""
    centres, home = q.centres[lists], q.centres[own]
    distance = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)
    own_distance = ((x - home) ** 2).sum(1)
    apart = np.sqrt(np.maximum((home**2).sum(1)[:, None] - 2 * home @ centres.T + (centres**2).sum(1), 0))
    # Within `far` of the half space of points that are nearer to the list's centre than to the vector's own.
    return (distance - own_distance[:, None] <= 2 * far * apart + 1e-6) & (np.sqrt(distance) <= far + radius + 1e-6)


def _linked(base: DataFrame, d: int, q: Quantiser, threshold: float) -> DataFrame:
    """Link classes of one vector length: rows (node, links, root) for each block a class meets; root spans the links."""
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-12
    context = base.sparkSession.sparkContext
    shared = context.broadcast(q)  # at most 4096 lists

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_vectors(batch.column(2), d))
            near, distance = q.lists(x)
            code, error = q.codes(x, near)
            more = [pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(np.sqrt(distance[np.arange(len(x)), near]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "list", "code", "error", "out"])

    indexed = written(base.select("node", "label", "v", "n").mapInArrow(lean(assigned), "node binary, label long, v binary, n long, list int, code binary, error double, out double"), "op4-index")
    radii = np.full(len(q.centres), -np.inf)
    for r in indexed.groupBy("list").agg(F.max("out").alias("out")).collect():  # a row for each list
        radii[r["list"]] = r["out"]
    spread = context.broadcast(radii)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, every = shared.value, np.arange(len(spread.value))
        for batch in batches:
            x, own = _unit(_vectors(batch.column(2), d)), batch.column(3).to_numpy()
            for some in np.array_split(np.arange(len(x)), 1 + len(x) * len(every) // _STEP):
                row, found = np.nonzero(_probes(q, x[some], own[some], every, spread.value, far))
                row = pa.array(some[row])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(found.astype(np.int32))], names=["node", "label", "list"])

    # Lists of a label lie one after another; a vector's place in its list is by hash, and blocks are ranges of places.
    lists = indexed.groupBy("label", "list").agg(F.count("*").alias("size"))
    order = Window.partitionBy("label").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    lists = written(lists.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))), "op4-lists")
    block = lambda place: F.expr(f"cast(({place}) div {BLOCK} as int)")
    placed = indexed.join(lists.hint("merge"), ["label", "list"]).withColumn("block", block("start + pmod(xxhash64(node), size)"))
    # A label of one block needs no probes: its vectors all meet there.
    large = written(lists.groupBy("label").agg(F.sum("size").alias("size")).where(F.col("size") > BLOCK).select("label"), "op4-large")
    large = F.broadcast(large) if large.count() <= BROADCAST_LABELS else large.hint("merge")
    probes = indexed.join(large, "label", "left_semi").select("node", "label", "v", "list").mapInArrow(lean(probed), "node binary, label long, list int").join(lists.hint("merge"), ["label", "list"])
    probes = probes.select("node", "label", F.explode(F.sequence(block("start"), block("start + size - 1"))).alias("block")).distinct()
    asked = written(probes.unionByName(indexed.join(large, "label", "left_anti").select("node", "label", F.lit(0).alias("block"))), "op4-asked")
    chunks = written(asked.groupBy("label", "block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "op4-chunks")
    asked = asked.join(chunks.hint("merge"), ["label", "block"]).withColumn("chunk", F.expr("pmod(xxhash64(node, 1), chunks)").cast("int"))
    columns = ["label", "block", "chunk", "query", "list", "node", "v", "n", "code", "error"]
    asked = asked.select("node", "block", "chunk").join(indexed.drop("code").hint("merge"), "node").withColumns({"query": F.lit(1), "code": F.lit(None).cast("binary")})
    stored = placed.join(chunks.hint("merge"), ["label", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("query", F.lit(0))
    meet = stored.select(columns).unionByName(asked.select(columns))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for group in runs(batches, 3):
            is_query = group.column("query").to_numpy().astype(bool)
            if is_query.all() or not is_query.any():
                continue
            nodes, n = utf8_column(group.column("node"))[0].reshape(-1, 16), group.column("n").to_numpy()
            raw = _vectors(group.column("v"), d)
            norm = np.sqrt((raw * raw).sum(1))
            unit, of = raw / norm[:, None], group.column("list").to_numpy()
            b, a = np.flatnonzero(~is_query), np.flatnonzero(is_query)
            code = utf8_column(group.column("code"))[0].reshape(-1, SUBSPACES)
            error, x, own = group.column("error").to_numpy()[b], unit[a], of[a]
            linked = np.zeros((len(a), len(b)), bool)
            here = np.unique(of[b])
            radius = np.array([np.sqrt(((unit[b][of[b] == c] - q.centres[c]) ** 2).sum(1).max()) for c in here])
            probing = _probes(q, x, own, here, radius, far)
            for k, c in enumerate(here.tolist()):
                inside, probe = np.flatnonzero(of[b] == c), np.flatnonzero(probing[:, k])
                if not len(probe):
                    continue
                r = q.residual(x[probe] - q.centres[c])
                tables = np.stack([np.maximum((r[:, s] ** 2).sum(1)[:, None] - 2 * r[:, s] @ q.words[s].T + (q.words[s] ** 2).sum(1), 0) for s in range(SUBSPACES)]).astype(np.float32)
                for part in np.array_split(np.arange(len(probe)), max(1, len(probe) * len(inside) // _STEP)):
                    coded = np.zeros((len(part), len(inside)), np.float32)
                    for s in range(SUBSPACES):
                        coded += tables[s][part][:, code[inside, s]]
                    i, j = np.nonzero(coded <= ((far + error[inside]) ** 2 * (1 + 1e-5) + 1e-5).astype(np.float32))
                    i, j = probe[part[i]], inside[j]
                    for some in np.array_split(np.arange(len(i)), max(1, len(i) * d // (_STEP * 4))):
                        y, z = raw[a[i[some]]], raw[b[j[some]]]
                        ok = (y * z).sum(1) / (norm[a[i[some]]] * norm[b[j[some]]]) >= threshold
                        linked[i[some][ok], j[some][ok]] = True
            place = {x: k for k, x in enumerate(map(bytes, nodes[b]))}
            for i, x in enumerate(map(bytes, nodes[a])):
                if x in place:  # not with itself
                    linked[i, place[x]] = False
            links = linked @ n[b]
            rows = np.flatnonzero(links)
            if not len(rows):
                continue
            part, columns = linked[rows], np.flatnonzero(linked.any(0))
            part = part[:, columns]
            root = _roots(part)
            out = [nodes[a[i]].tobytes() for i in rows] + [nodes[b[j]].tobytes() for j in columns]
            spans = [nodes[b[columns[k]]].tobytes() for k in root]
            yield pa.RecordBatch.from_pydict({"node": pa.array(out, pa.binary()), "links": pa.array(np.concatenate((links[rows], np.zeros(len(columns), np.int64)))), "root": pa.array(spans, pa.binary())})

    keys = ["label", "block", "chunk"]
    return meet.repartition(*keys).sortWithinPartitions(*keys, "query").mapInArrow(lean(match), "node binary, links long, root binary")


def _roots(linked: np.ndarray) -> np.ndarray:
    """For rows, then columns, of a matrix of links, the first column of their component."""
    column = np.arange(linked.shape[1])
    while True:
        row = np.where(linked, column, len(column)).min(1)
        new = np.minimum(column, np.where(linked, row[:, None], len(column)).min(0))
        new = new[new]
        if (new == column).all():
            return np.concatenate((row, column))
        column = new


def link_embeddings(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Every row of vectors (vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    rows = written(_classes(vectors), "op4-rows")
    classes = rows.where("node is not null").groupBy("node", "label", "d", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(_numbered(classes), "op4-classes")
    found = None
    for size in classes.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect():  # a row for each length of vectors
        mine = classes.where(F.col("d") == size["d"])
        picked = mine.select("v").orderBy(F.xxhash64("v")).limit(max(1, min(TRAIN, TRAIN_BYTES // (8 * size["d"])))).toArrow()
        more = _linked(mine, size["d"], train(_unit(_vectors(picked.column("v").combine_chunks(), size["d"])), size["n"]), threshold)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "op4-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = comps.join(classes.select("node", "least").hint("merge"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("smallest"))
    member = named.join(least.hint("merge"), "component").select("node", "smallest")
    member = classes.select("node", "n", "least").join(counts.hint("merge"), "node", "left").join(member.hint("merge"), "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest"))
    out = rows.select("vec_id", "node").join(member.hint("merge"), "node", "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLE: dict[str, str] = {}
