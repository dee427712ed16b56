"""Operator 6: toxicity of documents by a linear classifier over character n-grams.

Features are hashed n-grams of ORDERS characters (code points; A-Z lower-cased, white space as one kind), present or
not in the whole text. Each is scaled by its naive Bayes log-count ratio; a logistic regression is fitted on the
scaled features. Training takes the at most SAMPLE labelled doc_ids of either class with the smallest hashes, and one text
of each; classes are weighted by their counts among all labelled doc_ids. Features are the FEATURES with the largest
ratio times root of support, so a document's score needs only the few of its n-grams that are among them.

Defined results: null and empty texts score as a document without features; a null doc_id is never trained on; of rows
that share a labelled doc_id the text with the smallest hash is trained on; repeated rows are scored alike; texts of any length are scored whole, in slices; a score of exactly 0.5 counts as toxic;
buckets of equal rank are taken by number; without labels of both classes every score is 0; labels that disagree for a
doc_id count as toxic; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import added, lean, row_chunks, table, utf8_column, written

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 1 << 13
#: Labelled rows of either class that training takes at most.
SAMPLE = 2500
MIN_DOCS = 4
SMOOTHING = 1.0
RIDGE = 1e-4
STEPS = 150
#: A name that no given column has.
_SCORE = "__toxicity_score"
#: Rows in which the buckets' counts are summed.
_PARTS = 512
#: Characters a step takes from a long document.
_SLICE = 1 << 20
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


@dataclass
class Model:
    weights: np.ndarray  # float32, by bucket; 0 for buckets that are no feature
    bias: float

    def score(self, found: np.ndarray) -> float:
        z = self.bias + float(self.weights[found].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-z)) if z > -500 else 0.0


def code_points(data: np.ndarray) -> np.ndarray:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _FOLD[np.minimum(points, 127)], points)


def gram_buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of every n-gram, order by order and slice by slice."""
    for start in range(0, max(1, len(points)), _SLICE):
        part = points[start : start + _SLICE + max(ORDERS) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :]
            if n in ORDERS:
                yield ((h[:_SLICE] * np.uint64(0xD1342543DE82EF95)) >> np.uint64(44)).astype(np.int64)


def features(points: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a document, or those of them that are wanted (bool by bucket)."""
    found = [np.unique(b if wanted is None else b[wanted[b]]) for b in gram_buckets(points)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def choose(positive: np.ndarray, negative: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """The features' buckets, ascending, and their log-count ratios, from the documents of either class that hold each bucket."""
    ratio = np.log((positive + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((negative + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    rank = np.where(positive + negative >= MIN_DOCS, np.abs(ratio) * np.sqrt(positive + negative), 0)
    chosen = np.sort(np.argsort(-rank, kind="stable")[:FEATURES])
    chosen = chosen[rank[chosen] > 0]
    return chosen, ratio[chosen]


def fit(rows: list[np.ndarray], labels: np.ndarray, class_weight: dict[int, float], chosen: np.ndarray, scale: np.ndarray) -> Model:
    """Logistic regression on the scaled features; rows: each document's places among the chosen buckets."""
    column, row = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    x = scale[column]
    weight = np.array([class_weight[int(y)] for y in labels], float)
    weight /= weight.sum()
    w, bias = np.zeros(len(chosen)), float(np.log((weight * labels).sum() / (weight * (1 - labels)).sum()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, STEPS + 1):  # Adam on all rows
        z = np.bincount(row, x * w[column], len(labels)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        g, gb = np.bincount(column, x * error[row], len(chosen)) + RIDGE * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**k, 1 - 0.999**k
        w -= 0.02 * m / c / (np.sqrt(v / d) + 1e-10)
        bias -= 0.02 * mb / c / (np.sqrt(vb / d) + 1e-10)
    out = np.zeros(BUCKETS, np.float32)
    out[chosen] = w * scale
    return Model(out, float(bias))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    """Fit on a bounded sample of (doc_id, column) rows and the whole texts of their documents.

    Executors count the buckets' documents by class; only these counts, whose number is fixed, and each sampled
    document's chosen features reach the driver.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    total = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = written(named.where("label = 1").orderBy(order, "doc_id").limit(SAMPLE).unionByName(named.where("label = 0").orderBy(order, "doc_id").limit(SAMPLE)), "op6-sample")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(0))
            for i in range(len(off) - 1):
                yield pa.RecordBatch.from_pydict({"found": pa.array([features(code_points(data[off[i] : off[i + 1]])).astype(np.int32).tobytes()], pa.binary()), "label": batch.column(1).slice(i, 1)})

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.zeros((2, BUCKETS))
        for batch in batches:
            for found, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by[y][np.frombuffer(found.as_py(), np.int32)] += 1
        for k, (neg, pos) in enumerate(zip(np.split(by[0], _PARTS), np.split(by[1], _PARTS), strict=True)):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([np.concatenate((neg, pos)).tobytes()], pa.binary())})

    # picked has 2 * SAMPLE narrow rows at most, so broadcasting it is bounded. One text stands for each of them, whatever
    # the number of rows with its doc_id: map-side, a task hands on at most as many texts.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "label")
    rows = written(texts.mapInArrow(lean(grams), "found binary, label int"), "op6-grams").coalesce(8)
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not found.get(0) or not found.get(1):
        return Model(np.zeros(BUCKETS, np.float32), -1000.0)
    sums = added(rows.mapInArrow(lean(counts), "k int, v binary"), _PARTS)
    negative, positive = sums[:, : BUCKETS // _PARTS].ravel(), sums[:, BUCKETS // _PARTS :].ravel()
    chosen, scale = choose(positive, negative, found[1], found[0])
    if not len(chosen):
        return Model(np.zeros(BUCKETS, np.float32), -1000.0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            kept = [place[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"places": pa.array([x[x >= 0].astype(np.int32).tobytes() for x in kept], pa.binary()), "label": batch.column(1)})

    sample = rows.mapInArrow(lean(places), "places binary, label int").toArrow()
    return fit([np.frombuffer(x.as_py(), np.int32) for x in sample.column("places")], sample.column("label").to_numpy(), {k: total.get(k, 0) / found[k] for k in (0, 1)}, chosen, scale)


def score_texts(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score (0 to 1) of each whole text, in a column of that name."""
    names = docs.columns
    at, shared = names.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted = model.weights != 0
        for batch in batches:
            data, off = utf8_column(batch.column(at))
            scores = np.empty(len(off) - 1)
            for i, j in row_chunks(off, _SLICE):
                if j - i == 1:
                    scores[i] = model.score(features(code_points(data[off[i] : off[j]]), wanted))
                else:
                    scores[i:j] = _score_chunk(model, wanted, data[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, name])

    return docs.mapInArrow(lean(run), docs.select("*", F.lit(0.0).alias(name)).schema)


def _score_chunk(model: Model, wanted: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Scores of several rows at once; n-grams that cross rows don't count."""
    rows = len(off) - 1
    # The points of all rows; a row's first point is the number of points that begin before its bytes.
    begins = np.cumsum((data & 0xC0) != 0x80)
    first = np.concatenate(([0], begins))[off]
    points, keys = code_points(data), []
    for n, bucket in zip(ORDERS, gram_buckets(points), strict=False):
        hit = np.flatnonzero(wanted[bucket])
        row = np.searchsorted(first, hit, "right") - 1
        inside = hit + n <= first[row + 1]
        keys.append(row[inside] << 20 | bucket[hit[inside]])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    z = model.bias + np.bincount(keys >> 20, model.weights[keys & (BUCKETS - 1)], rows)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    scored = score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below 0.5, with their columns."""
    return score_texts(docs, train(docs, labels), _SCORE).where(F.col(_SCORE) < 0.5).select(*docs.columns)


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
