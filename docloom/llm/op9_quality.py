"""Operator 9: document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a document's whole text are standardised and mapped to FREQUENCIES random cosines, whose inner
products approximate a Gaussian kernel. Every partition sums its part of the normal equations; the sums, whose size
is fixed, are solved on the driver. Predictions of the training rows, counted in BINS bins, give a monotone curve
(pool adjacent violators) from prediction to score. All labelled rows are used.

Defined results: null and empty texts have all-zero counts and get the score of such a document; a null doc_id is
never trained on; labels that disagree for a doc_id count as the lower; texts of any length are measured whole; a score
of exactly THRESHOLD is kept; without labels of both classes every score is their share of ones (0.5 without any);
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import added, lean, row_chunks, table, utf8_column, written
from docloom.llm.hashing import span_hashes, word_spans
from docloom.llm.op6_toxicity import held_out

FREQUENCIES = 256
WIDTH = 1.0
RIDGE = 1e-3
BINS = 2000
_LOW, _HIGH = -0.5, 1.5
THRESHOLD = 0.3
#: Names that no given column has.
STATS, _SCORE = "__quality_stats", "__quality_score"
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "mark": b"!?", "bar": b"|", "sign": b"#$%&*+<=>@[\\]^_`{}~/", "quote": b"\"'()-", "space": b" \t\n\r\x0b\x0c", "line": b"\n"}  # fixed values: character classes
STATISTICS = ["chars", "words", "lines", "word_mean", "word_sd", "word_max", "line_mean", "upper", "lower", "digit", "stop", "mark", "bar", "sign", "quote", "space", "high", "distinct", "line_distinct", "sign_words", "short_words", "top_word"]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    rows, size = len(off) - 1, np.diff(off)

    def total(values: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (run[off[1:]] - run[off[:-1]]).astype(float)

    def spread(first: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        run, run2 = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
        n = np.maximum(np.diff(first), 1)
        mean = (run[first[1:]] - run[first[:-1]]) / n
        return mean, np.sqrt(np.maximum((run2[first[1:]] - run2[first[:-1]]) / n - mean**2, 0)), n

    member = {}
    for name, values in _SETS.items():
        lut = np.zeros(256, bool)
        lut[list(values)] = True
        member[name] = lut[data]
    share = {name: total(m) / np.maximum(size, 1) for name, m in member.items()}
    starts, ends, first = word_spans(data, off, _WORD)
    length = (ends - starts).astype(float)
    mean, sd, _ = spread(first, length)
    signs = np.concatenate(([0], np.cumsum(member["sign"] | member["mark"])))
    sign_words, _, _ = spread(first, ((signs[ends] - signs[starts]) > 0).astype(float))
    short, _, _ = spread(first, (length <= 3).astype(float))
    begins, stops, line_first = word_spans(data, off, _LINE)
    line_mean, _, _ = spread(line_first, (stops - begins).astype(float))
    h, lines = span_hashes(data, starts, ends), span_hashes(data, begins, stops)
    words, n_lines = np.diff(first), np.diff(line_first)
    longest, distinct, line_distinct, top = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i, (a, b, c, d) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), line_first[:-1].tolist(), line_first[1:].tolist(), strict=True)):
        if b > a:
            longest[i] = length[a:b].max()
            _, counts = np.unique(h[a:b], return_counts=True)
            # Relative to what a text of this length has: a long text repeats more words.
            distinct[i], top[i] = np.log(len(counts)) / np.log(b - a + 1), counts.max() / (b - a)
        if d > c:
            line_distinct[i] = len(np.unique(lines[c:d])) / (d - c)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(n_lines), mean, sd, np.log1p(longest), np.log1p(line_mean), share["upper"], share["lower"], share["digit"], share["stop"], share["mark"], share["bar"],
        share["sign"], share["quote"], share["space"], total(data >= 0x80) / np.maximum(size, 1), distinct, line_distinct, sign_words, short, top,
    ])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    curve: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(cosines(stats, self.mean, self.sd) @ self.weights, self.at, self.curve)


def cosines(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng, d = np.random.default_rng(20240229), stats.shape[1]
    frequency, phase = rng.normal(size=(d, FREQUENCIES)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, FREQUENCIES)
    x = np.clip((stats - mean) / sd, -6, 6)
    return np.column_stack([np.sqrt(2 / FREQUENCIES) * np.cos(x @ frequency + phase), np.ones(len(x))])


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pooled blocks' mean place and share of ones, in ascending order."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at.tolist(), ones.tolist(), n.tolist(), strict=True):
        blocks.append([x * w, y, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return utf8_column(batch.column(0))[0].view(np.float64).reshape(-1, len(STATISTICS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs with the statistics of each whole text (column STATS: doubles, little-endian)."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(at))
            for i, j in row_chunks(off, 1 << 20):
                found = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array([row.tobytes() for row in found], pa.binary())], names=[*names, STATS])

    return docs.mapInArrow(lean(run), docs.select("*", F.lit(b"").alias(STATS)).schema)


def train(stats: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """Fit on all rows of stats (doc_id, STATS) with a label."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("double").alias("label"))
    rows = written(stats.select(F.col("doc_id").cast("long").alias("doc_id"), STATS).join(named.hint("merge"), "doc_id").select(STATS, "label"), "op9-labelled")
    d, n = len(STATISTICS), FREQUENCIES + 1

    def summed(part):
        """Per task, the sums of part's matrices over its batches, as rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    more = part(_stats_of(batch), batch.column(1).to_numpy())
                    out = more if out is None else out + more
            if out is not None:
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(out)), pa.int32()), "v": pa.array([v.tobytes() for v in out], pa.binary())})

        return rows.mapInArrow(lean(run), "k int, v binary")

    moments = added(summed(lambda x, y: np.vstack([np.full(d, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0), np.full(d, y.sum())])), 4)
    if moments.shape[1] != d or not 0 < moments[3, 0] < moments[0, 0]:
        share = moments[3, 0] / moments[0, 0] if moments.shape[1] == d else 0.5
        return Model(np.zeros(d), np.ones(d), np.zeros(n), np.array([0.0]), np.array([share]))
    mean = moments[1] / moments[0]
    sd = np.maximum(np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0)), 1e-6)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = cosines(x, mean, sd)
        return np.column_stack([z.T @ z, z.T @ y])

    equations = added(summed(normal), n)
    weights = np.linalg.solve(equations[:, :n] + RIDGE * np.eye(n), equations[:, n])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((cosines(_stats_of(batch), mean, sd) @ weights - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(at), "label": batch.column(1)})

    bins = rows.mapInArrow(lean(binned), "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect()  # at most BINS rows
    at, curve = isotonic(_LOW + (np.array([r["bin"] for r in bins]) + 0.5) * (_HIGH - _LOW) / BINS, np.array([r["ones"] for r in bins]), np.array([r["n"] for r in bins]))
    return Model(mean, sd, weights, at, curve)


def score_statistics(stats: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """stats with a score, in a column of that name, instead of the column STATS."""
    names = [x for x in stats.columns if x != STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(_stats_of(batch)))], names=[*names, name])

    return stats.select(STATS, *names).mapInArrow(lean(run), stats.select(*names, F.lit(0.0).alias(name)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for every row of docs."""
    stats = written(document_statistics(docs.select("doc_id", "text")).select("doc_id", STATS), "op9-statistics")
    return score_statistics(stats, train(stats, labels))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_low_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least THRESHOLD, with their columns."""
    stats = written(document_statistics(docs), "op9-statistics")
    return score_statistics(stats, train(stats, labels), _SCORE).where(F.col(_SCORE) >= THRESHOLD).select(*docs.columns)


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE: dict[str, str] = {}
