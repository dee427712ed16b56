"""Where a user's own functions come in: embedders, text extractors, rerankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], column: str = "text", prefix: str = "") -> DataFrame:
    """rows with a vector of each text by batches; prefix is for queries. Errors of the embedder fail the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = embedder([prefix + (t or "") for t in frame[column]]) if len(frame) else []
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} vectors for {len(frame)} texts")
            yield frame.assign(vector=[[float(x) for x in v] for v in found])

    return rows.mapInPandas(run, rows.select("*", F.array(F.lit(0.0)).alias("vector")).schema)


def extract(files: DataFrame, extractors: list[tuple[str, Callable[[bytes], str]]]) -> DataFrame:
    """Every extractor's text of files (path, content): path, provider, ord, text, error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for n, (name, function) in enumerate(extractors):
                    try:
                        rows.append((path, name, n, function(content), None))
                    except Exception as e:  # noqa: BLE001 - a provider's failure is recorded, the next one's text may serve
                        rows.append((path, name, n, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "provider", "ord", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, provider string, ord int, text string, error string")


def first_usable(attempts: DataFrame) -> DataFrame:
    """The first attempt of each path (path, provider, ord, status) that isn't needs_ocr, failed or unavailable, and how many came before."""
    usable = ~F.col("status").isin("needs_ocr", "failed", "unavailable")
    order = Window.partitionBy("path").orderBy("ord")
    rows = attempts.withColumn("tried", F.row_number().over(order)).where(usable)
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("path", "provider", "tried")


def score_pairs(candidates: DataFrame, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """Scores (qid, chunk_id, score) of candidates (qid, query, chunk_id, text); a question whose scorer fails gets none."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            scores = scorer(frame["query"].iloc[0], frame["text"].tolist())
        except Exception:  # noqa: BLE001 - without scores the ranking stays as it is
            scores = []
        frame = frame.iloc[: len(scores)]
        return frame[["qid", "chunk_id"]].assign(score=[float(s) for s in scores[: len(frame)]])

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")
