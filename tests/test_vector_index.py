"""The stored vector index against brute force."""

import numpy as np
import pytest

from docloom.operators import search, vector_index
from docloom.operators.storage import scratch


def brute(rows, queries, top):
    out = set()
    width = max(map(len, (v for _, v in rows if v)), default=0)
    kept = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
    for q, v in queries:
        if v is None or len(v) != width or not np.isfinite(v).all():
            continue
        found = sorted((round(float(((x - np.array(v)) ** 2).sum()), 6), i) for i, x in kept)[:top]
        out |= {(q, i, n) for n, (_, i) in enumerate(found, 1)}
    return out


def check(spark, rows, queries, top=5, root=None):
    frame = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "qid long, vector array<double>")
    index = vector_index.build(frame, root)
    got = {(r["qid"], r["chunk_id"], r["rank"]) for r in search.nearest(index, asked, top).collect()}
    assert got == brute(rows, queries, top)
    return index, asked


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "CHUNK", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    rows = [(f"c{k:05d}", [float(x) for x in centres[k % 30] + spread * rng.normal(size=12)]) for k in range(3000)]
    rows += [(f"same{k:04d}", rows[7][1]) for k in range(1500)]  # a hot list, ties by id
    queries = [(k, [float(x) for x in centres[k % 30] + spread * rng.normal(size=12)]) for k in range(120)] + [(500, rows[7][1])]
    root = scratch(spark, "index")
    index, asked = check(spark, rows, queries, 10, root)
    again = vector_index.open_index(spark, root)
    assert search.nearest(again, asked, 10).count() == search.nearest(index, asked, 10).count() == 1210
    met = vector_index.probed_lists(index, asked, 10).collect()
    assert len(met) == 121 and all(r["met"] <= r["lists"] for r in met)
    if spread < 1:
        assert np.mean([r["met"] / r["lists"] for r in met]) < 0.2


def test_odd_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 1.0]), ("e", [1.0, 2.0]), ("f", [0.0, 0.0]), ("g", [1e8, -1e8])]
    queries = [(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [float("inf"), 0.0]), (5, [1e8, -1e8])]
    check(spark, rows, queries, 3)
    check(spark, rows, queries, 50)
    assert search.nearest(spark.createDataFrame([("b", None)], "chunk_id string, vector array<float>"), spark.createDataFrame(queries, "qid long, vector array<double>")).count() == 0


def test_many_queries_stay_off_the_driver(spark):
    vectors = spark.range(500).selectExpr("cast(id as string) as chunk_id", "array(double(id % 25), double(id div 25)) as vector")
    queries = spark.range(20000).selectExpr("id as qid", "array(double(id % 25) + 0.1, double(id % 20) + 0.2) as vector")
    found = search.nearest(vectors, queries, 1)
    assert found.count() == 20000
    assert found.where("cast(chunk_id as long) % 25 = qid % 25 and cast(cast(chunk_id as long) / 25 as int) = qid % 20").count() == 20000
