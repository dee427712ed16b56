"""Block-max postings against the plain full-text search."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import blockmax, search
from docloom.operators.storage import scratch


def corpus(spark, n=1500, seed=3):
    """Frequent words everywhere, rarer ones in a few documents, repeated texts and lengths."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    rows = [(f"c{k:05d}", " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for k in range(n)]
    rows += [(f"d{k:03d}", "w0 w0 w1 same text w300") for k in range(50)] + [("e", None), ("f", "")]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(4)


def questions(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{min(399, int(rng.expovariate(1 / 60)))}" for _ in range(rng.randint(1, 8)))) for k in range(60)]
    return spark.createDataFrame([*rows, (100, "w0"), (101, "w0 w1 w2 w3 w399"), (102, "nothing here"), (103, ""), (104, None), (105, "w5 w5 w300")], "qid long, query string")


@pytest.mark.parametrize("top", [1, 10])
def test_equals_the_plain_search(spark, monkeypatch, top):
    monkeypatch.setattr(blockmax, "POSTINGS", 8)
    monkeypatch.setattr(blockmax, "START", 12)
    chunks, asked = corpus(spark), questions(spark)
    root = scratch(spark, "postings")
    index = blockmax.build(chunks.where("text is not null"), root)
    rows = lambda df: {(r["qid"], r["chunk_id"], round(r["score"], 5), r["rank"]) for r in df.collect()}
    want = rows(search.bm25(chunks.where("text is not null"), asked, top))
    assert rows(blockmax.bm25(index, asked, top)) == want
    if top == 1:
        read = blockmax.blocks_read(blockmax.open_index(spark, root), asked, top).collect()
        assert all(r["read_blocks"] <= r["blocks"] for r in read)
        assert sum(r["read_postings"] for r in read) < 0.8 * sum(r["postings"] for r in read)


def test_blocks_hold_all_postings(spark):
    chunks = corpus(spark, 300).where("text is not null")
    index = blockmax.build(chunks)
    numbers = [r["doc"] for r in index.docs.orderBy("doc").collect()]
    assert numbers == list(range(chunks.count()))
    names = {r["doc"]: r["chunk_id"] for r in index.docs.collect()}
    found = set()
    for r in index.blocks.collect():
        doc = r["first"]
        for gap, tf in zip(r["gaps"], r["counts"], strict=True):
            doc += gap
            found.add((r["term"], names[doc], tf))
        assert len(r["gaps"]) == r["n"] == len(r["lengths"])
    assert found == {(r["term"], r["chunk_id"], r["tf"]) for r in search.postings(chunks).collect()}


def test_nothing_to_find(spark):
    empty = blockmax.build(spark.createDataFrame([], "chunk_id string, text string"))
    assert blockmax.bm25(empty, questions(spark)).count() == 0
    index = blockmax.build(corpus(spark, 20).where("text is not null"))
    assert blockmax.bm25(index, questions(spark).where(F.lit(False))).count() == 0
