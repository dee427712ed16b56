import pandas as pd
import pytest

from docloom.functions import hooks
from docloom.operators import answers


def test_embedding_batches(spark):
    rows = spark.createDataFrame([("a",), (None,)], "text string")
    got = sorted(r["vector"] for r in hooks.embed(rows, lambda ts: [[float(len(t))] for t in ts], prefix="q: ").collect())
    assert got == [[3.0], [4.0]]
    with pytest.raises(Exception, match="vectors for"):
        hooks.embed(rows, lambda ts: []).collect()


def test_extractors_in_turn(spark):
    def fails(content):
        raise RuntimeError("no")

    files = spark.createDataFrame([("f", bytearray(b"text"))], "path string, content binary")
    tried = hooks.extract(files, [("x", fails), ("y", lambda c: c.decode())]).orderBy("ord").collect()
    assert [(r["provider"], r["text"], r["error"]) for r in tried] == [("x", None, "no"), ("y", "text", None)]
    rows = spark.createDataFrame([("f", "x", 0, "failed"), ("f", "y", 1, "needs_ocr"), ("f", "z", 2, "high"), ("g", "x", 0, "needs_ocr")], "path string, provider string, ord int, status string")
    assert [tuple(r) for r in hooks.first_usable(rows).collect()] == [("f", "z", 3)]


def test_scorer_fails_open(spark):
    def scorer(query, texts):
        if query == "bad":
            raise RuntimeError
        return [float(len(t)) for t in texts]

    rows = spark.createDataFrame([(1, "ok", "a", "xyz"), (2, "bad", "b", "x")], "qid int, query string, chunk_id string, text string")
    assert [tuple(r) for r in hooks.score_pairs(rows, scorer).collect()] == [(1, "a", 3.0)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"key_facts": [{"content": "a"}]}\n```', ["a"]), ('Well: {"key_facts": [{"content": "a"},],} thanks', ["a"]), ('{"key_facts": [{"content": "a"}, {"content": "b', ["a", "b"]),
        ('{"key_facts": [{"content": "a, ]"}', ["a ]"]), ("no json", []), ("", []), (None, []), ('{"key_facts": [}', []),
    ],
)
def test_answers(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "qid int, answer string")
    assert [r["content"] for r in answers.facts(rows).orderBy("n").collect()] == want


def test_brackets():
    assert answers.close_brackets('{"a": [1, 2, {"b": "x') == '{"a": [1, 2, {"b": "x"}]}'
    assert pd.Series(['{"a": "]"}']).map(answers.close_brackets)[0] == '{"a": "]"}'
