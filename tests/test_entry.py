import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 90


def test_entry_answers(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r["coverage_status"] for r in rows} <= {"no_answer", "thin", "grounded"}


def test_queries_without_the_training_operators(monkeypatch):
    def gone(name, *args):
        raise ModuleNotFoundError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    assert "bm25_topk" in __spark_entry__.queries() and not any(n.startswith("op1") for n in __spark_entry__.queries())
