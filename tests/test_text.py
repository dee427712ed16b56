import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import questions as q
from docloom.functions import text as t
from docloom.operators import quality


def value(spark, column, **names):
    return spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} string" for k in names)).select(column.alias("v")).collect()[0]["v"]


def test_page_and_watermark_lines(spark):
    for line, want in (("12", True), ("Page 7", True), ("第 3 页", True), ("- 4 -", True), ("12345", False), ("Page seven", False)):
        assert value(spark, t.is_page_line(F.col("x")), x=line) is want
    assert value(spark, t.is_watermark_line(F.col("x")), x="Strictly CONFIDENTIAL copy")
    assert not value(spark, t.is_watermark_line(F.col("x")), x="plain")


def test_lines_and_hash(spark):
    assert value(spark, t.lines(F.col("x")), x="a\r\nb\rc\u0085d\n") == ["a", "b", "c", "d"]
    assert value(spark, t.lines(F.col("x")), x="") == []
    same = {value(spark, t.content_hash(F.col("x")), x=x) for x in ("a\r\nb ", " a\nb", "a\rb\n")}
    assert len(same) == 1


def test_headings_and_noise(spark):
    assert value(spark, t.joined_heading(F.col("x")), x="H O W  T O  R E A D") == "HOW TO READ".replace("TO", "T O")
    assert value(spark, t.joined_heading(F.col("x")), x="P L A N  first\nline") == "PLAN first line"
    assert value(spark, t.noise_label(F.col("x")), x="short") == "short"
    assert value(spark, t.noise_label(F.col("x")), x="1 . . . . . . . . . . . . . . . . . . 22") == "pure_dotted"
    assert value(spark, t.noise_label(F.col("x")), x="Intro ......................... 1\nNext ......................... 2") == "mixed_toc"


def test_spaced_letters(spark):
    for text, want in (("H O W T O R E A D this", "HOW TO READ this"), ("a b c", "a b c"), (None, ""), ("F i v e s x", "Fivesx"), ("see O R G A N I Z A T I O N C H A R T S, p. 1", "see ORGANIZATION CHARTS, p. 1")):
        assert spark.createDataFrame([(text,)], "x string").select(quality.join_spaced_letters(F.col("x")).alias("v")).collect()[0]["v"] == want


@pytest.mark.parametrize("seed", range(3))
def test_spaced_letters_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "B", "z", " ", " ", " ", "  ", "\n", ",", "1", "ab", "_", "H O W T O R E A D"]) for _ in range(rng.randrange(40))) for _ in range(300)]

    def scan(text):
        """Words apart by white space alone, letter by letter."""
        out, at = [], 0
        parts = re.split(r"([A-Za-z0-9_]+)", text)  # gap, word, gap, word, ..., gap
        while at < len(parts):
            end = at
            if at % 2 and len(parts[at]) == 1 and parts[at].isalpha():
                while end + 2 < len(parts) and parts[end + 1].isspace() and len(parts[end + 2]) == 1 and parts[end + 2].isalpha():
                    end += 2
            letters = "".join(parts[at : end + 1 : 2])
            out.append(quality.PHRASES.get(letters.upper(), letters) if end - at >= 8 else "".join(parts[at : end + 1]))
            at = end + 1
        return "".join(out)

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", quality.join_spaced_letters(F.col("x")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in rows} == {i: scan(x) for i, x in enumerate(texts)}


def test_metadata_round_trip(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "name string, n int").select(t.packed(n=F.col("n"), name=F.col("name")).alias("x"))
    back = rows.unionByName(spark.createDataFrame([("{broken",), (None,)], "x string")).select(t.unpacked(F.col("x"), "name string, n int").alias("s")).select("s.metadata.name", "s.metadata.n", "s.raw").collect()
    assert [tuple(r) for r in back] == [("a", 1, None), (None, 2, None), (None, None, "{broken"), (None, None, None)]


def test_questions(spark):
    assert tuple(value(spark, q.answer_mode(F.col("x"), F.lit("zh")), x="Make slides please")) == ("ppt_outline", "ppt_keyword")
    assert tuple(value(spark, q.resolved(F.col("x"), F.lit(None).cast("string")), x="继续 说")) == ("clarification_required", "")
    assert tuple(value(spark, q.resolved(F.col("x"), F.lit("计划 一")), x="下一步")) == ("resolved", "计划 一；追问：下一步")
    assert value(spark, q.anchor_terms(F.col("x")), x="The plan, the PLAN of x1 怎么办") == ["the", "plan", "of", "x1"]
    assert value(spark, q.is_relation_question(F.col("x")), x="Who reports to Anna?")
    assert not value(spark, q.is_relation_question(F.col("x")), x="How to read who reports to Anna")
    assert value(spark, q.under_anchors(F.col("x")), x="people under Anna Berg") == ["Anna", "Berg"]
    assert value(spark, q.is_no_answer(F.col("x")), x="目前 资料不足。")


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, ""), (2, "\u0000" * 5 + "ab"), (3, "x same line\n" * 60), (4, "-" * 30), (5, "Fine text of one line.")], "doc_id int, text string")
    got = {r["doc_id"]: r["reason"] for r in quality.text_quality(docs).collect()}
    assert got == {1: "empty", 2: "garbled", 3: "repeated", 4: "unreadable", 5: None}
