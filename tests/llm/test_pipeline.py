"""The stages of corpus_pipeline against brute force and planted cases."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_contamination, check_pieces, clashing, components_of_texts, empty, texts_by_id

WORDS = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li", "su") for b in ("n", "st", "lo", "v") for c in ("a", "er", "is", "")]
PHRASE = "this very passage of the benchmark has well over ten words in it for sure"


def planted(spark, folder):
    rng = np.random.default_rng(21)
    docs, marks, kinds = [], [], {}

    def add(kind, text):
        i = len(docs)
        docs.append((i, text, "en", "s", len(text)))
        marks.append((i, int(kind != "bad"), int(kind == "toxic")))
        kinds[i] = kind
        return i

    for i in range(300):
        words = list(rng.choice(WORDS, rng.integers(60, 200)))
        if i % 9 == 0:
            for _ in range(5):
                words[rng.integers(len(words))] = f"grobix{rng.choice(WORDS)}"
            add("toxic", " ".join(words))
        elif i % 7 == 0:
            add("bad", " ".join(w + "%%%" for w in words))
        elif i % 11 == 0:
            add("leak", " ".join([*words[:20], PHRASE, *words[20:]]))
        else:
            add("clean", " ".join(words))
            if i % 13 == 0:
                words[3] = "changed"
                add("copy", " ".join(words))
                add("copy", docs[-1][1])
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return frame, kinds


def test_pipeline(spark, tmp_path):
    docs, kinds = planted(spark, tmp_path)
    gone, rows = {"toxicity": "toxic", "quality": "bad", "near duplicates": "copy", "decontamination": "leak"}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, str(tmp_path))
        assert kept.columns == docs.columns
        before, after = ({r["doc_id"] for r in x.collect()} for x in (rows, kept))
        lost = before - after
        assert {i for i in before if kinds[i] == gone[name]} == lost, name
        rows = spark.createDataFrame(kept.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    used, least = check_pieces(packed, texts_by_id(rows))
    assert used <= least + 1
    assert sorted((r["doc_id"], r["piece"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["piece"]) for r in packed)


def test_stages_on_the_given_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d for (d, _), (n, c) in zip(rows, components_of_texts(rows, corpus_pipeline.SIMILAR), strict=True) if not n or c == d}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, sf_dir).collect()} == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, t in rows if not brute_contamination(t, items)[1]}
    assert {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()} == clean


def test_stages_take_odd_rows(spark):
    sf_dir, schema = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i % 5003}" for i in range(40_000))
    odd = [(None, None, None, None, None)] * 2 + [(10**9, "", "x", None, 0), (10**9 + 1, " \n ", "x", None, 0), (10**9 + 2, long, "en", "s", 1), (10**9 + 3, long, "en", "s", 2), (None, long, "en", "s", 1)]
    # Columns that clash with names that stages use.
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).unionByName(spark.createDataFrame(odd, schema))).withColumns({"hit_id": F.lit(1), "component_id": F.lit(2), "label": F.lit(3), "quality": F.lit(0)})
    rows = lambda df: Counter(map(str, df.collect()))
    given = rows(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, empty(docs), sf_dir).count() == 0, name
        if name == "packing":
            assert sorted(str(r["doc_id"]) for r in out.where("piece = 0").collect()) == sorted(str(r["doc_id"]) for r in docs.collect())
            continue
        kept[name] = rows(out)
        assert out.columns == docs.columns and not kept[name] - given, name
    none, blank = ([x for x in given if x.startswith(f"Row(doc_id={i}, text={t}")] for i, t in ((None, None), (10**9, "''")))
    # Rows without words are no leaks and no copies of each other; equal rows are one after near duplicates.
    assert kept["decontamination"][none[0]] == 2 and kept["decontamination"][blank[0]] == 1
    assert kept["near duplicates"][none[0]] == 1 and kept["near duplicates"][blank[0]] == 1
    # Of equal long texts the row with the smallest id stays.
    assert [k.split(",")[0] for k in kept["near duplicates"] if "w4999 w5000" in k] == [f"Row(doc_id={10**9 + 2}"]


def test_stages_decide_by_row(spark, tmp_path):
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(WORDS, 80)) for _ in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], schema)
    found = lambda kept: sorted((str(r["doc_id"]), r["text"], r["source"]) for r in kept.collect())
    clean = [(None, plain[0], "a"), (None, plain[1], "a"), (7, plain[2], "a"), (8, plain[3], "a")]
    hit = [(None, f"{plain[4]} {PHRASE}", "a"), (7, f"{plain[5]} {PHRASE}", "a")]
    assert found(corpus_pipeline.decontamination(spark, frame(clean + hit), str(tmp_path))) == sorted((str(i), t, s) for i, t, s in clean)
    near = lambda t: t + " changed"
    kept = [(1, plain[6], "a"), (None, plain[7], "a"), (2, plain[8], "a"), (2, plain[9], "a"), (3, plain[10], "a"), (0, near(plain[11]), "a")]
    copies = [(None, near(plain[6]), "a"), (2, near(plain[10]), "a"), (5, plain[8], "b"), (1, plain[6], "a"), (9, plain[11], "a")]
    # The key of a null must not depend on its column alone: these two differ in where the null is.
    odd = spark.createDataFrame([(50, "same words here", None, "x", 1), (51, "other words there", "x", None, 1)], schema)
    got = corpus_pipeline.near_duplicate(spark, frame(kept + copies).unionByName(odd), str(tmp_path))
    want = [*((str(i), t, s) for i, t, s in kept if (i, t) != (3, plain[10])), ("2", near(plain[10]), "a")]
    assert [x for x in found(got.where("doc_id is null or doc_id < 50"))] == sorted(want)
    assert got.where("doc_id >= 50").count() == 2
    keys = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string")
    assert keys.select(corpus_pipeline.row_key(keys)).distinct().count() == 2


def test_stages_pass_columns_of_any_name_and_type(spark, tmp_path):
    """Names that stages use themselves, dots, back quotes, and types that can't be compared or hashed."""
    docs, kinds = planted(spark, tmp_path)
    odd = {"__row_key": F.lit(7), "row_key": F.lit(8), "a.b": F.col("doc_id") * 2, "back`quote": F.lit("x"), "a map": F.create_map(F.lit("k"), F.col("doc_id")), "__toxicity_score": F.lit("s"), "__quality_score": F.lit(1.5), "__quality_stats": F.array(F.lit(1)), "c0": F.lit(True), "score": F.lit(None).cast("double"), "TEXT ": F.lit("t"), "group": F.struct(F.lit(1).alias("first"))}
    wide = docs.select("*", *(v.alias(k) for k, v in odd.items())).unionByName(docs.where("doc_id < 3").select("*", *(v.alias(k) for k, v in odd.items())))
    values = lambda df: Counter(str(tuple(r)) for r in df.collect())
    given, rows = values(wide), wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = {r["doc_id"] for r in stage(spark, rows.select(docs.columns), str(tmp_path)).collect()}
        kept = stage(spark, rows, str(tmp_path))
        assert kept.columns == wide.columns and kept.schema.simpleString() == wide.schema.simpleString(), name
        found = values(kept)
        assert not found - given and {r[0] for r in kept.collect()} == want, name
        assert max(found.values()) == (1 if name in ("near duplicates", "decontamination") else 2)
        rows = spark.createDataFrame(kept.collect(), wide.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() >= rows.count()


def test_row_keys_have_128_bits(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), (None, "null"), ("null", None), ("a", "b")], "x string, y string")
    keys = [bytes(r[0]) for r in rows.select(corpus_pipeline.row_key(rows)).collect()]
    assert {len(k) for k in keys} == {16} and len(set(keys)) == 4
