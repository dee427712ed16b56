import hashlib
import shutil
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import assets, chunking, evaluate, evidence, layout, registry, search, storage, variants
from docloom.plans import inputs
from docloom.sources import assemble, files


def docs(spark, *texts, kind="text"):
    return spark.createDataFrame([(str(i), kind, x) for i, x in enumerate(texts)], "source_key string, source_type string, text string")


def test_sections_and_breadcrumbs(spark):
    text = "# Top\nintro\n## One\na\n# Late\nb\n## Two\nc"
    got = [(r["section"], r["text"], r["breadcrumb"]) for r in chunking.markdown_sections(docs(spark, text)).orderBy("section").collect()]
    assert got == [(0, "# Top\nintro", "# Top"), (1, "## One\na\n# Late\nb", "# Late > ## One"), (2, "## Two\nc", "# Late > ## Two")]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25, 100])
def test_windows_equal_a_loop(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = [r["chunk_index"] for r in chunking.chunk_documents(docs(spark, text), 10, 3).orderBy("chunk_index").collect()]
    want, start = [], 0
    while text:
        want.append(text[start : start + 10])
        if start + 10 >= n:
            break
        start += 7
    assert len(got) == len(want)
    rows = chunking.chunk_documents(docs(spark, text), 10, 3).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == want


def test_pdf_noise_leaves_dense_numbers(spark):
    rows = chunking.chunk_documents(docs(spark, "short\n\n" + "A real paragraph of enough characters.", kind="pdf")).collect()
    assert [(r["chunk_id"], r["text"][:6]) for r in rows] == [("0#0", "A real")]


def test_line_packing(spark):
    rows = spark.createDataFrame([("a", "H", i, "x" * 10) for i in range(5)], "source_key string, header string, ord int, line string")
    got = chunking.pack_lines(rows, 30).orderBy("part").collect()
    assert [r["text"].count("x" * 10) for r in got] == [2, 2, 1] and all(r["text"].startswith("H\n") for r in got)


def test_bm25_equals_sqlite(spark):
    corpus = ["the cat sat on the mat", "a dog and a cat", "dogs chase cats", "mat mat mat", "nothing here at all", "été on the beach"]
    connection = sqlite3.connect(":memory:")
    connection.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    connection.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(corpus)))
    want = {str(i): round(-s, 6) for i, s in connection.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH '\"cat\" OR \"mat\" OR \"ete\"'")}
    chunks = spark.createDataFrame([(str(i), x) for i, x in enumerate(corpus)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "Cat mat, ÉTÉ")], "qid int, query string")
    got = {r["chunk_id"]: r["score"] for r in search.bm25(chunks, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nearest_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=(50, 6))
    vectors = spark.createDataFrame([(f"{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)] + [("null", None)], "chunk_id string, vector array<double>")
    got = search.nearest(vectors, vectors.where("chunk_id < '003'").withColumnRenamed("chunk_id", "qid"), 5, block=2).orderBy("qid", "rank").collect()
    for q in range(3):
        want = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:5]
        assert [r["chunk_id"] for r in got if r["qid"] == f"{q:03d}"] == [f"{i:03d}" for i in want]


def test_fusion_order(spark):
    fts = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, chunk_id string, rank int")
    vec = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "d", 1000)], "qid int, chunk_id string, rank int")
    assert [r["chunk_id"] for r in search.fuse(fts, vec).orderBy("rank").collect()] == ["b", "a", "c", "d"]


def test_focus_pages_drop_the_rest(spark):
    page = "[ORG_CHART]\nPage: {}\nStructure:\n{}"
    hits = spark.createDataFrame([(1, "a", "s", "org_chart", page.format(1, "Anna Berg"), 1), (1, "b", "s", "org_chart", page.format(2, "Else"), 2), (1, "c", "s", "text", "x", 3), (1, "d", "t", "text", "y", 4)], "qid int, chunk_id string, source_name string, source_type string, text string, rank int")
    asked = spark.createDataFrame([(1, "who reports to Anna")], "qid int, query string")
    assert [r["chunk_id"] for r in search.focus_pages(hits, asked).orderBy("rank").collect()] == ["a", "c"]


def test_rerank_keeps_unscored_after_scored(spark):
    fused = spark.createDataFrame([(1, c, s, r) for r, (c, s) in enumerate(zip("abcd", (0.4, 0.3, 0.2, 0.1)), 1)], "qid int, chunk_id string, score double, rank int")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.5), (1, "d", 1.0)], "qid int, chunk_id string, score double")
    assert [r["chunk_id"] for r in search.rerank(fused, scores, 3).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_neighbours_are_capped_in_order_of_hits(spark):
    chunks = spark.createDataFrame([("s", i, f"s#{i}", "t") for i in range(30)], "source_key string, chunk_index int, chunk_id string, text string")
    hits = spark.createDataFrame([(1, f"s#{i}", "s", i, 1.0 / r, r) for r, i in enumerate((0, 10, 11, 20, 25), 1)], "qid int, chunk_id string, source_key string, chunk_index int, score double, rank int")
    got = {r["chunk_id"]: r["role"] for r in evidence.expand_neighbours(hits, chunks).collect()}
    added = {k: v for k, v in got.items() if v != "retrieved"}
    assert added == {"s#1": "context_after", "s#9": "context_before", "s#12": "context_after", "s#19": "context_before", "s#21": "context_after", "s#24": "context_before"}


def test_reservation_rules(spark):
    known = spark.createDataFrame([("h1", "indexed"), ("h2", "processing"), ("h3", "failed"), ("h4", "review_required")], "content_hash string, status string")
    came = spark.createDataFrame([("h1", 1), ("h2", 2), ("h3", 3), ("h4", 4), ("h5", 5), ("h5", 6), ("h3", 7)], "content_hash string, seq int")
    got = [r["outcome"] for r in registry.reserve(came, known).orderBy("seq").collect()]
    assert got == ["duplicate", "duplicate_pending", "reserved", "review_required", "reserved", "duplicate_pending", "duplicate_pending"]
    assert registry.reserve(came, known, F.lit(True)).where("seq = 4").collect()[0]["outcome"] == "reserved"


def test_batch_and_recovery(spark):
    uploads = spark.createDataFrame([("a", "ok", 2), ("a", "duplicate", 0), ("b", "ok", 1), ("b", "accepted", 0), ("c", "failed", 0)], "batch_id string, status string, chunks int")
    assert {r["batch_id"]: r["status"] for r in registry.batch_rollup(uploads).collect()} == {"a": "ok", "b": "accepted", "c": "partial"}
    tasks = spark.createDataFrame([("1", "queued", "x"), ("2", "processing", "y"), ("3", "completed", "x")], "task_id string, status string, raw_file_path string")
    files = spark.createDataFrame([("x",)], "raw_file_path string")
    assert {r["task_id"]: r["outcome"] for r in registry.recover_tasks(tasks, files).collect()} == {"1": "requeued", "2": "failed"}


def test_saving_twice_is_one_asset(spark):
    rows = spark.createDataFrame([("a1", "q", "x ", "2024-01-01"), ("a2", " q", "x", "2024-01-02"), ("a3", "q", "y", "2024-01-03")], "asset_id string, question string, answer string, at string").withColumn("created_at", F.to_timestamp("at"))
    stored = spark.createDataFrame([], "operation_key string, asset_id string")
    got = {r["asset_id"]: (r["kept_id"], r["outcome"]) for r in assets.save(rows, stored).collect()}
    assert got == {"a1": ("a1", "created"), "a2": ("a1", "idempotent_reuse"), "a3": ("a3", "created")}


def test_blocks_merge_in_pairs(spark):
    rows = [("s", 1, i, f"t{i}", 0.0, 14.0 * i, 50.0, 14.0 * i + 12, 10.0, 800.0) for i in range(5)]
    blocks = spark.createDataFrame(rows, "source_id string, page int, block_id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page_height double")
    assert [(r["line_1"], r["line_2"]) for r in layout.merge_blocks(blocks).orderBy("node").collect()] == [("t0", "t1"), ("t2", "t3"), ("t4", None)]


def test_hierarchy_and_projection(spark):
    rows = [("s", 1, 1, "Boss", None, 100.0, 0.0, 0), ("s", 1, 2, "Left", "role", 50.0, 50.0, 1), ("s", 1, 3, "Right", None, 150.0, 50.0, 1), ("s", 1, 4, "Far", None, 900.0, 100.0, 2)]
    nodes = spark.createDataFrame(rows, "source_id string, page int, node int, line_1 string, line_2 string, x_center double, y_center double, band int")
    edges = layout.hierarchy(nodes)
    assert sorted((r["parent"], r["child"]) for r in edges.collect()) == [(1, 2), (1, 3)]
    text = layout.projection_text(layout.paths(nodes, edges), spark.createDataFrame([("s", 1, "Plan")], "source_id string, page int, title string")).collect()[0]["text"]
    assert "- Field 1: Boss\n  - Field 1: Left (Field 2: role)\n  - Field 1: Right\n- Field 1: Far" in text
    assert "- Field 1: Right is structurally under Field 1: Boss." in text


def test_gate_and_acceptance(spark):
    hits = spark.createDataFrame([(1, r, "text", "a long enough passage about Alpha beta things") for r in range(1, 6)] + [(2, 1, "text", "short")], "qid int, rank int, source_type string, text string")
    cases = spark.createDataFrame([(1, "text", ["alphabeta"], ["text"]), (2, "text", [], None), (3, None, ["x"], None)], "qid int, top_type string, terms array<string>, types array<string>")
    assert {r["qid"]: r["passed"] for r in evaluate.quality_gate(cases, hits).collect()} == {1: True, 2: False, 3: False}
    lacks = evaluate.quality_gate(cases.withColumn("types", F.array(F.lit("text"), F.lit("org_chart"))), hits).where("qid = 1").collect()[0]
    assert (lacks["missing_types"], lacks["passed"]) == (1, False)


def test_paths_have_no_greatest_depth(spark):
    n = 150
    nodes = spark.createDataFrame([("s", 1, i, f"n{i}", None, 10.0, 10.0 * i, i) for i in range(n)] + [("s", 2, 7, "alone", None, 1.0, 1.0, 0)], "source_id string, page int, node int, line_1 string, line_2 string, x_center double, y_center double, band int")
    placed = layout.paths(nodes, layout.hierarchy(nodes))
    assert sorted((r["page"], r["node"], r["depth"], r["path"].count("/")) for r in placed.collect()) == [*((1, i, i, i) for i in range(n)), (2, 7, 0, 0)]
    whole = layout.projection_text(placed, spark.createDataFrame([], "source_id string, page int, title string"))
    parts = {(r["page"], r["part"]): r for r in layout.split_trees(placed, whole, 20).collect()}
    assert sorted(parts) == [(1, 0), (1, 1), (2, 0)] and parts[1, 1]["n_nodes"] == n - 1
    text = parts[1, 1]["text"]
    assert "Context Root: Field 1: n0 -> Field 1: n1\n" in text and "\n- n0 manages n1.\n- Field 1: n2 is structurally under Field 1: n1.\n" in text
    assert "Structure:\n- Field 1: n2\n  - Field 1: n3\n" in text


@pytest.mark.parametrize("seed", range(3))
def test_bands_and_layout_pages_equal_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("s", page, i, "x" * int(rng.integers(1, 50)), float(rng.integers(0, 600)), float(rng.integers(0, 120) * 3), 10.0) for page in range(6) for i in range(rng.integers(0, 40))]
    blocks = spark.createDataFrame([(*r[:6], r[4] + 60, r[5] + r[6], 10.0, 800.0) for r in rows], "source_id string, page int, block_id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, page_height double")
    got = {r["page"]: (r["short"], r["rows"], r["columns"], r["is_layout"]) for r in layout.layout_pages(blocks).collect()}
    for page in range(6):
        mine = [r for r in rows if r[1] == page]
        short = sorted((r[5] + 5, r[4] + 30, r[2]) for r in mine if len(r[3]) <= 32)
        bands = []
        for y, *_ in short:
            near = [b for b in bands if abs(y - sum(b) / len(b)) <= 10]
            (near[0] if near else bands.append([]) or bands[-1]).append(y)
        columns = {round(x / 80) for _, x, _ in short}
        crowded = len(short) >= 12 and len(short) >= 0.65 * len(mine) and len(bands) >= 3 and len(columns) >= 3
        if mine:
            assert got[page] == (len(short), len(bands), len(columns), crowded)


@pytest.mark.parametrize("seed", range(3))
def test_line_packing_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{s}", page, "HEAD", i, "y" * int(rng.integers(0, 40))) for s in range(3) for page in range(2) for i in range(rng.integers(1, 30))]
    got = {}
    for r in chunking.pack_lines(spark.createDataFrame(rows, "source_key string, page int, header string, ord int, line string").repartition(3), 60).collect():
        got.setdefault((r["source_key"], r["page"]), {})[r["part"]] = r["text"]
    for key in {r[:2] for r in rows}:
        parts = [["HEAD"]]
        for *_, line in (r for r in rows if r[:2] == key):
            if len(parts[-1]) > 1 and len("\n".join([*parts[-1], line])) > 60:
                parts.append(["HEAD"])
            parts[-1].append(line)
        assert [got[key][k] for k in range(len(got[key]))] == ["\n".join(p) for p in parts]


def test_keywords_among_names(spark):
    scores = spark.createDataFrame([(1, f"c{i}", 1.0 / (i + 1)) for i in range(6)], "qid int, chunk_id string, score double")
    chunks = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(["Plan A.md", "plan b.md", None, "", "notes", "PLAN c"])], "chunk_id string, source_name string")
    words = spark.createDataFrame([(1, "PLAN"), (2, ""), (3, "zzz"), (4, ".md"), (5, None)], "kid int, keyword string")
    got = sorted((r["kid"], r["rank"], r["chunk_id"]) for r in search.keyword_hits(scores, chunks, words, 3).collect())
    assert got == [(1, 1, "c0"), (1, 2, "c1"), (1, 3, "c5"), (2, 1, "c0"), (2, 2, "c1"), (2, 3, "c3"), (4, 1, "c0"), (4, 2, "c1")]


def test_questions_without_hits_are_reported(spark):
    chunks = spark.createDataFrame([("s", i, f"s#{i}", "text") for i in range(4)], "source_key string, chunk_index int, chunk_id string, text string")
    expanded = spark.createDataFrame([(1, "s#0", "s", 0, 1.0, "retrieved"), (1, "s#2", "s", 2, 1.0, "context_after")], "qid int, chunk_id string, source_key string, chunk_index int, score double, role string")
    asked = spark.createDataFrame([(1,), (2,)], "qid int")
    assert {r["qid"]: (r["final_chunks"], r["continuity"]) for r in evidence.fidelity_report(asked, expanded, chunks).collect()} == {1: (2, "gapped"), 2: (0, "empty")}


def test_dossier_coverage(spark):
    hits = spark.createDataFrame([(1, 1, "a", 1, "s1", "pdf"), (1, 2, "a", 1, "s1", "pdf"), (1, 2, "b", 2, "s2", "text")], "qid int, variant_ord int, chunk_id string, rank int, source_name string, source_type string")
    variants = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "qid int, variant_ord int")
    got = {r["qid"]: (r["source_count"], r["chunk_count"], r["source_types"], r["low_evidence"]) for r in evidence.dossier_coverage(variants, hits).collect()}
    assert got == {1: (2, 2, {"pdf": 1, "text": 1}, False), 2: (0, 0, {}, True)}


def test_word_processor_blocks(spark):
    rows = [("d", 1, " First ", None), ("d", 2, None, [["a", "b|c"], ["d"]]), ("d", 3, "  ", None), ("d", 4, "Last", None), ("e", 1, None, []), ("f", 1, None, None)]
    got = assemble.from_paragraphs(spark.createDataFrame(rows, "source_id string, ord int, text string, rows array<array<string>>")).collect()
    assert [tuple(r) for r in got] == [("d", "First\n| a | b\\|c |\n| --- | --- |\n| d |  |\nLast", 2, 1, 2)]


def test_published_versions(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="nothing is published"):
        storage.published(spark, root, "chunks")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", None)], "chunk_id string, vector array<double>")
    assert storage.publish_index(chunks, search.postings(chunks), vectors, root) == 1
    held = storage.published(spark, root, "chunks")
    assert [r["chunk_id"] for r in held.collect()] == ["a"] and [tuple(r) for r in storage.published(spark, root, "quarantine").collect()] == [("b", "no vector")]
    # A version that isn't finished isn't seen: nothing points to it.
    chunks.write.parquet(f"{root}/versions/half/chunks")
    assert storage.published(spark, root, "chunks").count() == 1
    assert storage.publish_index(chunks, search.postings(chunks), vectors.fillna(0).withColumn("vector", F.array(F.lit(1.0))), root) == 2
    assert storage.published(spark, root, "chunks").count() == 2 and held.count() == 1


def test_text_files(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    docs = spark.createDataFrame([("a.txt", "x\ny\n"), ("b.md", "é"), ("c.txt", None)], "name string, text string")
    assert files.write_texts(docs, folder).count() == 3
    (tmp_path / "in" / "d.bin").write_bytes(b"zz")
    got = sorted((r["source_name"], r["source_type"], r["text"], r["characters"], r["line_count"]) for r in files.read_texts(spark, folder).collect())
    assert got == [("a.txt", "txt", "x\ny\n", 4, 2), ("b.md", "md", "é", 1, 1), ("c.txt", "txt", "", 0, got[2][4])] and got[2][4] in (0, 1)


def test_answers_saved_by_day(spark):
    root = storage.scratch(spark, "days")
    at = lambda day, n: F.expr(f"timestamp'2024-01-{day:02d} 10:00:00' + make_interval(0, 0, 0, 0, 0, {n}, 0)")
    rows = lambda *x: spark.createDataFrame([(i, q, "a", d) for i, q, d in x], "asset_id string, question string, answer string, d int").withColumn("created_at", F.make_timestamp(F.lit(2024), F.lit(1), F.col("d"), F.lit(10), F.lit(0), F.lit(0))).drop("d")
    found = lambda: sorted((r["asset_id"], str(r["day"])) for r in spark.read.parquet(f"{root}/assets").collect())
    batch = rows(("x1", "q1", 1), ("x2", "q1", 2), ("x3", "q2", 2), ("x4", None, 3))
    assert assets.save_by_day(batch, root).count() == 3
    want = [("x1", "2024-01-01"), ("x3", "2024-01-02"), ("x4", "2024-01-03")]
    assert found() == want
    assert assets.save_by_day(batch, root).count() == 0 and found() == want
    # A key that another day holds isn't written again; other rows of a touched day stay.
    assert assets.save_by_day(rows(("y1", "q1 ", 3), ("y2", "q3", 2), ("y3", "q4", 9)), root).count() == 2
    assert found() == sorted([*want, ("y2", "2024-01-02"), ("y3", "2024-01-09")])
    # A batch that failed between assets and keys is taken up again without copies.
    spark.read.parquet(f"{root}/keys").where("operation_key is null").write.mode("overwrite").parquet(f"{root}/none")
    shutil.rmtree(root.removeprefix("file://") + "/keys")
    assert assets.save_by_day(rows(("y2", "q3", 2)), root).count() == 1 and found() == sorted([*want, ("y2", "2024-01-02"), ("y3", "2024-01-09")])
    assert assets.save_by_day(rows(("z", "q", 1)).limit(0), root).count() == 0


def test_circles_of_edges_are_told(spark):
    nodes = spark.createDataFrame([("s", 1, k, 0, float(k), 0.0, f"n{k}", None) for k in range(40)], "source_id string, page int, node long, band int, x_center double, y_center double, line_1 string, line_2 string")
    chain = [("s", 1, k, k + 1) for k in range(39)]
    edges = lambda rows: spark.createDataFrame(rows, "source_id string, page int, parent long, child long")
    assert {r["node"]: r["depth"] for r in layout.paths(nodes, edges(chain)).collect()} == {k: k for k in range(40)}
    with pytest.raises(ValueError, match="circles"):
        layout.paths(nodes, edges([*chain, ("s", 1, 39, 0)]))


def test_rewritten_tables_get_a_new_index(spark, tmp_path):
    built = []
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for _ in range(2):
            made = inputs.maintained(spark, str(tmp_path), "numbers", lambda n=n: built.append(n) or spark.range(n))
            assert made.count() == n
    assert built == [3, 4]


def test_names_that_hold_keywords(spark):
    names = ["Report 2024.pdf", "report", "ÉTUDE de cas", "", "aab", "x" * 50, "日本語の報告", None, "a b", "AAB"]
    words = ["", "r", "RE", "rep", "2024", "étude", "aab", "b", "報告", "zzz", "xxxx", "e d", None, "report 2024.pdf and more"]
    got = search.holding(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(words)), "kid int, keyword string"))
    want = sorted({(n, k) for n in names if n is not None for k, w in enumerate(words) if w is not None and w.lower() in n.lower()})
    assert sorted((r["name"], r["kid"]) for r in got.collect()) == want


def test_long_names_are_sought_in_linear_time(spark):
    long = spark.range(3).select(F.concat(F.repeat(F.concat(F.lit("section-"), F.col("id").cast("string"), F.lit(" ")), 10_000), F.lit("needle")).alias("name"))
    found = search.holding(long, spark.createDataFrame([(1, "needle"), (2, "on-2 sec"), (3, "nowhere")], "kid int, keyword string")).groupBy("kid").count().collect()
    assert {r["kid"]: r["count"] for r in found} == {1: 3, 2: 1}


def test_sketches_of_parts_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("source_key"), F.when(F.col("id") % 3 == 0, "pdf").otherwise("text").alias("source_type"), (F.col("id") % 7).alias("day"))
    found = {r["source_type"]: r for r in registry.merged_stats(registry.stat_sketches(rows, ["day"])).collect()}
    for r in registry.corpus_stats(rows).collect():
        assert abs(found[r["source_type"]]["sources"] - r["sources"]) <= 0.02 * r["sources"] and found[r["source_type"]]["chunks"] == r["chunks"]


def test_variants_keep_unknown_keys(spark):
    texts = ['{"b": 1, "a": {"x": [1, 2]}, "n": "5", "new": null}', "no json", None, "[1]", "{}"]
    rows = variants.parsed(spark.createDataFrame([(t,) for t in texts], "json string"), "json")
    got = [tuple(r) for r in rows.select(*variants.typed(F.col("meta"), {"b": ("$.b", "int"), "x": ("$.a.x[1]", "bigint"), "n": ("$.n", "int"), "a": ("$.a", "int")}), variants.encoded(F.col("meta"))).collect()]
    assert got[0] == (1, 2, 5, None, '{"a":{"x":[1,2]},"b":1,"n":"5","new":null}')
    assert [g[4] for g in got[1:]] == [None, None, "[1]", "{}"]
    assert sorted(r["key"] for r in variants.entries(rows).collect()) == ["a", "b", "n", "new"]


def test_trees_and_bands_bring_a_page_together_once(spark):
    n = 600
    nodes = spark.range(n).select(F.lit("s").alias("source_id"), F.lit(1).alias("page"), F.col("id").alias("node"), F.lit("x").alias("line_1"), F.lit(None).cast("string").alias("line_2"), F.lit(1.0).alias("x_center"), (F.col("id") * 30.0).alias("y_center"), F.col("id").cast("int").alias("band"))
    trees = layout.forest(nodes, layout.hierarchy(nodes))
    plan = layout.projection_text(trees, spark.createDataFrame([], "source_id string, page int, title string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no second gathering of nodes
    assert [r["depth"] for r in trees.collect()[0]["rows"]] == list(range(n))
    assert "path" not in trees.schema.simpleString()  # paths are as long as trees are deep
    banded = layout.bands(nodes.drop("band"))
    assert "FlatMapGroups" not in banded._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["node"], r["band"]) for r in banded.collect()) == [(k, k) for k in range(n)]


def test_best_scores_are_those_of_all_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 12) % 40), f"s{i % 4}" if i % 9 else None) for i in range(700)]
    rows += [(f"d{i}", "w1 w2 w3", "s1") for i in range(80)]  # equal scores
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, source_name string").repartition(3)
    asked = spark.createDataFrame([((i, i % 2), f"w{i} w{i + 1} w1 w1 none") for i in range(12)], "qid struct<a:int,b:int>, query string")
    tokens = search.token_rows(chunks, "source_name").cache()
    scores = search.bm25_scores(tokens, asked).cache()
    rows_of = lambda df: sorted((tuple(r["qid"]), r["chunk_id"], r["score"], r["rank"]) for r in df.collect())
    want = search.ranked(scores, F.desc("score"), F.col("chunk_id"), top=7)
    assert rows_of(search.bm25(tokens, asked, 7)) == rows_of(want)
    # Each partition sends its best alone.
    assert search.best_scores(tokens, asked, 2).count() <= 12 * 2 * tokens.rdd.getNumPartitions() < scores.count()
    words = spark.createDataFrame([(1, "S"), (2, "s1"), (3, "s9")], "kid int, keyword string")
    hits = lambda s: sorted((tuple(r["qid"]), r["kid"], r["chunk_id"], r["rank"]) for r in search.keyword_hits(s, chunks, words, 3).collect())
    assert hits(search.best_scores(tokens, asked, 3, "source_name")) == hits(scores)
    assert search.bm25(tokens, asked.limit(0)).count() == 0
    few = search.with_chunks(search.bm25(tokens, asked, 1), chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in few


def test_entities_end_where_letters_do(spark):
    rows = spark.createDataFrame([(1, "Interview über SSö und äAB"), (2, "Interview at ABC"), (3, "Projectö XYö and Nö")], "qid int, question string")
    got = {r["qid"]: r["query"] for r in evidence.expand_queries(rows).where("variant_ord = 2").collect()}
    assert got == {1: "Interview 面试", 2: "ABC 面试"}


def test_sketches_are_told_exactly(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("source_key"), F.lit("text").alias("source_type"), (F.col("id") % 3).alias("part"))
    hashes = sorted({int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) for i in range(200_000)})[: registry.SKETCH]
    got = registry.merged_stats(registry.stat_sketches(rows, ["part"])).collect()[0]
    assert got["sources"] == int((registry.SKETCH - 1) * 2.0**52 / (hashes[-1] + 1)) and abs(got["sources"] - 200_000) < 2_000


def test_saving_many_days_writes_few_files(spark):
    root = storage.scratch(spark, "many-days")
    batch = spark.range(400).select(F.concat(F.lit("x"), "id").alias("asset_id"), F.concat(F.lit("q"), "id").alias("question"), F.timestamp_seconds(F.col("id") * 86400).alias("created_at"))
    assert assets.save_by_day(batch, root).count() == 400
    saved = spark.read.parquet(f"{root}/assets")
    assert len(saved.inputFiles()) <= assets.BUCKETS and saved.select("day").distinct().count() == 400
    assert assets.save_by_day(batch, root).count() == 0 and spark.read.parquet(f"{root}/assets").count() == 400


def test_many_files_are_listed_at_once(spark, tmp_path):
    import time

    (tmp_path / "deep").mkdir()
    for i in range(2_000):
        (tmp_path / "deep" / f"{i}.txt").write_text("x" if i % 2 else "")
    (tmp_path / "e.MD").write_text("")
    for name in (".h.txt", "_h.txt", "h.bin", "txt"):
        (tmp_path / name).write_text("")
    began = time.time()
    found = files._empty_files(spark, str(tmp_path))
    assert time.time() - began < 5
    assert sorted(r["path"] for r in found.collect()) == sorted([f"file:{tmp_path}/e.MD", *(f"file:{tmp_path}/deep/{i}.txt" for i in range(0, 2_000, 2))])


def test_only_kept_chunks_are_split_into_postings(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 3} w1 w1") for i in range(9)], "chunk_id string, text string")
    vectors = chunks.where("chunk_id < 'c4'").select("chunk_id", F.array(F.lit(1.0)).alias("vector"))
    rows = lambda root: sorted(map(tuple, storage.published(spark, root, "postings").select("term", "chunk_id", "tf").collect()))
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    storage.publish_index(chunks, search.postings(chunks), vectors, a)
    storage.publish_index(chunks, search.token_rows(chunks), vectors, b)
    storage.publish_index(chunks, chunks, vectors, c)
    assert rows(a) == rows(b) == rows(c) and len({r[1] for r in rows(a)}) == 4


def test_documents_are_chunked_without_moving_texts(spark):
    rows = [(str(k), "text" if k % 3 else "pdf", f"first {k}\n\n \n\n{'word ' * 30}{k}\n\nlast") for k in range(40)]
    rows += [(str(k), "text", f"once more {k}\n\n{'other ' * 9}") for k in range(5)]
    rows += [(None, "text", "a\n\nb"), (None, "text", "c"), ("m", "text", "# T\nx\n## A\ny\n\nz"), ("n", "text", None), ("o", None, "tiny\n\n" + "long enough for a chunk of its own")]
    docs = spark.createDataFrame(rows, "source_key string, source_type string, text string")
    found = chunking.chunk_documents(docs, 50, 10)
    got = {}
    for r in found.collect():
        got.setdefault(r["source_key"], {})[r["chunk_index"]] = r["text"]
        assert r["chunk_id"] == "#".join(filter(None, [r["source_key"], str(r["chunk_index"])]))
    assert found.count() == sum(map(len, got.values()))  # repeated and missing keys are numbered through
    assert sorted(got["7"].items())[0] == (0, "first 7") and sorted(got["7"]) == list(range(len(got["7"])))
    assert set(got[None].values()) == {"a", "b", "c"} and sorted(got[None]) == [0, 1, 2]
    assert got["6"] and all(len(t.strip()) >= 30 for t in got["6"].values())
    assert list(got["o"].values()) == ["long enough for a chunk of its own"]
    assert "once more 4" in got["4"].values() and "first 4" in got["4"].values() and "n" not in got
    assert [got["m"][k] for k in sorted(got["m"])] == ["# T\nx", "## A\ny\n\nz"]
    # Of what is sorted or shuffled, nothing is a plain document's text.
    plan = chunking.chunk_documents(docs.where("length(source_key) = 2"), 50, 10)._jdf.queryExecution().executedPlan().toString()
    branch = plan.split("Generate posexplode(filter(flatten")
    assert len(branch) == 2 and "Exchange" not in branch[1].split("Scan")[0]


def test_the_best_scores_are_those_of_all_scores(spark):
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(words[(i * 7 + j * j) % 12] for j in range(3 + i % 9)) for i in range(300)]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string").coalesce(1)
    asked = spark.createDataFrame([(q, f"w{q % 12} w{q * 5 % 12} w{q % 12}") for q in range(30)] + [(99, "nowhere")], "qid long, query string")
    order = lambda rows: search.ranked(rows, F.desc("score"), F.col("chunk_id"), top=4)
    want = sorted(map(tuple, order(search.bm25_scores(chunks, asked)).select("qid", "chunk_id", "score", "rank").collect()))
    kept = search.CELLS, search.BATCH
    try:
        for search.CELLS, search.BATCH in ((1 << 21, 2_000), (100, 7), (31, 2)):
            best = search.best_scores(chunks, asked, 4)
            assert sorted(map(tuple, order(best).select("qid", "chunk_id", "score", "rank").collect())) == want
    finally:
        search.CELLS, search.BATCH = kept


def test_files_are_no_state_of_the_driver(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    docs = spark.range(3_000).select(F.concat("id", F.lit(".txt")).alias("name"), F.concat(F.lit("x"), "id").alias("text"))
    paths = [r["path"] for r in files.write_texts(docs, folder).collect()]
    rows = files.read_texts(spark, folder)
    # No scan's driver holds the files, tasks read many, and no folder has them all.
    assert len(rows.inputFiles()) < 100 and rows.rdd.getNumPartitions() < 50
    assert sorted((r["path"], r["text"]) for r in rows.collect()) == sorted(("file:" + p.removeprefix("file://"), "x" + p.rsplit("/", 1)[1][:-4]) for p in paths)
    assert len(set(paths)) == 3_000 and max(len(list(p.iterdir())) for p in (tmp_path / "in").iterdir()) < 50


def test_files_of_odd_names_and_places(spark, tmp_path):
    want = {"a b.txt": "x", "50%.md": "ä", "p%20q.txt": "", "a[1].MD": "z", "deep/er/x?.txt": "y" * 100, "deep/e.txt": "", "k=1/v.txt": "v", "_k=2.txt": "w", "deep/_k=3/u.md": "u"}
    for name in [*want, ".h.txt", "_h.txt", "h.bin", "txt", "t.txt._COPYING_", "_tmp/n.txt", "_tmp/empty.txt", "deep/.git/n.md", "deep/.git/empty.md", "no/text.bin"]:
        (tmp_path / "in dir" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in dir" / name).write_text(want.get(name, "" if "empty" in name else "n"))
    (tmp_path / "linked").mkdir()
    (tmp_path / "linked" / "l.txt").write_text("l")
    (tmp_path / "in dir" / "link").symlink_to(tmp_path / "linked")
    (tmp_path / "in dir" / "gone.txt").symlink_to(tmp_path / "nowhere")
    want["link/l.txt"] = "l"
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.odd.link./in", f"file://{tmp_path}/in%20dir")
    kept = files.BATCH_BYTES, files.LIST_NAMES, files.SCAN_FILES
    try:
        # At once and in small batches; by Arrow, and by Java where Arrow can't open the folder.
        for files.BATCH_BYTES, files.LIST_NAMES, files.SCAN_FILES in (kept, (60, 2, 2)):
            for folder, start in ((f"{tmp_path}/in dir", f"file:{tmp_path}/in dir"), (f"file://{tmp_path}/in dir/", f"file:{tmp_path}/in dir"), ("viewfs://odd/in", "viewfs://odd/in")):
                got = [(r["path"], r["text"]) for r in files.read_texts(spark, folder).collect()]
                assert sorted(got) == sorted((f"{start}/{name}", text) for name, text in want.items())
    finally:
        files.BATCH_BYTES, files.LIST_NAMES, files.SCAN_FILES = kept
    assert [(r["path"], r["text"]) for r in files.read_texts(spark, f"{tmp_path}/in dir/a b.txt").collect()] == [(f"file:{tmp_path}/in dir/a b.txt", "x")]
    (tmp_path / "none").mkdir()
    assert files.read_texts(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_texts(spark, f"{tmp_path}/nowhere")
