"""Queries over layout blocks and streams that the given tables make."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import content_hash, lines
from docloom.operators import layout
from docloom.operators.storage import scratch
from docloom.plans.inputs import table
from docloom.plans.text_queries import lines as lines_sql
from docloom.plans.text_queries import heading_sql, strip
from docloom.streaming import jobs


MAX_NODES = 8


def _blocks(spark, d):
    """The lines of a document as blocks of its page, four in a row."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("n", "line")).where("trim(line) <> ''")
    x0, y0 = ((F.col("n") % 4) * 120 + F.col("doc_id") % 7).cast("double"), (F.floor(F.col("n") / 4) * 30 + F.col("n") % 3).cast("double")
    return rows.select(
        F.lit("all").alias("source_id"), F.col("doc_id").alias("page"), F.col("n").alias("block_id"), F.col("line").alias("text"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 80).alias("x1"), (y0 + 12).alias("y1"), F.when(F.col("n") == 0, 18.0).otherwise(10.0).alias("font_size"), F.lit(800.0).alias("page_height"),
    )


def _nodes(spark, d):
    """Blocks as nodes with the rows they were put in as bands."""
    return _blocks(spark, d).select("source_id", "page", F.col("block_id").alias("node"), F.col("text").alias("line_1"), F.lit(None).cast("string").alias("line_2"), ((F.col("x0") + F.col("x1")) / 2).alias("x_center"), ((F.col("y0") + F.col("y1")) / 2).alias("y_center"), F.floor(F.col("block_id") / 4).cast("int").alias("band"))


def layout_titles(spark, d):
    return layout.titles(_blocks(spark, d)).select("page", "block_id", "title")


def layout_merge(spark, d):
    """Lines below each other at the distance of a line, so that they join in pairs."""
    rows = _blocks(spark, d).withColumns({"x0": F.lit(10.0), "x1": F.lit(90.0), "y0": F.col("block_id") * 15.0 + F.floor(F.col("block_id") / 5) * 40.0}).withColumn("y1", F.col("y0") + 12.0)
    return layout.merge_blocks(rows).select("page", F.col("node").alias("node"), "line_1", "line_2", "y_center")


def layout_bands(spark, d):
    return layout.bands(_nodes(spark, d).select("source_id", "page", "node", "x_center", "y_center")).groupBy("page").agg(F.count_distinct("band").alias("bands"), F.count("*").alias("nodes"))


def layout_hierarchy(spark, d):
    return layout.hierarchy(_nodes(spark, d)).select("page", "parent", "child")


def layout_projection(spark, d):
    nodes = _nodes(spark, d)
    return layout.projection_text(layout.forest(nodes, layout.hierarchy(nodes)), layout.titles(_blocks(spark, d)).select("source_id", "page", "title")).drop("n_nodes")


def layout_subtrees(spark, d):
    """Projections, and of trees beyond MAX_NODES those of their large subtrees."""
    nodes = _nodes(spark, d)
    placed = layout.forest(nodes, layout.hierarchy(nodes))
    whole = layout.projection_text(placed, layout.titles(_blocks(spark, d)).select("source_id", "page", "title"))
    return layout.split_trees(placed, whole, MAX_NODES).select("page", "part", F.col("n_nodes").cast("long").alias("n_nodes"), F.md5("text").alias("text_hash"))


def layout_page_test(spark, d):
    return layout.layout_pages(layout.clean_blocks(_blocks(spark, d))).select("page", "is_layout", "short", "rows", "columns")


def ocr_projection(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("page"), F.concat(F.lit("• Org  Chart\n"), "text").alias("text"))
    return layout.ocr_projection(rows).select("page", "projection")


def stream_ingest(spark, d):
    at = scratch(spark, "stream")
    rows = jobs.read(spark, f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_key"), F.lit("text").alias("source_type"), "text")
    jobs.ingest(rows, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out/chunks").groupBy("source_key").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


def stream_task_state(spark, d):
    at = scratch(spark, "stream")
    events = jobs.read(spark, f"{d}/events.parquet")
    shaped = events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    jobs.task_states(shaped, f"{at}/out", f"{at}/checkpoint")
    return jobs.read_task_states(spark, f"{at}/out").select("task_id", "status", "ts")


def stream_content_states(spark, d):
    """Every document is uploaded twice with the outcome of the first in between."""
    at = scratch(spark, "stream")
    docs = jobs.read(spark, f"{d}/documents.parquet").select(content_hash(F.col("text")).alias("content_hash"), "doc_id")
    kinds = F.array(F.lit("upload"), F.when(F.col("doc_id") % 3 == 0, "failed").when(F.col("doc_id") % 3 == 1, "indexed").otherwise("review_required"), F.lit("upload"))
    events = docs.select("content_hash", "doc_id", F.posexplode(kinds).alias("k", "kind")).select("content_hash", (F.col("doc_id") * 3 + F.col("k")).alias("seq"), "kind")
    jobs.content_states(events).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string, seq long, outcome string").parquet(f"{at}/out").select("seq", "outcome")


def stream_first_uploads(spark, d):
    at = scratch(spark, "stream")
    events = jobs.read(spark, f"{d}/events.parquet").select(F.concat_ws("-", "user_id", "event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.first_uploads(events).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string, ts timestamp").parquet(f"{at}/out").groupBy("content_hash").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (layout_titles, layout_merge, layout_bands, layout_hierarchy, layout_projection, layout_subtrees, layout_page_test, ocr_projection, stream_ingest, stream_task_state, stream_content_states, stream_first_uploads)}

_BLOCKS = f"""ls AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents), ln AS (SELECT doc_id, i - 1 AS n, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM ls) WHERE trim(ls[i]) <> ''),
b AS (SELECT doc_id AS page, CAST(n AS INTEGER) AS block_id, line AS text, CAST((n % 4) * 120 + doc_id % 7 AS DOUBLE) AS x0, CAST((n // 4) * 30 + n % 3 AS DOUBLE) AS y0, CASE WHEN n = 0 THEN 18 ELSE 10 END AS font FROM ln)"""
_EDGES = "ed AS (SELECT c.page, arg_min(p.block_id, (abs(p.x0 - c.x0), p.x0)) AS parent, c.block_id AS child FROM b c JOIN b p ON p.page = c.page AND p.block_id // 4 + 1 = c.block_id // 4 WHERE abs(p.x0 - c.x0) <= 500 GROUP BY 1, 3)"
_TITLES = r"tt AS (SELECT page, block_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN sig THEN 0 WHEN y0 <= 120 THEN 1 ELSE 2 END, CASE WHEN sig THEN y0 END, font DESC, block_id) AS r FROM (SELECT *, regexp_matches(text, '(?i)\bORG(?:ANISATION|ANIZATION)?\s+CHART\b') OR contains(upper(text), 'FIRST LINE STRUCTURE') AS sig FROM b)) WHERE r = 1)"
_STEP = "printf('%010.3f.%06d', {0}.x0 + 40, {0}.block_id)"
_WHOLE = rf"""{_TITLES}, pt AS (SELECT page, block_id, text, CAST(NULL AS INTEGER) AS parent, 0 AS depth, {_STEP.format('b')} AS path FROM b WHERE (page, block_id) NOT IN (SELECT (page, child) FROM ed)
  UNION ALL SELECT b.page, b.block_id, b.text, ed.parent, pt.depth + 1, pt.path || '/' || {_STEP.format('b')} FROM pt JOIN ed ON ed.page = pt.page AND ed.parent = pt.block_id JOIN b ON b.page = ed.page AND b.block_id = ed.child),
st AS (SELECT page, string_agg(repeat('  ', CAST(depth AS BIGINT)) || '- Field 1: ' || text, chr(10) ORDER BY path) AS structure FROM pt GROUP BY 1), tr AS (SELECT c.page, string_agg('- Field 1: ' || c.text || ' is structurally under Field 1: ' || p.text || '.', chr(10) ORDER BY p.path, c.path) AS triggers FROM pt c JOIN pt p ON p.page = c.page AND p.block_id = c.parent GROUP BY 1),
whole AS (SELECT page, '[ORG_CHART]' || chr(10) || 'Source: all' || chr(10) || 'Page: ' || page || chr(10) || 'Title: ' || coalesce(title, 'ORG CHART') || chr(10) || 'Extraction mode: layout' || chr(10) || 'Confidence: medium' || chr(10) || chr(10) || 'Structure:' || chr(10) || structure || chr(10) || chr(10) || 'Semantic Search Triggers:' || chr(10) || coalesce(triggers, '') || chr(10) || '[/ORG_CHART]' AS text FROM st LEFT JOIN tr USING (page) LEFT JOIN tt USING (page))"""


def _held(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


ORACLE = {
    "layout_titles": f"WITH {_BLOCKS}, {_TITLES} SELECT page, block_id, title FROM tt",
    "layout_projection": f"WITH RECURSIVE {_BLOCKS}, {_EDGES}, {_WHOLE} SELECT 'all' AS source_id, page, text FROM whole",
    "layout_subtrees": f"""WITH RECURSIVE {_BLOCKS}, {_EDGES}, {_WHOLE}, n AS (SELECT page, count(*) AS n_nodes FROM pt GROUP BY 1),
      sub AS (SELECT *, array_to_string(string_split(path, '/')[1:2], '/') AS top FROM pt WHERE depth >= 1), big AS (SELECT page, top, count(*) AS n_nodes FROM sub JOIN (SELECT page FROM n WHERE n_nodes > {MAX_NODES}) USING (page) GROUP BY 1, 2 HAVING count(*) >= {MAX_NODES}),
      parts AS (SELECT s.page, s.top, big.n_nodes, max(CASE WHEN s.depth = 1 THEN 'Field 1: ' || p.text || ' -> Field 1: ' || s.text END) AS context, max(CASE WHEN s.depth = 1 THEN '- ' || p.text || ' manages ' || s.text || '.' END) AS manages,
        coalesce(string_agg(repeat('  ', CAST(s.depth - 2 AS BIGINT)) || '- Field 1: ' || s.text, chr(10) ORDER BY s.path) FILTER (s.depth > 1), '') AS structure, coalesce(string_agg('- Field 1: ' || s.text || ' is structurally under Field 1: ' || p.text || '.', chr(10) ORDER BY p.path, s.path) FILTER (s.depth > 1), '') AS triggers
        FROM sub s JOIN big USING (page, top) JOIN pt p ON p.page = s.page AND p.block_id = s.parent GROUP BY 1, 2, 3)
      SELECT page, 0 AS part, n_nodes, md5(text) AS text_hash FROM whole JOIN n USING (page) UNION ALL SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY top) AS INTEGER), n_nodes, md5('[ORG_CHART_SUBTREE]' || chr(10) || 'Source: all' || chr(10) || 'Page: ' || page || chr(10) || 'Context Root: ' || context || chr(10) || 'Confidence: medium' || chr(10) || chr(10) || 'Structure:'
        || CASE WHEN structure = '' THEN '' ELSE chr(10) || structure END || chr(10) || chr(10) || 'Semantic Search Triggers:' || chr(10) || manages || CASE WHEN triggers = '' THEN '' ELSE chr(10) || triggers END || chr(10) || '[/ORG_CHART_SUBTREE]') FROM parts""",
    "layout_page_test": rf"""WITH {_BLOCKS}, c AS (SELECT * FROM (SELECT page, block_id, x0, y0, {heading_sql('text')} AS text FROM b) WHERE text <> '' AND NOT ((y0 + 12 <= 120 OR y0 >= 680) AND regexp_matches(text, '^(?:{"|".join(layout.FOOTERS)})$'))),
      s AS (SELECT page, count(*) AS short, count(DISTINCT block_id // 4) AS rows, count(DISTINCT round_even((x0 + 40) / 80, 0)) AS columns FROM c WHERE length(text) <= 32 GROUP BY 1),
      t AS (SELECT page, count(*) AS n, string_agg(text, chr(10) ORDER BY block_id) AS text, count(*) FILTER (regexp_matches(text, '^(?:[0-9]+\.|附录\s*[A-Z]?)')) AS numbered, count(*) FILTER (regexp_matches(text, '^[•◦▪\-]|^[A-Za-z0-9_]+\s+(?:str|int|float|bool|list|dict)')) AS bullets FROM c GROUP BY 1),
      o AS (SELECT t.*, coalesce(short, 0) AS short, coalesce(rows, 0) AS rows, coalesce(columns, 0) AS columns, {_held('text', layout.TABLES)} >= 3 OR {_held('text', layout.TRIPS)} >= 4 OR {_held('text', layout.TRIP_PREPARATION)} >= 4 OR {_held('upper(text)', layout.MILESTONES)} >= 4 OR {_held('upper(text)', layout.CODE)} >= 2
        OR ((contains(text, '目录') OR contains(upper(text), 'TABLE OF CONTENTS')) AND numbered >= 3) OR ({_held('upper(text)', layout.CONTENTS)} >= 3 AND numbered >= 2) OR (bullets >= 5 AND {_held('text', ['参数', '默认', '说明', '输入', '输出'])} > 0) AS other FROM t LEFT JOIN s USING (page))
      SELECT page, regexp_matches(text, '(?i)ORG(?:ANISATION|ANIZATION)?\s+CHART') OR (NOT other AND short >= 12 AND short >= 0.65 * n AND rows >= 3 AND columns >= 3) AS is_layout, short, rows, columns FROM o""",
    "layout_hierarchy": f"WITH {_BLOCKS}, {_EDGES} SELECT page, parent, child FROM ed",
    "layout_merge": f"""WITH {_BLOCKS}, m AS (SELECT page, block_id, text, block_id * 15.0::DOUBLE + (block_id // 5) * 40.0::DOUBLE AS y0, row_number() OVER (PARTITION BY page ORDER BY block_id) AS n FROM b), j AS (SELECT *, lead(text) OVER w AS t2, lead(y0) OVER w AS y2, lead(y0) OVER w - (y0 + 12) <= 1.5 * CASE WHEN n = 1 AND block_id = 0 THEN 14 ELSE 10 END AS joins FROM m WINDOW w AS (PARTITION BY page ORDER BY n)),
      f AS (SELECT *, sum(CASE WHEN coalesce(lag_j, false) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY n) AS run FROM (SELECT *, lag(joins) OVER (PARTITION BY page ORDER BY n) AS lag_j FROM j)), p AS (SELECT *, row_number() OVER (PARTITION BY page, run ORDER BY n) - 1 AS place FROM f)
      SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY n) AS INTEGER) AS node, text AS line_1, CASE WHEN joins THEN t2 END AS line_2, (y0 + CASE WHEN joins THEN y2 ELSE y0 END + 12) / 2 AS y_center FROM p WHERE place % 2 = 0""",
    "ocr_projection": rf"""WITH t AS (SELECT source, doc_id, {lines_sql('text')} AS ls FROM documents), l AS (SELECT source, doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(x, '^[ \t\-•·|]+|[ \t\-•·|]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)\bORG(?:ANISATION|ANIZATION)?\s+CHART\b') AND x <> '组织架构')[1:80] AS f FROM t)
      SELECT doc_id AS page, '[ORG_CHART_OCR]' || chr(10) || 'Source: ' || source || chr(10) || 'Page: ' || doc_id || chr(10) || 'Extraction mode: ocr_layout_fallback' || chr(10) || 'Confidence: low' || chr(10) || chr(10) || 'Structure:' || chr(10) || array_to_string(list_transform(f, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || 'Semantic Search Triggers:' || chr(10)
        || array_to_string(list_transform(f[1:20], lambda x: '- ' || x || ' appears in OCR org chart text.'), chr(10)) || chr(10) || '[/ORG_CHART_OCR]' AS projection FROM l WHERE len(list_filter(f, lambda x: length(x) <= 48)) >= 4""",
    "stream_ingest": f"""WITH d AS (SELECT min(CAST(doc_id AS VARCHAR)) AS source_key, {strip('text')} AS p FROM documents GROUP BY 2), w AS (SELECT source_key, unnest([substr(p, s + 1, 1024) FOR s IN range(0, greatest(0, CAST(ceil((length(p) - 1024) / 896.0) AS BIGINT) * 896) + 1, 896)]) AS t FROM d WHERE p <> '')
      SELECT source_key, count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS characters FROM w WHERE {strip('t')} <> '' GROUP BY 1""",
    # Rows of a page are 30 apart and their blocks differ by 2 at most, so each row is a band.
    "layout_bands": f"WITH {_BLOCKS} SELECT page, count(DISTINCT block_id // 4) AS bands, count(*) AS nodes FROM b GROUP BY 1",
    "stream_content_states": f"""WITH RECURSIVE c AS (SELECT doc_id, sha256({strip('text')}) AS h, ['failed', 'indexed', 'review_required'][doc_id % 3 + 1] AS kind FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS i FROM c),
      s AS (SELECT h, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS doc_id, '' AS before, '' AS between, 'failed' AS after FROM o GROUP BY h UNION ALL SELECT h, i, doc_id, before, between, CASE WHEN between = 'failed' THEN 'processing' ELSE between END FROM (SELECT o.h, o.i, o.doc_id, s.after AS before, CASE WHEN s.after IN ('failed', 'processing') THEN kind ELSE s.after END AS between FROM s JOIN o ON o.h = s.h AND o.i = s.i + 1)),
      u AS (SELECT doc_id * 3 AS seq, before AS met FROM s WHERE i > 0 UNION ALL SELECT doc_id * 3 + 2, between FROM s WHERE i > 0) SELECT seq, CASE met WHEN 'failed' THEN 'reserved' WHEN 'processing' THEN 'duplicate_pending' WHEN 'indexed' THEN 'duplicate' ELSE met END AS outcome FROM u""",
    "stream_first_uploads": """WITH RECURSIVE e AS (SELECT user_id || '-' || event_type AS content_hash, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events), a AS (SELECT content_hash, i, ts AS last, true AS taken FROM e WHERE i = 1
      UNION ALL SELECT e.content_hash, e.i, CASE WHEN e.ts > a.last + INTERVAL 10 MINUTE THEN e.ts ELSE a.last END, e.ts > a.last + INTERVAL 10 MINUTE FROM a JOIN e ON e.content_hash = a.content_hash AND e.i = a.i + 1) SELECT content_hash, count(*) FILTER (taken) AS n FROM a GROUP BY 1""",
    "stream_task_state": "SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1",
}
