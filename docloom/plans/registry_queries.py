"""Queries over registries, maintained tables, saved answers and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.operators import assets, chunking, evaluate, registry, search, storage
from docloom.operators.storage import scratch
from docloom.plans.inputs import documents, questions, table
from docloom.plans.search_queries import _CORPUS, _HITS, _chunk_tokens, _chunks, _hits, _tokens
from docloom.plans.text_queries import _STARTS, strip
from docloom.sources import assemble

STATUSES = ["indexed", "processing", "review_required", "version_conflict", "failed"]
TASKS = {"click": "queued", "view": "processing", "purchase": "completed", "signup": "review_required"}


def _at(column):
    """A time a minute apart for each number."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col(column) * 60)


def _uploads(spark, d):
    """All documents as uploads in the order of their numbers, named by their source."""
    policy = F.when(F.col("doc_id") % 7 == 0, "replace").when(F.col("doc_id") % 7 == 1, "keep").otherwise("")
    return documents(spark, d).select(F.col("doc_id").alias("seq"), "source_key", F.col("source_name").alias("original_name"), content_hash(F.col("text")).alias("content_hash"), policy.alias("version_policy"))


def _registry(spark, d):
    """Contents of the non-English documents, known from before."""
    rows = table(spark, d, "documents").where("lang <> 'en'").select(content_hash(F.col("text")).alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return rows.select("content_hash", F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 5 + 1).cast("int")).alias("status"))


def _sources(spark, d):
    rows = table(spark, d, "documents").where("lang <> 'en'")
    status = F.when(F.col("doc_id") % 4 == 0, "delete_failed").when(F.col("doc_id") % 4 == 1, "deleted").otherwise("indexed")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("original_name"), content_hash(F.col("text")).alias("content_hash"), status.alias("status"), _at("doc_id").alias("created_at"))


def reserve_content(spark, d):
    return registry.reserve(_uploads(spark, d), _registry(spark, d), F.col("seq") % 2 == 0, F.col("seq") % 3 == 0).select("seq", "outcome")


def version_conflict(spark, d):
    reserved = registry.reserve(_uploads(spark, d), _registry(spark, d))
    return registry.version_conflicts(reserved, _sources(spark, d)).select("seq", "outcome", "replaces")


def version_replace(spark, d):
    replaced = version_conflict(spark, d).where("replaces is not null").select(F.col("replaces").alias("source_id"))
    return registry.replace_versions(_sources(spark, d), replaced, replaced.where("pmod(cast(source_id as long), 3) = 0")).select("source_id", "status")


def latest_version(spark, d):
    return registry.latest_active(_sources(spark, d)).select("original_name", "source_id", "created_at")


def list_sources(spark, d):
    return registry.listed(_sources(spark, d)).select("source_id", "status", "created_at")


def upsert_index(spark, d):
    chunks = _chunks(spark, d)
    new = chunks.where("chunk_index = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return registry.upsert(chunks, new, "chunk_id").groupBy("source_name").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


def _chunk_vectors(spark, d):
    """Vectors for the first chunks of the documents that have one."""
    return table(spark, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit("#0")).alias("chunk_id"), F.col("embedding").alias("vector"))


def index_consistency(spark, d):
    return registry.quarantine(_chunks(spark, d), _chunk_vectors(spark, d))


def quarantine_filter(spark, d):
    return registry.without(_chunks(spark, d), registry.quarantine(_chunks(spark, d), _chunk_vectors(spark, d))).select("chunk_id")


def delete_source(spark, d):
    """Every third document's id goes, and the source src3 by its name alone."""
    chunks = _chunks(spark, d).withColumnRenamed("source_key", "source_id")
    gone = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("source_name"))
    named = gone.select(F.lit("unknown").alias("source_id"), F.lit("src3").alias("source_name")).distinct()
    return registry.delete_sources(chunks, gone.unionByName(named)).groupBy("source_name").agg(F.count("*").alias("chunks"))


def backfill_sources(spark, d):
    rows = _chunks(spark, d).select(F.when(F.col("source_key").cast("long") % 2 == 0, F.col("source_key")).otherwise("").alias("source_id"), "source_name", F.concat(F.lit("raw/"), "source_key").alias("raw_path"), "chunk_index")
    return registry.backfill_sources(rows, _sources(spark, d).select("source_id"))


def backfill_hashes(spark, d):
    counts = _chunks(spark, d).groupBy("source_key").agg(F.count("*").alias("chunk_count"))
    files = documents(spark, d).join(counts.hint("merge"), "source_key").select(content_hash(F.col("text")).alias("content_hash"), "source_name", "chunk_count")
    return registry.backfill_hashes(files, _registry(spark, d))


def chunk_lookup(spark, d):
    refs = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id").cast("string")).otherwise(F.concat(F.col("vec_id").cast("string"), F.lit("#1"))).alias("ref"))
    return registry.lookup(refs, _chunks(spark, d)).select("ref", "chunk_id", "raw_file_path", F.md5("text").alias("text_hash"))


def corpus_stats(spark, d):
    return registry.corpus_stats(_chunks(spark, d))


def index_difference(spark, d):
    chunks = _chunks(spark, d)
    return registry.index_difference(chunks, search.postings(chunks), _chunk_vectors(spark, d))


def _task_events(spark, d):
    status = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in TASKS.items()), F.lit("failed"))
    return table(spark, d, "events").select(F.col("user_id").alias("task_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"), F.concat(F.lit("raw/"), F.col("user_id").cast("string")).alias("raw_file_path"))


def task_state(spark, d):
    return registry.latest_tasks(_task_events(spark, d))


def task_health(spark, d):
    """Health of the tasks, every fourth of which has no quality action, and of the corpus."""
    tasks = registry.latest_tasks(_task_events(spark, d))
    action = F.when(F.col("status") == "completed", F.element_at(F.array(*map(F.lit, ["", "direct", "cleaned", "low_indexed"])), (F.col("task_id") % 4 + 1).cast("int")))
    return registry.knowledge_health(tasks.withColumn("quality_action", action), _chunks(spark, d))


def task_recovery(spark, d):
    tasks = registry.latest_tasks(_task_events(spark, d)).withColumn("raw_file_path", F.concat(F.lit("raw/"), F.col("task_id").cast("string")))
    return registry.recover_tasks(tasks, _task_events(spark, d).where("status = 'completed'").select("raw_file_path"))


def batch_rollup(spark, d):
    outcome = registry.reserve(_uploads(spark, d), _registry(spark, d))
    status = F.when(F.col("outcome") == "reserved", F.when(F.col("seq") % 11 == 0, "accepted").otherwise("ok")).otherwise(F.col("outcome"))
    rows = outcome.select("original_name", status.alias("status"), F.when(status == "ok", 3).otherwise(0).alias("chunks"))
    return registry.batch_rollup(rows.withColumnRenamed("original_name", "batch_id"))


def _payloads(spark, d):
    """Assistant turns as answers to the turn before; conversations share answers."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = turns.where("role <> 'user'").join(asked.hint("merge"), ["conv_id", "turn"])
    number = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select(F.format_string("ans_%010d", number).alias("asset_id"), "conv_id", "turn", "question", F.col("text").alias("answer"), F.when(F.col("conv_id") % 4 == 0, "no_answer").otherwise("grounded").alias("source_status"), F.lit("zh").alias("language"), F.timestamp_seconds(F.lit(1_700_000_000) + number * 60).alias("created_at"))


def _stored(spark, d):
    rows = _payloads(spark, d).where("conv_id % 10 = 0").withColumn("operation_key", assets.operation_key(["question", "answer", "source_status", "language"]))
    return rows.groupBy("operation_key").agg(F.min("asset_id").alias("asset_id"))


def save_assets(spark, d):
    return assets.save(_payloads(spark, d), _stored(spark, d)).select("asset_id", "kept_id", "outcome", "day")


def _manifests(spark, d):
    cites = F.transform(F.sequence(F.lit(0), (F.col("turn") % 3).cast("int")), lambda k: F.struct(F.concat(F.lit("src"), ((F.col("conv_id") + k) % 20).cast("string")).alias("source_name"), k.alias("chunk_index")))
    return _payloads(spark, d).withColumns({"sources": cites, "rag_status": F.lit("not_indexed"), "publication_status": F.lit("local_only"), "updated_at": F.col("created_at")})


def asset_page(spark, d):
    return assets.page(_manifests(spark, d), 50, "2023-11-15 12:00:00").select("asset_id", assets.title_of(F.col("question")).alias("title"), "created_at", F.size("sources").alias("source_count"))


def asset_maintenance(spark, d):
    changes = _manifests(spark, d).where("conv_id % 3 = 0").select("asset_id", F.lit("indexed").alias("rag_status"), F.when(F.col("turn") % 2 == 1, "published").alias("publication_status"))
    rows = assets.patch(_manifests(spark, d), changes, F.timestamp_seconds(F.lit(1_800_000_000)))
    kept = registry.without(rows, rows.where("conv_id % 5 = 0"), "asset_id")
    return kept.select("asset_id", "rag_status", "publication_status", "updated_at")


def export_retention(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("asset_id"), F.concat(F.lit("e"), F.format_string("%04d", "turn")).alias("path"), _at("turn").alias("created_at"))
    return assets.retain_exports(rows).select("asset_id", "path", "kept")


def render_asset(spark, d):
    return assets.render(_manifests(spark, d)).select("asset_id", "markdown")


def promote_assets(spark, d):
    rows = assets.promote(_manifests(spark, d), _payloads(spark, d).where("conv_id % 10 = 1").select("asset_id"))
    return rows.select("chunk_id", "asset_id", F.array_join("derived_chunks", ",").alias("derived_chunks"), F.array_join("derived_sources", ",").alias("derived_sources"), "coverage_status", F.md5("text").alias("text_hash"))


def quality_gate(spark, d):
    words = F.transform(F.slice(F.split("question", " "), 2, 2), F.lower)
    cases = questions(spark, d).select("qid", F.when(F.col("qid") % 2 == 0, "text").alias("top_type"), F.when(F.col("qid") % 3 == 0, F.array(F.lit("pdf"), F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("types"), words.alias("terms"))
    return evaluate.quality_gate(cases, _hits(spark, d))


def answer_acceptance(spark, d):
    rows = _payloads(spark, d)
    cases = rows.select(F.col("asset_id").alias("key"), F.array(F.element_at(F.split("question", " "), 1)).alias("required"), F.array(F.lit("the")).alias("forbidden"), F.when(F.col("turn") % 3 == 0, "no_answer").otherwise("grounded").alias("expected_status"))
    answers = rows.where("conv_id % 9 > 0").select(F.col("asset_id").alias("key"), "answer", F.col("source_status").alias("status"), (F.col("turn") % 2).alias("n_sources"))
    return evaluate.acceptance(cases, answers)


def source_recall(spark, d):
    return evaluate.source_recall(questions(spark, d).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("expected_source")), _hits(spark, d))


def manifest_validation(spark, d):
    key = F.when(F.col("page_id") % 13 == 0, "").otherwise(F.regexp_extract("url", r"/(\d+)", 1))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("n"), key.alias("key"), "url", F.when(F.contains("url", F.lit(".html")), "text/html").otherwise("text/plain").alias("mime"), F.lit("text/html").alias("expected_mime"), (F.col("page_id") % 4 > 0).alias("enabled"), F.when(F.col("page_id") % 8 == 0, "old").otherwise("").alias("reason"))
    return evaluate.check_manifest(rows)


def blocks_to_documents(spark, d):
    kind = F.when(F.col("turn") % 4 == 3, "notes").otherwise("paragraph")
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.floor(F.col("turn") / 2).cast("int").alias("section_no"), F.col("turn").alias("ord"), kind.alias("kind"), "text")
    return assemble.from_blocks(rows)


def paragraphs_to_documents(spark, d):
    """Conversations as word-processor files: a paragraph for each turn, every fourth turn as a table below its head."""
    cell = F.concat("text", F.lit("|"), F.col("turn").cast("string"))
    rows = F.when(F.col("turn") % 4 == 3, F.array(F.array(F.lit("role"), F.lit("text")), F.array(F.col("role"), cell), F.array(F.lit("end"))))
    blocks = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 4 < 3, F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"), rows.alias("rows"))
    return assemble.from_paragraphs(blocks).select("source_id", "text", *(F.col(c).cast("long").alias(c) for c in ("paragraph_count", "table_count", "table_rows")))


def publish_index(spark, d):
    """The index published twice, the second time with changed first chunks: what readers find then."""
    root = scratch(spark, "published")
    chunks, vectors = _chunks(spark, d), _chunk_vectors(spark, d)
    storage.publish_index(chunks, _chunk_tokens(spark, d), vectors, root)
    new = chunks.where("chunk_index = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    changed = registry.upsert(chunks, new, "chunk_id")
    storage.publish_index(changed, changed.select("chunk_id", "text"), vectors, root)
    found = lambda name, n: storage.published(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), n.cast("long").alias("total"))
    return found("chunks", F.sum(F.length("text"))).unionByName(found("postings", F.sum("tf"))).unionByName(found("vectors", F.sum(F.size("vector")))).unionByName(found("quarantine", F.count_distinct("reason")))


def cells_to_documents(spark, d):
    """Suppliers as sheets of their nation: a row each, with a formula, gaps, bars and line ends in cells."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    cell = lambda c, value, formula: F.struct(F.lit(c).alias("c"), value.cast("string").alias("value"), formula.cast("string").alias("formula"))
    even = F.col("s_suppkey") % 2 == 0
    cells = F.array(
        cell(1, F.col("s_name"), F.lit(None)), cell(2, F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("a|b"), F.lit("\n"), F.col("s_suppkey").cast("string"))), F.lit(None)),
        cell(3, F.when(even, F.col("s_nationkey")), F.when(even, "A1+1")),
    )
    rows = s.select((F.col("s_nationkey") % 5).cast("string").alias("source_id"), F.col("s_nationkey").cast("int").alias("sheet_no"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("sheet"), F.col("s_suppkey").cast("int").alias("r"), F.explode(cells).alias("x"))
    return assemble.from_cells(rows.select("source_id", "sheet_no", "sheet", "r", "x.c", "x.value", "x.formula"))


QUERIES = {f.__name__: f for f in (
    reserve_content, version_conflict, version_replace, latest_version, list_sources, upsert_index, index_consistency, quarantine_filter, delete_source, backfill_sources, backfill_hashes, chunk_lookup, corpus_stats,
    index_difference, task_state, task_health, task_recovery, batch_rollup, save_assets, asset_page, asset_maintenance, export_retention, render_asset, promote_assets, quality_gate, answer_acceptance, source_recall, manifest_validation, blocks_to_documents, paragraphs_to_documents, cells_to_documents, publish_index,
)}

_HASH = f"sha256({strip('text')})"
_STATUS = "[" + ", ".join(repr(x) for x in STATUSES) + "][doc_id % 5 + 1]"
_REG = f"reg AS (SELECT h, {_STATUS} AS known FROM (SELECT {_HASH} AS h, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' GROUP BY 1))"
_UP = f"up AS (SELECT doc_id AS seq, source, {_HASH} AS h, min(doc_id) OVER (PARTITION BY {_HASH}) AS first, CASE doc_id % 7 WHEN 0 THEN 'replace' WHEN 1 THEN 'keep' ELSE '' END AS policy FROM documents)"


def _reserved(review: str, version: str) -> str:
    return f"{_REG}, {_UP}, res AS (SELECT up.*, CASE WHEN known = 'indexed' THEN 'duplicate' WHEN known = 'processing' THEN 'duplicate_pending' WHEN known = 'review_required' AND NOT {review} THEN 'review_required' WHEN known = 'version_conflict' AND NOT {version} THEN 'version_conflict' WHEN seq > first THEN 'duplicate_pending' ELSE 'reserved' END AS outcome FROM up LEFT JOIN reg USING (h))"


_SRC = f"src AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_id, source AS original_name, {_HASH} AS h, CASE doc_id % 4 WHEN 0 THEN 'delete_failed' WHEN 1 THEN 'deleted' ELSE 'indexed' END AS status, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS created_at FROM documents WHERE lang <> 'en')"
_ACTIVE = f"{_SRC}, act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY original_name ORDER BY created_at DESC, source_id DESC) AS n FROM src WHERE status = 'indexed') WHERE n = 1)"
_CONFLICT = f"{_reserved('false', 'false')}, {_ACTIVE}, con AS (SELECT seq, policy, outcome, act.source_id AS active, outcome = 'reserved' AND act.source_id IS NOT NULL AND act.h <> res.h AS c FROM res LEFT JOIN act ON act.original_name = res.source), vc AS (SELECT seq, CASE WHEN c AND policy = '' THEN 'version_conflict' ELSE outcome END AS outcome, CASE WHEN c AND policy = 'replace' THEN active END AS replaces FROM con)"
_TASK = "ev AS (SELECT user_id AS task_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TASKS.items()) + " ELSE 'failed' END AS status, ts, event_id FROM events), task AS (SELECT task_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM ev GROUP BY 1)"
_PAY = "pay AS (SELECT format('ans_{:010d}', a.conv_id * 1000 + a.turn) AS asset_id, a.conv_id, a.turn, u.text AS question, a.text AS answer, CASE WHEN a.conv_id % 4 = 0 THEN 'no_answer' ELSE 'grounded' END AS source_status, make_timestamp((1700000000 + (a.conv_id * 1000 + a.turn) * 60) * 1000000) AS created_at FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role <> 'user')"
_KEYS = f"pk AS (SELECT *, {strip('question')} || chr(31) || {strip('answer')} || chr(31) || source_status AS k FROM pay)"
_MAN = f"{_PAY}, man AS (SELECT *, list_transform(range(0, turn % 3 + 1), lambda k: 'src' || (conv_id + k) % 20) AS names FROM pay)"
_MD = f"'# ' || substr(trim(regexp_replace(question, '\\s+', ' ', 'g')), 1, 40) || chr(10) || chr(10) || '## Question' || chr(10) || {strip('question')} || chr(10) || chr(10) || '## Answer' || chr(10) || {strip('answer')} || chr(10) || chr(10) || '## Sources' || chr(10) || array_to_string(list_transform(names, lambda x, i: '- ' || x || '#' || (i - 1)), chr(10)) || chr(10) || chr(10) || '## Metadata' || chr(10) || '- language: zh'"

ORACLE = {
    "reserve_content": f"WITH {_reserved('seq % 2 = 0', 'seq % 3 = 0')} SELECT seq, outcome FROM res",
    "version_conflict": f"WITH {_CONFLICT} SELECT * FROM vc",
    "version_replace": f"WITH {_CONFLICT}, rp AS (SELECT DISTINCT replaces AS source_id, CAST(replaces AS BIGINT) % 3 = 0 AS failed FROM vc WHERE replaces IS NOT NULL) SELECT source_id, CASE WHEN failed THEN 'delete_failed' ELSE status END AS status FROM src LEFT JOIN rp USING (source_id) WHERE failed IS NULL OR failed",
    "latest_version": f"WITH {_ACTIVE} SELECT original_name, source_id, created_at FROM act",
    "list_sources": f"WITH {_SRC} SELECT source_id, status, created_at FROM src WHERE status IN ('indexed', 'delete_failed')",
    "upsert_index": f"WITH {_CORPUS} SELECT source_name, count(*) AS chunks, CAST(sum(length(text) + CASE WHEN chunk_index = 0 THEN 4 ELSE 0 END) AS BIGINT) AS characters FROM corpus GROUP BY 1",
    "index_consistency": f"WITH {_CORPUS} SELECT chunk_id, 'no vector' AS reason FROM corpus WHERE chunk_id NOT IN (SELECT vec_id || '#0' FROM embeddings)",
    "quarantine_filter": f"WITH {_CORPUS} SELECT chunk_id FROM corpus WHERE chunk_id IN (SELECT vec_id || '#0' FROM embeddings)",
    "delete_source": f"WITH {_CORPUS}, gone AS (SELECT DISTINCT source_key FROM corpus WHERE CAST(source_key AS BIGINT) % 3 = 0), names AS (SELECT source FROM documents WHERE doc_id % 3 = 0 AND CAST(doc_id AS VARCHAR) NOT IN (SELECT source_key FROM gone) UNION SELECT 'src3') SELECT source_name, count(*) AS chunks FROM corpus WHERE source_key NOT IN (SELECT source_key FROM gone) AND source_name NOT IN (SELECT source FROM names) GROUP BY 1",
    "backfill_sources": f"WITH {_CORPUS}, r AS (SELECT CASE WHEN CAST(source_key AS BIGINT) % 2 = 0 THEN source_key ELSE 'legacy_' || substr(sha256(source_name || chr(10) || 'raw/' || source_key), 1, 24) END AS source_id, source_name, chunk_index FROM corpus) SELECT source_id, count(*) AS chunk_count, arg_min(source_name, chunk_index) AS source_name FROM r WHERE source_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang <> 'en') GROUP BY 1",
    "backfill_hashes": f"WITH {_CORPUS}, n AS (SELECT source_key, count(*) AS chunk_count FROM corpus GROUP BY 1), f AS (SELECT {_HASH} AS h, source, chunk_count FROM documents JOIN n ON source_key = CAST(doc_id AS VARCHAR)) SELECT h AS content_hash, min((source, chunk_count))[1] AS source_name, min((source, chunk_count))[2] AS chunk_count, 'indexed' AS status FROM f WHERE h NOT IN (SELECT {_HASH} FROM documents WHERE lang <> 'en') GROUP BY 1",
    "chunk_lookup": f"WITH {_CORPUS}, refs AS (SELECT CASE WHEN vec_id % 2 = 0 THEN CAST(vec_id AS VARCHAR) ELSE vec_id || '#1' END AS ref FROM embeddings) SELECT ref, chunk_id, 'raw/' || source_key AS raw_file_path, md5(text) AS text_hash FROM refs JOIN corpus ON chunk_id = CASE WHEN contains(ref, '#') THEN ref ELSE ref || '#0' END",
    "corpus_stats": f"WITH {_CORPUS} SELECT source_type, count(DISTINCT source_key) AS sources, count(*) AS chunks FROM corpus GROUP BY 1",
    "index_difference": rf"WITH {_CORPUS}, v AS (SELECT vec_id || '#0' AS chunk_id FROM embeddings), p AS (SELECT chunk_id FROM corpus WHERE regexp_matches(lower(text), '[\p{{L}}\p{{N}}]')), a AS (SELECT chunk_id FROM corpus UNION SELECT chunk_id FROM v) SELECT chunk_id, 'chunks' AS missing_in FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM corpus) UNION ALL SELECT chunk_id, 'postings' FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM p) UNION ALL SELECT chunk_id, 'vectors' FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM v)",
    "task_state": f"WITH {_TASK} SELECT * FROM task",
    "task_health": f"""WITH {_CORPUS}, {_TASK}, a AS (SELECT ['', 'direct', 'cleaned', 'low_indexed'][task_id % 4 + 1] AS action FROM task WHERE status = 'completed')
      SELECT 'status' AS measure, status AS value, count(*) AS n FROM task GROUP BY 2 UNION ALL SELECT 'quality_action', action, count(*) FROM a WHERE action <> '' GROUP BY 2 UNION ALL SELECT 'indexed_sources', '', count(DISTINCT source_key) FROM corpus UNION ALL SELECT 'total_chunks', '', count(*) FROM corpus UNION ALL SELECT 'source_type', source_type, count(DISTINCT source_key) FROM corpus GROUP BY 2""",
    "publish_index": f"""WITH {_CORPUS}, k AS (SELECT chunk_id, CASE WHEN chunk_index = 0 THEN 'new ' || text ELSE text END AS text FROM corpus WHERE chunk_id IN (SELECT vec_id || '#0' FROM embeddings)), t AS (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM k)
      SELECT 'chunks' AS name, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS total FROM k UNION ALL SELECT 'postings', count(DISTINCT (chunk_id, term)), count(*) FROM t UNION ALL SELECT 'vectors', count(*), CAST(sum(len(embedding)) AS BIGINT) FROM embeddings WHERE vec_id || '#0' IN (SELECT chunk_id FROM k)
      UNION ALL SELECT 'quarantine', count(*), count(DISTINCT 1) FROM corpus WHERE chunk_id NOT IN (SELECT chunk_id FROM k)""",
    "promote_assets": f"""WITH {_MAN}, todo AS (SELECT *, {_MD} AS md FROM man WHERE source_status <> 'no_answer' AND conv_id % 10 <> 1), tx AS (SELECT *, '---' || chr(10) || 'source_type: generated_asset' || chr(10) || 'generated: true' || chr(10) || 'asset_id: ' || asset_id || chr(10) || '---' || chr(10) || md AS text FROM todo),
      ls AS (SELECT asset_id, string_split(text, chr(10)) AS ls FROM tx), ln AS (SELECT asset_id, i, ls[i] AS line FROM (SELECT asset_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls)), sec AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY i) AS section FROM ln),
      p AS (SELECT asset_id, section, {strip("string_agg(line, chr(10) ORDER BY i)")} AS p FROM sec GROUP BY 1, 2), w AS (SELECT asset_id, section, i AS w, substr(p, starts[i] + 1, 1024) AS text FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM (SELECT *, {_STARTS} AS starts FROM p WHERE p <> ''))),
      c AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY section, w) - 1 AS n, text FROM w)
      SELECT 'generated_' || asset_id || '#' || n AS chunk_id, asset_id, array_to_string(list_transform(names, lambda x, i: x || '#' || (i - 1)), ',') AS derived_chunks, array_to_string(list_sort(list_distinct(names)), ',') AS derived_sources, source_status AS coverage_status, md5(text) AS text_hash FROM c JOIN todo USING (asset_id) WHERE {strip('text')} <> ''""",
    "paragraphs_to_documents": r"""WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '| role | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(trim(role), '|', '\|') || ' | ' || replace(replace(trim(text || '|' || turn, ' '), '|', '\|'), chr(10), ' ') || ' |' || chr(10) || '| end |  |' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS line FROM conversations)
      SELECT CAST(conv_id AS VARCHAR) AS source_id, string_agg(line, chr(10) ORDER BY turn) AS text, count(*) FILTER (turn % 4 < 3) AS paragraph_count, count(*) FILTER (turn % 4 = 3) AS table_count, CAST(3 * count(*) FILTER (turn % 4 = 3) AS BIGINT) AS table_rows FROM b WHERE line <> '' GROUP BY 1""",
    "task_recovery": f"WITH {_TASK} SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM ev WHERE status = 'completed') THEN 'requeued' ELSE 'failed' END AS outcome FROM task WHERE status IN ('queued', 'processing')",
    "batch_rollup": f"""WITH {_reserved('false', 'false')}, s AS (SELECT source AS batch_id, CASE WHEN outcome = 'reserved' AND seq % 11 = 0 THEN 'accepted' WHEN outcome = 'reserved' THEN 'ok' ELSE outcome END AS st FROM res),
      g AS (SELECT batch_id, count(*) AS files, count(*) FILTER (st = 'ok') AS succeeded, count(*) FILTER (st = 'accepted') AS accepted, count(*) FILTER (st IN ('duplicate', 'duplicate_pending')) AS duplicate, count(*) FILTER (st = 'review_required') AS review, count(*) FILTER (st = 'version_conflict') AS conflict, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed, CAST(3 * count(*) FILTER (st = 'ok') AS BIGINT) AS chunks FROM s GROUP BY 1)
      SELECT *, CASE WHEN succeeded + duplicate = files THEN 'ok' WHEN accepted > 0 AND succeeded + duplicate + accepted = files THEN 'accepted' ELSE 'partial' END AS status FROM g""",
    "save_assets": f"WITH {_PAY}, {_KEYS}, st AS (SELECT k, min(asset_id) AS stored FROM pk WHERE conv_id % 10 = 0 GROUP BY 1), f AS (SELECT k, arg_min(asset_id, (created_at, asset_id)) AS first FROM pk GROUP BY 1) SELECT asset_id, coalesce(stored, first) AS kept_id, CASE WHEN stored IS NULL AND asset_id = first THEN 'created' ELSE 'idempotent_reuse' END AS outcome, CAST(created_at AS DATE) AS day FROM pk JOIN f USING (k) LEFT JOIN st USING (k)",
    "asset_page": f"WITH {_MAN} SELECT asset_id, substr(trim(regexp_replace(question, '\\s+', ' ', 'g')), 1, 40) AS title, created_at, CAST(len(names) AS INTEGER) AS source_count FROM man WHERE created_at < TIMESTAMP '2023-11-15 12:00:00' ORDER BY created_at DESC, asset_id DESC LIMIT 50",
    "asset_maintenance": f"WITH {_PAY} SELECT asset_id, CASE WHEN conv_id % 3 = 0 THEN 'indexed' ELSE 'not_indexed' END AS rag_status, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 1 THEN 'published' ELSE 'local_only' END AS publication_status, CASE WHEN conv_id % 3 = 0 THEN make_timestamp(1800000000000000) ELSE created_at END AS updated_at FROM pay WHERE conv_id % 5 <> 0",
    "export_retention": "SELECT conv_id AS asset_id, 'e' || format('{:04d}', turn) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5 AS kept FROM conversations",
    "render_asset": f"WITH {_MAN} SELECT asset_id, {_MD} AS markdown FROM man",
    "quality_gate": rf"""WITH {_HITS}, c AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'text' END AS top_type, CASE WHEN item_id % 3 = 0 THEN ['pdf', 'text'] ELSE [] END AS types, string_split(text, ' ')[2:3] AS terms FROM benchmark), h AS (SELECT qid, count(*) AS hits, count(*) FILTER (length({strip('text')}) < 30) AS noisy, arg_min(source_type, rank) AS ft, list(DISTINCT source_type) AS kinds, string_agg(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g'), '' ORDER BY rank) AS k FROM hits GROUP BY 1),
      r AS (SELECT qid, coalesce(hits, 0) AS hits, coalesce(noisy, 0) AS noisy, coalesce(top_type IS NULL OR top_type = ft, false) AS type_ok, len(list_filter(types, lambda t: NOT list_contains(coalesce(kinds, []), t))) AS missing_types, len(list_filter(terms, lambda t: NOT contains(coalesce(k, ''), regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g')))) AS missing FROM c LEFT JOIN h USING (qid)) SELECT *, hits = 5 AND noisy = 0 AND type_ok AND missing_types = 0 AND missing = 0 AS passed FROM r""",
    "answer_acceptance": f"""WITH {_PAY}, c AS (SELECT asset_id, conv_id % 9 > 0 AS has, answer, string_split(question, ' ')[1] AS req, CASE WHEN turn % 3 = 0 THEN 'no_answer' ELSE 'grounded' END AS want, source_status AS got, turn % 2 AS n FROM pay)
      SELECT asset_id AS key, array_to_string(list_filter([CASE WHEN NOT has THEN 'no_answer_row' END, CASE WHEN NOT contains(CASE WHEN has THEN lower(answer) ELSE '' END, lower(req)) THEN 'required_term' END, CASE WHEN has AND contains(lower(answer), 'the') THEN 'forbidden_term' END, CASE WHEN NOT has OR got <> want THEN 'status' END,
        CASE WHEN want = 'grounded' AND (NOT has OR n = 0) THEN 'sources_missing' END, CASE WHEN want <> 'grounded' AND has AND n > 0 THEN 'sources_present' END], lambda x: x IS NOT NULL), ',') AS failures FROM c""",
    "source_recall": f"WITH {_HITS} SELECT qs.qid, count(*) FILTER (source_name = 'src' || qs.qid % 20) AS matching, count(*) FILTER (source_name = 'src' || qs.qid % 20) > 0 AS recalled FROM qs LEFT JOIN hits USING (qid) GROUP BY 1",
    "manifest_validation": r"""WITH r AS (SELECT page_id AS n, CASE WHEN page_id % 13 = 0 THEN '' ELSE regexp_extract(url, '/(\d+)', 1) END AS key, url, page_id FROM pages), c AS (SELECT *, count(*) OVER (PARTITION BY key) AS same FROM r)
      SELECT n, array_to_string(list_filter([CASE WHEN key = '' THEN 'empty_key' END, CASE WHEN same > 1 THEN 'repeated_key' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' END, CASE WHEN NOT contains(url, '.html') THEN 'mime' END, CASE WHEN page_id % 4 = 0 AND page_id % 8 <> 0 THEN 'no_reason' END], lambda x: x IS NOT NULL), ',') AS problems FROM c""",
    "blocks_to_documents": "WITH s AS (SELECT conv_id, turn // 2 AS n, string_agg(CASE WHEN turn % 4 = 3 THEN '### Notes' || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS b FROM conversations WHERE text <> '' GROUP BY 1, 2) SELECT CAST(conv_id AS VARCHAR) AS source_id, string_agg('## Slide ' || n || chr(10) || chr(10) || b, chr(10) || chr(10) ORDER BY n) AS text FROM s GROUP BY 1",
    "cells_to_documents": r"""WITH s AS (SELECT s_suppkey AS r, s_nationkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 3 WHEN s_suppkey % 3 > 0 THEN 2 ELSE 1 END AS last, s_name AS a, CASE WHEN s_suppkey % 3 > 0 THEN 'a\|b<br>' || s_suppkey ELSE '' END AS b, CASE WHEN s_suppkey % 2 = 0 THEN '=A1+1（计算值：' || s_nationkey || '）' ELSE '' END AS c FROM supplier),
      w AS (SELECT *, max(last) OVER (PARTITION BY n) AS w, row_number() OVER (PARTITION BY n ORDER BY r) AS k FROM s), l AS (SELECT n, r, '| ' || array_to_string([a, b, c][1:w], ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '| ' || array_to_string(['---', '---', '---'][1:w], ' | ') || ' |' ELSE '' END AS t FROM w),
      h AS (SELECT n, '## Sheet: N' || n || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY r) AS t FROM l GROUP BY 1) SELECT CAST(n % 5 AS VARCHAR) AS source_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS text FROM h GROUP BY 1""",
}
