"""Queries over the search index and the evidence it gives, each for all questions at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.questions import FOCUS_STOP
from docloom.functions.text import MARKED, PLAIN
from docloom.operators import chunking, evidence, search, vector_index
from docloom.operators.storage import stored
from docloom.plans.inputs import documents, kept, maintained, questions, table, vectors
from docloom.plans.text_queries import CHUNKS

HITS = 5


def _whole(spark, d):
    """Documents as one chunk each, as the vectors have them."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


def _question_vectors(spark, d):
    """Every question with the vector of the same number."""
    return questions(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")).hint("merge"), "qid")


def _chunks(spark, d):
    """The maintained index's chunks."""

    def build():
        docs = documents(spark, d).withColumn("raw_file_path", F.concat(F.lit("raw/"), "source_key"))
        named = chunking.chunk_documents(docs, keep=("source_name", "doc_id")).drop("source_type")
        kind = F.when(F.col("doc_id") % 5 == 0, "generated_asset").when(F.col("doc_id") % 2 == 0, "pdf").otherwise("text")
        return named.withColumn("source_type", kind).drop("doc_id", "embedding_text")

    return maintained(spark, d, "chunks", build)


def _tokens_of(spark, d, name, chunks):
    """The maintained index's tokens of chunks."""
    return maintained(spark, d, name, lambda: search.token_rows(chunks, *(c for c in ("source_name",) if c in chunks.columns)))


def _whole_tokens(spark, d):
    return _tokens_of(spark, d, "document-tokens", _whole(spark, d))


def _chunk_tokens(spark, d):
    return _tokens_of(spark, d, "chunk-tokens", _chunks(spark, d))


def _vector_index(spark, d):
    """The maintained index's vectors."""
    return kept(spark, d, "vector-index", lambda: vector_index.build(vectors(spark, d)))


def _hits(spark, d):
    return search.with_chunks(search.bm25(_chunk_tokens(spark, d), questions(spark, d), HITS), _chunks(spark, d))


def _variants(spark, d):
    """The question, the question without its first word, and words that nothing holds."""
    rows = questions(spark, d)
    texts = F.array(F.col("question"), F.regexp_replace("question", r"^\S+\s*", ""), F.lit("qqzx zzqx"))
    return rows.select("qid", F.posexplode(texts).alias("n", "query")).select("qid", (F.col("n") + 1).alias("variant_ord"), "query")


def _variant_hits(spark, d):
    chunks, variants = _chunks(spark, d), _variants(spark, d)
    found = search.bm25(_chunk_tokens(spark, d), variants.select(F.struct("qid", "variant_ord").alias("qid"), "query"), HITS)
    return search.with_chunks(found.select("qid.qid", "qid.variant_ord", "chunk_id", "score", "rank"), chunks)


def index_postings(spark, d):
    rows = search.postings(_chunk_tokens(spark, d))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def bm25_topk(spark, d):
    return search.bm25(_whole_tokens(spark, d), questions(spark, d))


def vector_topk(spark, d):
    return search.nearest(_vector_index(spark, d), vectors(spark, d).select(F.col("chunk_id").alias("qid"), "vector").where("cast(qid as long) % 100 = 0"))


def rrf_fusion(spark, d):
    asked = _question_vectors(spark, d)
    return search.fuse(search.bm25(_whole_tokens(spark, d), asked), search.nearest(_vector_index(spark, d), asked))


def hybrid_topk(spark, d):
    return search.hybrid(_whole_tokens(spark, d), _vector_index(spark, d), _question_vectors(spark, d)).select("qid", "chunk_id", "score", "rank")


def _layout(spark, d):
    """Fused hits whose texts are layout projections for every second document, and questions that ask for relations."""
    fused = rrf_fusion(spark, d).join(documents(spark, d).select(F.col("source_key").alias("chunk_id"), "source_name", "doc_id", "text").hint("merge"), "chunk_id")
    is_layout = F.col("doc_id") % 2 == 0
    text = F.when(is_layout, F.concat(F.lit("[ORG_CHART]\nPage: "), (F.col("doc_id") % 5).cast("string"), F.lit("\nStructure:\n"), "text")).otherwise(F.col("text"))
    fused = fused.withColumn("text", text).withColumn("source_type", F.when(is_layout, "org_chart").otherwise("text"))
    asked = questions(spark, d).select("qid", F.concat(F.when(F.col("qid") % 2 == 0, "who reports to ").otherwise("about "), F.element_at(F.split("query", " "), 4)).alias("query"))
    return fused, asked


def rank_explain(spark, d):
    fused, asked = _layout(spark, d)
    rows = search.with_intent(fused, asked).where("rank <= 10")
    return rows.select("qid", "chunk_id", "rank_fts", "rank_vector", "score", "rank", F.col("triggered").alias("intent_triggered"), F.col("applied").alias("intent_applied"), "source_type")


def focus_pages(spark, d):
    fused, asked = _layout(spark, d)
    return search.focus_pages(fused, asked).select("qid", "chunk_id", F.col("rank").alias("rank"))


def focus_expansion(spark, d):
    _, asked = _layout(spark, d)
    return search.with_focus(search.bm25(_whole_tokens(spark, d), questions(spark, d)), _whole_tokens(spark, d), asked)


def rerank_candidates(spark, d):
    fused = stored(rrf_fusion(spark, d), "fused")
    scores = fused.where("pmod(cast(chunk_id as long), 3) > 0").select("qid", "chunk_id", (F.pmod(F.col("chunk_id").cast("long") * 37 + F.col("qid"), F.lit(101)) / 101.0).alias("score"))
    return search.rerank(fused, scores, 10).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def source_keyword_hits(spark, d):
    words = questions(spark, d).select(F.col("qid").alias("kid"), F.concat(F.lit("SRC"), F.col("qid").cast("string")).alias("keyword"))
    scores = search.best_scores(_chunk_tokens(spark, d), questions(spark, d), 3, "source_name")
    return search.keyword_hits(scores, _chunks(spark, d), words, 3).select("qid", "kid", "chunk_id", "rank")


def channel_diagnostics(spark, d):
    asked = _question_vectors(spark, d)
    lists = search.bm25(_whole_tokens(spark, d), asked).select("qid", "chunk_id", "rank", F.lit("fts").alias("channel")).unionByName(search.nearest(_vector_index(spark, d), asked).select("qid", "chunk_id", "rank", F.lit("vector").alias("channel")))
    return evidence.channel_counts(lists.join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("label")).hint("merge"), "chunk_id"))


def support_filter(spark, d):
    return evidence.supported(_hits(spark, d), questions(spark, d)).select("qid", "chunk_id", "score", "support_rank")


def neighbor_expand(spark, d):
    chunks = _chunks(spark, d)
    return evidence.expand_neighbours(_hits(spark, d), chunks).select("qid", "chunk_id", "score", "role")


def _asked_twice(spark, d):
    return questions(spark, d).unionByName(questions(spark, d).select((-1 - F.col("qid")).alias("qid"), "query", "question"))


def fidelity_report(spark, d):
    """Every question, and one as many again that was never asked."""
    chunks = _chunks(spark, d)
    return evidence.fidelity_report(_asked_twice(spark, d), evidence.expand_neighbours(_hits(spark, d), chunks), chunks)


def evidence_report(spark, d):
    return evidence.evidence_report(_asked_twice(spark, d), _hits(spark, d))


def bm25_evidence(spark, d):
    """Chunking, index, search and the status of each question's evidence with its best source."""
    hits = _hits(spark, d)
    best = evidence.top_sources(hits).where("n = 1").select("qid", F.col("source_name").alias("best_source"))
    return evidence.evidence_report(questions(spark, d), hits).join(best.hint("merge"), "qid", "left")


def top_sources(spark, d):
    return evidence.top_sources(_hits(spark, d))


def topic_dossier(spark, d):
    return evidence.dossier(_variant_hits(spark, d))


def topic_coverage(spark, d):
    """Coverage of each question's variants; of every fifth question only what nothing holds."""
    variants, hits = _variants(spark, d), _variant_hits(spark, d).where("qid % 5 > 0")
    rows = evidence.dossier_coverage(variants, hits)
    types = F.array_join(F.transform(F.map_entries("source_types"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return rows.select("qid", "source_count", "chunk_count", types.alias("source_types"), "low_evidence")


def variant_union(spark, d):
    return evidence.keep_first(_variant_hits(spark, d), "variant_ord", "rank").select("qid", "chunk_id", "variant_ord", "rank")


def missing_variants(spark, d):
    return evidence.missing_variants(_variants(spark, d), _variant_hits(spark, d))


def source_references(spark, d):
    return evidence.source_references(_hits(spark, d))


def source_status(spark, d):
    answers = questions(spark, d).select("qid", F.when(F.col("qid") % 3 == 0, "资料不足").otherwise("ok").alias("answer"))
    return evidence.source_status(questions(spark, d), _hits(spark, d).where("qid % 4 > 0 or source_type = 'generated_asset'"), answers)


def context_packing(spark, d):
    rows = evidence.context_text(_hits(spark, d))
    return rows.select("qid", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_hash"))


QUERIES = {f.__name__: f for f in (
    index_postings, bm25_topk, vector_topk, rrf_fusion, hybrid_topk, rank_explain, focus_pages, focus_expansion, rerank_candidates, source_keyword_hits, channel_diagnostics, support_filter, neighbor_expand,
    fidelity_report, evidence_report, bm25_evidence, top_sources, topic_dossier, topic_coverage, variant_union, missing_variants, source_references, source_status, context_packing,
)}


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(translate(lower({x}), '{MARKED}', '{PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(index: str, queries: str, top: int, name: str = "bm") -> str:
    """CTEs that end in {name}(qid, chunk_id, score, rank) for index(chunk_id, text) and queries(qid, query)."""
    return f"""{name}_p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM {index}) GROUP BY 1, 2),
{name}_l AS (SELECT chunk_id, len({_tokens('text')}) AS dl FROM {index}), {name}_c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_q AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_tokens('query')}[1:10]) AS term FROM {queries}) GROUP BY 1, 2), {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_s AS (SELECT qid, chunk_id, round(sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_d USING (term) JOIN {name}_l USING (chunk_id), {name}_c GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {top})"""


def nearest_sql(queries: str, name: str = "nn", top: int = 10) -> str:
    distance = "round(list_sum(list_transform(list_zip(q.vector::DOUBLE[], e.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
    return f"""{name}_d AS (SELECT qid, CAST(vec_id AS VARCHAR) AS chunk_id, {distance} AS d FROM {queries} q, embeddings e),
{name} AS (SELECT qid, chunk_id, round(1 / (1 + d), 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) AS INTEGER) AS rank FROM {name}_d) WHERE rank <= {top})"""


_INDEX = "idx AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents)"
_ASKED = "asked AS (SELECT item_id AS qid, text AS query, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id)"
_ORDER = "{0} DESC, (rank_fts IS NOT NULL AND rank_vector IS NOT NULL) DESC, rank_vector NULLS LAST, rank_fts NULLS LAST"
_FUSED = f"""{_INDEX}, {_ASKED}, {bm25_sql('idx', 'asked', 10)}, {nearest_sql('asked')},
f0 AS (SELECT coalesce(bm.qid, nn.qid) AS qid, coalesce(bm.chunk_id, nn.chunk_id) AS chunk_id, bm.rank AS rank_fts, nn.rank AS rank_vector, round(coalesce(1 / (60 + bm.rank), 0) + coalesce(1 / (60 + nn.rank), 0), 9) AS score FROM bm FULL JOIN nn ON bm.qid = nn.qid AND bm.chunk_id = nn.chunk_id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_ORDER.format('score')}) AS INTEGER) AS rank FROM f0)"""
_QUESTIONS = "qs AS (SELECT item_id AS qid, text AS query FROM benchmark)"
_CORPUS = f"""{CHUNKS}, corpus AS (SELECT source_key || '#' || chunk_index AS chunk_id, source_key, CAST(chunk_index AS INTEGER) AS chunk_index, c.text, source AS source_name, CASE WHEN doc_id % 5 = 0 THEN 'generated_asset' WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'text' END AS source_type FROM chunks c JOIN documents ON doc_id = CAST(source_key AS BIGINT))"""
_HITS = f"{_CORPUS}, {_QUESTIONS}, {bm25_sql('corpus', 'qs', HITS)}, hits AS (SELECT * FROM bm JOIN corpus USING (chunk_id))"
_VARIANTS = r"vs AS (SELECT item_id * 10 + n AS qid, [text, regexp_replace(text, '^\S+\s*', ''), 'qqzx zzqx'][n] AS query FROM benchmark, (SELECT unnest([1, 2, 3]) AS n))"
_VHITS = f"{_CORPUS}, {_VARIANTS}, {bm25_sql('corpus', 'vs', HITS)}, vhits AS (SELECT qid // 10 AS qid, CAST(qid % 10 AS INTEGER) AS variant_ord, * EXCLUDE (qid) FROM bm JOIN corpus USING (chunk_id))"
_LAYOUT = f"""{_FUSED}, lay AS (SELECT fused.*, source AS source_name, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'org_chart' ELSE 'text' END AS source_type, lower(text) AS low, doc_id % 5 AS page FROM fused JOIN documents ON doc_id = CAST(chunk_id AS BIGINT)),
lq AS (SELECT item_id AS qid, string_split(text, ' ')[4] AS word, item_id % 2 = 0 AS triggered FROM benchmark)"""
_EXPANDED = f"""{_HITS}, near AS (SELECT h.qid, c.chunk_id, c.source_key, c.chunk_index, min((h.rank, o, h.score)) AS key FROM hits h, (SELECT unnest([-1, 1]) AS o) JOIN corpus c ON true WHERE c.source_key = h.source_key AND c.chunk_index = h.chunk_index + o AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.qid = h.qid AND x.chunk_id = c.chunk_id) GROUP BY ALL),
added AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY key[1], key[2]) AS n FROM near),
expanded AS (SELECT qid, chunk_id, source_key, chunk_index, score, 'retrieved' AS role FROM hits UNION ALL SELECT qid, chunk_id, source_key, chunk_index, key[3], CASE WHEN key[2] < 0 THEN 'context_before' ELSE 'context_after' END FROM added WHERE n <= 6)"""
_EXPANDED = _EXPANDED.replace("hits h, (SELECT unnest([-1, 1]) AS o) JOIN corpus c ON true", "hits h, (SELECT unnest([-1, 1]) AS o), corpus c")
_REPORT = "CASE WHEN chunk_count = 0 THEN 'no_answer' WHEN source_count < 2 OR chunk_count < 2 THEN 'thin' ELSE 'grounded' END"
_COUNTED = "counted AS (SELECT q.qid, count(DISTINCT source_name) AS source_count, count(chunk_id) AS chunk_count FROM {0} q LEFT JOIN hits h ON h.qid = q.qid GROUP BY 1), rep AS (SELECT *, " + _REPORT + " AS coverage_status FROM counted)"
_TOPS = "tops AS (SELECT qid, source_name, count(*) AS chunk_count, CAST(row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, min(rank)) AS INTEGER) AS n FROM hits GROUP BY 1, 2)"

ORACLE = {
    "index_postings": f"WITH {_CORPUS}, t AS (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM corpus) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM t GROUP BY 1",
    "bm25_topk": f"WITH {_INDEX}, {_QUESTIONS}, {bm25_sql('idx', 'qs', 10)} SELECT qid, chunk_id, score, rank FROM bm",
    "vector_topk": f"WITH vq AS (SELECT CAST(vec_id AS VARCHAR) AS qid, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0), {nearest_sql('vq')} SELECT * FROM nn",
    "rrf_fusion": f"WITH {_FUSED} SELECT * FROM fused",
    "hybrid_topk": f"WITH {_FUSED} SELECT qid, chunk_id, score, rank FROM fused WHERE rank <= 10",
    "rank_explain": f"""WITH {_LAYOUT}, b AS (SELECT lay.*, triggered, triggered AND source_type = 'org_chart' AS applied, score + CASE WHEN triggered AND source_type = 'org_chart' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END AS os FROM lay JOIN lq USING (qid))
      SELECT * FROM (SELECT qid, chunk_id, rank_fts, rank_vector, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_ORDER.format('os')}) AS INTEGER) AS rank, triggered AS intent_triggered, applied AS intent_applied, source_type FROM b) WHERE rank <= 10""",
    "focus_expansion": f"""WITH {_INDEX}, {_QUESTIONS}, {bm25_sql('idx', 'qs', 10)}, fw AS (SELECT item_id AS qid, list_filter(regexp_split_to_array('who reports to ' || string_split(text, ' ')[4], '[^A-Za-z]+'), lambda z: length(z) >= 3 AND lower(z) NOT IN ({", ".join(repr(w) for w in FOCUS_STOP)})) AS ws FROM benchmark WHERE item_id % 2 = 0),
      fd AS (SELECT qid, list_filter(ws, lambda z, i: list_position(ws, z) = i) AS ws FROM fw), fq AS (SELECT qid * 100 + i AS qid, ws[i] AS query FROM (SELECT qid, ws, unnest(range(1, len(ws) + 1)) AS i FROM fd)), {bm25_sql('idx', 'fq', 5, 'own')},
      u AS (SELECT qid, chunk_id, 0 AS segment, rank AS place FROM bm UNION ALL SELECT qid // 100, chunk_id, qid % 100, rank FROM own), f AS (SELECT qid, chunk_id, min((segment, place)) AS first FROM u GROUP BY 1, 2)
      SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY first, chunk_id) AS INTEGER) AS rank FROM f""",
    "source_keyword_hits": f"WITH {_CORPUS}, {_QUESTIONS}, {bm25_sql('corpus', 'qs', 1)}, held AS (SELECT source_name, kid FROM (SELECT DISTINCT source_name FROM corpus), (SELECT item_id AS kid FROM benchmark) WHERE contains(source_name, 'src' || kid)) SELECT * FROM (SELECT qid, kid, chunk_id, CAST(row_number() OVER (PARTITION BY qid, kid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm_s JOIN corpus USING (chunk_id) JOIN held USING (source_name)) WHERE rank <= 3",
    "rerank_candidates": f"""WITH {_FUSED}, s AS (SELECT *, CASE WHEN CAST(chunk_id AS BIGINT) % 3 > 0 AND rank <= 10 THEN (CAST(chunk_id AS BIGINT) * 37 + qid) % 101 / 101.0::DOUBLE END AS new FROM fused)
      SELECT qid, chunk_id, round(coalesce(new, score), 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN new IS NOT NULL THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END, -new, rank) AS INTEGER) AS rank FROM s""",
    "channel_diagnostics": f"WITH {_FUSED}, l AS (SELECT qid, chunk_id, rank, 'fts' AS channel FROM bm UNION ALL SELECT qid, chunk_id, rank, 'vector' FROM nn) SELECT qid, channel, lang AS label, count(*) AS hits, min(rank) AS best_rank FROM l JOIN documents ON doc_id = CAST(chunk_id AS BIGINT) GROUP BY 1, 2, 3",
    "support_filter": rf"""WITH {_HITS}, a AS (SELECT item_id AS qid, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda z: lower(z)), lambda z: length(z) >= 2) AS anchors FROM benchmark),
      k AS (SELECT h.* FROM hits h JOIN a USING (qid) WHERE len(list_filter(anchors, lambda z: contains(lower(h.text || ' ' || source_name || ' ' || chunk_id), z))) > 0) SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY source_type = 'generated_asset', score DESC, chunk_id) AS INTEGER) AS support_rank FROM k""",
    "neighbor_expand": f"WITH {_EXPANDED} SELECT qid, chunk_id, score, role FROM expanded",
    "fidelity_report": f"""WITH {_EXPANDED}, f AS (SELECT qid, count(*) FILTER (role = 'retrieved') AS original_chunks, count(*) AS final_chunks, count(*) FILTER (role <> 'retrieved') AS added_chunks, count(DISTINCT e.source_key) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars,
      CASE WHEN count(DISTINCT e.source_key) > 1 THEN 'fragmented' WHEN max(e.chunk_index) - min(e.chunk_index) + 1 = count(*) THEN 'continuous' ELSE 'gapped' END AS continuity FROM expanded e JOIN corpus USING (chunk_id) GROUP BY qid)
      SELECT qid, coalesce(original_chunks, 0) AS original_chunks, coalesce(final_chunks, 0) AS final_chunks, coalesce(added_chunks, 0) AS added_chunks, coalesce(sources, 0) AS sources, coalesce(chars, 0) AS chars, coalesce(continuity, 'empty') AS continuity FROM (SELECT qid FROM qs UNION ALL SELECT -1 - qid FROM qs) LEFT JOIN f USING (qid)""",
    "evidence_report": f"WITH {_HITS}, q2 AS (SELECT qid FROM qs UNION ALL SELECT -1 - qid FROM qs), {_COUNTED.format('q2')} SELECT *, coverage_status <> 'grounded' AS low_evidence FROM rep",
    "bm25_evidence": f"WITH {_HITS}, {_COUNTED.format('qs')}, {_TOPS} SELECT rep.*, coverage_status <> 'grounded' AS low_evidence, source_name AS best_source FROM rep LEFT JOIN tops ON tops.qid = rep.qid AND n = 1",
    "top_sources": f"WITH {_HITS}, {_TOPS} SELECT * FROM tops",
    "topic_dossier": f"""WITH {_VHITS}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY variant_ord, rank) AS seen FROM vhits)
      SELECT qid, source_name, count(*) AS chunk_count, arg_min(source_type, (variant_ord, rank)) AS source_type, CAST(row_number() OVER (PARTITION BY qid ORDER BY min((variant_ord, rank))) AS INTEGER) AS group_ord FROM f WHERE seen = 1 GROUP BY 1, 2""",
    "topic_coverage": f"""WITH {_VHITS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY variant_ord, rank) AS seen FROM vhits WHERE qid % 5 > 0) WHERE seen = 1), k AS (SELECT qid, string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS source_types FROM (SELECT qid, source_type, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
      g AS (SELECT qid, count(DISTINCT source_name) AS s, count(*) AS c FROM f GROUP BY 1) SELECT item_id AS qid, coalesce(s, 0) AS source_count, coalesce(c, 0) AS chunk_count, coalesce(source_types, '') AS source_types, c IS NULL AS low_evidence FROM benchmark LEFT JOIN g ON g.qid = item_id LEFT JOIN k ON k.qid = item_id""",
    "focus_pages": rf"""WITH {_LAYOUT}, w AS (SELECT item_id AS qid, list_filter(regexp_split_to_array('who reports to ' || string_split(text, ' ')[4], '[^A-Za-z]+'), lambda z: length(z) >= 3 AND lower(z) NOT IN ({", ".join(repr(w) for w in FOCUS_STOP)})) AS ws FROM benchmark),
      h AS (SELECT lay.*, triggered, source_type = 'org_chart' AS layout, len(list_filter(ws, lambda z: regexp_matches(low, '(?:^|[^\p{{L}}\p{{N}}_])' || lower(z) || '(?:[^\p{{L}}\p{{N}}_]|$)'))) > 0 AS holds FROM lay JOIN lq USING (qid) JOIN w USING (qid)),
      p AS (SELECT DISTINCT qid, source_name, page FROM h WHERE triggered AND layout AND holds), n AS (SELECT DISTINCT qid, source_name FROM p),
      s AS (SELECT h.qid, chunk_id, h.rank, CASE WHEN h.qid NOT IN (SELECT qid FROM p) THEN 0 WHEN NOT layout AND n.qid IS NOT NULL THEN 2 WHEN layout AND p.qid IS NOT NULL AND holds THEN 0 WHEN layout AND p.qid IS NOT NULL THEN 1 END AS segment FROM h LEFT JOIN p ON p.qid = h.qid AND p.source_name = h.source_name AND p.page = h.page LEFT JOIN n ON n.qid = h.qid AND n.source_name = h.source_name)
      SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY segment, rank) AS INTEGER) AS rank FROM s WHERE segment IS NOT NULL""",
    "variant_union": f"WITH {_VHITS} SELECT qid, chunk_id, variant_ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY variant_ord, rank) AS seen FROM vhits) WHERE seen = 1",
    "missing_variants": f"WITH {_VHITS} SELECT qid // 10 AS qid, CAST(qid % 10 AS INTEGER) AS variant_ord, 'No chunks were retrieved for ' || query || '.' AS missing FROM vs WHERE NOT EXISTS (SELECT 1 FROM bm WHERE bm.qid = vs.qid)",
    "source_references": f"WITH {_HITS} SELECT qid, source_name || '#' || chunk_index AS ref, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS INTEGER) AS n FROM hits GROUP BY 1, 2",
    "source_status": f"""WITH {_HITS}, k AS (SELECT qid, bool_and(source_type = 'generated_asset') AS g, count(*) AS n FROM hits WHERE qid % 4 > 0 OR source_type = 'generated_asset' GROUP BY 1),
      s AS (SELECT qs.qid, n, CASE WHEN g THEN 'generated_only' WHEN n IS NULL OR qs.qid % 3 = 0 THEN 'no_answer' ELSE 'grounded' END AS source_status FROM qs LEFT JOIN k USING (qid)) SELECT qid, source_status, CASE WHEN source_status = 'grounded' THEN n ELSE 0 END AS n_sources FROM s""",
    "context_packing": f"WITH {_HITS}, c AS (SELECT qid, string_agg('[' || rank || '] (' || CASE WHEN source_type = 'generated_asset' THEN 'secondary' ELSE 'primary' END || ') ' || source_name || '#' || chunk_index || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS c FROM hits GROUP BY 1) SELECT qid, length(c) AS n_chars, md5(c) AS context_hash FROM c",
}
