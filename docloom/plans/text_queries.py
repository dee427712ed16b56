"""Queries over texts: hashes, lines, verdicts, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import questions as q
from docloom.functions import text as t
from docloom.operators import chunking, evidence, quality, registry
from docloom.operators.storage import scratch, stored
from docloom.plans.inputs import documents, marked_documents, pages_of_sources, questions, table
from docloom.sources import files

SHARE = 0.04
#: Markers of follow-ups in the given conversations.
TURN_RULES = {"markers": ["that", "this"], "start": "^(?:And|The|Of)"}


def content_hash(spark, d):
    return documents(spark, d).select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))


def content_dedup(spark, d):
    rows = registry.duplicates(documents(spark, d).select("doc_id", "text"), t.content_hash(F.col("text")), "doc_id")
    return rows.select("doc_id", F.when(F.col("doc_id") != F.col("survivor"), F.col("survivor")).alias("duplicate_of"))


def line_features(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("line_no", "raw"))
    line = t.strip(F.col("raw"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), t.is_page_line(line).alias("page_line"), t.is_watermark_line(line).alias("watermark"), t.normalized_line(F.col("raw")).alias("line"))


def page_repeated_lines(spark, d):
    return quality.repeated_lines(pages_of_sources(spark, d), SHARE)


def clean_boilerplate(spark, d):
    return quality.clean_pages(pages_of_sources(spark, d), SHARE).select("source_id", "page", "cleaned")


def paged_quality(spark, d):
    return quality.paged_quality(quality.clean_pages(pages_of_sources(spark, d), SHARE)).select("source_id", "page_count", "non_empty_pages", "valid_ratio", "short_line_ratio", "watermark_ratio", "unique_line_ratio", "chars_per_page", "status", "action")


def text_quality(spark, d):
    return quality.text_quality(documents(spark, d)).select("doc_id", F.col("char_count").cast("long").alias("char_count"), "valid_ratio", "suspicious_ratio", "short_line_ratio", "unique_line_ratio", "reason", "status", "action")


def ocr_quality(spark, d):
    return quality.ocr_quality(documents(spark, d)).select("doc_id", "valid_ratio", "short_line_ratio", "unique_line_ratio", "reason", "status", "action")


def coverage_record(spark, d):
    kept = quality.coverage_record(documents(spark, d))
    return kept.select("doc_id", "format", "coverage_status", *(F.col(c).cast("long").alias(c) for c in ("characters", "line_count", "paragraph_count")))


def review_routing(spark, d):
    verdicts = quality.coverage_record(quality.ocr_quality(documents(spark, d)))
    return quality.review_route(verdicts).groupBy("source_name", "route").agg(F.count("*").alias("documents"))


def manual_entries(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    return quality.manual_documents(turns.select("conv_id", "turn", "text")).select("conv_id", "turn", "source_type", "text", "status", "action", "valid_ratio", "page_count")


def text_corpus(spark, d):
    """The documents as files, every third one of Markdown, read back with the counts of each."""
    folder = scratch(spark, "files")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt"))
    stored(files.write_texts(documents(spark, d).select(name.alias("name"), "text"), folder), "file-names")
    rows = files.read_texts(spark, folder)
    return rows.select("source_name", "source_type", *(F.col(c).cast("long").alias(c) for c in ("characters", "line_count")), t.content_hash(F.col("text")).alias("content_hash"))


def heading_words(spark, d):
    spaced = F.regexp_replace("text", "([A-Za-z])(?=[A-Za-z])", "$1 ")
    return documents(spark, d).select("doc_id", t.joined_heading(F.concat(spaced, F.lit("   "), "source_name")).alias("heading"))


def chunk_noise(spark, d):
    rows = chunking.chunk_documents(documents(spark, d).withColumn("source_type", F.lit("text")))
    return rows.groupBy(t.noise_label(F.col("text")).alias("label"), t.is_contents_noise(F.col("text")).alias("noise")).agg(F.count("*").alias("chunks"))


def compact_text(spark, d):
    return documents(spark, d).select("doc_id", t.compact(F.col("text"), 80).alias("short"), F.md5(t.compact_key(F.col("text"))).alias("key_hash"))


def answer_modes(spark, d):
    text = F.concat("text", F.when(F.col("turn") % 5 == 0, " as slides").when(F.col("turn") % 5 == 1, " a decision memo").when(F.col("turn") % 5 == 2, " Lessons learned").otherwise(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", q.answer_mode(text, F.when(F.col("conv_id") % 7 == 0, "en").otherwise("zh")).alias("m"))
    return rows.groupBy("m.mode", "m.reason").agg(F.count("*").alias("turns"))


def followup_resolution(spark, d):
    return evidence.resolve_follow_ups(table(spark, d, "conversations"), **TURN_RULES)


def anchor_terms(spark, d):
    return questions(spark, d).select("qid", F.array_join(q.anchor_terms(F.col("question")), " ").alias("anchors"))


def _titled_questions(spark, d):
    head = F.when(F.col("qid") % 3 == 0, "ABC project ").when(F.col("qid") % 3 == 1, "Interview at Docloom about ").otherwise("")
    return questions(spark, d).select("qid", F.concat(head, "question").alias("question"))


def query_expansion(spark, d):
    """Every document's title is a hint for one of the questions."""
    several = table(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("several"))  # one row
    titles = table(spark, d, "documents").join(F.broadcast(several)).select((F.col("doc_id") % F.col("several")).alias("qid"), F.col("doc_id").cast("int").alias("n"), F.concat(F.lit("abc_retro-"), "source").alias("title"))
    return evidence.expand_queries(_titled_questions(spark, d), titles)


def relation_focus(spark, d):
    head = F.when(F.col("turn") % 3 == 0, "Who reports to ").when(F.col("turn") % 3 == 1, "How to read charts under ").otherwise("People under Anna Berg and ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(head, "text").alias("query"))
    return rows.select("conv_id", "turn", q.is_relation_question(F.col("query")).alias("relation"), F.array_join(q.focus_tokens(F.col("query")), " ").alias("focus"), F.array_join(q.under_anchors(F.col("query")), " ").alias("anchors"))


def answer_filters(spark, d):
    text = F.concat("text", F.when(F.col("turn") % 4 == 1, "（资料不足）\n来源：a").when(F.col("turn") % 4 == 3, "\n 来源: b").otherwise(""))
    rows = table(spark, d, "conversations").where("role <> 'user'").select("conv_id", "turn", text.alias("answer"))
    return rows.select("conv_id", "turn", q.is_no_answer(F.col("answer")).alias("no_answer"), t.without_references(F.col("answer")).alias("body"))


def display_names(spark, d):
    name = F.concat(F.lit("manual_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, name).otherwise(F.col("event_type")).alias("name"))
    return rows.select("event_id", t.display_name(F.col("name")).alias("shown"))


def metadata_codec(spark, d):
    """Events' attributes to a sorted JSON text and back; broken JSON stays as it is."""
    text = F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(t.packed(user_id=F.col("user_id"), event_type=F.col("event_type")))
    rows = table(spark, d, "events").select("event_id", t.unpacked(text, "event_type string, user_id long").alias("s"))
    return rows.select("event_id", F.col("s.metadata.user_id").alias("user_id"), F.coalesce("s.metadata.event_type", "s.raw").alias("event_type"))


def chunk_windows(spark, d):
    rows = chunking.windows(chunking.paragraphs(documents(spark, d)))
    return rows.select("source_key", "section", F.col("w").cast("long").alias("w"), "text")


def markdown_sections(spark, d):
    return chunking.markdown_sections(marked_documents(spark, d)).select("source_key", F.col("section").cast("long").alias("section"), "text", "breadcrumb")


def chunk_documents(spark, d):
    return chunking.chunk_documents(documents(spark, d)).select("chunk_id", "source_key", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def chunk_limit(spark, d):
    return chunking.within_limit(chunking.chunk_documents(documents(spark, d)), 10)


def prepared_chunks(spark, d):
    rows = documents(spark, d).select("source_key", F.lit(0).alias("ord"), "text", (F.col("doc_id") % 3 == 0).alias("is_pre_chunked"))
    return chunking.chunk_prepared(rows).select("chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_hash"))


def line_packing(spark, d):
    rows = documents(spark, d).select("source_key", F.lit("# part").alias("header"), F.posexplode(t.lines(F.col("text"))).alias("ord", "line"))
    return chunking.pack_lines(rows)


def spaced_letters(spark, d):
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("H O W T O R E A D "), "text").alias("text"))
    return rows.select("doc_id", quality.join_spaced_letters(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (
    content_hash, content_dedup, line_features, page_repeated_lines, clean_boilerplate, paged_quality, text_quality, ocr_quality, coverage_record, review_routing, manual_entries, text_corpus, heading_words, chunk_noise,
    compact_text, answer_modes, followup_resolution, anchor_terms, query_expansion, relation_focus, answer_filters, display_names, metadata_codec, chunk_windows, markdown_sections, chunk_documents, chunk_limit, prepared_chunks, line_packing, spaced_letters,
)}


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN ends_with({x}, chr(10)) THEN string_split({x}, chr(10))[:-2] ELSE string_split({x}, chr(10)) END)"


def ratio(a: str, b: str) -> str:
    return f"floor(({a}) * 1000.0::DOUBLE / greatest({b}, 1) + 0.5::DOUBLE) / 1000.0::DOUBLE"


def heading_sql(x: str) -> str:
    """joined_heading of x."""
    flat = strip(f"regexp_replace({x}, '[\\r\\n]+', ' ', 'g')")
    parts = f"list_transform(list_filter(regexp_split_to_array({flat}, '\\s{{2,}}'), lambda p: {strip('p')} <> ''), lambda p: {collapse('p')})"
    whole = f"len(string_split(p, ' ')) >= 3 AND len(list_filter(string_split(p, ' '), lambda z: NOT regexp_matches(z, '^[A-Za-z0-9&/(),.-]$'))) = 0"
    return strip(f"array_to_string(list_transform({parts}, lambda p: CASE WHEN {whole} THEN replace(p, ' ', '') ELSE p END), ' ')")


def filled(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda z: {strip('z')}), lambda z: z <> '')"


_PAGE = r"'^(?:[0-9]{1,4}|(?i:page)\s*[0-9]{1,4}|第\s*[0-9]{1,4}\s*页|-\s*[0-9]{1,4}\s*-)$'"
_MARK = "(" + " OR ".join(f"contains(lower(l), '{w}')" for w in t.WATERMARKS) + ")"
_LINES = f"rows AS (SELECT doc_id, source, i - 1 AS line_no, ls[i] AS raw FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, {lines('text')} AS ls FROM documents))), feat AS (SELECT *, {strip('raw')} AS l, {collapse('lower(raw)')} AS line FROM rows)"
_REPEATED = f"""{_LINES}, counts AS (SELECT source, count(DISTINCT doc_id) AS page_count FROM documents GROUP BY source HAVING count(DISTINCT doc_id) >= 3),
seen AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM feat WHERE line <> '' AND NOT regexp_matches(l, {_PAGE}) GROUP BY source, line HAVING count(DISTINCT doc_id) >= 2),
repeated AS (SELECT source, line, pages FROM seen JOIN counts USING (source) WHERE pages >= ceil(page_count * {SHARE}::DOUBLE))"""
_CLEAN = f"""{_REPEATED}, kept AS (SELECT doc_id, string_agg(CASE WHEN l = '' THEN '' ELSE raw END, chr(10) ORDER BY line_no) AS text FROM feat f WHERE NOT regexp_matches(l, {_PAGE}) AND NOT {_MARK} AND NOT EXISTS (SELECT 1 FROM repeated r WHERE r.source = f.source AND r.line = f.line) GROUP BY doc_id),
clean AS (SELECT d.source AS source_id, d.doc_id AS page, d.text, coalesce({strip('k.text')}, '') AS cleaned FROM documents d LEFT JOIN kept k USING (doc_id))"""
_UNIQUE = f"CASE WHEN len(fl) = 0 THEN 0.0::DOUBLE ELSE {ratio('len(list_distinct(list_transform(fl, lambda z: ' + collapse('lower(z)') + ')))', 'least(len(fl), 10)')} END"
_MEASURED = rf"""m AS (SELECT doc_id, source, bare, fl, length(bare) AS char_count, len(fl) AS line_count, length(regexp_replace(bare, '[^\x{{fffd}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g')) AS suspicious,
  {ratio(r"length(regexp_replace(bare, '[^\p{L}\p{N}]', '', 'g'))", 'length(bare)')} AS valid_ratio, {ratio('len(list_filter(fl, lambda z: length(z) < 10))', 'len(fl)')} AS short_line_ratio, {_UNIQUE} AS unique_line_ratio
  FROM (SELECT doc_id, source, {strip('text')} AS bare, {filled('text')} AS fl FROM documents))"""
_OCR = f"{_MEASURED}, o AS (SELECT *, CASE WHEN char_count < 80 THEN 'short' WHEN valid_ratio < 0.45::DOUBLE THEN 'unreadable' WHEN unique_line_ratio < 0.35::DOUBLE AND line_count >= 3 THEN 'repeated' END AS reason FROM m)"
_STARTS = "range(0, greatest(0, CAST(ceil((length(p) - 1024) / 896.0) AS BIGINT) * 896) + 1, 896)"
CHUNKS = rf"""paras AS (SELECT doc_id, i - 1 AS section, {strip('parts[i]')} AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents))),
wins AS (SELECT doc_id, section, i - 1 AS w, substr(p, starts[i] + 1, 1024) AS text FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM (SELECT *, {_STARTS} AS starts FROM paras WHERE p <> ''))),
noise AS (SELECT *, {strip('text')} AS bare, {filled('text')} AS fl FROM wins),
label AS (SELECT *, CASE WHEN length(bare) < 30 THEN 'short' WHEN regexp_matches(bare, '^[.\s·…0-9]+$') THEN 'pure_dotted' WHEN len(fl) > 0 AND len(list_filter(fl, lambda z: regexp_matches(z, '[.\s·…0-9]{{20,}}'))) * 2 > len(fl) THEN 'mixed_toc' ELSE '' END AS label FROM noise),
chunks AS (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS source_key, row_number() OVER (PARTITION BY doc_id ORDER BY section, w) - 1 AS chunk_index, text FROM label WHERE NOT (doc_id % 2 = 0 AND label <> '')) WHERE {strip('text')} <> '')"""
_ROLE = "SELECT conv_id, turn, role, text FROM conversations"

ORACLE = {
    "content_hash": f"SELECT doc_id, sha256({strip('text')}) AS content_hash FROM documents",
    "content_dedup": f"SELECT doc_id, CASE WHEN doc_id <> s THEN s END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {strip('text')}) AS s FROM documents)",
    "line_features": f"WITH {_LINES} SELECT doc_id, line_no, regexp_matches(l, {_PAGE}) AS page_line, {_MARK} AS watermark, line FROM feat",
    "page_repeated_lines": f"WITH {_REPEATED} SELECT source AS source_id, line, pages FROM repeated",
    "clean_boilerplate": f"WITH {_CLEAN} SELECT source_id, page, cleaned FROM clean",
    "paged_quality": f"""WITH {_CLEAN}, l AS (SELECT source_id, page, length({strip('text')}) AS rc, length(cleaned) AS cc, {filled('text')} AS rl, {filled('cleaned')} AS cl FROM clean),
      g AS (SELECT source_id, count(DISTINCT page) AS page_count, count(*) FILTER (rc > 0) AS non_empty_pages, sum(rc) AS rc, sum(cc) AS cc, sum(len(rl)) AS rl, sum(len(cl)) AS cl, sum(len(list_filter(rl, lambda z: length(z) < 10))) AS sl FROM l GROUP BY source_id),
      u AS (SELECT source_id, count(DISTINCT {collapse('lower(x)')}) AS dl FROM (SELECT source_id, unnest(cl) AS x FROM l) GROUP BY source_id),
      r AS (SELECT source_id, page_count, non_empty_pages, rc, cc, {ratio('cc', 'rc')} AS valid_ratio, {ratio('sl', 'rl')} AS short_line_ratio, {ratio('greatest(0, rl - cl)', 'rl')} AS watermark_ratio, {ratio('dl', 'least(cl, 10)')} AS unique_line_ratio, floor(cc * 10.0::DOUBLE / page_count + 0.5::DOUBLE) / 10.0::DOUBLE AS chars_per_page, {ratio('non_empty_pages', 'page_count')} AS nr FROM g JOIN u USING (source_id)),
      s AS (SELECT *, CASE WHEN cc = 0 OR nr < 0.15 OR (page_count >= 3 AND chars_per_page < 80) OR (unique_line_ratio < 0.2 AND watermark_ratio > 0.4) OR valid_ratio < 0.1 THEN 'needs_ocr' WHEN watermark_ratio > 0.5 OR short_line_ratio > 0.6 THEN 'low' ELSE 'high' END AS status FROM r)
      SELECT source_id, page_count, non_empty_pages, valid_ratio, short_line_ratio, watermark_ratio, unique_line_ratio, chars_per_page, status, CASE WHEN status = 'needs_ocr' THEN 'needs_ocr_skipped' WHEN status = 'low' THEN 'low_indexed' WHEN cc = rc THEN 'direct' ELSE 'cleaned' END AS action FROM s""",
    "text_quality": f"""WITH {_MEASURED}, s AS (SELECT *, {ratio('suspicious', 'char_count')} AS suspicious_ratio FROM m),
      r AS (SELECT *, CASE WHEN char_count = 0 THEN 'empty' WHEN suspicious >= 3 AND suspicious_ratio > 0.05 THEN 'garbled' WHEN line_count >= 5 AND unique_line_ratio < 0.2::DOUBLE THEN 'repeated' WHEN char_count >= 20 AND valid_ratio < 0.1::DOUBLE THEN 'unreadable' END AS reason FROM s)
      SELECT doc_id, char_count, valid_ratio, suspicious_ratio, short_line_ratio, unique_line_ratio, reason, CASE WHEN reason IS NULL THEN 'high' ELSE 'low' END AS status, CASE WHEN reason IS NULL THEN 'structured_direct' ELSE 'structured_review' END AS action FROM r""",
    "ocr_quality": f"WITH {_OCR} SELECT doc_id, valid_ratio, short_line_ratio, unique_line_ratio, reason, CASE WHEN reason IS NULL THEN 'high' ELSE 'low' END AS status, CASE WHEN reason IS NULL THEN 'image_ocr' ELSE 'image_ocr_low' END AS action FROM o",
    "coverage_record": f"SELECT doc_id, 'text' AS format, CASE WHEN {strip('text')} = '' THEN 'partial' ELSE 'complete' END AS coverage_status, length(text) AS characters, len({lines('text')}) AS line_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip('p')} <> '')) AS paragraph_count FROM documents",
    "review_routing": f"WITH {_OCR} SELECT source AS source_name, CASE WHEN reason IS NOT NULL OR bare = '' THEN 'review_required' ELSE 'direct' END AS route, count(*) AS documents FROM o GROUP BY 1, 2",
    "manual_entries": f"SELECT conv_id, turn, 'manual' AS source_type, {collapse('text')} AS text, 'high' AS status, 'direct' AS action, 1.0::DOUBLE AS valid_ratio, 1 AS page_count FROM conversations WHERE role = 'user'",
    "text_corpus": f"SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS source_name, CASE WHEN doc_id % 3 = 0 THEN 'md' ELSE 'txt' END AS source_type, length(text) AS characters, CAST(len({lines('text')}) AS BIGINT) AS line_count, sha256({strip('text')}) AS content_hash FROM documents",
    "heading_words": rf"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z])', '\1 ', 'g'), '([A-Za-z]) ([^A-Za-z]|$)', '\1\2', 'g') || '   ' || source AS s FROM documents) SELECT doc_id, {heading_sql('s')} AS heading FROM h""",
    "chunk_noise": f"WITH {CHUNKS} SELECT label, label <> '' AS noise, count(*) AS chunks FROM label WHERE {strip('text')} <> '' GROUP BY 1, 2",
    "compact_text": rf"SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 80)) || '...' END AS short, md5(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS key_hash FROM (SELECT doc_id, text, {collapse('text')} AS c FROM documents)",
    "answer_modes": r"""WITH x AS (SELECT conv_id, text || CASE turn % 5 WHEN 0 THEN ' as slides' WHEN 1 THEN ' a decision memo' WHEN 2 THEN ' Lessons learned' ELSE '' END AS t FROM conversations),
      m AS (SELECT CASE WHEN conv_id % 7 = 0 OR regexp_matches(t, '(?i)\benglish report\b') OR contains(t, '英文报告') THEN 'english_report,language_en' WHEN contains(t, '面试故事') OR regexp_matches(t, '(?i)\binterview story\b|\bSTAR\b') THEN 'interview_story,interview_story_keyword' WHEN contains(t, '复盘') OR regexp_matches(t, '(?i)\bretrospective\b|\blessons learned\b') THEN 'retrospective,retrospective_keyword'
        WHEN contains(upper(t), 'PPT') OR contains(t, '幻灯片') OR contains(lower(t), 'slide') THEN 'ppt_outline,ppt_keyword' WHEN contains(t, '决策') OR contains(lower(t), 'decision memo') THEN 'decision_memo,decision_keyword' ELSE 'answer,default' END AS m FROM x)
      SELECT split_part(m, ',', 1) AS mode, split_part(m, ',', 2) AS reason, count(*) AS turns FROM m GROUP BY 1, 2""",
    "followup_resolution": f"""WITH u AS (SELECT conv_id, turn, {collapse('text')} AS now, coalesce(lag({collapse('text')}) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations WHERE role = 'user'),
      f AS (SELECT *, now <> '' AND (contains(now, 'that') OR contains(now, 'this') OR regexp_matches(now, '^(?:And|The|Of)')) AS follows FROM u)
      SELECT conv_id, turn, CASE WHEN follows AND before = '' THEN 'clarification_required' WHEN follows THEN 'resolved' ELSE 'standalone' END AS status, CASE WHEN follows AND before = '' THEN '' WHEN follows THEN before || '；追问：' || now ELSE now END AS resolved_question FROM f""",
    "anchor_terms": r"""WITH t AS (SELECT item_id AS qid, regexp_extract_all(text, '[A-Za-z0-9]+') AS ts FROM benchmark), e AS (SELECT qid, i, lower(ts[i]) AS w FROM (SELECT qid, ts, unnest(range(1, len(ts) + 1)) AS i FROM t)),
      f AS (SELECT qid, w, min(i) AS i FROM e WHERE length(w) >= 2 GROUP BY 1, 2) SELECT qid, coalesce(string_agg(w, ' ' ORDER BY i), '') AS anchors FROM (SELECT item_id AS qid FROM benchmark) LEFT JOIN f USING (qid) GROUP BY qid""",
    "query_expansion": rf"""WITH q AS (SELECT item_id AS qid, {collapse("CASE item_id % 3 WHEN 0 THEN 'ABC project ' WHEN 1 THEN 'Interview at Docloom about ' ELSE '' END || text")} AS question FROM benchmark),
      c AS (SELECT *, CASE WHEN regexp_matches(question, '(?i)(?:^|[^\p{{L}}\p{{N}}_])interview(?:[^\p{{L}}\p{{N}}_]|$)') THEN '面试' WHEN regexp_matches(question, '(?i)(?:^|[^\p{{L}}\p{{N}}_])project(?:[^\p{{L}}\p{{N}}_]|$)') THEN '项目' WHEN regexp_matches(question, '(?i)(?:^|[^\p{{L}}\p{{N}}_])retrospective(?:[^\p{{L}}\p{{N}}_]|$)') THEN '复盘' ELSE '' END AS context FROM q),
      w AS (SELECT *, regexp_split_to_array(question, '[^\p{{L}}\p{{N}}_]+') AS words FROM c),
      e AS (SELECT *, CASE WHEN len(list_filter(words, lambda z: regexp_full_match(z, '[A-Z][A-Z0-9]{{1,9}}'))) > 0 THEN list_filter(words, lambda z: regexp_full_match(z, '[A-Z][A-Z0-9]{{1,9}}'))[1] WHEN context <> '' THEN coalesce(list_filter(words, lambda z: regexp_full_match(z, '[A-Z][A-Za-z0-9]{{1,19}}') AND z NOT IN ({", ".join(repr(w) for w in q.QUESTION_WORDS)}))[1], '') ELSE '' END AS entity FROM w),
      names(context, n, what, reason) AS (VALUES {", ".join(f"({c!r}, {n}, {w!r}, {r!r})" for c, v in q.VARIANTS.items() for n, (w, r) in enumerate(v))}),
      v AS (SELECT qid, 0 AS part, 0 AS n, question AS query, 'original query' AS reason FROM e UNION ALL SELECT qid, 0, 1, entity || ' ' || context, 'base topic' FROM e WHERE entity <> '' AND context <> ''
        UNION ALL SELECT qid, 0, 2 + names.n, entity || ' ' || what, reason FROM e JOIN names ON names.context = CASE WHEN e.context IN ('面试', '项目') THEN e.context ELSE '' END WHERE entity <> ''
        UNION ALL SELECT e.qid, 1, CAST(doc_id * 3 AS INTEGER), entity || ' 项目复盘', 'source title hint' FROM e JOIN documents ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = e.qid WHERE entity <> '' AND contains('abc retro ' || lower(source), lower(entity))),
      f AS (SELECT qid, query, min((part, n, reason)) AS first FROM v WHERE query <> '' GROUP BY 1, 2)
      SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) AS INTEGER) AS variant_ord, query, first[3] AS reason FROM f) WHERE variant_ord <= 6""",
    "relation_focus": rf"""WITH q AS (SELECT conv_id, turn, turn % 3 AS k, CASE turn % 3 WHEN 0 THEN 'Who reports to ' WHEN 1 THEN 'How to read charts under ' ELSE 'People under Anna Berg and ' END || text AS q FROM conversations),
      f AS (SELECT conv_id, turn, k, list_filter(list_filter(regexp_split_to_array(q, '[^A-Za-z]+'), lambda z: length(z) >= 3), lambda z: lower(z) NOT IN ({", ".join(repr(w) for w in q.FOCUS_STOP)})) AS ws, regexp_extract(q, '\bunder\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)(?:[^\p{{L}}\p{{N}}_]|$)', 1) AS u FROM q)
      SELECT conv_id, turn, k <> 1 AS relation, array_to_string(list_filter(ws, lambda z, i: list_position(ws, z) = i), ' ') AS focus, array_to_string(list_filter(string_split(u, ' '), lambda z: length(z) >= 3 AND lower(z) NOT IN ({", ".join(repr(w) for w in q.FOCUS_STOP)})), ' ') AS anchors FROM f""",
    "answer_filters": rf"""WITH a AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 1 THEN '（资料不足）' || chr(10) || '来源：a' WHEN 3 THEN chr(10) || ' 来源: b' ELSE '' END AS a FROM conversations WHERE role <> 'user')
      SELECT conv_id, turn, ({" OR ".join(f"contains(substr({collapse('a')}, 1, 500), '{w}')" for w in q.NO_ANSWER)}) AS no_answer, regexp_replace({strip(r"regexp_split_to_array(a, '(?:\n\s*)?来源[:：]')[1]")}, '[（(【\[]\s*$', '') AS body FROM a""",
    "display_names": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '手动录入 ' || strftime(ts, '%H:%M') ELSE event_type END AS shown FROM events",
    "metadata_codec": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE event_type END AS event_type FROM events",
    "chunk_windows": f"WITH {CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS source_key, CAST(section AS INTEGER) AS section, w, text FROM wins",
    "markdown_sections": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source_key, source, string_split('# ' || source || chr(10) || 'Preface' || chr(10) || replace(text, chr(10), chr(10) || '## '), chr(10)) AS ls FROM documents),
      r AS (SELECT source_key, source, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)), s AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY i) AS section FROM r)
      SELECT source_key, CAST(section AS BIGINT) AS section, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text, '# ' || min(source) || coalesce(' > ' || max(line) FILTER (starts_with(line, '## ')), '') AS breadcrumb FROM s GROUP BY source_key, section""",
    "chunk_documents": f"WITH {CHUNKS} SELECT source_key || '#' || chunk_index AS chunk_id, source_key, chunk_index, text FROM chunks",
    "chunk_limit": f"WITH {CHUNKS} SELECT source_key, count(*) AS n_chunks, count(*) <= 10 AS accepted, CASE WHEN count(*) > 10 THEN count(*) || ' chunks exceed the limit of 10' END AS reason FROM chunks GROUP BY source_key",
    "prepared_chunks": f"""WITH p AS (SELECT doc_id, text, {strip('text')} AS p FROM documents), s AS (SELECT doc_id, p, range(0, greatest(0, CAST(ceil((length(p) - 1024) / 1024.0) AS BIGINT) * 1024) + 1, 1024) AS starts FROM p WHERE doc_id % 3 <> 0),
      c AS (SELECT doc_id, i - 1 AS n, substr(p, starts[i] + 1, 1024) AS text FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM s) UNION ALL SELECT doc_id, 0, text FROM p WHERE doc_id % 3 = 0)
      SELECT doc_id || '#' || n AS chunk_id, length(text) AS n_chars, md5(text) AS text_hash FROM c""",
}
