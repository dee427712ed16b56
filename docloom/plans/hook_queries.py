"""Queries that use the hooks and parse answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import hooks
from docloom.operators import answers, search
from docloom.plans.inputs import questions, table
from docloom.plans.search_queries import _whole, bm25_sql


def _answers(spark, d):
    """Assistant turns as JSON answers: fenced, with text around them, with trailing commas, cut off, or plain."""
    t = table(spark, d, "conversations").where("role <> 'user'")
    fact = F.to_json(F.struct(F.col("text").alias("content"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source")))
    body = F.concat(F.lit('{"logic_chain": "x", "terminology": [{"zh": "词", "en": "word"}], "key_facts": ['), fact)
    kind = F.col("conv_id") % 5
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("]}\n```"))).when(kind == 1, F.concat(F.lit("So: "), body, F.lit("]} ok"))).when(kind == 2, F.concat(body, F.lit(",]}"))).when(kind == 3, body).otherwise(F.col("text"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), text.alias("answer"))


def answer_facts(spark, d):
    return answers.facts(_answers(spark, d)).select("qid", "n", "content", "source")


def answer_terms(spark, d):
    return answers.terms(_answers(spark, d)).select("qid", "n", "zh", "en")


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def text_embedding(spark, d):
    """Length and number of spaces as the vector of a text, as any embedder would give one."""
    rows = hooks.embed(table(spark, d, "documents").select("doc_id", "text"), _lengths)
    return rows.select("doc_id", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


def extraction_chain(spark, d):
    """Pages' texts by two extractors, the second of which serves where the first gives too little."""
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content"))
    tried = hooks.extract(files, [("half", _first_half), ("whole", bytes.decode)])
    status = F.when(F.col("error").isNotNull(), "failed").when(F.length("text") < 1000, "needs_ocr").otherwise("high")
    return hooks.first_usable(tried.withColumn("status", status))


def _first_half(content: bytes) -> str:
    return content.decode()[: len(content.decode()) // 2]


def _overlap(query: str, texts: list[str]) -> list[float]:
    words = set(query.split(" "))
    return [round(len(words & set(t.split(" "))) / len(words), 6) for t in texts]


def reranked_by_overlap(spark, d):
    """BM25's best, reranked by the share of the question's words that a document holds."""
    found = search.bm25(_whole(spark, d), questions(spark, d))
    candidates = found.join(_whole(spark, d).hint("merge"), "chunk_id").join(questions(spark, d).select("qid", "query").hint("merge"), "qid")
    return search.rerank(found, hooks.score_pairs(candidates.select("qid", "query", "chunk_id", "text"), _overlap)).select("qid", "chunk_id", "score", "rank")


QUERIES = {f.__name__: f for f in (answer_facts, answer_terms, text_embedding, extraction_chain, reranked_by_overlap)}
ORACLE = {
    "answer_facts": "SELECT conv_id * 1000 + turn AS qid, 1 AS n, trim(text) AS content, 's' || conv_id AS source FROM conversations WHERE role <> 'user' AND conv_id % 5 < 4 AND trim(text) <> ''",
    "answer_terms": "SELECT conv_id * 1000 + turn AS qid, 1 AS n, '词' AS zh, 'word' AS en FROM conversations WHERE role <> 'user' AND conv_id % 5 < 4",
    "text_embedding": "SELECT doc_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b FROM documents",
    "extraction_chain": "SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN length(html) // 2 >= 1000 THEN 'half' ELSE 'whole' END AS provider, CASE WHEN length(html) // 2 >= 1000 THEN 1 ELSE 2 END AS tried FROM pages WHERE length(html) >= 1000",
    "reranked_by_overlap": f"""WITH idx AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents), qs AS (SELECT item_id AS qid, text AS query FROM benchmark), {bm25_sql('idx', 'qs', 10)},
      s AS (SELECT bm.qid, chunk_id, bm.rank, round(len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(text, ' ')))) / len(list_distinct(string_split(query, ' '))), 6) AS score FROM bm JOIN idx USING (chunk_id) JOIN qs USING (qid))
      SELECT qid, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER) AS rank FROM s""",
}
