"""From ranked chunks to evidence: variants, support, neighbours, dossiers and reports, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.questions import VARIANTS, anchor_terms, context_of, entity_of, is_no_answer, resolved
from docloom.functions.text import collapse
from docloom.operators.joins import small
from docloom.operators.storage import stored

MAX_VARIANTS, MAX_ADDED, RADIUS = 6, 6, 1


def resolve_follow_ups(turns: DataFrame, **rules) -> DataFrame:
    """User turns (conv_id, turn, role, text) with status and resolved_question, by the user turn before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.where("role = 'user'").withColumn("previous", F.lag("text").over(order))
    return asked.select("conv_id", "turn", resolved(F.col("text"), F.col("previous"), **rules).alias("r")).select("conv_id", "turn", "r.status", "r.resolved_question")


def expand_queries(questions: DataFrame, titles: DataFrame | None = None, limit: int = MAX_VARIANTS) -> DataFrame:
    """(qid, question) to its distinct variants in order: qid, variant_ord (from 1), query, reason.

    titles: (qid, n, title) of sources that hint at further variants.
    """
    text = collapse(F.col("question"))
    pair = lambda q, r: F.struct(q.alias("query"), F.lit(r).alias("reason"))
    about = F.col("entity")

    def of(context: str) -> Column:
        return F.array(*(pair(F.concat(about, F.lit(f" {what}")), why) for what, why in VARIANTS[context]))

    rows = questions.select("qid", text.alias("question")).withColumns({"entity": entity_of(F.col("question")), "context": context_of(F.col("question"))})
    own = F.when(F.col("context") == "面试", of("面试")).when(F.col("context") == "项目", of("项目")).otherwise(of(""))
    none = F.array().cast("array<struct<query:string,reason:string>>")
    base = F.when(F.col("context") != "", F.array(pair(F.concat_ws(" ", "entity", "context"), "base topic"))).otherwise(none)
    built = F.concat(F.array(pair(F.col("question"), "original query")), F.when(about != "", F.concat(base, own)).otherwise(none))
    variants = rows.select("qid", F.posexplode(built).alias("n", "v")).select("qid", F.lit(0).alias("part"), "n", "v.query", "v.reason")
    if titles is not None:
        flat = F.translate(F.coalesce("title", F.lit("")), "_-", "  ")
        hints = titles.join(rows.where("entity <> ''").hint("merge"), "qid").withColumn("flat", flat).where(F.contains(F.lower("flat"), F.lower("entity")))
        low = F.lower("flat")
        found = F.array(
            F.when(F.contains(low, F.lit("retro")) | F.contains(F.col("flat"), F.lit("复盘")), F.concat("entity", F.lit(" 项目复盘"))),
            F.when(F.contains(low, F.lit("interview")) | F.contains(F.col("flat"), F.lit("面试")), F.concat("entity", F.lit(" 面试"))),
            F.when(F.contains(F.col("flat"), F.lit("技术选型")), F.concat("entity", F.lit(" 技术选型"))),
        )
        more = hints.select("qid", "n", F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("m", "query"))
        variants = variants.unionByName(more.select("qid", F.lit(1).alias("part"), (F.col("n") * 3 + F.col("m")).cast("int").alias("n"), "query", F.lit("source title hint").alias("reason")))
    first = variants.where("query <> ''").groupBy("qid", "query").agg(F.min(F.struct("part", "n", "reason")).alias("first"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy("first.part", "first.n"))
    return first.withColumn("variant_ord", order).where(F.col("variant_ord") <= limit).select("qid", "variant_ord", "query", F.col("first.reason").alias("reason"))


def keep_first(hits: DataFrame, *order: str) -> DataFrame:
    """Hits of all variants, each chunk of a question once: as it was first seen."""
    return hits.withColumn("seen", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy(*order))).where("seen = 1").drop("seen")


def supported(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits that hold an anchor of their question (qid, question) as a substring; generated ones last, best first."""
    anchors = questions.select("qid", anchor_terms(F.col("question")).alias("anchors"))
    rows = hits.join(small(anchors), "qid").withColumn("hay", F.lower(F.concat_ws(" ", "text", "source_name", "chunk_id")))
    kept = rows.where(F.exists("anchors", lambda a: F.contains(F.col("hay"), a))).drop("hay", "anchors")
    order = Window.partitionBy("qid").orderBy((F.col("source_type") == "generated_asset").cast("int"), F.desc("score"), "chunk_id")
    return kept.withColumn("support_rank", F.row_number().over(order))


def expand_neighbours(hits: DataFrame, chunks: DataFrame, radius: int = RADIUS, limit: int = MAX_ADDED) -> DataFrame:
    """Hits (qid, chunk_id, source_key, chunk_index, score, rank) and up to limit chunks beside them, with roles.

    Neighbours are added in the order of hits, then offsets; the first hit that reaches one gives its score.
    """
    offsets = [o for o in range(-radius, radius + 1) if o]
    # Questions times a few rows, which are used three times: the search behind them runs once.
    hits = stored(hits.select("qid", "chunk_id", "source_key", "chunk_index", "score", "rank"), "hits")
    near = hits.select("qid", "source_key", "score", "rank", F.explode(F.array(*map(F.lit, offsets))).alias("offset"), "chunk_index").withColumn("chunk_index", F.col("chunk_index") + F.col("offset")).where("chunk_index >= 0")
    found = near.join(chunks.select("source_key", "chunk_index", "chunk_id").hint("merge"), ["source_key", "chunk_index"]).join(hits.select("qid", "chunk_id").hint("merge"), ["qid", "chunk_id"], "left_anti")
    first = found.groupBy("qid", "chunk_id", "source_key", "chunk_index").agg(F.min(F.struct("rank", "offset", "score")).alias("by"))
    added = first.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("by.rank", "by.offset"))).where(F.col("n") <= limit)
    role = F.when(F.col("by.offset") < 0, "context_before").otherwise("context_after")
    return hits.select("qid", "chunk_id", "source_key", "chunk_index", "score", F.lit("retrieved").alias("role")).unionByName(added.select("qid", "chunk_id", "source_key", "chunk_index", F.col("by.score").alias("score"), role.alias("role")))


def fidelity_report(questions: DataFrame, expanded: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question (qid): original, final and added chunks, sources, characters, and whether the chunks are continuous."""
    rows = expanded.join(chunks.select("chunk_id", F.length("text").alias("n_chars")).hint("merge"), "chunk_id")
    places = F.max("chunk_index") - F.min("chunk_index") + 1
    status = F.when(F.count_distinct("source_key") > 1, "fragmented").when(places == F.count("*"), "continuous").otherwise("gapped")
    found = rows.groupBy("qid").agg(
        F.count_if(F.col("role") == "retrieved").alias("original_chunks"), F.count("*").alias("final_chunks"), F.count_if(F.col("role") != "retrieved").alias("added_chunks"),
        F.count_distinct("source_key").alias("sources"), F.sum("n_chars").alias("chars"), status.alias("continuity"),
    )
    return questions.select("qid").join(found.hint("merge"), "qid", "left").fillna(0, ["original_chunks", "final_chunks", "added_chunks", "sources", "chars"]).fillna("empty", ["continuity"])


def evidence_report(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question: sources, chunks, status and whether evidence is low; questions without hits too."""
    counted = hits.groupBy("qid").agg(F.count_distinct("source_name").alias("source_count"), F.count("*").alias("chunk_count"))
    rows = questions.select("qid").join(counted.hint("merge"), "qid", "left").fillna(0, ["source_count", "chunk_count"])
    status = F.when(F.col("chunk_count") == 0, "no_answer").when((F.col("source_count") < 2) | (F.col("chunk_count") < 2), "thin").otherwise("grounded")
    return rows.withColumn("coverage_status", status).withColumn("low_evidence", F.col("coverage_status").isin("no_answer", "thin"))


def top_sources(hits: DataFrame) -> DataFrame:
    """Per question its sources by number of chunks, then by their best rank."""
    counted = hits.groupBy("qid", "source_name").agg(F.count("*").alias("chunk_count"), F.min("rank").alias("first_rank"))
    return counted.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("chunk_count"), "first_rank"))).drop("first_rank")


def dossier(hits: DataFrame) -> DataFrame:
    """Groups of a question's distinct chunks by source in first-seen order; hits: variant_ord, rank, source_type."""
    first = keep_first(hits, "variant_ord", "rank")
    groups = first.groupBy("qid", "source_name").agg(F.count("*").alias("chunk_count"), F.min(F.struct("variant_ord", "rank")).alias("seen"), F.min_by("source_type", F.struct("variant_ord", "rank")).alias("source_type"))
    return groups.withColumn("group_ord", F.row_number().over(Window.partitionBy("qid").orderBy("seen"))).drop("seen")


def dossier_coverage(variants: DataFrame, hits: DataFrame) -> DataFrame:
    """Per question of variants (qid): its distinct chunks, their sources and types (map of counts), and low evidence: no chunk."""
    first = keep_first(hits, "variant_ord", "rank")
    totals = first.groupBy("qid").agg(F.count_distinct("source_name").alias("source_count"), F.count("*").alias("chunk_count"))
    kinds = first.groupBy("qid", "source_type").agg(F.count("*").alias("n")).groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_types"))
    rows = variants.select("qid").distinct().join(totals.hint("merge"), "qid", "left").join(kinds.hint("merge"), "qid", "left").fillna(0, ["source_count", "chunk_count"])
    return rows.withColumns({"source_types": F.coalesce("source_types", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), "low_evidence": F.col("chunk_count") == 0})


def missing_variants(variants: DataFrame, hits: DataFrame) -> DataFrame:
    """Variants (qid, variant_ord, query) without hits, as sentences."""
    return variants.join(hits.select("qid", "variant_ord").distinct().hint("merge"), ["qid", "variant_ord"], "left_anti").select("qid", "variant_ord", F.concat(F.lit("No chunks were retrieved for "), "query", F.lit(".")).alias("missing"))


def source_status(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """generated_only, no_answer or grounded per question, from its hits and answer (qid, answer)."""
    kinds = hits.groupBy("qid").agg(F.bool_and(F.col("source_type") == "generated_asset").alias("generated"), F.count("*").alias("n"))
    rows = questions.select("qid").join(kinds.hint("merge"), "qid", "left").join(answers.select("qid", "answer").hint("merge"), "qid", "left")
    status = F.when(F.coalesce("generated", F.lit(False)), "generated_only").when(F.col("n").isNull() | is_no_answer(F.col("answer")), "no_answer").otherwise("grounded")
    return rows.select("qid", status.alias("source_status"), F.when(status == "grounded", F.col("n")).otherwise(0).cast("long").alias("n_sources"))


def source_references(hits: DataFrame) -> DataFrame:
    """Distinct source#index references of a question in the order of its hits."""
    refs = hits.groupBy("qid", F.concat_ws("#", "source_name", "chunk_index").alias("ref")).agg(F.min("rank").alias("first"))
    return refs.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


def context_text(hits: DataFrame) -> DataFrame:
    """A question's chunk texts with numbered headers, generated ones labelled secondary."""
    label = F.when(F.col("source_type") == "generated_asset", "secondary").otherwise("primary")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), label, F.lit(") "), "source_name", F.lit("#"), F.col("chunk_index").cast("string"), F.lit("\n"), "text")
    return hits.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def channel_counts(rankings: DataFrame) -> DataFrame:
    """Hits per question, channel and label."""
    return rankings.groupBy("qid", "channel", "label").agg(F.count("*").alias("hits"), F.min("rank").alias("best_rank"))
