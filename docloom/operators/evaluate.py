"""Gates and acceptance checks over retrieved chunks and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import compact_key, noise_label

GATE_HITS = 5


def quality_gate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case (qid, top_type, types, terms): exactly GATE_HITS hits, none noise, the first of the wanted type, all types and terms found.

    Terms are sought in the compacted texts of all hits, one after another.
    """
    rows = hits.withColumn("noise", noise_label(F.col("text")) != "").withColumn("key", compact_key(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]), "")
    seen = rows.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("noise").alias("noisy"), F.min_by("source_type", "rank").alias("first_type"), F.collect_set("source_type").alias("found_types"), text.alias("found"))
    joined = cases.join(seen.hint("merge"), "qid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    absent = lambda wanted, has: F.size(F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda t: ~has(t))).cast("long")
    missing = absent(F.col("terms"), lambda t: F.contains(F.coalesce("found", F.lit("")), compact_key(t)))
    types = absent(F.col("types"), lambda t: F.array_contains(F.coalesce("found_types", F.array().cast("array<string>")), t))
    checked = joined.withColumns({"missing": missing, "missing_types": types, "type_ok": F.coalesce(F.col("top_type").isNull() | (F.col("top_type") == F.col("first_type")), F.lit(False))})
    passed = (F.col("n") == GATE_HITS) & (F.coalesce("noisy", F.lit(0)) == 0) & F.col("type_ok") & (F.col("missing") == 0) & (F.col("missing_types") == 0)
    return checked.select("qid", F.col("n").alias("hits"), F.coalesce("noisy", F.lit(0)).alias("noisy"), "type_ok", "missing_types", "missing", passed.alias("passed"))


def acceptance(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Failures of each answer (key, answer, status, n_sources) against its case (required, forbidden, status)."""
    rows = cases.join(answers.select("key", "answer", F.col("status").alias("got"), "n_sources").hint("merge"), "key", "left")
    text = F.lower(F.coalesce("answer", F.lit("")))
    fails = F.array(
        F.when(F.col("answer").isNull(), "no_answer_row"), F.when(F.exists("required", lambda t: ~F.contains(text, F.lower(t))), "required_term"), F.when(F.exists("forbidden", lambda t: F.contains(text, F.lower(t))), "forbidden_term"),
        F.when(~F.col("got").eqNullSafe(F.col("expected_status")), "status"), F.when((F.col("expected_status") == "grounded") & (F.coalesce("n_sources", F.lit(0)) == 0), "sources_missing"), F.when((F.col("expected_status") != "grounded") & (F.coalesce("n_sources", F.lit(0)) > 0), "sources_present"),
    )
    return rows.select("key", F.array_join(F.filter(fails, lambda x: x.isNotNull()), ",").alias("failures"))


def source_recall(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Whether a hit of each case (qid, expected_source) is of the expected source, and how many."""
    rows = cases.join(hits.select("qid", "source_name").hint("merge"), "qid", "left")
    found = F.count_if(F.col("source_name") == F.col("expected_source"))
    return rows.groupBy("qid").agg(found.alias("matching"), (found > 0).alias("recalled"))


def check_manifest(rows: DataFrame) -> DataFrame:
    """Rows (n, key, url, mime, expected_mime, enabled, reason) with their problems."""
    same = F.count("*").over(Window.partitionBy("key"))
    problems = F.array(F.when(F.coalesce("key", F.lit("")) == "", "empty_key"), F.when(same > 1, "repeated_key"), F.when(~F.startswith("url", F.lit("https://")), "not_https"), F.when(F.col("mime") != F.col("expected_mime"), "mime"), F.when(~F.col("enabled") & (F.coalesce("reason", F.lit("")) == ""), "no_reason"))
    return rows.select("n", F.array_join(F.filter(problems, lambda x: x.isNotNull()), ",").alias("problems"))
