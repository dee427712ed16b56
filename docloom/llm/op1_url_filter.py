"""Operator 1: judge urls by listed hosts and paths, through a blocked Bloom filter and an exact join.

A canonical url is its host (A-Z lower-cased) and path. A listed rule fits its host, all subdomains and every path
that starts with its path. So a url is looked up under each suffix of its host that has as many labels as some rule's
host, with each prefix of its path that is as long as some rule's path. The Bloom filter, of bounded size, drops nearly
all of those keys; the rest meet the rules in an exact hash join, which removes false positives; the rules are
broadcast for it if they are counted to be few. The longest rule wins; of equally long ones the one with the longer
host, then the first by host.

Defined results: a null url, or one without ://, has an empty host and path and fits no rule; rows are judged one by
one, repeated page_ids too; urls, hosts and paths of any length are judged whole; rules that are listed twice with
different verdicts count as the first by name; without rules all get the default verdict; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bloom
from docloom.llm.common import lean, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which they are sent to all executors.
BROADCAST_RULES = 100_000
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = _rest(url)
    return F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(rest)), "^[^?#]*", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host + path of the winner, else null) and verdict of every row of pages."""
    listed = written(rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", F.concat("host", "path")), "op1-rules")
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # as many as there are different lengths of paths
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not lengths:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # A rule of n labels fits the last n labels of a host alone, so of long hosts only few suffixes are looked up.
    labels = sorted(r[0] for r in listed.select(F.size(F.split("host", "\\."))).distinct().collect())
    few = listed.count() <= BROADCAST_RULES
    words = bloom.build(listed, "key")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.probe(words, batch.column(3).to_numpy())))

    parts = F.split("host", "\\.")
    suffixes = F.array(*(F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels))
    prefixes = F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))
    urls = pages.select("host", "path").distinct()
    given = lambda x: F.explode(F.filter(x, lambda y: y.isNotNull()))
    keys = urls.withColumn("suffix", given(suffixes)).withColumn("prefix", given(prefixes)).select("host", "path", F.concat("suffix", "prefix").alias("key"))
    hits = keys.select("host", "path", "key", bloom.key_hash("key").alias("h")).mapInArrow(lean(possible), "host string, path string, key string, h long")
    rules = listed.select("key", "verdict", F.length("host").alias("host_length"), F.col("host").alias("rule_host"))
    fits = hits.drop("h").join(F.broadcast(rules) if few else rules.hint("shuffle_hash"), "key")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(-F.length("key"), -F.col("host_length"), "rule_host")).alias("best"))
    return pages.join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
urls AS (SELECT n, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
fits AS (
  SELECT n, rules.host || rules.path AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC, rules.host) AS k
  FROM urls JOIN rules ON (urls.host = rules.host OR ends_with(urls.host, '.' || rules.host)) AND starts_with(urls.path, rules.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""
QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE = {"op1_url_filter": _SQL}
