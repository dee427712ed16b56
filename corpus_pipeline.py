"""From documents to packed training sequences: what one stage keeps is the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the rows they keep with the columns of documents.

Defined results of all stages: rows are judged one by one, also where doc_id is null or repeated; null and empty texts
are texts without words, which no filter takes for a copy or a leak; texts of any length are judged whole; ties of a
score and its threshold are as the operators say; equal rows (in all columns) are one row after near duplicates; an empty
table stays empty. Further columns pass unchanged whatever their names and types: stages see columns by their place
alone (`Rows`), never by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table, written
from docloom.llm.op2_packing import pack_documents
from docloom.llm.op5_minhash_dedup import near_duplicates
from docloom.llm.op6_toxicity import reject_toxic
from docloom.llm.op9_quality import reject_low_quality
from docloom.llm.op10_decontamination import contamination

#: Percent of shared shingles from which documents are near duplicates.
SIMILAR = 80
#: Keys of rows (16 bytes each) up to which they are sent to all executors.
BROADCAST_KEYS = 1_000_000


class Rows:
    """docs with its columns renamed by place: doc_id, text, and for all others c0, c1 and so on."""

    def __init__(self, docs: DataFrame):
        self.given = docs.columns
        self.names = [c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(self.given)]
        self.df = docs.toDF(*self.names)

    def restored(self, kept: DataFrame) -> DataFrame:
        """Rows of self.df, further columns beside them, with the given names."""
        return kept.select(*self.names).toDF(*self.given)


def row_key(docs: DataFrame) -> Column:
    """128 bits of all columns' values and of which are null. Equal rows share it.

    Values count as Spark casts them to strings, each hashed, so neither types nor borders of columns matter.
    """
    each = [F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("null")) for c in docs.columns]
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", *each), 256), 1, 32))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled ones among them, doesn't reject."""
    rows = Rows(docs)
    return rows.restored(reject_toxic(spark, rows.df, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject."""
    rows = Rows(docs)
    return rows.restored(reject_low_quality(spark, rows.df, table(spark, sf_dir, "labels")))


def by_key(keyed: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """keyed with only (left_semi) or without (left_anti) the rows of the keys: texts move only if the keys are counted to be many."""
    few = keys.count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(keys) if few else keys.hint("merge"), "row_key", how)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last) of each group of near duplicates; equal rows count once."""
    rows = Rows(docs)
    keyed = rows.df.withColumn("row_key", row_key(rows.df))
    groups = near_duplicates(keyed.select(F.col("row_key").alias("doc_id"), "text"), SIMILAR).groupBy(F.col("doc_id").alias("row_key")).agg(F.first("component_id").alias("group"), F.count("*").alias("copies"))
    ids = keyed.select("row_key", F.col("doc_id").alias("id")).distinct()
    groups = written(groups.join(ids.hint("merge"), "row_key"), "stage-groups")
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key"))["row_key"].alias("first"))
    decided = groups.join(first.hint("merge"), "group")
    copied = written(decided.where("row_key = first and copies > 1").select("row_key"), "stage-copied")
    gone = written(decided.where("row_key <> first").select("row_key").unionByName(copied), "stage-gone")
    once = by_key(keyed, copied, "left_semi").groupBy("row_key").agg(F.first(F.struct(*rows.names)).alias("row")).select("row.*")
    return rows.restored(by_key(keyed, gone, "left_anti").select(*rows.names).union(once))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark text."""
    rows = Rows(docs)
    keyed = rows.df.withColumn("row_key", row_key(rows.df))
    hit = contamination(keyed.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where(F.size("items") > 0)
    hit = written(hit.select(F.col("doc_id").alias("row_key")).distinct(), "stage-hit")
    return rows.restored(by_key(keyed, hit, "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(Rows(docs).df, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near duplicates", near_duplicate), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers and the sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
