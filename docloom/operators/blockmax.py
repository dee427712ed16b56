"""Full-text search over block-max postings: blocks that can't hold one of a question's first k are never read.

Documents are numbered. A term's postings lie in blocks by ranges of numbers; a range is the power of two that gives about
POSTINGS postings to a block, so ranges of different terms nest. A block row holds the gaps between its documents' numbers,
their counts and lengths (small whole numbers, which Parquet packs), and beside them, in columns of their own, the largest
contribution of a posting. A frequent term, even one of a third of all documents, is many rows.

A search first reads only the blocks' largest contributions. A block's bound for a question is its own plus, for each other
term of the question, the largest of that term's blocks that overlap its range: no document of the block scores more. The
START blocks with the highest bounds are read first. The best documents there are then scored in full, by reading the other
terms' blocks that hold them; the k-th of these scores is a floor, which the answer reaches at least. Terms whose largest
contributions together stay below the floor aren't enough for a document: every document of the answer holds one of the
others. So of those others all blocks are read whose bound reaches the floor, and of the insufficient terms, mostly the
frequent ones, only blocks that hold a document which can still reach it. All documents of the answer then have exact scores.
All steps are joins and grouped sums, for all questions at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.joins import is_small, side
from docloom.operators.search import DIGITS, K1, TOP, B, query_terms, ranked, token_rows
from docloom.operators.storage import stored
from docloom.operators.versions import VersionedTables

#: Postings of a block, about; blocks of each question that are read first; documents, as a multiple of those asked for,
#: that are scored in full after that.
POSTINGS, START, SCORED = 64, 64, 4
#: What rounding of two scores may hide.
_SLACK = 2 * 10.0**-DIGITS


@dataclass
class PostingsIndex:
    docs: DataFrame  # doc, chunk_id
    terms: DataFrame  # term, df, shift
    blocks: DataFrame  # term, range, n, top, first, gaps, counts, lengths
    corpus: DataFrame  # n, avgdl: one row


def _numbered(tokens: DataFrame) -> DataFrame:
    """tokens with whole numbers from 0 without gaps (doc)."""
    rows = stored(tokens.select("chunk_id", "tokens", "dl", F.monotonically_increasing_id().alias("id")), "numbered")
    part = F.shiftright("id", 33)
    # A row for each partition that wrote the table.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select("chunk_id", "tokens", "dl", (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("doc"))


def _share(tf: Column | str, dl: Column | str, avgdl: Column | str) -> Column:
    """A posting's contribution, but for its term's weight."""
    tf, dl, avgdl = (F.col(x) if isinstance(x, str) else x for x in (tf, dl, avgdl))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def build(chunks: DataFrame, root: str | None = None) -> PostingsIndex:
    """Index chunks (chunk_id, text; or token rows), published under root if it is given."""
    spark = chunks.sparkSession
    docs = stored(_numbered(chunks if "tokens" in chunks.columns else token_rows(chunks)), "numbered-docs")
    corpus = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = stored(docs.select("doc", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc", "dl").agg(F.count("*").alias("tf")), "postings")
    # As many documents as hold POSTINGS of the term, as a power of two.
    wide = F.ceil(F.log2(F.greatest(F.lit(POSTINGS) * F.col("n") / F.col("df"), F.lit(1.0)))).cast("int")
    terms = stored(found.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus), how="cross").select("term", "df", wide.alias("shift")), "terms")
    ranges = found.join(terms.select("term", "shift").hint("merge"), "term").withColumn("range", F.expr("shiftright(doc, shift)"))
    rows = ranges.groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("p"))
    gaps = F.transform(F.col("p"), lambda x, i: (x["doc"] - F.when(i == 0, x["doc"]).otherwise(F.get(F.col("p.doc"), i - 1))).cast("int"))
    rows = rows.join(F.broadcast(corpus.select("avgdl")), how="cross").select(
        "term", "range", F.size("p").alias("n"), F.array_max(F.transform("p", lambda x: _share(x["tf"], x["dl"], F.col("avgdl")))).alias("top"), F.col("p")[0]["doc"].alias("first"),
        gaps.alias("gaps"), F.transform("p", lambda x: x["tf"].cast("int")).alias("counts"), F.transform("p", lambda x: x["dl"].cast("int")).alias("lengths"),
    )
    tables = {"docs": docs.select("doc", "chunk_id"), "terms": terms, "blocks": rows.repartition("term").sortWithinPartitions("term", "range"), "corpus": corpus}
    if root is None:
        return PostingsIndex(**{name: stored(df, f"index-{name}") for name, df in tables.items()})
    VersionedTables(spark, root, "term").publish(tables)
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> PostingsIndex:
    """The index that was published last under root."""
    tables = VersionedTables(spark, root, "term")
    number = tables.manifest().number
    return PostingsIndex(**{name: tables.table(name, number) for name in ("docs", "terms", "blocks", "corpus")})


def _weighted(index: PostingsIndex, queries: DataFrame) -> DataFrame:
    """(qid, term, weight, shift) of the questions' terms that are in the index."""
    asked = stored(query_terms(queries), "query-terms")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    known = index.terms.join(side(asked, is_small(asked)), "term").join(F.broadcast(index.corpus), how="cross")
    return stored(known.select("qid", "term", (F.col("times") * idf).alias("weight"), "shift"), "query-weights")


def bounded_blocks(index: PostingsIndex, asked: DataFrame) -> DataFrame:
    """Every block of the questions' terms (asked): qid, term, range, weight, n, own contribution, and the bound of its documents' scores."""
    few = is_small(asked)
    mine = stored(index.blocks.select("term", "range", "n", "top").join(side(asked, few), "term").withColumn("own", F.col("weight") * F.col("top")), "query-blocks")
    other = asked.select("qid", F.col("term").alias("other"), F.col("shift").alias("other_shift"))
    pairs = asked.select("qid", "term", "shift").join(side(other, few), "qid").where("term <> other").withColumn("level", F.greatest("shift", "other_shift"))
    levels = pairs.select("qid", F.col("other").alias("term"), "level").distinct()
    # The largest block of a term within every range of a level.
    high = mine.select("qid", "term", "shift", "range", "own").join(side(levels, few), ["qid", "term"])
    high = high.groupBy("qid", F.col("term").alias("other"), "level", F.expr("shiftright(range, level - shift)").alias("at")).agg(F.max("own").alias("more"))
    low = mine.select("qid", "term", "shift", "range").join(side(pairs.select("qid", "term", "other", "level"), few), ["qid", "term"]).withColumn("at", F.expr("shiftright(range, level - shift)"))
    more = low.join(high.hint("merge"), ["qid", "other", "level", "at"]).groupBy("qid", "term", "range").agg(F.sum("more").alias("more"))
    return stored(mine.join(more.hint("merge"), ["qid", "term", "range"], "left").select("qid", "term", "range", "weight", "n", "own", (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("bound")), "block-bounds")


def _sums(index: PostingsIndex, wanted: DataFrame) -> DataFrame:
    """(qid, doc, score): sums of the contributions that the wanted blocks (qid, term, range, weight) hold."""
    few = is_small(wanted)
    read = index.blocks.select("term", "range", "first", "gaps", "counts", "lengths").join(side(wanted.select("qid", "term", "range", "weight"), few), ["term", "range"]).join(F.broadcast(index.corpus.select("avgdl")), how="cross")
    # Numbers are running sums of the gaps.
    numbers = F.aggregate("gaps", F.array().cast("array<bigint>"), lambda out, gap: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.col("first")) + gap)))
    rows = read.select("qid", "weight", "avgdl", F.explode(F.arrays_zip(numbers.alias("doc"), F.col("counts").alias("tf"), F.col("lengths").alias("dl"))).alias("p"))
    return rows.groupBy("qid", "p.doc").agg(F.sum(F.col("weight") * _share("p.tf", "p.dl", "avgdl")).alias("score"))


def _floors(index: PostingsIndex, asked: DataFrame, blocks: DataFrame, top: int) -> DataFrame:
    """(qid, floor): a score that the top-th document of each question reaches; none where fewer were found at first."""
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "term", "range")
    start = blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= START)
    best = stored(ranked(_sums(index, stored(start, "first-blocks")), F.desc("score"), F.col("doc"), top=SCORED * top).select("qid", "doc"), "first-docs")
    holding = best.join(side(asked, is_small(asked)), "qid").select("qid", "term", F.expr("shiftright(doc, shift)").alias("range"), "weight").distinct()
    whole = _sums(index, stored(holding, "holding-blocks")).join(side(best, is_small(best)), ["qid", "doc"], "left_semi")
    floors = ranked(whole, F.desc("score"), F.col("doc"), top=top).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    return stored(floors.where(F.col("n") >= top).select("qid", (F.col("floor") - _SLACK).alias("floor")), "floors")


def wanted_blocks(index: PostingsIndex, queries: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """All blocks of the questions' terms with their bounds, and those of them that a search reads at last."""
    asked = _weighted(index, queries)
    blocks = bounded_blocks(index, asked)
    floors = _floors(index, asked, blocks, top)
    most = blocks.groupBy("qid", "term").agg(F.max("own").alias("most")).join(floors.hint("merge"), "qid", "left")
    upto = Window.partitionBy("qid").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    # The terms that together stay below the floor; a question has at most TERMS of them.
    most = most.withColumn("enough", F.coalesce(F.sum("most").over(upto) >= F.col("floor"), F.lit(True)))
    terms = stored(most.join(asked.hint("merge"), ["qid", "term"]).select("qid", "term", "weight", "shift", "most", "enough", "floor"), "term-parts")
    few = is_small(terms)
    needed = blocks.join(side(terms.where("enough").select("qid", "term", "floor"), few), ["qid", "term"]).where("floor is null or bound >= floor").drop("floor")
    needed = stored(needed, "needed-blocks")
    rest = terms.where("not enough")
    missing = rest.groupBy("qid", "floor").agg(F.sum("most").alias("missing"))
    able = _sums(index, needed).join(side(missing, few), "qid").where("score + missing >= floor").select("qid", "doc")
    ranges = able.join(side(rest.select("qid", "term", "shift"), few), "qid").select("qid", "term", F.expr("shiftright(doc, shift)").alias("range")).distinct()
    return blocks, stored(needed.unionByName(blocks.join(ranges.hint("merge"), ["qid", "term", "range"], "left_semi")), "wanted-blocks")


def bm25(index: PostingsIndex, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The best chunks of each question (qid, query): qid, chunk_id, score, rank. Ties go by chunk_id."""
    _, wanted = wanted_blocks(index, queries, top)
    scored = _sums(index, wanted).withColumn("score", F.round("score", DIGITS))
    tied = scored.withColumn("place", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("place") <= top)
    tied = stored(tied.select("qid", "doc", "score"), "best-docs")
    return ranked(index.docs.join(side(tied, is_small(tied)), "doc").select("qid", "chunk_id", "score"), F.desc("score"), F.col("chunk_id"), top=top)


def blocks_read(index: PostingsIndex, queries: DataFrame, top: int = TOP) -> DataFrame:
    """Of each question, how many blocks and postings its terms have, and how many of them a search reads: qid, blocks, read_blocks, postings, read_postings."""
    blocks, wanted = wanted_blocks(index, queries, top)
    sums = lambda df, a, b: df.groupBy("qid").agg(F.count("*").alias(a), F.sum("n").alias(b))
    return sums(blocks, "blocks", "postings").join(sums(wanted, "read_blocks", "read_postings").hint("merge"), "qid")
