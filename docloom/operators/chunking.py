"""Documents to chunks: paragraphs, Markdown sections with breadcrumbs, overlapping windows, guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import LINE_END, is_contents_noise, lines, strip
from docloom.operators.joins import is_small, side
from docloom.operators.storage import stored

SIZE, OVERLAP, LIMIT = 1024, 128, 100


def paragraphs(docs: DataFrame, *keep: str) -> DataFrame:
    """(source_key, section, text): stripped parts between blank lines, numbered from 0 among all parts."""
    rows = docs.select("source_key", *keep, F.posexplode(F.split("text", "\n\n")).alias("section", "raw"))
    return rows.select("source_key", *keep, "section", strip(F.col("raw")).alias("text")).where("text <> ''")


def is_markdown(text: Column) -> Column:
    """Whether a line begins with two number signs."""
    return F.contains(text, F.lit("##")) & text.rlike(f"(?:^|{LINE_END})##")


def markdown_sections(docs: DataFrame, *keep: str) -> DataFrame:
    """(source_key, section, text, breadcrumb): a section begins at every second-level heading."""
    rows = docs.select("source_key", *keep, F.posexplode(lines(F.col("text"))).alias("n", "line"))
    is_h2, is_h1 = F.startswith("line", F.lit("## ")), F.startswith("line", F.lit("# "))
    so_far = Window.partitionBy("source_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.when(is_h2, 1).otherwise(0)).over(so_far)).withColumn("h1", F.last(F.when(is_h1, F.col("line")), ignorenulls=True).over(so_far))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    grouped = rows.groupBy("source_key", *keep, "section").agg(strip(joined).alias("text"), F.max_by("h1", "n").alias("h1"), F.max(F.when(is_h2, F.col("line"))).alias("h2"))
    # A later first-level heading counts for the section that holds it, as it is read when the section ends.
    return grouped.where("text <> ''").select("source_key", *keep, F.col("section").cast("int").alias("section"), "text", F.concat_ws(" > ", "h1", "h2").alias("breadcrumb"))


def window_starts(length: Column, size: int, overlap: int) -> Column:
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((length - size) / step) * step).cast("int")
    return F.sequence(F.lit(0), last, F.lit(step))


def windows(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Each row's text in overlapping windows: window number w and its text."""
    rest = [c for c in sections.columns if c != "text"]
    cut = F.transform(window_starts(F.length("text"), size, overlap), lambda i: F.substring(F.col("text"), i + 1, F.lit(size)))
    return sections.select(*rest, F.posexplode(cut).alias("w", "text"))


def _numbered_alone(docs: DataFrame, size: int, overlap: int, *keep: str) -> DataFrame:
    """(source_key, chunk_index, text, breadcrumb): windows of paragraphs but for noise of pdf sources, numbered within each row."""

    def cut(part: Column) -> Column:
        return F.transform(window_starts(F.length(part), size, overlap), lambda i: F.substring(part, i + 1, F.lit(size)))

    parts = F.filter(F.transform(F.split("text", "\n\n"), strip), lambda p: p != "")
    kept = F.filter(F.flatten(F.transform(parts, cut)), lambda x: (F.col("source_type") != "pdf") | ~is_contents_noise(x))
    return docs.select("source_key", *keep, F.posexplode(kept).alias("chunk_index", "text")).withColumn("breadcrumb", F.lit(""))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_key, source_type, text) to chunks: chunk_id, source_key, source_type, chunk_index, text, embedding_text.

    Noise is dropped from pdf sources before numbering; blank windows after it, so they leave a gap. Where docs have a
    raw_file_path, their chunks do too, as they have the columns to keep.
    """
    more = [c for c in ("raw_file_path",) if c in docs.columns] + list(keep)
    repeated = stored(docs.groupBy("source_key").agg(F.count("*").alias("n")).where("n > 1").select("source_key"), "repeated-keys")
    alone, others = docs, None
    if not repeated.isEmpty():
        few, same = is_small(repeated), F.col("d.source_key").eqNullSafe(F.col("r.source_key"))
        alone, others = (docs.alias("d").join(side(repeated.alias("r"), few), same, kind) for kind in ("left_anti", "left_semi"))
    marked = is_markdown(F.col("text"))
    # A document whose key no other has is numbered in its own row: its text is neither shuffled nor sorted.
    numbered = _numbered_alone(alone.where(~marked), size, overlap, "source_type", *more)
    sections = markdown_sections(alone.where(marked), "source_type", *more)
    if others is not None:
        plain = paragraphs(others.where(~marked), "source_type", *more).withColumn("breadcrumb", F.lit(""))
        sections = sections.unionByName(plain).unionByName(markdown_sections(others.where(marked), "source_type", *more))
    cut = windows(sections, size, overlap)
    kept = cut.where((F.col("source_type") != "pdf") | ~is_contents_noise(F.col("text")))
    more_numbered = kept.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source_key").orderBy("section", "w")) - 1).drop("section", "w")
    numbered = numbered.unionByName(more_numbered).where(strip(F.col("text")) != "")
    embedding = F.when(F.col("breadcrumb") != "", F.concat(F.lit("[BREADCRUMB]"), "breadcrumb", F.lit("[/BREADCRUMB]\n\n"), "text")).otherwise("")
    return numbered.select(F.concat_ws("#", "source_key", "chunk_index").alias("chunk_id"), "source_key", "source_type", "chunk_index", "text", embedding.alias("embedding_text"), *more)


def chunk_prepared(records: DataFrame, size: int = SIZE) -> DataFrame:
    """Records (source_key, ord, text, is_pre_chunked): prepared ones as they are, others in windows without overlap."""
    ready = records.where("is_pre_chunked").select("source_key", "ord", F.lit(0).alias("w"), "text")
    cut = windows(records.where("not is_pre_chunked").select("source_key", "ord", strip(F.col("text")).alias("text")), size, 0).select("source_key", "ord", "w", "text")
    order = Window.partitionBy("source_key").orderBy("ord", "w")
    return ready.unionByName(cut).withColumn("chunk_index", F.row_number().over(order) - 1).select(F.concat_ws("#", "source_key", "chunk_index").alias("chunk_id"), "source_key", "chunk_index", "text")


def within_limit(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per source: n_chunks, accepted, and the reason of a rejection."""
    counted = chunks.groupBy("source_key").agg(F.count("*").alias("n_chunks"))
    reason = F.when(F.col("n_chunks") > limit, F.concat(F.col("n_chunks").cast("string"), F.lit(f" chunks exceed the limit of {limit}")))
    return counted.withColumn("accepted", F.col("n_chunks") <= limit).withColumn("reason", reason)


def pack_lines(rows: DataFrame, limit: int = 3500) -> DataFrame:
    """Lines (source_key, page, header, ord, line) packed in order into parts of at most limit characters: source_key, page, part, text.

    Each part begins with the header. Packing is sequential, so a group is one page's lines; without a page column,
    a source's.
    """
    group = ["source_key", "page"] if "page" in rows.columns else ["source_key"]
    kinds = dict(rows.dtypes)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        header, parts, held, size = frame["header"].iloc[0], [], [], 0
        for line in frame["line"]:
            if held and len(header) + size + 1 + len(line) > limit:
                parts.append("\n".join([header, *held]))
                held, size = [], 0
            held.append(line)
            size += 1 + len(line)
        parts.append("\n".join([header, *held]))
        return pd.DataFrame({**{c: frame[c].iloc[0] for c in group}, "part": range(len(parts)), "text": parts})

    return rows.groupBy(*group).applyInPandas(pack, ", ".join(f"{c} {kinds[c]}" for c in group) + ", part int, text string")
