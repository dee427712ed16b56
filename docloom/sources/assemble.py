"""Documents from ordered blocks and from the cells of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip


def _joined(order: list[str], text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), separator)


def table_text(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a Markdown table; the first row is its head, short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda x: F.regexp_replace(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), width - F.size(row))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n")


def from_paragraphs(blocks: DataFrame) -> DataFrame:
    """Blocks of word-processor files (source_id, ord, text; rows: a table's rows of cells, or null) to a text per source.

    Paragraphs, stripped, and tables as Markdown stand in order, one below the other, without headings of their own:
    source_id, text, paragraph_count, table_count, table_rows.
    """
    is_table = F.col("rows").isNotNull() & (F.size("rows") > 0)
    shown = blocks.withColumn("line", F.when(is_table, table_text(F.col("rows"))).when(F.col("rows").isNull(), strip(F.coalesce("text", F.lit("")))))
    kept = shown.where("line <> ''")
    tables = is_table.cast("int")
    return kept.groupBy("source_id").agg(_joined(["ord"], "line", "\n").alias("text"), F.sum(1 - tables).alias("paragraph_count"), F.sum(tables).alias("table_count"), F.coalesce(F.sum(F.when(is_table, F.size("rows"))), F.lit(0)).alias("table_rows"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of slides (source_id, section_no, ord, kind, text) to a text per source: slides by blank lines, notes under a heading."""
    notes = F.when(F.col("kind") == "notes", F.concat(F.lit("### Notes\n"), "text")).otherwise(F.col("text"))
    rows = blocks.where("text is not null and text <> ''").withColumn("text", notes)
    sections = rows.groupBy("source_id", "section_no").agg(_joined(["ord"], "text", "\n\n").alias("body")).withColumn("text", F.concat(F.lit("## Slide "), F.col("section_no").cast("string"), F.lit("\n\n"), "body"))
    return sections.groupBy("source_id").agg(_joined(["section_no"], "text", "\n\n").alias("text"))


def from_cells(cells: DataFrame) -> DataFrame:
    """Cells (source_id, sheet_no, sheet, r, c, value, formula) to Markdown tables: blank rows dropped, short rows padded."""
    shown = F.when(F.col("formula").isNotNull(), F.concat(F.lit("="), F.col("formula"), F.lit("（计算值："), F.coalesce("value", F.lit("")), F.lit("）"))).otherwise(F.coalesce("value", F.lit("")))
    safe = F.regexp_replace(F.replace(shown, F.lit("|"), F.lit("\\|")), "\r\n|[\r\n]", "<br>")
    rows = cells.withColumn("cell", safe).groupBy("source_id", "sheet_no", "sheet", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "cell"))).alias("row"), F.max(F.when(F.trim("cell") != "", F.col("c"))).alias("last")).where("last is not null")
    rows = rows.withColumn("width", F.max("last").over(Window.partitionBy("source_id", "sheet_no"))).withColumn("n", F.row_number().over(Window.partitionBy("source_id", "sheet_no").orderBy("r")))
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda k: F.coalesce(F.element_at("row", k), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    rows = rows.withColumn("text", F.when(F.col("n") == 1, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    sheets = rows.groupBy("source_id", "sheet_no", "sheet").agg(_joined(["r"], "text", "\n").alias("body")).withColumn("text", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), "body"))
    return sheets.groupBy("source_id").agg(_joined(["sheet_no"], "text", "\n\n").alias("text"))
