"""Text blocks of pages to titles, two-line nodes, bands, hierarchies and their projection texts.

blocks: source_id, page, block_id, text, x0, y0, x1, y1, font_size, page_height. Pages are small; they are the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import filled_lines, joined_heading, lines, once
from docloom.operators.storage import stored

PAGE = ["source_id", "page"]
EDGE, NEAR, MAX_X, BAND, OCR_LINES, OCR_TRIGGERS = 0.15, 5.0, 500.0, 8.0, 80, 20
TITLE = r"(?i)\bORG(?:ANISATION|ANIZATION)?\s+CHART\b"
#: Page numbers, slide numbers and notices; those of a company are added by the caller, as they name it.
FOOTERS = [r"[0-9]+(?:\s*/\s*[0-9]+)?", r"(?i)slide\s+[0-9]+", r"(?i)(?:©\s*202[0-9]|strictly confidential|internal use only)"]
# Markers of pages that are tables, itineraries, plans, code or contents.
TABLES = ["参数名称", "默认值", "描述", "类型", "输入列名", "输出", "说明"]
TRIPS = ["每日行程", "日期", "核心路线", "里程", "驾车时长", "行程亮点", "机场", "酒店"]
TRIP_PREPARATION = ["出行时间", "出行人数", "核心路线", "行前准备", "离线地图", "衣物储备", "随车物品", "预约状态"]
MILESTONES = ["开发计划", "阶段", "里程碑", "周期", "目标", "关键交付物", "GO/NO-GO", "BOM", "RFQ"]
CODE = ["PYTHON", "DF.WITH_COLUMN", "IMPORT ", "RETURN ", "COL(", "ARKLLMVISIONUNDERSTANDING"]
CONTENTS = ["目录", "文档控制", "修订摘要", "执行摘要", "附录", "BOM", "验收方法"]


def clean_blocks(blocks: DataFrame, footers: list[str] = FOOTERS) -> DataFrame:
    """Blocks with joined headings, without empty ones and page furniture at the edges."""
    rows = blocks.withColumn("text", joined_heading(F.col("text"))).where("text <> ''")
    at_edge = (F.col("page_height") > 0) & ((F.col("y1") <= F.col("page_height") * EDGE) | (F.col("y0") >= F.col("page_height") * (1 - EDGE)))
    return rows.where(~(at_edge & F.col("text").rlike("^(?:" + "|".join(footers) + ")$")))


def titles(blocks: DataFrame) -> DataFrame:
    """The title block of each page: a named one first, else the largest at the top, else the largest."""
    signal = F.col("text").rlike(TITLE) | F.contains(F.upper("text"), F.lit("FIRST LINE STRUCTURE"))
    top = F.col("y0") <= F.col("page_height") * EDGE
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    order = Window.partitionBy(*PAGE).orderBy(F.when(signal, 0).when(top, 1).otherwise(2), F.when(signal, F.col("y0")), F.desc("font_size"), area.desc(), "block_id")
    return blocks.withColumn("n", F.row_number().over(order)).where("n = 1").select(*PAGE, "block_id", F.col("text").alias("title"))


def without_titles(blocks: DataFrame) -> DataFrame:
    return blocks.join(titles(blocks).select(*PAGE, "block_id").hint("merge"), [*PAGE, "block_id"], "left_anti")


def _merges(a: str, b: str) -> Column:
    gap = F.greatest(F.lit(0.0), F.col(f"{b}.y0") - F.col(f"{a}.y1"))
    font = F.greatest((F.col(f"{a}.font_size") + F.col(f"{b}.font_size")) / 2, F.lit(1.0))
    near = F.abs((F.col(f"{a}.x0") + F.col(f"{a}.x1")) / 2 - (F.col(f"{b}.x0") + F.col(f"{b}.x1")) / 2) < NEAR
    overlap = F.greatest(F.lit(0.0), F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")) / F.greatest(F.lit(1.0), F.least(F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.col(f"{b}.x1") - F.col(f"{b}.x0")))
    return (gap <= 1.5 * font) & (near | (overlap >= 0.7))


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Nodes of one or two lines: neighbours in reading order that belong together, taken in pairs from the left."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_id")
    fields = ["block_id", "text", "x0", "y0", "x1", "y1", "font_size"]
    rows = blocks.select(*PAGE, F.struct(*fields).alias("a"), "y0", "x0", "block_id").withColumn("b", F.lead("a").over(order)).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("joins", F.coalesce(_merges("a", "b"), F.lit(False)))
    # Runs of blocks that each join the next: within a run, blocks at even places begin a pair, if they join at all.
    fresh = ~F.coalesce(F.lag("joins").over(order), F.lit(False))
    rows = rows.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    place = F.row_number().over(Window.partitionBy(*PAGE, "run").orderBy("n")) - 1
    heads = rows.withColumn("place", place).where("place % 2 = 0").withColumn("two", F.col("joins"))
    both = lambda f, c: F.when(F.col("two"), f(f"a.{c}", f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    nodes = heads.select(*PAGE, "n", F.col("a.text").alias("line_1"), F.when(F.col("two"), F.col("b.text")).alias("line_2"), both(F.least, "x0"), both(F.least, "y0"), both(F.greatest, "x1"), both(F.greatest, "y1"))
    named = nodes.withColumn("node", F.row_number().over(Window.partitionBy(*PAGE).orderBy("n")))
    return named.select(*PAGE, "node", "line_1", "line_2", ((F.col("x0") + F.col("x1")) / 2).alias("x_center"), ((F.col("y0") + F.col("y1")) / 2).alias("y_center"))


def bands(nodes: DataFrame, tolerance: float = BAND) -> DataFrame:
    """Nodes with their band: each joins the first band whose mean height is near. Sequential within a page, whose nodes are
    one row meanwhile.

    Heights come in ascending order, so a band that a later one was begun beside is out of reach from then on: only the
    last one is compared.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def assign(heights: pd.Series) -> pd.Series:
        def of(page: np.ndarray) -> list[int]:
            chosen, total, n, k = [], 0.0, 0, -1
            for y in page.tolist():
                if n and abs(y - total / n) <= tolerance:
                    total, n = total + y, n + 1
                else:
                    total, n, k = y, 1, k + 1
                chosen.append(k)
            return chosen

        return heights.map(of)

    rest = [c for c in nodes.columns if c not in PAGE]
    place = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    row = F.struct(place("y_center").alias("y"), place("x_center").alias("x"), F.col("node").alias("id"), F.struct(*rest).alias("row"))
    pages = nodes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("bands", assign(F.transform("rows", lambda r: r["y"])))
    each = pages.select(*PAGE, F.explode(F.arrays_zip(F.transform("rows", lambda r: r["row"]).alias("row"), F.col("bands").alias("band"))).alias("z"))
    values = {c: F.col("z.band" if c == "band" else f"z.row.{c}").alias(c) for c in [*rest, "band"]}
    return each.select(*PAGE, *values.values()).select(*nodes.columns, *([] if "band" in nodes.columns else ["band"]))


def hierarchy(nodes: DataFrame, reach: float = MAX_X) -> DataFrame:
    """Edges (parent, child) from each node to the nearest one by x in the band above, the leftmost if two are as near."""
    above = nodes.select(*PAGE, (F.col("band") + 1).alias("band"), F.col("node").alias("parent"), F.col("x_center").alias("parent_x"))
    pairs = nodes.join(above.hint("merge"), [*PAGE, "band"]).withColumn("distance", F.abs(F.col("x_center") - F.col("parent_x")))
    best = pairs.groupBy(*PAGE, "node").agg(F.min(F.struct("distance", "parent_x", "parent")).alias("best")).where(F.col("best.distance") <= reach)
    return best.select(*PAGE, F.col("best.parent").alias("parent"), F.col("node").alias("child"), F.lit("inferred_reports_to").alias("relation"), F.lit("medium").alias("confidence"))


def label(line_1: Column, line_2: Column) -> Column:
    return F.when(line_2.isNull(), F.concat(F.lit("Field 1: "), line_1)).otherwise(F.concat(F.lit("Field 1: "), line_1, F.lit(" (Field 2: "), line_2, F.lit(")")))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _placed(nodes: pd.Series, steps: pd.Series, children: pd.Series, parents: pd.Series) -> pd.Series:
    """Of each page's nodes in the order of its forest: their number, depth, and the place of what is above; null if edges lead in a circle."""

    def of(ids: np.ndarray, step: np.ndarray, below: np.ndarray | None, above: np.ndarray | None) -> list[list[int | None]] | None:
        number = {x: i for i, x in enumerate(ids)}
        up = dict(zip(below, above, strict=True)) if below is not None else {}
        kids: dict[int, list[int]] = {}
        for i, x in enumerate(ids):
            kids.setdefault(number.get(up[x], -1) if x in up else -1, []).append(i)
        at, depth, over = [], [], []
        # A node whose parent isn't there is a root that is told to be below one.
        todo = [(i, int(ids[i] in up), None) for i in sorted(kids.get(-1, []), key=step.__getitem__, reverse=True)]
        while todo:
            i, deep, parent = todo.pop()
            place = len(at)
            at.append(i)
            depth.append(deep)
            over.append(parent)
            todo.extend((j, deep + 1, place) for j in sorted(kids.get(i, []), key=step.__getitem__, reverse=True))
        return [at, depth, over] if len(at) == len(ids) else None

    return pd.Series([of(*x) for x in zip(nodes, steps, children, parents, strict=True)], dtype="object")


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each page: its nodes in the order of their paths, each with parent, name, depth and `up`, its parent's place.

    A page's texts are brought together once; what is told of its trees is made from that row. Edges that lead in a circle
    have no root: ValueError. A node has one parent.
    """
    rest = [c for c in nodes.columns if c not in PAGE]
    rows = nodes.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest, F.format_string("%010.3f.%06d", "x_center", "node").alias("step"))).alias("nodes"))
    below = edges.groupBy(*PAGE).agg(F.collect_list("child").alias("child"), F.collect_list("parent").alias("parent"))
    rows = rows.join(below.hint("merge"), PAGE, "left")
    rows = rows.withColumn("placed", _placed(F.transform("nodes", lambda n: n["node"]), F.transform("nodes", lambda n: n["step"]), "child", "parent"))
    node = lambda k: F.get("nodes", F.get(F.get("placed", F.lit(0)), k))

    def row(_: Column, k: Column) -> Column:
        up = F.get(F.get("placed", F.lit(2)), k)
        return once(node(k), lambda n: F.struct(*(n[c].alias(c) for c in rest), n["step"].alias("step"), F.get(F.get("placed", F.lit(1)), k).alias("depth"), up.alias("up"), F.when(up.isNotNull(), node(up)["node"]).alias("parent"), label(n["line_1"], n["line_2"]).alias("name")))

    # Alone in a projection the row is built once, however many of its fields are used.
    kept = stored(rows.select(*PAGE, F.transform(F.get("placed", F.lit(0)), row).alias("rows")), "layout-forest")
    if astray := kept.where("rows is null").count():
        raise ValueError(f"on {astray} pages nodes lie on or below circles of edges")
    return kept


@F.pandas_udf(T.ArrayType(T.StringType()))
def _paths(steps: pd.Series, ups: pd.Series) -> pd.Series:
    def of(step: np.ndarray, up: np.ndarray) -> list[str]:
        out: list[str] = []
        for own, above in zip(step, up, strict=True):
            out.append(own if above is None or above != above else f"{out[int(above)]}/{own}")
        return out

    return pd.Series([of(*x) for x in zip(steps, ups, strict=True)], dtype="object")


def paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the path of x places from their root, their place in the order of paths and their depth, whatever the depth."""
    rows = forest(nodes, edges)
    rows = rows.withColumn("paths", _paths(F.transform("rows", lambda r: r["step"]), F.transform("rows", lambda r: r["up"])))
    each = rows.select(*PAGE, F.posexplode(F.arrays_zip("rows", "paths")).alias("place", "z"))
    return each.select(*PAGE, "place", "z.rows.*", F.col("z.paths").alias("path")).drop("step")


def _gathered(placed: DataFrame) -> DataFrame:
    """A row for each page, as forest has it, of nodes with paths."""
    if "rows" in placed.columns:
        return placed
    fields = ["place", "node", "line_1", "name", "depth", "up"]
    return placed.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def projection_text(placed: DataFrame, named: DataFrame) -> DataFrame:
    """The canonical text of each page's forest (as forest or paths give it), with its number of nodes (named: title per page)."""
    rows = _gathered(placed).join(named.hint("merge"), PAGE, "left")
    structure = F.array_join(F.transform("rows", lambda r: F.concat(F.repeat(F.lit("  "), r["depth"]), F.lit("- "), r["name"])), "\n")
    head = F.concat(F.lit("[ORG_CHART]\nSource: "), "source_id", F.lit("\nPage: "), F.col("page").cast("string"), F.lit("\nTitle: "), F.coalesce("title", F.lit("ORG CHART")), F.lit("\nExtraction mode: layout\nConfidence: medium\n\nStructure:\n"))
    text = F.concat(head, structure, F.lit("\n\nSemantic Search Triggers:\n"), _triggers(F.col("rows"), F.lit(0)), F.lit("\n[/ORG_CHART]"))
    return rows.select(*PAGE, text.alias("text"), F.size("rows").cast("long").alias("n_nodes"))


def _triggers(rows: Column, first: Column) -> Column:
    """Sentences on which node is under which, in the order of the upper and then of the lower; rows begin at place `first`."""
    ways = F.array_sort(F.transform(rows, lambda r, k: F.struct(r["up"].alias("up"), k.alias("k"))))
    under = lambda w: F.concat(F.lit("- "), F.get(rows, w["k"])["name"], F.lit(" is structurally under "), F.get(rows, w["up"] - first)["name"], F.lit("."))
    return F.array_join(F.transform(F.filter(ways, lambda w: w["up"] >= first), under), "\n")


def _lines(order: Column | str, line: Column) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    rows = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(order.alias("o"), line.alias("line")))))
    return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")


def subtrees(placed: DataFrame, min_nodes: int) -> DataFrame:
    """The children of roots whose subtrees have at least min_nodes nodes: page, part (from 1, in order), n_nodes, above (the
    root), first (the place of the child) and rows (its subtree)."""
    rows = _gathered(placed)
    # In the order of paths a subtree is a run, which the next node that is no deeper than its top ends.
    heads = F.concat(F.filter(F.transform("rows", lambda r, k: F.when(r["depth"] <= 1, k)), lambda k: k.isNotNull()), F.array(F.size("rows")))
    rows = rows.withColumn("heads", heads)
    tops = F.filter(F.transform("heads", lambda k, i: F.struct(k.alias("first"), (F.get("heads", i + 1) - k).alias("n_nodes"))), lambda t: (t["n_nodes"] >= min_nodes) & F.get("rows", t["first"])["up"].isNotNull())
    each = rows.select(*PAGE, "rows", F.posexplode(tops).alias("n", "t"))
    top = F.get("rows", F.col("t.first"))
    return each.select(*PAGE, (F.col("n") + 1).alias("part"), F.col("t.n_nodes").cast("long").alias("n_nodes"), F.get("rows", top["up"]).alias("above"), F.col("t.first").alias("first"), F.slice("rows", F.col("t.first") + 1, F.col("t.n_nodes")).alias("rows"))


def split_trees(placed: DataFrame, whole: DataFrame, max_nodes: int) -> DataFrame:
    """A page's projection (whole: source_id, page, text, n_nodes) as part 0; of trees beyond max_nodes, also a part for each
    child of a root whose subtree has at least max_nodes nodes, in order: part, n_nodes, text."""
    pages = _gathered(placed)
    first = whole.select(*PAGE, F.lit(0).alias("part"), "n_nodes", "text")
    parts = subtrees(pages.where(F.size("rows") > max_nodes), max_nodes)
    below = F.slice("rows", F.lit(2), F.size("rows"))
    structure = F.array_join(F.transform(below, lambda r: F.concat(F.repeat(F.lit("  "), r["depth"] - 2), F.lit("- "), r["name"])), "\n")
    top = F.get("rows", F.lit(0))
    text = F.concat_ws(
        "\n", F.lit("[ORG_CHART_SUBTREE]"), F.concat(F.lit("Source: "), "source_id"), F.concat(F.lit("Page: "), F.col("page").cast("string")), F.concat(F.lit("Context Root: "), F.col("above.name"), F.lit(" -> "), top["name"]), F.lit("Confidence: medium"), F.lit(""),
        F.lit("Structure:"), F.nullif(structure, F.lit("")), F.lit(""), F.lit("Semantic Search Triggers:"), F.concat(F.lit("- "), F.col("above.line_1"), F.lit(" manages "), top["line_1"], F.lit(".")), F.nullif(_triggers(F.col("rows"), F.col("first")), F.lit("")), F.lit("[/ORG_CHART_SUBTREE]"),
    )
    return first.unionByName(parts.select(*PAGE, "part", "n_nodes", text.alias("text")))


def is_other_page(text: Column) -> Column:
    """Tables, itineraries, plans, code and contents pages: enough of their markers."""
    upper = F.upper(text)
    held = lambda where, words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(where, w)))
    matching = lambda pattern: once(filled_lines(text), lambda rows: F.size(F.filter(rows, lambda x: x.rlike(pattern))))
    numbered = matching(r"^(?:[0-9]+\.|附录\s*[A-Z]?\b)")
    bullets = matching(r"^[•◦▪\-]|^[A-Za-z0-9_]+\s+(?:str|int|float|bool|list|dict)\b")
    return (
        (held(text, TABLES) >= 3) | (held(text, TRIPS) >= 4) | (held(text, TRIP_PREPARATION) >= 4) | (held(upper, MILESTONES) >= 4) | (held(upper, CODE) >= 2)
        | ((F.contains(text, F.lit("目录")) | F.contains(upper, F.lit("TABLE OF CONTENTS"))) & (numbered >= 3)) | ((held(upper, CONTENTS) >= 3) & (numbered >= 2)) | ((bullets >= 5) & (held(text, ["参数", "默认", "说明", "输入", "输出"]) > 0))
    )


def layout_pages(blocks: DataFrame) -> DataFrame:
    """Pages with whether they are layout pages: a heading, or many short blocks in several rows and columns."""
    short = F.length("text") <= 32
    nodes = blocks.where(short).select(*PAGE, F.col("block_id").alias("node"), ((F.col("x0") + F.col("x1")) / 2).alias("x_center"), ((F.col("y0") + F.col("y1")) / 2).alias("y_center"))
    rows = bands(nodes, 10.0).groupBy(*PAGE).agg(F.count_distinct("band").alias("rows"), F.count_distinct(F.bround(F.col("x_center") / 80)).alias("columns"), F.count("*").alias("short"))
    text = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"), _lines("block_id", F.col("text")).alias("text"))
    joined = text.join(rows.hint("merge"), PAGE, "left").fillna(0, ["rows", "columns", "short"])
    crowded = (F.col("short") >= 12) & (F.col("short") >= 0.65 * F.col("n")) & (F.col("rows") >= 3) & (F.col("columns") >= 3)
    return joined.select(*PAGE, (F.col("text").rlike(TITLE) | (~is_other_page(F.col("text")) & crowded)).alias("is_layout"), "short", "rows", "columns")


def ocr_lines(text: Column) -> Column:
    """Lines without bullets and headings, the first OCR_LINES."""
    bare = F.transform(lines(text), lambda x: F.regexp_replace(x, "^[ \t\\-•·|]+|[ \t\\-•·|]+$", ""))
    return F.slice(F.filter(bare, lambda x: (x != "") & ~x.rlike(TITLE) & (x != "组织架构")), 1, OCR_LINES)


def ocr_projection(texts: DataFrame) -> DataFrame:
    """Projections of recognised texts (source_id, page, text) that are layout pages."""
    rows = texts.withColumn("found", ocr_lines(F.col("text")))
    marked = F.col("text").rlike(TITLE) | F.contains("text", F.lit("组织架构"))
    rows = rows.where(marked & (F.size(F.filter("found", lambda x: F.length(x) <= 48)) >= 4))
    body = F.array_join(F.transform("found", lambda x: F.concat(F.lit("- "), x)), "\n")
    triggers = F.array_join(F.transform(F.slice("found", 1, OCR_TRIGGERS), lambda x: F.concat(F.lit("- "), x, F.lit(" appears in OCR org chart text."))), "\n")
    head = F.concat(F.lit("[ORG_CHART_OCR]\nSource: "), "source_id", F.lit("\nPage: "), F.col("page").cast("string"), F.lit("\nExtraction mode: ocr_layout_fallback\nConfidence: low\n\nStructure:\n"))
    return rows.select(*PAGE, F.concat(head, body, F.lit("\n\nSemantic Search Triggers:\n"), triggers, F.lit("\n[/ORG_CHART_OCR]")).alias("projection"))
