"""Column expressions over text: stripping, lines, noise tests, tokens, ratios."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where lines end, as Unicode has it.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: Those that aren't a line feed.
RARE_END = LINE_END.split("|")[1].replace("\n", "")
#: Lower-case substrings of watermark lines.
WATERMARKS = ["仅供", "机密", "confidential", "internal use", "扫描全能王", "camscanner", "adobe scan", "created with", "powered by", "evaluation only", "试用版", "免费版", "©亿欧智库"]
#: Lines that hold only a page number.
PAGE_LINES = [r"[0-9]{1,4}", r"(?i:page)\s*[0-9]{1,4}", r"第\s*[0-9]{1,4}\s*页", r"-\s*[0-9]{1,4}\s*-"]
#: Leaders of contents pages.
LEADER = r"[.0-9 \t\n\x0B\f\r·…]"
#: Latin letters with marks, and what full-text search takes them for.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed a single time for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def collapse(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text begins no further line."""
    plain = F.coalesce(text, F.lit(""))
    found = F.when(plain.rlike(RARE_END), F.split(plain, LINE_END)).otherwise(F.split(plain, "\n"))
    return once(found, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def filled_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def normalized_line(line: Column) -> Column:
    return collapse(F.lower(line))


def is_page_line(line: Column) -> Column:
    return line.rlike("^(?:" + "|".join(PAGE_LINES) + ")$")


def is_watermark_line(line: Column) -> Column:
    return F.lower(line).rlike("|".join(map(re.escape, WATERMARKS)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with line feeds only and no white space at its ends."""
    return F.sha2(strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")), 256)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to three decimals; ties go up."""
    return F.floor(part * F.lit(1000.0) / F.greatest(whole, F.lit(1)) + 0.5) / F.lit(1000.0)


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without marks; characters of Chinese one by one and in pairs."""

    def tokens(plain: Column) -> Column:
        runs = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+)"), 1)
        han = F.regexp_extract_all(plain, F.lit(r"([\x{4e00}-\x{9fff}])"), 1)
        pairs = F.regexp_extract_all(plain, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), 1)
        return F.when(plain.rlike(r"[\x{4e00}-\x{9fff}]"), F.concat(runs, han, pairs)).otherwise(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), 1))

    def unmarked(low: Column) -> Column:
        return once(F.when(low.rlike(f"[{MARKED}]"), F.translate(low, MARKED, PLAIN)).otherwise(low), tokens)

    # Text of ASCII alone has no marks and no Chinese, and its letters and digits are told faster.
    ascii_only = lambda low: F.octet_length(low) == F.length(low)
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda x: F.when(ascii_only(x), F.regexp_extract_all(x, F.lit("([a-z0-9]+)"), 1)).otherwise(unmarked(x)))


def is_contents_noise(text: Column) -> Column:
    """A chunk that is short, dots and digits only, or mostly lines with long leaders."""
    return noise_label(text) != ""


def noise_label(text: Column) -> Column:
    """'short', 'pure_dotted', 'mixed_toc' or '' for a retrieved chunk."""

    def mostly_leaders(rows: Column) -> Column:
        return (F.size(rows) > 0) & (F.size(F.filter(rows, lambda x: x.rlike(LEADER + "{20,}"))) * 2 > F.size(rows))

    bare = strip(text)
    # Lines matter only where a leader is at all.
    crowded = text.rlike(LEADER + "{20,}") & once(filled_lines(text), mostly_leaders)
    return F.when(F.length(bare) < 30, "short").when(bare.rlike("^" + LEADER + "+$"), "pure_dotted").when(crowded, "mixed_toc").otherwise("")


def joined_heading(text: Column) -> Column:
    """Parts apart by two spaces or more; a part of three or more letter-spaced characters becomes a word."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "[\r\n]+", " "))
    parts = F.filter(F.split(flat, r"\s{2,}"), lambda p: strip(p) != "")

    def part(p: Column) -> Column:
        tokens = F.split(collapse(p), " ")
        return F.when((F.size(tokens) >= 3) & F.forall(tokens, lambda x: x.rlike("^[A-Za-z0-9&/(),.-]$")), F.array_join(tokens, "")).otherwise(collapse(p))

    return strip(F.array_join(F.transform(parts, part), " "))


def compact(text: Column, limit: int) -> Column:
    """Collapsed text, cut at limit characters with three dots."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("...")))


def compact_key(text: Column) -> Column:
    """Lower-case letters, digits and Chinese characters alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def without_references(answer: Column) -> Column:
    """The answer before its list of sources."""
    head = strip(F.element_at(F.split(F.coalesce(answer, F.lit("")), "(?:\n\\s*)?来源[:：]", 2), 1))
    return F.regexp_replace(F.regexp_replace(head, r"[（(【\[]\s*$", ""), r"\s+$", "")


def display_name(name: Column) -> Column:
    """manual_YYYYMMDD_HHMMSS as the time of its entry."""
    time = r"^manual_\d{8}_(\d{2})(\d{2})\d{2}$"
    return F.when(name.rlike(time), F.concat(F.lit("手动录入 "), F.regexp_extract(name, time, 1), F.lit(":"), F.regexp_extract(name, time, 2))).otherwise(name)


def packed(**values: Column) -> Column:
    """Metadata as a JSON text, by name."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


def unpacked(text: Column, schema: str) -> Column:
    """struct(metadata: the fields of the schema, raw: the text where it isn't a JSON object)."""
    is_object = F.json_object_keys(text).isNotNull()
    return F.struct(F.when(is_object, F.from_json(text, schema)).alias("metadata"), F.when(~is_object, text).alias("raw"))
