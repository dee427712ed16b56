"""Operator 13: fill-in-the-middle transformation of whole texts, with cuts at lines or at code points.

Cuts are counted in units, sentinels and digests in bytes, lengths in code points. What converts between code points and
bytes is a sparse exception index: of a text's multibyte characters alone it records the place and the bytes beyond the
first. A cut is then one searchsorted in that index; spans of ASCII need only arithmetic.

Each document draws four numbers from a hash of the seed and its doc_id: two cuts, whether it is transformed, and the
order of its parts. Texts that hold a sentinel stay plain, so that every output can be taken apart again.

Defined results: null and empty texts are plain and give an empty output; a null doc_id draws as an empty one; repeated
rows are transformed alike; equal cuts give an empty middle; texts of any length are cut whole; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import lean, row_chunks, table, utf8_column

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
LINES, CHARACTERS = "lines", "characters"


@dataclass
class Exceptions:
    """The multibyte characters of a text: their byte places, code-point places and the excess bytes up to each."""

    at: np.ndarray
    points: np.ndarray
    excess: np.ndarray  # one more: 0 before the first

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))))
        return cls(at, at - excess[:-1], excess)

    def to_points(self, places: np.ndarray) -> np.ndarray:
        """Code points before each byte place (a character's first byte, or the end)."""
        return places - self.excess[np.searchsorted(self.at, places, "left")]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """The byte place of each code point, or the end."""
        return points + self.excess[np.searchsorted(self.points, points, "left")]


def _cuts(data: np.ndarray, off: np.ndarray, draws: np.ndarray, units: str, index: Exceptions) -> tuple[np.ndarray, np.ndarray]:
    """Units of each row, and the byte places of its two cuts (rows x 2, ascending)."""
    if units == CHARACTERS:
        start = index.to_points(off[:-1])
        n = index.to_points(off[1:]) - start
        chosen = np.sort(draws % (n + 1)[:, None], axis=1)
        return n, index.to_bytes(start[:, None] + chosen)
    ends = np.flatnonzero(data == 10)
    first = np.searchsorted(ends, off)
    open_end = off[1:] > off[:-1]
    open_end[open_end] = data[off[1:][open_end] - 1] != 10
    n = np.diff(first) + open_end
    chosen = np.sort(draws % (n + 1)[:, None], axis=1)
    inner = np.minimum(first[:-1, None] + np.maximum(chosen, 1) - 1, max(len(ends) - 1, 0))
    places = ends[inner] + 1 if len(ends) else np.zeros_like(chosen)
    places = np.where(chosen == 0, off[:-1, None], np.where(chosen == n[:, None], off[1:, None], places))
    return n, places


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, units: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    rate: percent of the documents that are transformed; spm_rate: percent of those whose suffix comes first.
    """
    if units not in (LINES, CHARACTERS):
        raise ValueError(f"units are {LINES} or {CHARACTERS}")
    _check(sentinels)
    marks = [s.encode() for s in sentinels]
    pre, suf, mid = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, off = utf8_column(batch.column(1))
            drawn = np.column_stack([batch.column(k).to_numpy() for k in range(2, 6)]).astype(np.int64)
            for i, j in row_chunks(off):
                data, at, h = all_data[off[i] : off[j]], off[i : j + 1] - off[i], drawn[i:j]
                index = Exceptions.of(data)
                n, cut = _cuts(data, at, h[:, :2], units, index)
                points = index.to_points(np.column_stack([at[:-1], cut]))
                whole, forms, outputs, held = data.tobytes(), [], [], np.zeros(j - i, bool)
                for k, (a, c1, c2, b, h3, h4) in enumerate(zip(at[:-1].tolist(), cut[:, 0].tolist(), cut[:, 1].tolist(), at[1:].tolist(), h[:, 2].tolist(), h[:, 3].tolist(), strict=True)):
                    text = whole[a:b]
                    if a == b or h3 % 100 >= rate or any(m in text for m in marks):
                        forms.append("plain")
                        outputs.append(text)
                        held[k] = True
                    elif h4 % 100 < spm_rate:
                        forms.append("spm")
                        outputs.append(b"".join((suf, whole[c2:b], pre, whole[a:c1], mid, whole[c1:c2])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((pre, whole[a:c1], suf, whole[c2:b], mid, whole[c1:c2])))
                length = np.diff(points, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms), pa.array(length[:, 0], pa.int64(), mask=held), pa.array(length[:, 1], pa.int64(), mask=held), pa.array(outputs, pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
    return rows.mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _check(sentinels: tuple[str, str, str]) -> None:
    """A sentinel's first character occurs nowhere else in the sentinels: then none can begin inside another or across its border."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and none may begin within another")


def restore(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text of which output was made."""
    if form == "plain":
        return output
    pre, suf, mid = (s.encode() for s in sentinels)
    first, second = (suf, pre) if form == "spm" else (pre, suf)
    b = output.index(second)
    c = output.index(mid, b)
    one, two, middle = output[len(first) : b], output[b + len(second) : c], output[c + len(mid) :]
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return prefix + middle + suffix


def restored_texts(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """transformed with each text rebuilt from its output and form alone (column restored)."""
    _check(sentinels)
    names = transformed.columns
    form, output = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8_column(batch.column(output))
            for i, j in row_chunks(off):
                some, whole = batch.slice(i, j - i), data[off[i] : off[j]].tobytes()
                at = (off[i : j + 1] - off[i]).tolist()
                texts = [restore(whole[a:b], f, sentinels) for a, b, f in zip(at[:-1], at[1:], some.column(form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary()).view(pa.string())], names=[*names, "restored"])

    return transformed.mapInArrow(lean(run), transformed.select("*", F.lit("").alias("restored")).schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {
    "op13_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, string_split(t, chr(10)) AS lines,
    cast(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS bigint) AS n,
    cast('0x' || substr(h, 1, 8) AS bigint) AS h1, cast('0x' || substr(h, 9, 8) AS bigint) AS h2,
    cast('0x' || substr(h, 17, 8) AS bigint) AS h3, cast('0x' || substr(h, 25, 8) AS bigint) AS h4
  FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), heads AS (
  SELECT *, CASE WHEN a = n THEN t WHEN a = 0 THEN '' ELSE array_to_string(lines[1:a], chr(10)) || chr(10) END AS before_a,
    CASE WHEN b = n THEN t WHEN b = 0 THEN '' ELSE array_to_string(lines[1:b], chr(10)) || chr(10) END AS before_b
  FROM cuts
), parts AS (
  SELECT *, before_a AS p, substr(before_b, length(before_a) + 1) AS m, substr(t, length(before_b) + 1) AS s FROM heads
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS bigint) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN cast(length(m) AS bigint) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
}
