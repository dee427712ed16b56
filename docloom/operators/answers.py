"""Model answers that hold JSON, as rows of facts and terms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "key_facts array<struct<content:string,source:string>>, terminology array<struct<zh:string,en:string>>, logic_chain string"


def unfenced(answer: Column) -> Column:
    """The text from its first brace on, without a code fence."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s*```[ \t]*(?:json|JSON)?[ \t]*\r?\n?", ""), r"\r?\n?\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*)", 1)


def close_brackets(text: str) -> str:
    """text without commas before closing brackets, and with the brackets and the string it leaves open closed."""
    expected, quoted, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            expected.append("}" if c == "{" else "]")
        elif c in "}]" and (not expected or expected.pop() != c):
            return text
    return re.sub(r",(\s*[}\]])", r"\1", text + '"' * quoted + "".join(reversed(expected)))


def mended(*candidates: str) -> str:
    """The first candidate that is JSON with its brackets closed, else the last one as it is."""
    for text in candidates:
        fixed = close_brackets(text)
        try:
            json.loads(fixed)
        except ValueError:
            continue
        return fixed
    return candidates[-1]


def parsed(answers: DataFrame) -> DataFrame:
    """(qid, answer) with the struct parsed: by Spark, and after a repair of the brackets where that fails."""
    rows = answers.select("qid", "answer", unfenced(F.col("answer")).alias("rest"))
    whole = F.regexp_extract("rest", r"(?s)(\{.*\})", 1)
    rows = rows.withColumn("body", F.when(whole != "", whole).otherwise(F.col("rest")))
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    tried = rows.withColumn("p", F.from_json("body", f"{SCHEMA}, _bad string", strict))
    broken = (F.col("body") != "") & (F.col("p").isNull() | F.col("p._bad").isNotNull())

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(body=[mended(rest, body) for rest, body in zip(frame["rest"], frame["body"], strict=True)])

    again = tried.where(broken).select(rows.columns).mapInPandas(repair, rows.schema).withColumn("p", F.from_json("body", f"{SCHEMA}, _bad string", strict))
    every = tried.where(~broken | (F.col("body") == "")).unionByName(again)
    good = F.when(F.col("p._bad").isNull(), F.struct("p.key_facts", "p.terminology", "p.logic_chain"))
    return every.select("qid", "answer", good.alias("parsed"))


def facts(answers: DataFrame) -> DataFrame:
    """Facts of parsed answers in order: qid, n (from 1), content, source."""
    rows = parsed(answers).select("qid", F.posexplode("parsed.key_facts").alias("n", "fact")).where("trim(fact.content) <> ''")
    return rows.select("qid", (F.col("n") + 1).alias("n"), F.trim("fact.content").alias("content"), F.trim(F.coalesce("fact.source", F.lit(""))).alias("source"))


def terms(answers: DataFrame) -> DataFrame:
    rows = parsed(answers).select("qid", F.posexplode("parsed.terminology").alias("n", "term")).where("trim(term.zh) <> '' and trim(term.en) <> ''")
    return rows.select("qid", (F.col("n") + 1).alias("n"), "term.zh", "term.en")
