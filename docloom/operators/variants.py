"""Metadata as VARIANT columns: parsed once, read by typed paths, and written back with all keys, known or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, name: str = "meta") -> DataFrame:
    """rows with the JSON text of a column as a variant; null where it is no JSON."""
    return rows.withColumn(name, F.try_parse_json(F.col(column)))


def typed(meta: Column, fields: dict[str, tuple[str, str]]) -> list[Column]:
    """A column for each name -> (path, type): null where the path is missing or its value has no such type."""
    return [F.try_variant_get(meta, path, kind).alias(name) for name, (path, kind) in fields.items()]


def encoded(meta: Column) -> Column:
    """The JSON text of a variant, keys in order of their names: equal variants are equal texts."""
    return F.to_json(meta)


def entries(rows: DataFrame, name: str = "meta") -> DataFrame:
    """rows with a row for each key of a variant that is an object: key, value (variant). Other rows have none."""
    return rows.select("*", F.explode(F.try_variant_get(F.col(name), "$", "map<string,variant>")).alias("key", "value"))
