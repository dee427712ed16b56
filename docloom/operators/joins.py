"""How sides of joins are dealt with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join is sent to all executors.
SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df is counted to have few rows. It is run for that, so it should be stored or cheap."""
    return df.limit(rows + 1).count() <= rows


def side(df: DataFrame, few: bool) -> DataFrame:
    """df as a side of a join that is broadcast if it is known to be small, else sorted and merged."""
    return F.broadcast(df) if few else df.hint("merge")


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows, else to be joined by a sort and merge."""
    return side(df, is_small(df, rows))
