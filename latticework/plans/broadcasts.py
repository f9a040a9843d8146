"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a rule table (some 100 bytes each) that every executor may hold.
MOST_ROWS = 100_000


def if_small(table: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has at most `most` rows; else as it is, and Spark picks the join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
