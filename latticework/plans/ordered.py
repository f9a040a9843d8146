"""Ordered plans: renumbering, running offsets, islands, dense ids, upserts, ordered deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def renumber(df: DataFrame, by: list[Column | str], partition: list[str], target: str = "atomid", start: int = 1) -> DataFrame:
    """A new number from `start` in the order of `by`, inside each partition."""
    return df.withColumn(target, (F.row_number().over(W.partitionBy(*partition).orderBy(*by)) - 1 + start).cast("bigint"))


def running_offset(df: DataFrame, size: str, order: list[str], partition: list[str], target: str = "offset") -> DataFrame:
    """The sum of the sizes of all rows before this one: where its part begins after merging."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(target, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def islands(df: DataFrame, value: str, order: list[str], partition: list[str]) -> DataFrame:
    """partition, island (from 1), value, n: consecutive rows with the same value, as run lengths."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.when(F.lag(F.struct(value)).over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    marked = df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "island", value).agg(F.count(F.lit(1)).alias("n"))


def dense_id(df: DataFrame, shape: str, order: str, target: str = "shape_id") -> DataFrame:
    """Each shape's number from 0 by its first appearance.

    Only the distinct shapes are ranked, over ranges of their first appearance: a shape's number is its place in
    its range plus the sizes of the ranges before, so no task ranks all of them.
    """
    first = df.groupBy(shape).agg(F.min(order).alias("__at"))
    ranged = first.repartitionByRange("__at").withColumn("__p", F.spark_partition_id())
    from latticework.plans.store import Store

    held = Store(df.sparkSession).put("shapes", ranged)
    sizes = {r["__p"]: r["count"] for r in held.groupBy("__p").count().collect()}  # one number for each range
    before, total = [], 0
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total)]
        total += sizes[p]
    base = F.create_map(*before)[F.col("__p")] if before else F.lit(0)
    ranked = held.withColumn(target, (base + F.row_number().over(W.partitionBy("__p").orderBy("__at")) - 1).cast("bigint"))
    return df.join(ranked.select(shape, target), shape)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: the last row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__m")
    return df.groupBy(*key).agg(best).select(*key, *[F.col("__m")[c].alias(c) for c in rest])


def first_match(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__m")
    return df.groupBy(*key).agg(best).select(*key, *[F.col("__m")[c].alias(c) for c in rest])


def all_maxima(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Every row of a key that has the key's largest value (ties stay)."""
    best = df.groupBy(*key).agg(F.max(value).alias("__best"))
    return df.join(best, key).where(F.col(value) == F.col("__best")).drop("__best")
