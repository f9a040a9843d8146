"""Radius joins: a theta join on distance turned into an equi-join on grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)]))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def radius_join(left: DataFrame, right: DataFrame, coords: list[str], radius: float, on: list[str] | None = None, strict: bool = False, condition=None, null_safe: bool = False) -> DataFrame:
    """Pairs of rows at most (or, strict, less than) `radius` apart: all columns with suffixes _a and _b, and distance.

    The right side stands in its own cell and the left side visits the cells around its own, so a row is copied
    3^len(coords) times and no pair is found twice. `on` adds equality (null-safe if asked for); `condition(a, b)`
    gets column getters and is applied before the distance. Rows without a full position are left out.
    """
    a = left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    for c in coords:
        a = a.where(F.col(f"{c}_a").isNotNull() & ~F.isnan(f"{c}_a"))
        b = b.where(F.col(f"{c}_b").isNotNull() & ~F.isnan(f"{c}_b"))
    for i, c in enumerate(coords):
        near = F.array(*[_cell(F.col(f"{c}_a"), radius) + k for k in (-1, 0, 1)])
        a = a.withColumn(f"__c{i}", F.explode(near))
        b = b.withColumn(f"__d{i}", _cell(F.col(f"{c}_b"), radius))
    match = [F.col(f"__c{i}") == F.col(f"__d{i}") for i in range(len(coords))]
    for k in on or ():
        match.append(F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b")) if null_safe else F.col(f"{k}_a") == F.col(f"{k}_b"))
    if condition is not None:
        match.append(condition(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
    d = distance([F.col(f"{c}_a") for c in coords], [F.col(f"{c}_b") for c in coords])
    joined = a.join(b, reduce(lambda x, y: x & y, match)).withColumn("distance", d)
    keep = F.col("distance") < radius if strict else F.col("distance") <= radius
    return joined.where(keep).drop(*[f"__{s}{i}" for s in "cd" for i in range(len(coords))])


def nearest(left: DataFrame, right: DataFrame, coords: list[str], radius: float, left_id: str, right_id: str, on: list[str] | None = None, condition=None) -> DataFrame:
    """For each left row the nearest right row within the radius, ties to the smaller id."""
    pairs = radius_join(left, right, coords, radius, on, condition=condition)
    best = F.min(F.struct(F.col("distance"), F.col(f"{right_id}_b").alias("owner")))
    return pairs.groupBy(F.col(f"{left_id}_a").alias(left_id)).agg(best.alias("m")).select(left_id, F.col("m.owner").alias("owner"), F.col("m.distance").alias("distance"))
