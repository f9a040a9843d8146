"""Connected components of an edge table, by the smallest id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.store import Store

#: Edges (16 bytes each) that one task may take together.
ONE_TASK = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node that it hangs together with (itself left out)."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = back[: len(a)], back[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[u], parent[v])
        new = parent.copy()
        np.minimum.at(new, parent[u], low)
        np.minimum.at(new, parent[v], low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    while not (parent[parent] == parent).all():
        parent = parent[parent]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held_a, held_b, size = [], [], 0

    def reduce():
        a, b = stars(np.concatenate(held_a), np.concatenate(held_b))
        return [a], [b], len(a)

    floor = 500_000
    for pdf in batches:
        held_a.append(pdf["a"].to_numpy())
        held_b.append(pdf["b"].to_numpy())
        size += len(pdf)
        if size > floor:
            held_a, held_b, size = reduce()
            floor = max(500_000, 2 * size)
    if held_a:
        held_a, held_b, _ = reduce()
        yield pd.DataFrame({"a": held_a[0], "b": held_b[0]})


def components(edges: DataFrame, store: Store, one_task: int = ONE_TASK) -> DataFrame:
    """edges: a, b (bigint). Returns node, component for every node that has an edge.

    Each task first replaces its own edges by stars. What is left goes through one more task if its checked size
    allows, else through rounds of large-star and small-star joins, each written to the shared folder.
    """
    schema = "a bigint, b bigint"
    now = store.put("cc0", edges.where(F.col("a") != F.col("b")).select("a", "b").mapInPandas(_local, schema).distinct())
    n = now.count()
    if n <= one_task:
        done = now.coalesce(1).mapInPandas(_local, schema)
    else:
        state, i = None, 0
        while True:
            i += 1
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = store.put(f"cc{i}l", large)
            down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            joined = down.join(least, "u")
            small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
            now = store.put(f"cc{i}", small)
            new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            store.drop(f"cc{i - 1}")
            store.drop(f"cc{i}l")
            if new == state:
                break
            state = new
        done = now
    return done.select(F.col("a").alias("node"), F.col("b").alias("component")).union(done.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
