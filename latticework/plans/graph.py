"""Graph plans over edge tables: hops, nearest attribute, degree, quotient graphs, paths, products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.plans.store import Store


def both_ways(edges: DataFrame, u: str = "u", v: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every edge in both directions, as u and v."""
    k = [F.col(x) for x in keys]
    return edges.select(*k, F.col(u).alias("u"), F.col(v).alias("v")).union(edges.select(*k, F.col(v).alias("u"), F.col(u).alias("v"))).distinct()


def k_hop(edges: DataFrame, hops: int, keys: tuple[str, ...] = (), sources: DataFrame | None = None) -> DataFrame:
    """keys, src, dst, depth: nodes within `hops` of each source, with the least depth; depth 0 is the node itself.

    edges must be symmetric (`both_ways`). Each hop joins only the frontier found last, which is written to the
    shared folder, so that no hop computes the ones before it again.
    """
    k = list(keys)
    store = Store(edges.sparkSession)
    edges = store.put("edges", edges)
    start = sources.select(*k, "src") if sources is not None else edges.select(*k, F.col("u").alias("src")).distinct()
    frontier = start.select(*k, "src", F.col("src").alias("dst"))
    reached = frontier.withColumn("depth", F.lit(0))
    step = edges.select(*k, F.col("u").alias("dst"), F.col("v").alias("__next"))
    for depth in range(1, hops + 1):
        new = frontier.join(step, [*k, "dst"]).select(*k, "src", F.col("__next").alias("dst")).distinct()
        frontier = store.put(f"hop{depth}", new.join(reached.select(*k, "src", "dst"), [*k, "src", "dst"], "left_anti"))
        reached = reached.union(frontier.withColumn("depth", F.lit(depth)))
    return reached


def nearest_attribute(edges: DataFrame, values: DataFrame, hops: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, value: the value of the nearest node that has one, by (depth, node). values: keys, node, value."""
    k = list(keys)
    have = values.where(F.col("value").isNotNull())
    reach = k_hop(edges, hops, keys)
    found = reach.join(have.withColumnRenamed("node", "dst"), [*k, "dst"])
    return found.groupBy(*k, F.col("src").alias("node")).agg(F.min_by("value", F.struct("depth", "dst")).alias("value"), F.min("depth").alias("depth"))


def degree(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return edges.groupBy(*keys, F.col("u").alias("node")).agg(F.count_distinct("v").alias("degree"))


def consensus(column: str) -> Column:
    """The value that all rows of a group share, else null."""
    c = F.col(column)
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.count_distinct(c) == 1), F.min(c))


def quotient(nodes: DataFrame, edges: DataFrame, part: list[str], attributes: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(parts, edges between parts) of nodes (keys, node, part..., attributes) grouped by the part columns.

    Parts are numbered per `keys` by their smallest node and carry nnodes, nedges, density and the attributes that
    all members share. Null part values group together.
    """
    from pyspark.sql import Window as W

    from latticework.plans.ordered import dense_id

    k = list(keys)
    grouped = nodes.groupBy(*k, *part).agg(F.min("node").alias("__first"), F.count(F.lit(1)).alias("nnodes"), *[consensus(a).alias(a) for a in attributes if a not in part])
    if k:
        parts = grouped.withColumn("part_id", (F.row_number().over(W.partitionBy(*k).orderBy("__first")) - 1).cast("bigint"))
    else:  # no key to deal by: ranked range by range, each part is the only one with its first node
        parts = dense_id(grouped.withColumn("__shape", F.col("__first")), "__shape", "__first", "part_id").drop("__shape")
    same = reduce(lambda x, y: x & y, [F.col(f"n.{p}").eqNullSafe(F.col(f"p.{p}")) for p in [*k, *part]])
    member = nodes.alias("n").join(parts.alias("p"), same).select(*[F.col(f"n.{x}") for x in k], F.col("n.node"), F.col("p.part_id"))
    ends = edges.join(member.withColumnsRenamed({"node": "u", "part_id": "pu"}), [*k, "u"]).join(member.withColumnsRenamed({"node": "v", "part_id": "pv"}), [*k, "v"])
    inner = ends.where("pu = pv").groupBy(*k, F.col("pu").alias("part_id")).agg(F.count(F.lit(1)).alias("nedges"))
    outer = ends.where("pu <> pv").groupBy(*k, F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).agg(F.count(F.lit(1)).alias("n_edges"))
    parts = parts.join(inner, [*k, "part_id"], "left").withColumn("nedges", F.coalesce("nedges", F.lit(0)))
    parts = parts.withColumn("density", F.when(F.col("nnodes") > 1, 2.0 * F.col("nedges") / (F.col("nnodes") * (F.col("nnodes") - 1))).otherwise(F.lit(0.0)))
    return parts.drop("__first"), outer


def simple_paths(edges: DataFrame, length: int, keys: tuple[str, ...] = (), canonical: bool = True) -> DataFrame:
    """keys, n0..n<length>: paths of `length` edges without a repeated node; canonical: once, smaller end first."""
    k = list(keys)
    out = edges.select(*k, F.col("u").alias("n0"), F.col("v").alias("n1"))
    for i in range(1, length):
        step = edges.select(*k, F.col("u").alias(f"n{i}"), F.col("v").alias(f"n{i + 1}"))
        out = out.join(step, [*k, f"n{i}"])
        for j in range(i):
            out = out.where(F.col(f"n{i + 1}") != F.col(f"n{j}"))
    out = out.select(*k, *[f"n{i}" for i in range(length + 1)])
    return out.where(F.col("n0") < F.col(f"n{length}")) if canonical else out


def categorical_product(a: DataFrame, b: DataFrame, attributes: list[str], node: str = "node") -> DataFrame:
    """ia, ib: node pairs whose attributes are all equal or both missing."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in attributes])
    return a.alias("a").join(b.alias("b"), same).select(F.col(f"a.{node}").alias("ia"), F.col(f"b.{node}").alias("ib"))


def modular_product(pairs: DataFrame, edges_a: DataFrame, edges_b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the modular product: product nodes that differ in both parts and are joined in both graphs or in neither.

    pairs: keys, ia, ib; with keys (a molecule, say) products are formed inside each key alone, by an equi-join. Pairs
    and edges without keys are one small graph each.
    """
    k = list(keys)
    x = pairs.select(*k, F.col("ia").alias("ua"), F.col("ib").alias("ub"))
    y = pairs.select(*k, F.col("ia").alias("va"), F.col("ib").alias("vb"))
    both = (x.join(y, k) if k else x.join(y, (F.col("ua") < F.col("va")))).where((F.col("ua") < F.col("va")) & (F.col("ub") != F.col("vb")))
    ea = edges_a.select(*k, F.col("u").alias("ua"), F.col("v").alias("va"), F.lit(True).alias("in_a"))
    eb = edges_b.select(*[c for c in k if c in edges_b.columns], F.col("u").alias("ub"), F.col("v").alias("vb"), F.lit(True).alias("in_b"))
    marked = both.join(ea, [*k, "ua", "va"], "left").join(eb, [*[c for c in k if c in edges_b.columns], "ub", "vb"], "left")
    return marked.where(F.coalesce("in_a", F.lit(False)) == F.coalesce("in_b", F.lit(False))).select(*k, "ua", "ub", "va", "vb")


def connected(nodes: DataFrame, edges: DataFrame, store: Store, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """keys, connected: whether all nodes of each key hang together (node numbers are unique over all keys)."""
    from latticework.plans.components import components

    k = list(keys)
    comp = components(edges.select(F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b")), store)
    held = nodes.select(*k, "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return held.groupBy(*k).agg((F.min("component") == F.max("component")).alias("connected"))
