"""Graph patterns: compiled to joins where a pattern is fixed, searched in Python workers where it is not."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import predicates as pr
from latticework.plans.workers import prepare


class Pattern:
    """Nodes (name -> template), edges, pairs that must not be joined (all others if induced), and symmetry bounds.

    `ordered` pairs ask for an ascending node id: one answer for each symmetry class.
    """

    def __init__(self, nodes: dict[str, dict], edges: list[tuple[str, str]], ordered: list[tuple[str, str]] = (), induced: bool = True):
        self.nodes, self.edges, self.ordered, self.induced = nodes, edges, list(ordered), induced

    def order(self) -> list[str]:
        """Nodes so that each one but the first is joined to one before, most attributes first."""
        left = sorted(self.nodes, key=lambda n: (-len(self.nodes[n]), n))
        out = [left.pop(0)]
        while left:
            joined = [n for n in left if any({n, m} == set(e) for e in self.edges for m in out)]
            nxt = (joined or left)[0]
            left.remove(nxt)
            out.append(nxt)
        return out


def find(pattern: Pattern, nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = (), conditions: list = ()) -> DataFrame:
    """One row for each match, a column for each pattern node. edges must hold both directions.

    nodes: keys, node and the attributes that templates name. The pattern becomes a chain of joins: a filtered scan
    for each node, an edge join for each edge, an anti-join for each pair without an edge.
    conditions: functions of a getter(node name, attribute) -> Column.
    """
    k = list(keys)
    attributes = [c for c in nodes.columns if c not in (*k, "node")]

    def candidates(name: str) -> DataFrame:
        hit = nodes.where(pr.matches(pattern.nodes[name], ignore=("order", "replace")))
        return hit.select(*k, F.col("node").alias(name), *[F.col(a).alias(f"{name}.{a}".replace(".", "__")) for a in attributes])

    def get(name: str, attribute: str) -> Column:
        return F.col(name) if attribute == "node" else F.col(f"{name}__{attribute}")

    ordered = pattern.order()
    out, seen = candidates(ordered[0]), [ordered[0]]
    pairs = {frozenset(e) for e in pattern.edges}
    for name in ordered[1:]:
        linked = [m for m in seen if frozenset((m, name)) in pairs]
        if linked:
            step = edges.select(*k, F.col("u").alias(linked[0]), F.col("v").alias(name))
            out = out.join(step, [*k, linked[0]]).join(candidates(name), [*k, name])
        else:
            if not k:
                raise ValueError("a pattern of several pieces needs keys to join them by")
            out = out.join(candidates(name), k)
        for m in seen:
            out = out.where(F.col(m) != F.col(name))
        for a, b in pattern.ordered:
            if {a, b} <= {*seen, name} and name in (a, b):
                out = out.where(F.col(a) < F.col(b))
        for m in linked[1:]:
            out = out.join(edges.select(*k, F.col("u").alias(m), F.col("v").alias(name)), [*k, m, name], "left_semi")
        if pattern.induced:
            for m in seen:
                if m not in linked:
                    out = out.join(edges.select(*k, F.col("u").alias(m), F.col("v").alias(name)), [*k, m, name], "left_anti")
        seen.append(name)
    for c in conditions:
        out = out.where(c(get))
    return out.select(*k, *pattern.nodes, *[c for c in out.columns if "__" in c])


def bipartite_path(edges: DataFrame) -> DataFrame:
    """a, b, c: two different left nodes (a < c) of edges u, v that meet in a right node b."""
    x = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    y = edges.select(F.col("u").alias("c"), F.col("v").alias("b"))
    return x.join(y, "b").where("a < c").select("a", "b", "c")


def _order_kind(order) -> tuple[str, int]:
    if isinstance(order, int):
        return "number", order
    if order and set(order) in ({">"}, {"<"}):
        return "arrow", len(order) * (1 if order[0] == ">" else -1)
    if order and set(order) == {"*"}:
        return "star", len(order)
    raise ValueError(f"not an order: {order!r}")


def order_condition(order_a, resid_a: Column, order_b, resid_b: Column) -> Column:
    """Whether the residue numbers of two pattern nodes fit their orders: numbers, > and < chains, * groups."""
    (ka, va), (kb, vb) = _order_kind(order_a), _order_kind(order_b)
    if ka == "number" and kb == "number":
        return (resid_b - resid_a) == vb - va
    arrows = lambda k, v: k == "arrow" or (k == "number" and v == 0)
    if arrows(ka, va) and arrows(kb, vb):
        sign = (vb > va) - (vb < va)
        return F.signum((resid_b - resid_a).cast("double")) == float(sign)
    if ka == "star" and kb == "star":
        return (resid_a == resid_b) if va == vb else (resid_a != resid_b)
    if "star" in (ka, kb) and (("number", 0) in ((ka, va), (kb, vb))):
        return resid_a != resid_b
    return F.lit(True)


def any_pattern(patterns: list[dict[str, dict]]) -> Column:
    """Any of several conjunctions; each maps an alias to a template."""
    parts = [reduce(lambda a, b: a & b, [pr.matches(t, lambda c, n=n: F.col(f"{n}.{c}")) for n, t in p.items()], F.lit(True)) for p in patterns]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def without_neighbour(rows: DataFrame, neighbours: DataFrame, on: list[str]) -> DataFrame:
    """Rows with no neighbour of some kind (already filtered)."""
    return rows.join(neighbours, on, "left_anti")


def compare_with_template(have: DataFrame, want: DataFrame, on: list[str]) -> DataFrame:
    """Found, missing and extra members: a full outer join of what is there and what the template asks for."""
    a, b = have.withColumn("__h", F.lit(True)), want.withColumn("__w", F.lit(True))
    state = F.when(F.col("__h").isNull(), "missing").when(F.col("__w").isNull(), "extra").otherwise("found")
    return a.join(b, on, "full_outer").select(*on, state.alias("state"))


def upsert_interactions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Interactions keyed by (mol_id, itype, atoms, version): a new one takes the place (seq) of the old one."""
    from latticework.plans.ordered import last_wins

    key = ["mol_id", "itype", "atoms", "version"]
    both = old.withColumn("__t", F.lit(0)).unionByName(new.withColumn("__t", F.lit(1)))
    place = both.groupBy(*key).agg(F.min(F.struct("__t", "seq")).alias("__first"))
    kept = last_wins(both, key, ["__t", "seq"])
    return kept.join(place, key).withColumn("seq", F.col("__first.seq")).select(*old.columns)


def interactions_from_matches(matches: DataFrame, itype: str, atoms: list[str], params: list, keys: tuple[str, ...] = ("mol_id",), version: int = 1) -> DataFrame:
    """One interaction of fixed parameters (text or Column) for each match of a link."""
    made = [p if isinstance(p, Column) else F.lit(str(p)) for p in params]
    return matches.select(*keys, F.lit(itype).alias("itype"), F.array(*[F.col(a).cast("bigint") for a in atoms]).alias("atoms"), F.array(*made).alias("params"), F.lit(version).alias("version"))


def delete_interactions(interactions: DataFrame, matches: DataFrame, itype: str, atoms: list[str], params: list[str] | None = None) -> DataFrame:
    """Interactions without the first that stands on the matched atoms (and has the parameters, if given)."""
    gone = matches.select("mol_id", F.array(*[F.col(a).cast("bigint") for a in atoms]).alias("atoms")).distinct()
    hit = interactions.where(F.col("itype") == itype).join(gone, ["mol_id", "atoms"], "left_semi")
    if params:
        hit = hit.where(F.col("params") == F.array(*[F.lit(p) for p in params]))
    first = hit.groupBy("mol_id", "itype", "atoms").agg(F.min("seq").alias("seq"))
    return interactions.join(first, ["mol_id", "itype", "atoms", "seq"], "left_anti").select(*interactions.columns)


# --- searches in Python workers: each molecule is small ------------------------------------------------------------


def cover(items: set, options: list[list], start: int = 0) -> list[int] | None:
    """Indices of options that cover each item exactly once, lowest indices preferred; None if there are none."""
    if not items:
        return []
    for i in range(start, len(options)):
        o = set(options[i])
        if o and o <= items:
            rest = cover(items - o, options, i + 1)
            if rest is not None:
                return [i, *rest]
    return None


def exact_covers(rows: DataFrame, options: list[list[int]]) -> DataFrame:
    """mol_id, options: the exact cover of each molecule's items, null if there is none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"mol_id": pdf["mol_id"], "options": [cover(set(int(x) for x in i), options) for i in pdf["items"]]})

    prepare(rows.sparkSession)
    held = rows.groupBy("mol_id").agg(F.collect_set("item").alias("items"))
    return held.mapInPandas(run, "mol_id bigint, options array<int>")
