"""Mapping atoms to beads: weights, memberships, centroids, induced edges, checks and attribute carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiplicity_weights(rows: DataFrame) -> DataFrame:
    """from_id, to_id, weight: how often a source is listed for a target, over all its listings."""
    n = rows.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(W.partitionBy("from_id"))
    return n.select("from_id", "to_id", (F.col("__n").cast("double") / total).alias("weight"))


def normalised_weights(rows: DataFrame) -> DataFrame:
    """from_id, to_id, weight scaled to a sum of one for each target (targets that weigh nothing stay)."""
    total = F.sum("weight").over(W.partitionBy("to_id"))
    return rows.withColumn("weight", F.when(total == 0, F.col("weight")).otherwise(F.col("weight") / total))


def bead_members(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """The atoms with the beads that they belong to and their weights; table: atom, bead, weight."""
    return atoms.join(table, "atom")


def weighted_centroid(members: DataFrame, key: list[str], coords: list[str], weight: str, keep_weight: bool = False) -> DataFrame:
    """key, the weighted mean of each coordinate and the number of members; null where the weights sum to nothing.

    Members without a full position are left out. Decimal weights and coordinates are summed exactly.
    """
    placed = members
    for c in coords:
        placed = placed.where(F.col(c).isNotNull())
    total = F.sum(weight).alias("__w")
    sums = [F.sum(F.col(weight) * F.col(c)).alias(f"__{c}") for c in coords]
    g = placed.groupBy(*key).agg(total, *sums, F.count(F.lit(1)).alias("n_members"))

    def centre(c: str) -> Column:
        return F.when(F.abs("__w") >= 1e-7, F.col(f"__{c}").cast("double") / F.col("__w").cast("double")).alias(c)

    return g.select(*key, *[centre(c) for c in coords], "n_members", *([F.col("__w").alias(weight)] if keep_weight else []))


def induced_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges u, v between different beads whose atoms (atom, bead) are joined."""
    a = member.select(F.col("atom").alias("u"), F.col("bead").alias("bu"))
    b = member.select(F.col("atom").alias("v"), F.col("bead").alias("bv"))
    both = edges.select("u", "v").join(a, "u").join(b, "v").where("bu <> bv")
    return both.select(F.least("bu", "bv").alias("u"), F.greatest("bu", "bv").alias("v")).distinct()


def uncovered(atoms: DataFrame, member: DataFrame) -> DataFrame:
    return atoms.join(member.select("atom"), "atom", "left_anti")


def overlap(member: DataFrame) -> DataFrame:
    return member.groupBy("atom").agg(F.count_distinct("bead").alias("beads")).where("beads > 1")


def project(entries: DataFrame, rows: DataFrame, columns: DataFrame, by_row: list[str], by_column: list[str], binary: bool = False) -> DataFrame:
    """P A P^T of a sparse matrix (i, j, v): summed by the groups of its rows and columns; binary: 1 where anything is."""
    joined = entries.join(rows, "i").join(columns, "j").groupBy(*by_row, *by_column)
    if binary:
        return joined.agg((F.max(F.col("v")) > 0).cast("int").alias("n"))
    return joined.agg(F.sum("v").cast("bigint").alias("n"), F.count(F.lit(1)).alias("pairs"))


def carry_first(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """key, value of the first member, and whether members disagree."""
    return rows.groupBy(*key).agg(F.min_by(value, order).alias("value"), (F.count_distinct(value) > 1).alias("inconsistent"))


def map_molecules(atoms: DataFrame, edges: DataFrame, mapping: DataFrame) -> dict[str, DataFrame]:
    """Atoms (mol_id, node, resname, atomname, resid, chain, mass, x, y, z) to beads by residue and atom name.

    mapping: resname, atomname, bead, weight, bead_order. Beads are numbered in each molecule by their lowest atom,
    then by bead_order. Returns member, bead, edge, uncovered and overlap.
    """
    res = ["mol_id", "chain", "resid", "resname"]
    first = F.min("node").over(W.partitionBy(*res))
    hit = atoms.join(mapping, ["resname", "atomname"]).withColumn("__lowest", first)
    beads = hit.groupBy(*res, "bead").agg(F.min("__lowest").alias("__lowest"), F.min("bead_order").alias("bead_order"), F.max(F.abs("weight")).alias("__heavy"))
    ids = beads.withColumn("bead_id", F.row_number().over(W.partitionBy("mol_id").orderBy("__lowest", "bead_order")) - 1)
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*res, "bead"]]
    member = hit.alias("h").join(ids.alias("b"), same).select("h.mol_id", F.col("h.node").alias("atom"), "b.bead_id", "h.weight", *[F.col(f"h.{c}") for c in ("mass", "x", "y", "z")])
    centred = weighted_centroid(member.withColumn("weight", F.col("weight") * F.coalesce("mass", F.lit(1.0))), ["mol_id", "bead_id"], ["x", "y", "z"], "weight")
    bead = ids.select("mol_id", "bead_id", "chain", "resid", "resname", F.col("bead").alias("atomname")).join(centred, ["mol_id", "bead_id"], "left")
    a = member.select("mol_id", F.col("atom").alias("u"), F.col("bead_id").alias("bu"))
    b = member.select("mol_id", F.col("atom").alias("v"), F.col("bead_id").alias("bv"))
    edge = edges.join(a, ["mol_id", "u"]).join(b, ["mol_id", "v"]).where("bu <> bv").select("mol_id", F.least("bu", "bv").alias("u"), F.greatest("bu", "bv").alias("v")).distinct()
    return {
        "member": member.select("mol_id", "atom", "bead_id", "weight"), "bead": bead, "edge": edge,
        "uncovered": atoms.join(member.select("mol_id", F.col("atom").alias("node")), ["mol_id", "node"], "left_anti"),
        "overlap": member.groupBy("mol_id", "atom").agg(F.count_distinct("bead_id").alias("beads")).where("beads > 1"),
    }
