"""Residue contact maps from overlaps and from surfaces that atoms share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans import radius
from latticework.plans.broadcasts import if_small
from latticework.plans.workers import prepare

#: Widening of radii for overlaps, radius of water (Angstrom), points on a sphere.
WIDEN, WATER, FIB_A, FIB_B = 1.24, 2.80, 233, 377
#: The class of a contact between two atom types (0-10): 1-4 stabilise, 5 destabilises, 6 is neutral.
CLASSES = (
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    (0, 1, 1, 1, 5, 5, 6, 6, 6, 1, 1),
    (0, 1, 5, 1, 5, 5, 6, 6, 6, 1, 5),
    (0, 1, 1, 5, 5, 5, 6, 6, 6, 5, 1),
    (0, 5, 5, 5, 2, 2, 6, 6, 6, 5, 5),
    (0, 5, 5, 5, 2, 3, 6, 6, 6, 5, 5),
    (0, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6),
    (0, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6),
    (0, 6, 6, 6, 6, 6, 6, 6, 6, 6, 6),
    (0, 1, 1, 5, 5, 5, 6, 6, 6, 5, 4),
    (0, 1, 5, 1, 5, 5, 6, 6, 6, 4, 5),
)


def sphere(radius_: float = 1.0) -> np.ndarray:
    """FIB_B points of a Fibonacci lattice on a sphere: even steps down the axis, FIB_A / FIB_B of a turn at each."""
    height = np.linspace(1, -1, FIB_B, endpoint=False)
    ring = np.sqrt(1 - height**2) * np.exp(2j * np.pi * FIB_A / FIB_B * np.arange(1, FIB_B + 1))
    return radius_ * np.column_stack([ring.real, ring.imag, height])


def with_types(atoms: DataFrame, table: DataFrame) -> DataFrame:
    """Atoms with vrad and ctype by residue and atom name (0 where unknown); table: resname, atomname, vrad, ctype."""
    return atoms.join(if_small(table), ["resname", "atomname"], "left").fillna({"vrad": 0.0, "ctype": 0})


def overlaps(atoms: DataFrame, on: list[str], largest: float) -> DataFrame:
    """Atom pairs (i, j both ways) nearer than their widened radii. Positions in Angstrom."""
    pairs = radius.radius_join(atoms, atoms, ["x", "y", "z"], 2 * largest * WIDEN, on=on, strict=True, condition=lambda a, b: a("node") != b("node"))
    near = pairs.where(F.col("distance") < (F.col("vrad_a") + F.col("vrad_b")) * WIDEN)
    return near.select(*[F.col(f"{k}_a").alias(k) for k in on], F.col("node_a").alias("i"), F.col("node_b").alias("j"), F.col("residue_a").alias("ri"), F.col("residue_b").alias("rj"))


def surface_owners(atoms: DataFrame, on: list[str], largest: float) -> DataFrame:
    """For every point of an atom's sphere the nearest covering neighbour (ties to the lower node): i, j, n points.

    Neighbours come from a grid join; an atom's points are compared with its neighbours in one numpy step.
    """
    pairs = radius.radius_join(atoms, atoms, ["x", "y", "z"], 2 * largest + WATER, on=on, strict=True, condition=lambda a, b: a("node") != b("node"))
    near = pairs.where(F.col("distance") < F.col("vrad_a") + F.col("vrad_b") + WATER)
    keys = [F.col(f"{k}_a").alias(k) for k in on]
    one = F.struct(F.col("node_b").alias("j"), F.col("distance").alias("d"), *[F.col(f"{c}_b").alias(c) for c in ("x", "y", "z", "vrad", "residue", "ctype")])
    held = near.groupBy(*keys, F.col("node_a").alias("i"), *[F.col(f"{c}_a").alias(c) for c in ("x", "y", "z", "vrad", "residue", "ctype")]).agg(F.sort_array(F.collect_list(one)).alias("near"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = sphere()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                points = np.array([row.x, row.y, row.z]) + unit * (row.vrad + WATER)
                best, owner = np.full(FIB_B, np.inf), np.full(FIB_B, -1)
                for k, n in enumerate(row.near):
                    inside = ((points - np.array([n["x"], n["y"], n["z"]])) ** 2).sum(axis=1) <= (n["vrad"] + WATER) ** 2
                    take = inside & (n["d"] < best)
                    best[take], owner[take] = n["d"], k
                for k, count in zip(*np.unique(owner[owner >= 0], return_counts=True)):
                    n = row.near[int(k)]
                    out.append((*[getattr(row, x) for x in on], row.i, n["j"], row.residue, n["residue"], row.ctype, n["ctype"], int(count)))
            yield pd.DataFrame(out, columns=[*on, "i", "j", "ri", "rj", "ti", "tj", "points"])

    prepare(atoms.sparkSession)
    schema = ", ".join(f"{k} {atoms.schema[k].dataType.simpleString()}" for k in on)
    return held.mapInPandas(run, f"{schema}, i bigint, j bigint, ri bigint, rj bigint, ti int, tj int, points int")


def contact_map(atoms: DataFrame, on: list[str], largest: float = 1.9) -> DataFrame:
    """on, ri, rj, over, count, stab, dest, rcsu of residue pairs kept: overlapping, or more stabilising than not.

    atoms: on, node, residue, x, y, z (Angstrom), vrad, ctype.
    """
    over = overlaps(atoms, on, largest).groupBy(*on, "ri", "rj").agg(F.lit(1).alias("over"))
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in CLASSES])
    owned = surface_owners(atoms, on, largest).withColumn("cls", F.get(F.get(table, F.col("ti")), F.col("tj"))).where("cls > 0")
    counts = owned.groupBy(*on, "ri", "rj").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("cls") <= 4).alias("stab"), F.count_if(F.col("cls") == 5).alias("dest"))
    both = counts.join(over, [*on, "ri", "rj"], "full_outer").fillna(0, ["over", "count", "stab", "dest"]).where("ri <> rj")
    return both.withColumn("rcsu", F.col("stab") - F.col("dest")).where((F.col("over") == 1) | (F.col("rcsu") > 0))
