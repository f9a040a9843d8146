"""Bonds, elastic networks, contacts and water bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import geometry as geo
from latticework.functions import predicates as pr
from latticework.plans import graph, radius

#: Bond radii in nm by element (Se corrected to the scale of its neighbours).
RADII = {"H": 0.120, "D": 0.120, "He": 0.140, "C": 0.170, "N": 0.155, "O": 0.152, "F": 0.147, "Ne": 0.154, "Si": 0.210, "P": 0.180, "S": 0.180, "Cl": 0.175, "Ar": 0.188, "As": 0.185, "Se": 0.190, "Br": 0.185, "Kr": 0.202, "Te": 0.206, "I": 0.198, "Xe": 0.216}


def with_radius(atoms: DataFrame, radii: dict[str, float] | None = None) -> DataFrame:
    """Only atoms of known elements, with their radius."""
    r = F.create_map(*[F.lit(x) for kv in (radii or RADII).items() for x in kv])
    return atoms.withColumn("radius", r[F.col("element")]).where(F.col("radius").isNotNull())


def distance_bonds(atoms: DataFrame, fudge: float = 1.2, non_edges: DataFrame | None = None, largest: float | None = None, on: list[str] | None = None) -> DataFrame:
    """u, v, distance of atoms (node, residue, element, radius, x, y, z) that are near enough to be bonded.

    No two hydrogens, and no hydrogen with an atom of another residue; pairs of non_edges (u < v) are left out.
    """
    reach = largest if largest is not None else atoms.agg(F.max("radius")).first()[0]
    if reach is None:
        reach = 1.0
    h = lambda c: c.isin("H", "D")

    def allowed(a, b):
        return (a("node") < b("node")) & ~(h(a("element")) & h(b("element"))) & ~(~a("residue").eqNullSafe(b("residue")) & (h(a("element")) | h(b("element"))))

    pairs = radius.radius_join(atoms, atoms, ["x", "y", "z"], reach * fudge, on=on, condition=allowed)
    near = pairs.where(F.col("distance") <= 0.5 * (F.col("radius_a") + F.col("radius_b")) * fudge)
    keys = [F.col(f"{k}_a").alias(k) for k in on or ()]
    out = near.select(*keys, F.col("node_a").alias("u"), F.col("node_b").alias("v"), "distance")
    return out if non_edges is None else out.join(non_edges, [*(on or []), "u", "v"], "left_anti")


def name_bonds(atoms: DataFrame, block_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bonds, forbidden pairs, residues left to distances) from templates.

    atoms: mol_id, residue, resname, atomname, node. block_edges: resname, a, b (atom names). A residue with a
    repeated atom name, or whose name has no template, is left to distances.
    """
    key = ["mol_id", "residue"]
    names = atoms.groupBy(*key, "resname").agg((F.count(F.lit(1)) > F.count_distinct("atomname")).alias("repeated"))
    known = block_edges.select("resname").distinct().withColumn("known", F.lit(True))
    state = names.join(known, "resname", "left")
    left = state.where(F.col("repeated") | F.col("known").isNull()).select(*key)
    fine = atoms.join(left, key, "left_anti").select(*key, "resname", "atomname", "node")
    a = fine.withColumnsRenamed({"atomname": "a", "node": "na"})
    b = fine.withColumnsRenamed({"atomname": "b", "node": "nb"})
    ends = a.join(block_edges, ["resname", "a"]).join(b, [*key, "resname", "b"])
    bonds = ends.select("mol_id", F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v")).distinct()
    pairs = a.join(b, [*key, "resname"]).where("na < nb").select("mol_id", F.col("na").alias("u"), F.col("nb").alias("v"))
    return bonds, pairs.join(bonds, ["mol_id", "u", "v"], "left_anti"), left


def pairs_under_threshold(a: DataFrame, b: DataFrame, threshold: float, bonds: DataFrame | None = None, min_edges: int = 0) -> DataFrame:
    """Pairs of two selections (mol_id, node, x, y, z) strictly nearer than a threshold.

    Pairs of one molecule that are fewer than min_edges bonds apart are left out (bonds: mol_id, u, v both ways).
    """
    pairs = radius.radius_join(a, b, ["x", "y", "z"], threshold, strict=True, condition=lambda p, q: (p("node") != q("node")) | (p("mol_id") != q("mol_id")))
    if bonds is not None and min_edges > 1:
        near = graph.k_hop(bonds, min_edges - 1, ("mol_id",)).select(F.col("mol_id").alias("mol_id_a"), F.col("mol_id").alias("mol_id_b"), F.col("src").alias("node_a"), F.col("dst").alias("node_b"))
        pairs = pairs.join(near, ["mol_id_a", "mol_id_b", "node_a", "node_b"], "left_anti")
    return pairs


#: Residues and atoms on either side of the hydrogen bonds between nucleic strands, their longest (nm), and the bonds that must lie between.
DONORS = (("DA", ("C2", "N6")), ("DG", ("N1", "N2")), ("DC", ("N4",)), ("DT", ("N3",)))
ACCEPTORS = (("DA", ("N1",)), ("DG", ("O6",)), ("DC", ("N3", "O2")), ("DT", ("O2", "O4")))
STRAND_REACH, STRAND_BONDS = 0.30, 4
#: The atom of a cysteine bridge, and its longest (nm).
BRIDGE, BRIDGE_REACH = {"resname": "CYS", "atomname": "SG"}, 0.22


def _ends_of_strands(sides) -> list[dict]:
    """Templates of a side: a residue in the middle, or at either end, of a strand."""
    return [{"resname": pr.Choice((r, f"{r}3", f"{r}5")), "atomname": pr.Choice(tuple(names))} for r, names in sides]


def edges_at_distance(atoms: DataFrame, bonds: DataFrame, templates_a: list[dict], templates_b: list[dict], threshold: float, min_edges: int = 0) -> DataFrame:
    """mol_a, u, mol_b, v, distance: new edges between two selections of atoms, each pair once.

    Pairs of one molecule with fewer than min_edges bonds between them are left out. Molecules that the edges join are
    merged by `molecules.merge_by_edges`.
    """
    cols = ["mol_id", "node", "x", "y", "z"]
    a, b = (atoms.where(pr.any_matches(t)).select(*cols) for t in (templates_a, templates_b))
    near = pairs_under_threshold(a, b, threshold, graph.both_ways(bonds, keys=("mol_id",)) if min_edges > 1 else None, min_edges)
    ends = [F.struct(F.col(f"mol_id_{s}").alias("mol"), F.col(f"node_{s}").alias("node")) for s in "ab"]
    one = near.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q"), "distance").distinct()
    return one.select(F.col("p.mol").alias("mol_a"), F.col("p.node").alias("u"), F.col("q.mol").alias("mol_b"), F.col("q.node").alias("v"), "distance")


def nucleic_strands(atoms: DataFrame, bonds: DataFrame, threshold: float = STRAND_REACH) -> DataFrame:
    """Edges in place of the hydrogen bonds between complementary strands."""
    return edges_at_distance(atoms, bonds, _ends_of_strands(DONORS), _ends_of_strands(ACCEPTORS), threshold, STRAND_BONDS)


def cysteine_bridges(atoms: DataFrame, bonds: DataFrame, threshold: float = BRIDGE_REACH, template: dict | None = None) -> DataFrame:
    """Edges between sulphur atoms of cysteines that are near enough."""
    return edges_at_distance(atoms, bonds, [template or BRIDGE], [template or BRIDGE], threshold)


def without_bridges(edges: DataFrame, atoms: DataFrame, template: dict | None = None) -> DataFrame:
    """Edges (mol_id, u, v) without those between two sulphur atoms of cysteines."""
    hit = atoms.where(pr.matches(template or BRIDGE)).select("mol_id", "node")
    there = edges.join(hit.withColumnRenamed("node", "u"), ["mol_id", "u"], "left_semi").join(hit.withColumnRenamed("node", "v"), ["mol_id", "v"], "left_semi")
    return edges.join(there.select("mol_id", "u", "v"), ["mol_id", "u", "v"], "left_anti").select(*edges.columns)


def bridge_option(value: str) -> str | float:
    """What is asked of bridges: a distance in nm, `auto` (found at the usual distance) or `none`."""
    word = value.strip().lower()
    if word in ("auto", "none"):
        return word
    try:
        return float(word)
    except ValueError:
        raise ValueError(f"bridges are auto, none or a distance in nanometres, not {value!r}") from None


def elastic_network(beads: DataFrame, near: DataFrame, low: float, up: float, rate: float, power: float, base: float, minimum: float, bond_type: int = 6, on: list[str] | None = None, domain=None) -> DataFrame:
    """Bonds u, v, bond_type, length, force of beads (node, residue, x, y, z) within the upper bound.

    near: residue pairs (residue_a, residue_b, both ways, itself included) too near in the residue graph.
    domain(a, b) may ask for more, for instance an equal chain. A molecule (`on`) with a bead that has no position
    gets no network.
    """
    lost = beads.where(~pr.has_position())
    whole = beads.join(lost.select(*on).distinct(), on, "left_anti") if on else beads
    pairs = radius.radius_join(whole, whole, ["x", "y", "z"], up, on=on, condition=lambda a, b: (a("node") < b("node")) & (domain(a, b) if domain else F.lit(True)))
    keys = [F.col(f"{k}_a").alias(k) for k in on or ()]
    held = pairs.select(*keys, F.col("node_a").alias("u"), F.col("node_b").alias("v"), "residue_a", "residue_b", "distance")
    far = held.join(near, [*(on or []), "residue_a", "residue_b"], "left_anti")
    force = geo.decay_force(F.col("distance"), low, up, rate, power, base, minimum)
    return far.withColumn("force", force).where(F.col("force") > minimum).select(*(on or []), "u", "v", F.lit(bond_type).alias("bond_type"), geo.quantise(F.col("distance"), 1e5).alias("length"), "force")


def same_chain(a, b):
    return a("chain").eqNullSafe(b("chain"))


def same_region(regions: list[tuple[int, int]], column: str = "resid"):
    """Both in the same one of some regions."""
    def check(a, b):
        out = F.lit(False)
        for r in regions:
            out = out | (pr.in_regions(a(column), [r]) & pr.in_regions(b(column), [r]))
        return out

    return check


def symmetric(contact: DataFrame) -> DataFrame:
    """Contacts a, b (a < b) that are listed in both directions."""
    back = contact.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return contact.join(back, ["a", "b"], "left_semi").where("a < b").distinct()


def go_pairs(contact: DataFrame, residues: DataFrame, near: DataFrame, low: float = 0.3, up: float = 1.1, epsilon: float = 9.414) -> DataFrame:
    """Structure-based pairs: contacts (resid_a, chain_a, resid_b, chain_b) of residues (resid, chain, atype, node, x, y, z).

    Only contacts listed both ways, strictly between the cut-offs, and not within the near residue pairs (u, v).
    sigma is that of a Lennard-Jones minimum at the distance.
    """
    a = residues.select(*[F.col(c).alias(f"{c}_a") for c in residues.columns])
    b = residues.select(*[F.col(c).alias(f"{c}_b") for c in residues.columns])
    both = contact.join(a, contact["resid_a"].eqNullSafe(a["resid_a"]) & contact["chain_a"].eqNullSafe(a["chain_a"])).drop(a["resid_a"], a["chain_a"])
    both = both.join(b, both["resid_b"].eqNullSafe(b["resid_b"]) & both["chain_b"].eqNullSafe(b["chain_b"])).drop(b["resid_b"], b["chain_b"])
    d = radius.distance([F.col(f"{c}_a") for c in "xyz"], [F.col(f"{c}_b") for c in "xyz"])
    both = both.withColumn("distance", d).where((F.col("distance") > low) & (F.col("distance") < up))
    both = both.join(near.select(F.col("u").alias("node_a"), F.col("v").alias("node_b")), ["node_a", "node_b"], "left_anti")
    there = both.select("node_a", "node_b", "atype_a", "atype_b", "distance")
    back = both.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"))
    kept = there.join(back, ["node_a", "node_b"], "left_semi").where("node_a < node_b").dropDuplicates(["node_a", "node_b"])
    return kept.withColumns({"sigma": geo.sigma_from_distance(F.col("distance")), "epsilon": F.lit(epsilon)})


def drop_disordered(pairs: DataFrame, residues: DataFrame, regions: list[tuple[str | None, int, int]], ends: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Pairs without an end in a disordered region; residues: node, chain, resid (the original number)."""
    inside = residues.where(pr.in_chain_regions(F.col("chain"), F.col("resid"), regions)).select("node")
    for e in ends:
        pairs = pairs.join(inside.withColumnRenamed("node", e), e, "left_anti")
    return pairs


def water_bias(residues: DataFrame, epsilon: dict[str, float], sizes: dict[str, float], regions: list[tuple[str | None, int, int]] = (), water: str = "W", auto: bool = True) -> DataFrame:
    """One parameter for each residue (chain, resid, cgsecstruct, bb_atype, go_atype) with a bias: by its secondary structure, or 'idr' in a region."""
    from latticework.functions.scalars import bead_size

    table = F.create_map(*[F.lit(x) for kv in epsilon.items() for x in kv]) if epsilon else F.create_map(F.lit(""), F.lit(0.0))
    eps = F.coalesce(table[F.col("cgsecstruct")], F.lit(0.0)) if auto else F.lit(0.0)
    eps = F.when(pr.in_chain_regions(F.col("chain"), F.col("resid"), list(regions)), F.lit(float(epsilon.get("idr", 0.0)))).otherwise(eps)
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[bead_size(F.col("bb_atype"))]
    out = residues.withColumns({"epsilon": eps, "sigma": size}).where(F.abs("epsilon") > 1e-12)
    return out.select(F.lit(water).alias("atype_a"), F.col("go_atype").alias("atype_b"), "sigma", "epsilon", F.concat(F.lit("water bias "), F.coalesce("cgsecstruct", F.lit(""))).alias("comment"))
