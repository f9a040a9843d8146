"""Rules at work on molecules: bonds, links, implicit interactions, repair and modifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import predicates as pr
from latticework.operators import match, network
from latticework.plans import graph
from latticework.plans.components import components
from latticework.plans.store import Store

RESIDUE = ("chain", "resid", "resname", "insertion_code")


def make_bonds(atoms: DataFrame, block_edges: DataFrame | None, store: Store, allow_name: bool = True, allow_dist: bool = True, fudge: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """(bonds, atoms with mol_id by connected residues) of one system's atoms (mol_id, node, residue key, element, x, y, z).

    Names come first, residue by residue; distances then join what is near and not forbidden by a template.
    """
    residue = atoms.withColumn("residue", F.concat_ws("\x1f", F.col("mol_id").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RESIDUE]))
    bonds = forbidden = None
    if allow_name and block_edges is not None:
        bonds, forbidden, _ = network.name_bonds(residue.select("mol_id", "residue", "resname", "atomname", "node"), block_edges)
        bonds, forbidden = bonds.select("u", "v"), forbidden.select("u", "v")
    if allow_dist:
        near = network.distance_bonds(network.with_radius(residue.select("node", "residue", "element", "x", "y", "z")), fudge, forbidden).select("u", "v")
        bonds = near if bonds is None else bonds.union(near).distinct()
    bonds = store.put("bonds", bonds)
    first = residue.groupBy("residue").agg(F.min("node").alias("r"))
    member = residue.join(first, "residue").select("node", "r")
    ends = bonds.join(member.withColumnsRenamed({"node": "u", "r": "a"}), "u").join(member.withColumnsRenamed({"node": "v", "r": "b"}), "v")
    comp = components(ends.where("a <> b").select("a", "b").distinct(), store)
    placed = member.join(comp.withColumnRenamed("node", "r"), "r", "left").select("node", F.coalesce("component", "r").alias("mol_id"))
    return bonds, residue.drop("mol_id", "residue").join(placed, "node")


def _order_conditions(nodes: dict[str, dict]) -> list:
    """Residue orders of all pairs of a link's atoms, and one residue for equal orders."""
    names = list(nodes)
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            oa, ob = nodes[a].get("order", 0), nodes[b].get("order", 0)
            if oa == ob:
                out.append(lambda g, a=a, b=b: g(a, "resid") == g(b, "resid"))
            else:
                out.append(lambda g, a=a, b=b, oa=oa, ob=ob: match.order_condition(oa, g(a, "resid"), ob, g(b, "resid")))
    return out


def _names(want) -> list[str] | None:
    return None if want is None else [want] if isinstance(want, str) else [str(x) for x in want]


def match_link(link, atoms: DataFrame, edges: DataFrame, molecules: DataFrame | None = None) -> DataFrame:
    """mol_id and a column for each atom of a link (a rules.Template), one row for each match.

    atoms: mol_id, node, resid and the attributes that the link names; edges: mol_id, u, v both ways. In order:
    molecule attributes, the induced pattern, residue orders, modifications (if atoms tell theirs), pairs that must
    not be joined, any of its patterns.
    """
    safe = {n: f"n{i}" for i, n in enumerate(link.nodes)}
    nodes = {safe[n]: {k: v for k, v in a.items() if k not in ("order", "replace", "modifications")} for n, a in link.nodes.items()}
    orders = {safe[n]: a for n, a in link.nodes.items()}
    if molecules is not None and link.molmeta:
        fits = pr.matches(link.molmeta, lambda k: F.try_element_at("meta", F.lit(k)))
        atoms = atoms.join(molecules.where(fits).select("mol_id"), "mol_id", "left_semi")
    pattern = match.Pattern(nodes, [(safe[a], safe[b]) for a, b in link.edges if a in safe and b in safe])
    conditions = _order_conditions(orders)
    if "modifications" in atoms.columns:  # names of an atom's modifications; a link without any is for plain atoms
        conditions += [lambda g, n=safe[n], want=a.get("modifications"): pr.modifications_match(g(n, "modifications"), _names(want)) for n, a in link.nodes.items()]
    found = match.find(pattern, atoms, edges, ("mol_id",), conditions)
    for name, template in link.non_edges:
        own = safe[name]
        shift = template.get("order", 0)
        other = atoms.where(pr.matches({k: v for k, v in template.items() if k != "order"})).select("mol_id", F.col("node").alias("v"), F.col("resid").alias("__r"))
        bad = edges.join(other, ["mol_id", "v"]).select("mol_id", F.col("u").alias(own), "__r")
        on = [found["mol_id"] == bad["mol_id"], found[own] == bad[own], found[f"{own}__resid"] + (shift if isinstance(shift, int) else 0) == bad["__r"]]
        found = found.join(bad, on, "left_anti")
    if link.patterns:
        parts = F.lit(False)
        for p in link.patterns:
            one = F.lit(True)
            for key, attrs in p:
                if key in safe:
                    one = one & pr.matches(attrs, lambda c, k=safe[key]: F.col(f"{k}__{c}"), ignore=("order",))
            parts = parts | one
        found = found.where(parts)
    rename = {v: f"@{k}" for k, v in safe.items()} | {f"{v}__{c}": f"@{k}__{c}" for k, v in safe.items() for c in atoms.columns}
    return found.withColumnsRenamed({a: b for a, b in rename.items() if a in found.columns})


def apply_links(links: list, atoms: DataFrame, edges: DataFrame, interactions: DataFrame, store: Store, molecules: DataFrame | None = None, every: int = 8) -> tuple[DataFrame, DataFrame]:
    """(atoms, interactions) after all links in order: attributes replaced, interactions deleted and upserted, atoms dropped.

    Later links see what earlier ones did; the tables are written to the shared folder every few links.
    """
    both = graph.both_ways(edges, keys=("mol_id",))
    kinds = dict(atoms.dtypes)
    for i, link in enumerate(links):
        found = match_link(link, atoms, both, molecules)
        dropped = None
        for name, attrs in link.nodes.items():
            for k, v in attrs.get("replace", {}).items():
                hit = found.select("mol_id", F.col(f"`@{name}`").alias("node")).distinct()
                if k == "atomname" and v is None:
                    dropped = hit if dropped is None else dropped.union(hit)
                elif k in kinds:
                    atoms = atoms.join(hit.withColumn("__hit", F.lit(True)), ["mol_id", "node"], "left").withColumn(k, F.when(F.col("__hit"), F.lit(v).cast(kinds[k])).otherwise(F.col(k))).drop("__hit")
        for itype, held in link.removed.items():
            for r in held:
                interactions = match.delete_interactions(interactions, found, itype, [f"`@{a}`" for a in r.atoms], [str(p) for p in r.params] or None)
        for itype, held in link.interactions.items():
            for n, r in enumerate(held):
                version = int(r.meta.get("version", 1))
                point = lambda a: [F.col(f"`@{a}__{c}`") for c in "xyz"]
                params = [p.column(point) if hasattr(p, "column") else str(p) for p in r.params]
                new = match.interactions_from_matches(found, itype, [f"`@{a}`" for a in r.atoms], params, version=version).withColumn("seq", F.lit((i + 1) * 1_000_000 + n).cast("bigint"))
                interactions = match.upsert_interactions(interactions, new.select(*interactions.columns).dropDuplicates(["mol_id", "itype", "atoms", "version"]))
        if dropped is not None:
            atoms = atoms.join(dropped.distinct(), ["mol_id", "node"], "left_anti")
        if (i + 1) % every == 0:
            atoms, interactions = store.put(f"atoms{i}", atoms), store.put(f"interactions{i}", interactions)
    return atoms, interactions


def polish(atoms: DataFrame, edges: DataFrame, have: DataFrame, hh14: bool = False) -> DataFrame:
    """Implicit angles, dihedrals (one for each middle bond, with fewest hydrogens) and 1-4 pairs: mol_id, itype, atoms, comment.

    have: interactions that are there already (mol_id, itype, atoms), left out in either direction.
    """
    both = graph.both_ways(edges, keys=("mol_id",))
    two, three = graph.simple_paths(both, 2, ("mol_id",)), graph.simple_paths(both, 3, ("mol_id",))
    angles = two.select("mol_id", F.lit("angles").alias("itype"), F.array("n0", "n1", "n2").alias("atoms"))
    h = atoms.select("mol_id", F.col("node"), (F.substring("atomname", 1, 1) == "H").cast("int").alias("h"))
    ends = three
    for e in ("n0", "n3"):
        ends = ends.join(h.select("mol_id", F.col("node").alias(e), F.col("h").alias(f"h_{e}")), ["mol_id", e])
    middle = [F.least("n1", "n2").alias("b"), F.greatest("n1", "n2").alias("c")]
    best = ends.groupBy("mol_id", *middle).agg(F.min_by(F.array("n0", "n1", "n2", "n3"), F.struct(F.col("h_n0") + F.col("h_n3"), "n0", "n1", "n2", "n3")).alias("atoms"))
    dihedrals = best.select("mol_id", F.lit("dihedrals").alias("itype"), "atoms")
    near = graph.k_hop(both, 2, ("mol_id",)).select("mol_id", F.col("src").alias("n0"), F.col("dst").alias("n3"))
    pairs = ends.join(near, ["mol_id", "n0", "n3"], "left_anti")
    if not hh14:
        pairs = pairs.where(F.col("h_n0") + F.col("h_n3") < 2)
    pairs = pairs.select("mol_id", F.lit("pairs").alias("itype"), F.array(F.least("n0", "n3"), F.greatest("n0", "n3")).alias("atoms")).distinct()
    made = angles.union(dihedrals).union(pairs)
    known = have.select("mol_id", "itype", "atoms").union(have.select("mol_id", "itype", F.reverse("atoms").alias("atoms")))
    return made.join(known, ["mol_id", "itype", "atoms"], "left_anti").withColumn("comment", F.concat(F.lit("implicit "), F.regexp_replace("itype", "s$", "")))


def repair(atoms: DataFrame, template: DataFrame, mutated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(atoms with missing ones added and extra ones flagged ptm_atom, atoms removed from mutated residues).

    atoms: mol_id, node, residue key and attributes; template: resname, atomname, element. Names decide; a residue
    without a template is left out. New atoms have no position and follow the last node.
    """
    key = ["mol_id", *RESIDUE]
    known = atoms.join(template.select("resname").distinct(), "resname", "left_semi")
    residues = known.select(*key).distinct()
    want = residues.join(template, "resname")
    same = [known[k].eqNullSafe(want[k]) for k in [*key, "atomname"]]
    t = template.select("resname", "atomname", F.lit(False).alias("__in"))
    flagged = known.join(t, ["resname", "atomname"], "left").withColumn("ptm_atom", F.col("__in").isNull()).drop("__in")
    missing = want.join(known, same, "left_anti")
    from pyspark.sql import Window as W

    last = known.groupBy("mol_id").agg(F.max("node").alias("__last"))
    place = F.row_number().over(W.partitionBy("mol_id").orderBy(*RESIDUE, "atomname"))
    new = missing.withColumn("__k", place).join(last, "mol_id").withColumns({"node": F.col("__last") + F.col("__k"), "atomid": F.col("__last") + F.col("__k") + 1, "ptm_atom": F.lit(False)}).drop("__k", "__last")
    gone = flagged.limit(0)
    if mutated is not None:
        gone = flagged.where("ptm_atom").join(mutated, key, "left_semi")
        flagged = flagged.join(gone.select("mol_id", "node"), ["mol_id", "node"], "left_anti")
    return flagged.unionByName(new, allowMissingColumns=True), gone


def charge_dummies(atoms: DataFrame, edges: DataFrame, dummies: DataFrame) -> DataFrame:
    """mol_id, node, x, y, z of charge dummies (mol_id, node, distance) spread around their one other neighbour."""
    from latticework.functions.geometry import fibonacci_sphere

    both = graph.both_ways(edges, keys=("mol_id",))
    d = dummies.select("mol_id", F.col("node").alias("u"), "distance")
    other = both.join(d, ["mol_id", "u"]).join(dummies.select("mol_id", F.col("node").alias("v")), ["mol_id", "v"], "left_anti")
    one = other.groupBy("mol_id", "u").agg(F.min("v").alias("anchor"), F.count(F.lit(1)).alias("n"), F.first("distance").alias("distance"))
    one = one.withColumn("anchor", F.when(F.col("n") == 1, F.col("anchor")).otherwise(F.raise_error(F.lit("a charge dummy needs exactly one anchor"))))
    from pyspark.sql import Window as W

    w = W.partitionBy("mol_id", "anchor")
    placed = one.withColumns({"k": F.row_number().over(w.orderBy("u")) - 1, "of": F.count(F.lit(1)).over(w)})
    tables = F.create_map(*[x for n in range(1, 9) for x in (F.lit(n), F.array(*[F.array(*[F.lit(float(c)) for c in p]) for p in (fibonacci_sphere(n) if n != 2 else [(0.5, 0.0, 0.0), (-0.5, 0.0, 0.0)])]))])
    at = F.get(tables[F.col("of").cast("int")], F.col("k"))
    anchor = atoms.select("mol_id", F.col("node").alias("anchor"), *[F.col(c).alias(f"{c}0") for c in "xyz"])
    out = placed.join(anchor, ["mol_id", "anchor"])
    return out.select("mol_id", F.col("u").alias("node"), *[(F.col(f"{c}0") + F.col("distance") * F.get(at, F.lit(i))).alias(c) for i, c in enumerate("xyz")])
