"""Residues against their templates: repair by matching graphs, and modifications found on the graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.operators import match, subgraphs
from latticework.operators.subgraphs import Graph
from latticework.operators.topology import RESIDUE
from latticework.plans import graph
from latticework.plans.components import components
from latticework.plans.store import Store

_ANY = "\x1f"


def template_graph(atoms: dict[str, str], edges: list[tuple[str, str]]) -> Graph:
    """A residue's template: atom name -> element, and its bonds."""
    return Graph(atoms, edges)


def reference_residues(residues: DataFrame, templates: dict[str, Graph]) -> DataFrame:
    """residues (keys, resname, and mutation if one was asked for) with `reference`, the template that each is to become; null if unknown."""
    wanted = F.coalesce("mutation", "resname") if "mutation" in residues.columns else F.col("resname")
    return residues.withColumn("reference", F.when(wanted.isin(*templates), wanted))


def _best(found: Graph, names: dict, template: Graph) -> dict:
    """template atom -> node: by names where they fit the bonds, else the largest common part with the most names kept."""
    by_name = {v: n for n, v in names.items()}
    if len(by_name) == len(names) and all(v in template.near and found.kinds[n] == template.kinds[v] for v, n in by_name.items()):
        inside = template.only(by_name)
        if all((by_name[b] in found.near[by_name[a]]) == (b in inside.near[a]) for a in inside.near for b in inside.near if a != b):
            return by_name
    every = subgraphs.largest_common(found, template)
    turned = [m for one in every for m in _turns(one, template)]
    return max(turned, key=lambda m: (sum(names[n] == p for p, n in m.items()), [-ord(c) for p in sorted(m) for c in str(m[p])]), default={})


def _turns(found: dict, template: Graph) -> Iterator[dict]:
    """A match and its images under the symmetries of the matched part, among which names decide."""
    part = template.only(found)
    for turn in subgraphs.matches(part, part):
        yield {p: found[q] for p, q in turn.items()}


def match_residues(atoms: DataFrame, edges: DataFrame, templates: dict[str, Graph]) -> DataFrame:
    """mol_id, residue key, reference, node, template_atom: template_atom null for an extra atom, node null for a missing one.

    atoms: mol_id, node, residue key, atomname, element (and mutation, the residue that was asked for instead).
    edges: mol_id, u, v. Residues without a template are left out.
    """
    key = ["mol_id", *RESIDUE]
    safe = [F.coalesce(F.col(c).cast("string"), F.lit(_ANY)).alias(f"__{c}") for c in key]
    known = reference_residues(atoms, templates).where("reference IS NOT NULL").select(*safe, "reference", "node", "atomname", "element")
    group = [f"__{c}" for c in key] + ["reference"]
    end = known.select(*group, F.col("node").alias("u"))
    other = known.select(*group, F.col("node").alias("v"))
    mol = edges.withColumn("__mol_id", F.col("mol_id").cast("string")).select("__mol_id", "u", "v")
    inner = mol.join(end, ["__mol_id", "u"]).join(other, ["__mol_id", *group[1:], "v"]).select(*group, "u", "v")

    def one(row: dict) -> Iterator[tuple]:
        template = templates[row["reference"]]
        names = {n["node"]: n["atomname"] for n in row["nodes"]}
        got = _best(Graph({n["node"]: n["element"] for n in row["nodes"]}, [(e["u"], e["v"]) for e in row["edges"]]), names, template)
        back = {n: p for p, n in got.items()}
        yield from ((n, back.get(n)) for n in names)
        yield from ((None, p) for p in template.near if p not in got)

    made = subgraphs.each(subgraphs.gathered(known, inner, ["atomname", "element"], group), one, "node bigint, template_atom string", group)
    kinds = {c: atoms.schema[c].dataType for c in key}
    return made.select(*[F.when(F.col(f"__{c}") != _ANY, F.col(f"__{c}")).cast(kinds[c]).alias(c) for c in key], "reference", "node", "template_atom")


def repair_by_graph(atoms: DataFrame, edges: DataFrame, templates: dict[str, Graph], store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, edges, removed): misnamed atoms get their template's name (the old one in old_atomname), missing ones are
    added after the molecule's last node with the template's bonds and no position, extra ones are flagged ptm_atom, or
    removed where a mutation was asked for.
    """
    key = ["mol_id", *RESIDUE]
    found = store.put("residue_matches", match_residues(atoms, edges, templates))
    named = found.where("node IS NOT NULL").select("mol_id", "node", "template_atom", "reference")
    out = atoms.join(named, ["mol_id", "node"], "left").withColumn("old_atomname", F.col("atomname"))
    out = out.withColumns({"ptm_atom": F.col("reference").isNotNull() & F.col("template_atom").isNull(), "atomname": F.coalesce("template_atom", "atomname"), "resname": F.coalesce("reference", "resname")})
    mutated = F.col("mutation").isNotNull() if "mutation" in atoms.columns else F.lit(False)
    gone = out.where(F.col("ptm_atom") & mutated)
    out = out.join(gone.select("mol_id", "node"), ["mol_id", "node"], "left_anti")
    element = F.create_map(*[x for r, t in templates.items() for p, e in t.kinds.items() for x in (F.lit(f"{r}{_ANY}{p}"), F.lit(e))])
    last = atoms.groupBy("mol_id").agg(F.max("node").alias("__last"))
    place = F.row_number().over(W.partitionBy("mol_id").orderBy(*RESIDUE, "template_atom"))
    new = found.where("node IS NULL").withColumn("__k", place).join(last, "mol_id").select(
        "mol_id", (F.col("__last") + F.col("__k")).alias("node"), *[F.col("reference").alias(c) if c == "resname" else F.col(c) for c in RESIDUE],
        F.col("template_atom").alias("atomname"), element[F.concat_ws(_ANY, "reference", "template_atom")].alias("element"), "template_atom", "reference", F.lit(False).alias("ptm_atom"))
    new = store.put("residue_new", new)
    every = store.put("residue_atoms", out.unionByName(new, allowMissingColumns=True))
    bonds = atoms.sparkSession.createDataFrame([(r, a, b) for r, t in templates.items() for a in t.near for b in t.near[a] if a < b] or [(None, None, None)], "reference string, a string, b string")
    side = every.where("template_atom IS NOT NULL").select(*key, "reference", "template_atom", "node")
    fresh = new.select("mol_id", F.col("node").alias("__new"))
    a, b = side.withColumnsRenamed({"template_atom": "a", "node": "u"}).alias("a"), side.withColumnsRenamed({"template_atom": "b", "node": "v"}).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*key, "reference"]]
    joined = a.join(bonds.alias("t"), (F.col("a.reference") == F.col("t.reference")) & (F.col("a.a") == F.col("t.a"))).join(b, [*same, F.col("t.b") == F.col("b.b")])
    joined = joined.select(F.col("a.mol_id").alias("mol_id"), "u", "v")
    added = joined.join(fresh, (joined["mol_id"] == fresh["mol_id"]) & ((F.col("u") == F.col("__new")) | (F.col("v") == F.col("__new"))), "left_semi")
    kept = edges.select("mol_id", "u", "v")
    for e in ("u", "v"):
        kept = kept.join(gone.select("mol_id", F.col("node").alias(e)), ["mol_id", e], "left_anti")
    return every.drop("template_atom", "reference"), kept.select("mol_id", "u", "v").union(added).distinct(), gone.drop("template_atom", "reference")


def modification_graph(atoms: dict[str, tuple[bool, str]], edges: list[tuple[str, str]]) -> Graph:
    """A modification: name -> (whether it is a new atom, the element of a new atom or the name of an anchor), and its bonds."""
    return Graph({n: ("new" if new else "anchor", what) for n, (new, what) in atoms.items()}, edges)


def identify_modifications(atoms: DataFrame, edges: DataFrame, known: dict[str, Graph], store: Store) -> DataFrame:
    """mol_id, branch, resids, modifications: each branch of flagged atoms covered exactly by matches of known modifications.

    Branches are components of flagged atoms; a branch's graph holds its atoms (by element) and its anchors, the
    unflagged atoms next to them (by name). Larger modifications are tried first; an anchor may serve several. A
    branch that nothing covers has null modifications.
    """
    flagged = atoms.where("ptm_atom")
    ends = flagged.select("mol_id", F.col("node").alias("u")), flagged.select("mol_id", F.col("node").alias("v"))
    inner = edges.join(ends[0], ["mol_id", "u"], "left_semi").join(ends[1], ["mol_id", "v"], "left_semi")
    comp = _components_by_molecule(inner, store)
    branch = store.put("branches", flagged.join(comp, ["mol_id", "node"], "left").withColumn("branch", F.coalesce("component", "node")).select("mol_id", "branch", "node", "resid", F.col("element").alias("what"), F.lit("new").alias("state")))
    both = graph.both_ways(edges, keys=("mol_id",))
    touching = both.join(branch.select("mol_id", F.col("node").alias("u"), "branch"), ["mol_id", "u"])
    anchor = touching.join(atoms.where("NOT coalesce(ptm_atom, false)").select("mol_id", F.col("node").alias("v"), "resid", "atomname"), ["mol_id", "v"])
    anchor = anchor.select("mol_id", "branch", F.col("v").alias("node"), "resid", F.col("atomname").alias("what"), F.lit("anchor").alias("state")).distinct()
    held = store.put("branch_nodes", branch.union(anchor))
    order = sorted(known, key=lambda n: (-sum(k[0] == "new" for k in known[n].kinds.values()), -len(known[n].near), n))
    ascending = {n: subgraphs.bounds(known[n])[0] for n in order}

    def one(row: dict) -> Iterator[tuple]:
        g = Graph({n["node"]: (n["state"], n["what"]) for n in row["nodes"]}, [(e["u"], e["v"]) for e in row["edges"]])
        new = {x for x, k in g.kinds.items() if k[0] == "new"}
        options, of = [], []
        for name in order:
            for m in subgraphs.matches(g, known[name], ascending[name]):
                options.append([x for x in m.values() if x in new])
                of.append(name)
        got = match.cover(new, options)
        yield sorted({n["resid"] for n in row["nodes"] if n["state"] == "anchor"}), None if got is None else [of[i] for i in got]

    pairs = both.join(held.select("mol_id", "branch", F.col("node").alias("u")), ["mol_id", "u"]).join(held.select("mol_id", "branch", F.col("node").alias("v")), ["mol_id", "branch", "v"])
    rows = subgraphs.gathered(held, pairs.select("mol_id", "branch", "u", "v"), ["resid", "what", "state"], ["mol_id", "branch"])
    return subgraphs.each(rows, one, "resids array<int>, modifications array<string>", ["mol_id", "branch"])


def _components_by_molecule(edges: DataFrame, store: Store) -> DataFrame:
    """mol_id, node, component, where nodes are numbered in each molecule anew: both are packed into one number."""
    shift = F.lit(1 << 32)
    wide = lambda c: F.col("mol_id") * shift + F.col(c)
    comp = components(edges.select(wide("u").alias("a"), wide("v").alias("b")), store)
    low = lambda c: F.pmod(F.col(c), shift)
    return comp.select(F.expr("shiftright(node, 32)").alias("mol_id"), low("node").alias("node"), low("component").alias("component"))
