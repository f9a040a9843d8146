"""Whole-molecule operators: merging, naming, sorting, deleting, comparing, annotating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import predicates as pr
from latticework.functions.scalars import helix_letters
from latticework.plans.broadcasts import if_small
from latticework.plans.components import components
from latticework.plans.store import Store

ATOM_ORDER = ("chain", "resid", "resname", "insertion_code", "atomid")


def all_in_category(rows: DataFrame, key: list[str], column: str, values: tuple[str, ...] = pr.PROTEIN_RESIDUES) -> DataFrame:
    """Keys all of whose rows have one of the values (is a molecule all protein?)."""
    return rows.groupBy(*key).agg(F.every(pr.attribute_in(column, list(values))).alias("__all")).where("__all").select(*key)


def sort_atoms(atoms: DataFrame, by: tuple[str, ...] = ATOM_ORDER, target: str | None = "atomid") -> DataFrame:
    """Atoms numbered from 1 in each molecule by chain, residue and former number; ord keeps the place."""
    place = F.row_number().over(W.partitionBy("mol_id").orderBy(*by))
    out = atoms.withColumn("ord", place.cast("bigint"))
    return out.withColumn(target, F.col("ord")) if target else out


def edges_between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges from a node of one set to a node of another."""
    return edges.join(a.select(F.col("node").alias("u")), "u", "left_semi").join(b.select(F.col("node").alias("v")), "v", "left_semi").select(*edges.columns)


def prune_edges(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges without those between the two selections, in either direction."""
    there = edges_between(edges, a, b).select("u", "v")
    back = edges_between(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), a, b).select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.join(there.union(back).distinct(), ["u", "v"], "left_anti").select(*edges.columns)


def drop_edges_of(edges: DataFrame, gone: DataFrame, ends: tuple[str, ...] = ("u", "v")) -> DataFrame:
    for e in ends:
        edges = edges.join(gone.select(F.col("node").alias(e)), e, "left_anti").select(*edges.columns)
    return edges


def drop_nodes(bundle: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """atom, edge and interaction without some nodes (mol_id, node): edges and interactions that touch one go too."""
    atom = bundle["atom"].join(gone, ["mol_id", "node"], "left_anti")
    edge = bundle["edge"]
    for e in ("u", "v"):
        edge = edge.join(gone.withColumnRenamed("node", e), ["mol_id", e], "left_anti")
    inter = bundle["interaction"]
    touched = inter.select("mol_id", "itype", "seq", F.explode("atoms").alias("node")).join(gone, ["mol_id", "node"], "left_semi").select("mol_id", "itype", "seq").distinct()
    kept = {"atom": atom, "edge": edge, "interaction": inter.join(touched, ["mol_id", "itype", "seq"], "left_anti")}
    return bundle | {name: df.select(*bundle[name].columns) for name, df in kept.items()}


def shape_of(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """key and the ordered list of values, joined: equal for molecules of one type."""
    held = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*key).agg(F.array_join(F.transform(held, lambda x: x[value]), ",").alias("shape"))


def name_moltypes(atoms: DataFrame, interactions: DataFrame, attributes: tuple[str, ...] = ("atomname", "resname", "resid", "atype", "charge"), molname: str = "molecule", deduplicate: bool = True) -> DataFrame:
    """mol_id, moltype: molecules of equal atoms and interactions share a name, numbered by first appearance."""
    from latticework.plans.ordered import dense_id

    a = atoms.groupBy("mol_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", *attributes)))), 256).alias("__a"))
    i = interactions.groupBy("mol_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("itype", "seq", "atoms", "params")))), 256).alias("__i"))
    shaped = a.join(i, "mol_id", "left").select("mol_id", F.concat("__a", F.coalesce("__i", F.lit(""))).alias("shape"))
    if not deduplicate:
        shaped = shaped.withColumn("shape", F.col("mol_id").cast("string"))
    return dense_id(shaped, "shape", "mol_id").select("mol_id", F.concat(F.lit(f"{molname}_"), F.col("shape_id").cast("string")).alias("moltype"))


def merge_chains(atoms: DataFrame, chains: list[str], all_chains: bool = False) -> DataFrame:
    """mol_id, merged_id: molecules whose chains are all among the given ones become the first of them."""
    held = atoms.groupBy("mol_id").agg(F.collect_set("chain").alias("__c"))
    inside = F.lit(True) if all_chains else F.size(F.array_except("__c", F.array(*[F.lit(c) for c in chains]))) == 0
    marked = held.select("mol_id", inside.alias("__in"))
    first = marked.where("__in").agg(F.min("mol_id").alias("__first"))
    return marked.crossJoin(F.broadcast(first)).select("mol_id", F.when(F.col("__in"), F.col("__first")).otherwise(F.col("mol_id")).alias("merged_id"))


def merge_molecules(atoms: DataFrame, into: DataFrame) -> DataFrame:
    """Atoms renumbered for merging: node, resid and charge_group of later molecules follow on from the earlier ones.

    into: mol_id, merged_id. A missing residue number or charge group counts as one.
    """
    a = atoms.join(into, "mol_id").withColumn("__order", F.col("node"))
    size = a.groupBy("merged_id", "mol_id").agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.max_by("resid", F.when(F.coalesce("resid", F.lit(0)) != 0, F.col("node"))), F.lit(1)).alias("__r"), F.coalesce(F.max_by("charge_group", "node"), F.lit(1)).alias("__g"))
    w = W.partitionBy("merged_id").orderBy("mol_id").rowsBetween(W.unboundedPreceding, -1)
    off = size.select("merged_id", "mol_id", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in ("__n", "__r", "__g")])
    place = F.row_number().over(W.partitionBy("mol_id").orderBy("node")) - 1
    out = a.join(off, ["merged_id", "mol_id"]).withColumns({"__node": F.col("__n0") + place, "__res": F.col("__r0") + F.coalesce("resid", F.lit(1)), "__grp": F.col("__g0") + F.coalesce("charge_group", F.lit(1))})
    rest = [c for c in atoms.columns if c not in ("mol_id", "node", "resid", "charge_group")]
    return out.select(F.col("merged_id").alias("mol_id"), F.col("__node").alias("node"), F.col("__res").alias("resid"), F.col("__grp").alias("charge_group"), *rest, F.col("mol_id").alias("old_mol_id"), F.col("__order").alias("old_node"))


def merge_all(atoms: DataFrame) -> DataFrame:
    ids = atoms.select("mol_id").distinct()
    return merge_molecules(atoms, ids.crossJoin(F.broadcast(ids.agg(F.min("mol_id").alias("merged_id")))))


def merge_by_edges(atoms: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """Molecules joined by new edges (mol_a, mol_b) become the first of each component."""
    comp = components(edges.select(F.col("mol_a").cast("bigint").alias("a"), F.col("mol_b").cast("bigint").alias("b")), store)
    into = atoms.select("mol_id").distinct().join(comp.withColumnRenamed("node", "mol_id"), "mol_id", "left").select("mol_id", F.coalesce("component", "mol_id").alias("merged_id"))
    return merge_molecules(atoms, into)


def stash(rows: DataFrame, attributes: list[str], prefix: str = "stash_") -> DataFrame:
    """Copies of attributes that later changes leave alone; what is stashed already stays."""
    for a in attributes:
        name = f"{prefix}{a}"
        rows = rows.withColumn(name, F.coalesce(name, a) if name in rows.columns else F.col(a))
    return rows


def set_meta(molecules: DataFrame, meta: dict[str, str]) -> DataFrame:
    new = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv])
    old = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*meta))
    return molecules.withColumn("meta", F.map_concat(old, new))


def annotate_residues(residues: DataFrame, sequence: list | str, target: str, order: str = "res_id") -> DataFrame:
    """One value for each residue in order; a single value goes to all, any other length mismatch is an error."""
    n = F.count(F.lit(1)).over(W.partitionBy("mol_id"))
    i = F.row_number().over(W.partitionBy("mol_id").orderBy(order))
    values = F.array(*[F.lit(x) for x in sequence])
    wrong = F.raise_error(F.concat(F.lit(f"{len(sequence)} values for "), n.cast("string"), F.lit(" residues")))
    value = F.lit(sequence[0]) if len(sequence) == 1 else F.when(n == len(sequence), F.get(values, i - 1)).otherwise(wrong)
    return residues.withColumn(target, value)


def annotate_helices(residues: DataFrame, source: str = "aasecstruct", target: str = "cgsecstruct", order: str = "res_id") -> DataFrame:
    """Coarse secondary structure of each residue from the letters of its whole molecule."""
    seq = residues.groupBy("mol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, source))), lambda x: x[source]), "").alias("__s"))
    place = F.row_number().over(W.partitionBy("mol_id").orderBy(order)).cast("int")
    return residues.withColumn("__i", place).join(seq, "mol_id").withColumn(target, F.substring(helix_letters(F.col("__s")), F.col("__i"), F.lit(1))).drop("__s", "__i")


def annotate_disorder(rows: DataFrame, regions: list[tuple[str | None, int, int]], resid: str = "resid") -> DataFrame:
    """cgidr in the regions, where the coarse structure is coil."""
    inside = pr.in_chain_regions(F.col("chain"), F.col(resid), regions)
    out = rows.withColumn("cgidr", inside)
    return out.withColumn("cgsecstruct", F.when(inside, F.lit("C")).otherwise(F.col("cgsecstruct"))) if "cgsecstruct" in rows.columns else out


def residue_spec(text: str) -> dict:
    """[chain-][resname][[#]resid] as a template."""
    import re

    m = re.fullmatch(r"(?:(?P<chain>[^-]+)-)?(?P<resname>[A-Za-z][A-Za-z0-9]*?|[A-Za-z0-9]+(?=#))?#?(?P<resid>[0-9]+)?", text)
    if not m or not text:
        raise ValueError(f"not a residue: {text!r}")
    out = {k: v for k, v in m.groupdict().items() if v}
    if "resid" in out:
        out["resid"] = int(out["resid"])
    return out


def annotate_requests(residues: DataFrame, requests: list[tuple[str, str]], target: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Appends to an array column the value of every request (residue spec, value) that a residue meets.

    'nter' and 'cter' are the protein residues at chain ends (columns is_nter and is_cter).
    """
    out = F.coalesce(target, F.array().cast("array<string>")) if target in residues.columns else F.array().cast("array<string>")
    for spec, value in requests:
        if known and value != "none" and value.lstrip("+") not in known:
            raise NameError(f"unknown {target}: {value}")
        if spec in ("nter", "cter"):
            hit = F.coalesce(F.col(f"is_{spec}"), F.lit(False))
        else:
            hit = pr.matches(residue_spec(spec))
        out = F.when(hit, F.concat(out, F.array(F.lit(value)))).otherwise(out)
    return residues.withColumn(target, out)


def terminal_residues(residues: DataFrame, edges: DataFrame) -> DataFrame:
    """is_nter, is_cter: protein residues with one neighbour, of a higher or lower number than themselves."""
    n = edges.groupBy("mol_id", F.col("u").alias("res_id")).agg(F.count_distinct("v").alias("__d"), F.min("v").alias("__v"))
    other = residues.select("mol_id", F.col("res_id").alias("__v"), F.col("resid").alias("__r"))
    r = residues.join(n, ["mol_id", "res_id"], "left").join(other, ["mol_id", "__v"], "left")
    end = pr.attribute_in("resname", list(pr.PROTEIN_RESIDUES)) & (F.col("__d") == 1)
    return r.withColumns({"is_nter": F.coalesce(end & (F.col("resid") < F.col("__r")), F.lit(False)), "is_cter": F.coalesce(end & (F.col("resid") > F.col("__r")), F.lit(False))}).select(*residues.columns, "is_nter", "is_cter")


def rename_modified(residues: DataFrame, table: DataFrame) -> DataFrame:
    """New residue names by (resname, sorted modifications); table: resname, modifications, new_resname."""
    have = F.sort_array(F.coalesce("modifications", F.array().cast("array<string>")))
    t = table.select(F.col("resname").alias("__n"), F.sort_array("modifications").alias("__m"), "new_resname")
    return residues.join(if_small(t), (F.col("resname") == F.col("__n")) & (have == F.col("__m")), "left").withColumn("resname", F.coalesce("new_resname", "resname")).select(*residues.columns)


def position_restraints(atoms: DataFrame, select: Column, force: float, functype: int = 1, ifdef: str = "POSRES") -> DataFrame:
    """One restraint interaction for each selected atom."""
    return atoms.where(select).select("mol_id", F.lit("position_restraints").alias("itype"), F.array("node").alias("atoms"), F.array(F.lit(str(functype)), *[F.lit("POSRES_FC")] * 3).alias("params"), F.lit(ifdef).alias("ifdef"), F.lit(float(force)).alias("force"))


def virtual_sites(atoms: DataFrame, prefix: str, anchor: str = "BB", name: str = "CA") -> tuple[DataFrame, DataFrame]:
    """(atoms with one site for each anchor bead, numbered after the last node; their construction as interactions)."""
    last = atoms.groupBy("mol_id").agg(F.max("node").alias("__last"), F.max("charge_group").alias("__g"))
    place = F.row_number().over(W.partitionBy("mol_id").orderBy("node"))
    site = atoms.where(F.col("atomname") == anchor).withColumn("__k", place).join(last, "mol_id")
    new = {"node": F.col("__last") + F.col("__k"), "atomname": F.lit(name), "atype": F.concat(F.lit(f"{prefix}_"), F.col("__k").cast("string")), "charge_group": F.col("__g") + F.col("__k")}
    built = site.select("mol_id", F.lit("virtual_sitesn").alias("itype"), F.array((F.col("__last") + F.col("__k")).cast("bigint"), F.col("node").cast("bigint")).alias("atoms"), F.array(F.lit("1")).alias("params"))
    return atoms.unionByName(site.withColumns(new).select(*atoms.columns)), built


def same_multiset(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, same: whether both sides hold the same rows equally often."""
    x = a.groupBy(*key, *columns).agg(F.count(F.lit(1)).alias("__x"))
    y = b.groupBy(*key, *columns).agg(F.count(F.lit(1)).alias("__y"))
    both = x.join(y, [*key, *columns], "full_outer")
    return both.groupBy(*key).agg(F.every(F.col("__x").eqNullSafe(F.col("__y"))).alias("same"))


def remaining_messages(messages: DataFrame, column: str, allowed: dict[str, int | None], blanket: int = 0) -> DataFrame:
    """level, remaining: counts less what is allowed (None allows all); a blanket allowance is shared by the others in order."""
    n = messages.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    less = reduce(lambda acc, kv: F.when(F.col(column) == kv[0], F.lit(2**62) if kv[1] is None else F.lit(kv[1])).otherwise(acc), allowed.items(), F.lit(0))
    left = n.withColumn("remaining", F.greatest(F.col("__n") - less, F.lit(0)))
    if blanket:
        before = F.coalesce(F.sum("remaining").over(W.orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        left = left.withColumn("remaining", F.greatest(F.lit(0), F.col("remaining") - F.greatest(F.lit(0), F.lit(blanket) - before)))
    return left.select(column, F.col("remaining").cast("bigint").alias("remaining"))
