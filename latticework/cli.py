"""From structure files to a coarse-grained topology: read, bond, map, link, network, write."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.operators import mapping, molecules, network, topology
from latticework.plans import graph
from latticework.plans.broadcasts import if_small
from latticework.plans.store import Store
from latticework.sources import rules, structures
from latticework.sources import topology as files


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticework", description=__doc__)
    io = p.add_argument_group("files")
    io.add_argument("-f", dest="structures", required=True, help="structure file (pdb, ent, gro, cif)")
    io.add_argument("-x", dest="out", required=True, help="folder for the written system")
    io.add_argument("-ff-dir", dest="ff_dir", required=True)
    io.add_argument("-map-dir", dest="map_dir", required=True)
    io.add_argument("-from", dest="from_ff", default="universal")
    io.add_argument("-ff", dest="to_ff", required=True)
    io.add_argument("-ignore", nargs="*", default=["SOL"])
    io.add_argument("-ignh", action="store_true")
    io.add_argument("-model", type=int, default=1)
    bonds = p.add_argument_group("bonds")
    bonds.add_argument("-bonds-from", choices=("name", "distance", "none", "both"), default="both")
    bonds.add_argument("-bonds-fudge", type=float, default=1.2)
    net = p.add_argument_group("elastic network")
    net.add_argument("-elastic", action="store_true")
    for flag, default in (("ef", 700.0), ("el", 0.0), ("eu", 0.9), ("ea", 0.0), ("ep", 1.0), ("em", 0.0)):
        net.add_argument(f"-{flag}", type=float, default=default)
    net.add_argument("-ermd", type=int, default=2, help="residues this near in the chain get no bond")
    net.add_argument("-eb", nargs="*", default=["BB"], help="beads of the network")
    more = p.add_argument_group("more")
    more.add_argument("-ss", help="secondary structure letters, one a residue or one for all")
    more.add_argument("-posres", choices=("none", "all", "backbone"), default="none")
    more.add_argument("-pf", type=float, default=1000.0)
    more.add_argument("-name", default="molecule")
    more.add_argument("-maxwarn", type=int, default=0)
    return p


def run(spark: SparkSession, argv: list[str]) -> bool:
    """Whether the system was written; with more warnings than allowed nothing is."""
    a = arguments().parse_args(argv)
    store = Store(spark)
    to = rules.read_force_field(f"{a.ff_dir}/{a.to_ff}")
    maps = rules.read_mappings(a.map_dir).get((a.from_ff, a.to_ff), {})
    fmt = structures.resolve_format(a.structures)
    options = {"exclude": tuple(a.ignore), "ignore_h": a.ignh} | ({} if fmt == "gro" else {"model": a.model})
    read = structures.read_structures(spark, a.structures, fmt, **options)
    atoms = store.put("atoms", read["atom"].withColumn("mass", F.coalesce("mass", F.lit(1.0))))
    try:
        known = rules.read_force_field(f"{a.ff_dir}/{a.from_ff}").tables(spark)["block_edge"]
    except FileNotFoundError:
        known = None
    bonds, atoms = topology.make_bonds(atoms, known, store, a.bonds_from in ("name", "both"), a.bonds_from in ("distance", "both"), a.bonds_fudge) if a.bonds_from != "none" else (read["edge"].select("u", "v"), atoms)
    of = atoms.select(F.col("node").alias("u"), "mol_id")
    made = mapping.map_molecules(atoms, bonds.join(of, "u").select("mol_id", "u", "v"), rules.mapping_table(spark, list(maps.values())))
    block = if_small(to.tables(spark)["block_atom"].select("resname", "atomname", "atype", "charge"))
    bead = made["bead"].withColumnRenamed("bead_id", "node").join(block, ["resname", "atomname"], "left")
    bead = store.put("bead", bead.withColumns({"resid": F.col("resid").cast("int"), "charge_group": F.col("node") + 1, "atomid": F.col("node") + 1, "mass": F.lit(72.0)}))
    edge = store.put("edge", made["edge"])
    if a.ss:
        residues = bead.groupBy("mol_id", "resid").agg(F.min("node").alias("res_id"))
        letters = molecules.annotate_helices(molecules.annotate_residues(residues, a.ss, "aasecstruct"))
        bead = bead.join(letters.select("mol_id", "resid", "cgsecstruct"), ["mol_id", "resid"])
    none = spark.createDataFrame([], "mol_id bigint, itype string, seq bigint, atoms array<bigint>, params array<string>, version int")
    inner = _block_interactions(to, bead, spark)
    bead, inter = topology.apply_links(to.links, bead, edge, none.unionByName(inner), store)
    if a.elastic:
        hop = graph.both_ways(edge.join(bead.select("mol_id", F.col("node").alias("u"), F.col("resid").alias("ru")), ["mol_id", "u"]).join(bead.select("mol_id", F.col("node").alias("v"), F.col("resid").alias("rv")), ["mol_id", "v"]).where("ru <> rv"), "ru", "rv", ("mol_id",))
        near = graph.k_hop(hop, a.ermd, ("mol_id",)).select("mol_id", F.col("src").alias("residue_a"), F.col("dst").alias("residue_b"))
        own = bead.select("mol_id", F.col("resid").alias("residue_a"), F.col("resid").alias("residue_b")).distinct()
        held = bead.where(F.col("atomname").isin(*a.eb)).withColumn("residue", F.col("resid"))
        found = network.elastic_network(held.select("mol_id", "node", "residue", "x", "y", "z"), near.union(own), a.el, a.eu, a.ea, a.ep, a.ef, a.em, on=["mol_id"])
        rows = found.select("mol_id", F.lit("bonds").alias("itype"), F.lit(10**9).cast("bigint").alias("seq"), F.array("u", "v").alias("atoms"), F.array(F.col("bond_type").cast("string"), F.col("length").cast("string"), F.col("force").cast("string")).alias("params"), F.lit(2).alias("version"))
        inter = inter.unionByName(rows)
    if a.posres != "none":
        wanted = F.lit(True) if a.posres == "all" else F.col("atomname") == "BB"
        kept = molecules.position_restraints(bead, wanted, a.pf)
        inter = inter.unionByName(kept.select("mol_id", "itype", F.lit(2 * 10**9).cast("bigint").alias("seq"), "atoms", "params", F.lit(1).alias("version")))
    bead, inter = store.put("beads", bead), store.put("interactions", inter)
    named = store.put("named", molecules.name_moltypes(bead, inter, ("atomname", "resname", "resid", "atype"), a.name))
    warnings = read["message"].count() + made["uncovered"].where("element <> 'H'").count()
    staged = files.Staged(spark, a.out)
    first = named.groupBy("moltype").agg(F.min("mol_id").alias("mol_id")).orderBy("moltype").collect()  # one for each kind of molecule, each a file
    for r in first:
        one = files.itp_lines(bead.where(F.col("mol_id") == r["mol_id"]), inter.where(F.col("mol_id") == r["mol_id"]), r["moltype"])
        staged.add(f"{r['moltype']}.itp", one, ["part", "at"])
    order = named.withColumnRenamed("mol_id", "ord")
    staged.add("topol.top", files.topology_lines(order, [f"{r['moltype']}.itp" for r in first], a.name), ["at"])
    shown = bead.withColumns({"system_id": F.lit("all"), "altloc": F.lit(""), "insertion_code": F.coalesce("insertion_code", F.lit("")) if "insertion_code" in bead.columns else F.lit(""), "element": F.lit(""), "occupancy": F.lit(1.0), "temp_factor": F.lit(0.0)})
    lines = structures.pdb_lines(shown, edge.withColumn("system_id", F.lit("all")), nan_missing=True)
    staged.add("beads.pdb", lines.withColumnRenamed("line_no", "at"), ["at"])
    return staged.publish(max(0, warnings - a.maxwarn))


def _block_interactions(ff: rules.ForceField, bead, spark: SparkSession):
    """What each residue's template says, on the beads of every such residue."""
    rows = [(b.name, t, n, list(i.atoms), [str(p) for p in i.params]) for b in ff.blocks.values() for n, (t, i) in enumerate((t, i) for t, held in b.interactions.items() for i in held)]
    table = if_small(spark.createDataFrame(rows, "resname string, itype string, n int, names array<string>, params array<string>"))
    held = bead.select("mol_id", "chain", "resid", "resname").distinct().join(table, "resname").select("*", F.posexplode("names").alias("p", "atomname"))
    right = bead.select("mol_id", F.col("chain").alias("chain_b"), "resid", "resname", "atomname", "node")
    found = held.join(right, ["mol_id", "resid", "resname", "atomname"]).where(F.col("chain").eqNullSafe(F.col("chain_b")))
    grouped = found.groupBy("mol_id", "resid", "chain", "resname", "itype", "n", "params", F.size("names").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "node"))), lambda x: x["node"].cast("bigint")).alias("atoms"))
    return grouped.where(F.size("atoms") == F.col("k")).select("mol_id", "itype", (F.col("resid") * 1000 + F.col("n")).cast("bigint").alias("seq"), "atoms", "params", F.lit(1).alias("version"))


def main(argv: list[str] | None = None) -> int:
    import sys

    spark = SparkSession.builder.appName("latticework").getOrCreate()
    return 0 if run(spark, sys.argv[1:] if argv is None else argv) else 2


if __name__ == "__main__":
    raise SystemExit(main())
