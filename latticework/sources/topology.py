"""Topology files: ITP scan, and writers for molecules, atom types, pair parameters and systems."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.schema import frame

#: Which columns of a line are atoms, by section; the rest are parameters.
ATOM_COLUMNS = {
    "bonds": slice(0, 2), "position_restraints": slice(0, 1), "angles": slice(0, 3), "constraints": slice(0, 2), "dihedrals": slice(0, 4), "pairs": slice(0, 2), "pairs_nb": slice(0, 2),
    "exclusions": slice(0, None), "virtual_sites1": slice(0, 1), "virtual_sites2": slice(0, 3), "virtual_sites3": slice(0, 4), "virtual_sites4": slice(0, 5), "settles": slice(0, 1),
    "distance_restraints": slice(0, 2), "dihedral_restraints": slice(0, 4), "orientation_restraints": slice(0, 2), "angle_restraints": slice(0, 4), "angle_restraints_z": slice(0, 2), "cmap": slice(0, 5),
}
ITP_ATOM = "moltype string, nrexcl int, node bigint, atype string, resid int, resname string, atomname string, charge_group bigint, charge double, mass double"
ITP_INTERACTION = "moltype string, itype string, seq bigint, atoms array<bigint>, params array<string>, ifdef string, ifndef string"


def parse_itp(text: str) -> tuple[list[tuple], list[tuple]]:
    """(atoms, interactions) of all molecule types; conditions go with the interactions that they hold for."""
    atoms, inter, section, mol, open_ = [], [], "", ("", None), []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split(";", 1)[0].strip()
        if not line:
            continue
        if line.startswith("#"):
            word, *rest = line.split()
            if word in ("#ifdef", "#ifndef"):
                open_.append((word[1:], rest[0]))
            elif word == "#else":
                kind, name = open_.pop()
                open_.append(("ifndef" if kind == "ifdef" else "ifdef", name))
            elif word == "#endif":
                if not open_:
                    raise ValueError(f"line {number}: #endif without #ifdef")
                open_.pop()
            continue
        if m := re.fullmatch(r"\[\s*(\w+)\s*\]", line):
            section = m[1]
            continue
        w = line.split()
        if section == "moleculetype":
            mol = (w[0], int(w[1]))
        elif section == "atoms":
            more = [float(x) for x in w[6:8]] + [None, None]
            atoms.append((*mol, int(w[0]), w[1], int(w[2]), w[3], w[4], int(w[5]), more[0], more[1]))
        elif section == "virtual_sitesn":
            inter.append((mol[0], section, len(inter), [int(w[0]), *map(int, w[2:])], [w[1]], *_conditions(open_)))
        elif section in ATOM_COLUMNS:
            at = ATOM_COLUMNS[section]
            used = [int(x) for x in w[at]]
            inter.append((mol[0], section, len(inter), used, w[len(used):], *_conditions(open_)))
        elif section:
            raise KeyError(f"line {number}: unknown section {section}")
    if open_:
        raise ValueError("an #ifdef is not closed")
    return atoms, inter


def _conditions(open_: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    held = dict(open_)
    return held.get("ifdef"), held.get("ifndef")


def read_itp(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """atom and interaction of all ITP files that the path names."""
    files = spark.read.text(path, wholetext=True)

    def scan(which: int, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for text in pdf["value"]:
                    yield frame(parse_itp(text)[which], names)

        return files.mapInPandas(run, schema)

    return {"atom": scan(0, ITP_ATOM), "interaction": scan(1, ITP_INTERACTION)}


def canonical_atoms(itype: Column, atoms: Column) -> Column:
    """Bonds and pairs ascending, angles with the smaller end first, dihedrals with the smaller inner atom first."""
    g = lambda i: F.get(atoms, F.lit(i))
    flip = F.reverse(atoms)
    return F.when(itype.startswith("bond") | itype.startswith("pair"), F.sort_array(atoms)).when(itype == "angles", F.when(g(0) > g(2), flip).otherwise(atoms)).when(itype.isin("dihedrals", "impropers") & (F.size(atoms) == 4), F.when(g(1) > g(2), flip).otherwise(atoms)).otherwise(atoms)


def itp_lines(atoms: DataFrame, interactions: DataFrame, moltype: str, nrexcl: int = 1, header: tuple[str, ...] = (), defines: dict[str, str] | None = None) -> DataFrame:
    """part, at, line of one molecule's file, in order of (part, at).

    Atoms are renumbered from 1; sections go by number of atoms and name; inside a section by condition, group and
    the canonical order of atoms. impropers are written as dihedrals.
    """
    spark = atoms.sparkSession
    number = F.row_number().over(W.orderBy(F.asc_nulls_last("atomid"), "node"))  # one molecule's atoms
    a = atoms.withColumn("__i", number)
    shown = ["atype", "resid", "resname", "atomname", "charge_group", "charge", "mass"]
    wide = a.select(F.max(F.char_length(F.col("__i").cast("string"))).alias("__i"), *[F.max(F.char_length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in shown]).first()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pad = {"__i": F.lpad, "resid": F.lpad, "charge_group": F.lpad, "charge": F.lpad, "mass": F.lpad}
    body = F.concat_ws(" ", *[pad.get(c, F.rpad)(text(c), max(1, wide[c] or 1), " ") if wide[c] else F.lit("") for c in ["__i", *shown]])
    top = [f"; {h}" for h in header] + ([""] if header else [])
    for k, v in (defines or {}).items():
        top += [f"#ifndef {k}", f"#define {k} {v}", "#endif", ""]
    top += ["[ moleculetype ]", f"{moltype} {nrexcl}", "", "[ atoms ]"]
    out = spark.createDataFrame([("0", i, t) for i, t in enumerate(top)], "part string, at bigint, line string")
    out = out.union(a.select(F.lit("1"), F.col("__i").cast("bigint"), body)).union(spark.createDataFrame([("1z", 0, "")], "part string, at bigint, line string"))
    n = a.select(F.col("node").alias("__node"), "__i")
    flat = interactions.withColumn("__key", F.monotonically_increasing_id()).select("*", F.posexplode("atoms").alias("__p", "__node")).join(n, "__node")
    rest = [c for c in interactions.columns if c != "atoms"]
    held = flat.groupBy("__key", *rest).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__i"))), lambda x: x["__i"]).alias("__raw"))
    held = held.withColumn("__a", canonical_atoms(F.col("itype"), F.col("__raw")))
    key = F.when(F.col("itype") == "angles", F.get("__a", F.lit(1))).otherwise(F.array_min("__a"))
    words = F.transform("__a", lambda x: F.lpad(x.cast("string"), max(1, wide["__i"] or 1), " "))
    params = F.array_join("params", " ")
    line = F.when(F.col("itype") == "virtual_sitesn", F.concat_ws(" ", F.get(words, F.lit(0)), params, F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " "))).otherwise(F.concat_ws(" ", F.array_join(words, " "), params))
    line = F.when(F.col("comment").isNotNull(), F.concat(line, F.lit(" ; "), F.col("comment"))).otherwise(line) if "comment" in interactions.columns else line
    get = lambda c: F.coalesce(F.col(c), F.lit("")) if c in interactions.columns else F.lit("")
    block = F.concat_ws("|", F.lpad(F.size("__a").cast("string"), 3, "0"), "itype", get("ifdef"), get("ifndef"), get("grp"))
    ranked = held.select("itype", get("ifdef").alias("ifdef"), get("ifndef").alias("ifndef"), get("grp").alias("grp"), block.alias("__b"), line.alias("line"), F.row_number().over(W.partitionBy(block).orderBy(key, "__a", "seq")).alias("at"))
    section = F.when(F.col("itype") == "impropers", "dihedrals").otherwise(F.col("itype"))
    heads = ranked.groupBy("__b", "itype", "ifdef", "ifndef", "grp").agg(F.max("at").alias("n"))
    first = F.row_number().over(W.partitionBy("itype").orderBy("__b")) == 1
    opening = F.concat(F.when(first, F.array(F.concat(F.lit("[ "), section, F.lit(" ]")))).otherwise(F.array().cast("array<string>")), F.when(F.col("ifdef") != "", F.array(F.concat(F.lit("#ifdef "), F.col("ifdef")))).when(F.col("ifndef") != "", F.array(F.concat(F.lit("#ifndef "), F.col("ifndef")))).otherwise(F.array().cast("array<string>")), F.when(F.col("grp") != "", F.array(F.concat(F.lit("; "), F.col("grp")))).otherwise(F.array().cast("array<string>")))
    closing = F.concat(F.when((F.col("ifdef") != "") | (F.col("ifndef") != ""), F.array(F.lit("#endif"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    part = F.concat(F.lit("2|"), F.col("__b"))
    out = out.union(heads.select(part, opening.alias("o")).select(F.col("concat(2|, __b)").alias("part"), F.posexplode("o").alias("at", "line")).select("part", (F.col("at") - 10).cast("bigint"), "line"))
    out = out.union(ranked.select(part, F.col("at").cast("bigint"), "line"))
    return out.union(heads.select(part.alias("part"), "n", closing.alias("c")).select("part", F.posexplode("c").alias("at", "line"), "n").select("part", (F.col("n") + F.col("at") + 1).cast("bigint"), "line"))


def atomtype_lines(types: DataFrame) -> DataFrame:
    """at, line of [ atomtypes ]; types: atype, mass, charge, sigma, epsilon, comment."""
    line = F.format_string("%s %s %s A %s %s", "atype", F.col("mass").cast("string"), F.col("charge").cast("string"), F.col("sigma").cast("string"), F.col("epsilon").cast("string"))
    line = F.when(F.col("comment").isNotNull(), F.concat(line, F.lit(" ; "), F.col("comment"))).otherwise(line)
    head = types.sparkSession.createDataFrame([(0, "[ atomtypes ]")], "at bigint, line string")
    return head.union(types.select(F.row_number().over(W.orderBy("atype")).cast("bigint"), line))


def nonbond_lines(pairs: DataFrame, c6_c12: bool = False) -> DataFrame:
    """at, line of [ nonbond_params ]; pairs: atype_a, atype_b, sigma, epsilon, comment."""
    from latticework.functions.geometry import c6_c12 as convert

    a, b = convert(F.col("sigma"), F.col("epsilon")) if c6_c12 else (F.col("sigma"), F.col("epsilon"))
    line = F.format_string("%s %s 1 %.8f %.8f ;%s", "atype_a", "atype_b", a, b, F.coalesce("comment", F.lit("")))
    head = pairs.sparkSession.createDataFrame([(0, "[ nonbond_params ]")], "at bigint, line string")
    return head.union(pairs.select(F.row_number().over(W.orderBy("atype_a", "atype_b")).cast("bigint"), line))


def topology_lines(molecules: DataFrame, includes: list[str], title: str = "", defines: tuple[str, ...] = (), header: tuple[str, ...] = ()) -> DataFrame:
    """at, line of a system's file: includes, then runs of equal molecule types in order (ord, moltype)."""
    from latticework.plans.ordered import islands

    top = [*[("; " + h)[:4000] for h in header], *[f"#define {d}" for d in defines], *[f'#include "{i}"' for i in includes], "", "[ system ]", title, "", "[ molecules ]"]
    head = molecules.sparkSession.createDataFrame(list(enumerate(top)), "at bigint, line string")
    runs = islands(molecules.withColumn("__s", F.lit(0)), "moltype", ["ord"], ["__s"])
    return head.union(runs.select((F.col("island") + len(top)).cast("bigint"), F.format_string("%s    %d", "moltype", "n")))


class Staged:
    """Tables written to a staging folder and renamed into place together, if nothing speaks against it.

    A target that exists is first kept as a numbered copy beside it.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target, self.names = spark, target.rstrip("/"), []
        self.staging = self.target + ".staging"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def add(self, name: str, lines: DataFrame, order: list[str]) -> None:
        lines.repartition(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(f"{self.staging}/{name}")
        self.names.append(name)

    def publish(self, remaining_warnings: int = 0) -> bool:
        fs, staging = self._fs(self.staging)
        if remaining_warnings:
            fs.delete(staging, True)
            return False
        fs, target = self._fs(self.target)
        if fs.exists(target):
            n = 1
            while fs.exists(self._fs(f"{self.target}.{n}")[1]):
                n += 1
            fs.rename(target, self._fs(f"{self.target}.{n}")[1])
        fs.rename(staging, target)
        return True
