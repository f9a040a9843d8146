"""Structure files: PDB, GRO and mmCIF scans and writers.

Files are read whole through Spark's readers (so any store will do), one row a
file, and parsed in Arrow batches in the workers. A file is the unit of
parallelism; lengths become nm on the way in and Angstrom on the way out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.schema import ATOM, EDGE, Bundle, columns, frame

#: Fixed layout of atom records: name, start, stop, type.
PDB_FIELDS = (
    ("atomid", 6, 11, int), ("atomname", 12, 16, str), ("altloc", 16, 17, str), ("resname", 17, 21, str), ("chain", 21, 22, str), ("resid", 22, 26, int),
    ("insertion_code", 26, 27, str), ("x", 30, 38, float), ("y", 38, 46, float), ("z", 46, 54, float), ("occupancy", 54, 60, float), ("temp_factor", 60, 66, float),
    ("element", 76, 78, str), ("charge", 78, 80, str),
)
#: Record names that carry nothing for us.
PDB_SKIPPED = frozenset("HEADER OBSLTE TITLE SPLIT CAVEAT COMPND SOURCE KEYWDS EXPDTA NUMMDL MDLTYP AUTHOR REVDAT SPRSDE JRNL REMARK DBREF DBREF1 DBREF2 SEQADV SEQRES MODRES HET FORMUL HETNAM HETSYN HELIX SHEET SSBOND LINK CISPEP SITE ORIGX1 ORIGX2 ORIGX3 SCALE1 SCALE2 SCALE3 MTRIX1 MTRIX2 MTRIX3 ANISOU MASTER TURN SIGATM SIGUIJ HYDBND SLTBRG TVECT FTNOTE".split())


def _letter(name: str) -> str:
    got = re.search("[A-Za-z]", name)
    if not got:
        raise ValueError(f"no letter in {name!r}")
    return got[0]


def _charge(text: str) -> float:
    if not text:
        return 0.0
    try:
        return float(text)
    except ValueError:
        return float(text[::-1])


def parse_pdb(text: str, exclude: tuple[str, ...] = ("SOL",), ignore_h: bool = False, model: int = 1) -> dict[str, list]:
    """atoms, bonds (atom id pairs), box and messages. TER, ENDMDL and END close a molecule."""
    atoms, bonds, messages, box = [], [], [], None
    mol, skip, used = 0, False, False
    for number, line in enumerate(text.splitlines(), 1):
        kind = line[:6].strip().upper()
        if kind in ("ATOM", "HETATM"):
            if skip:
                continue
            row = {}
            for name, a, b, type_ in PDB_FIELDS:
                held = line[a:b].strip()
                row[name] = type_(held) if held else type_()
            row["charge"] = _charge(row["charge"])
            row["element"] = row["element"] or _letter(row["atomname"])
            if row["altloc"] not in ("", "A"):
                messages.append(("warning", "pdb-alternate", f"line {number}: only conformation A is used"))
                continue
            if row["resname"] in exclude or (ignore_h and row["element"] == "H"):
                continue
            for c in "xyz":
                row[c] /= 10
            atoms.append(row | {"mol_id": mol})
            used = True
        elif kind in ("TER", "ENDMDL", "END"):
            skip = skip and kind != "ENDMDL"
            if used:
                mol, used = mol + 1, False
        elif kind == "MODEL":
            skip = int(line[10:14]) != model
        elif kind == "CONECT":
            ids = [int(line[i : i + 5]) for i in range(6, len(line.rstrip()), 5) if line[i : i + 5].strip()]
            bonds += [(ids[0], o) for o in ids[1:]]
        elif kind == "CRYST1":
            box = [float(line[a:b]) / (10 if k < 3 else 1) for k, (a, b) in enumerate(((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54)))]
        elif kind and kind not in PDB_SKIPPED:
            raise KeyError(f"line {number}: unknown record {kind!r}")
    _join_by_bonds(atoms, bonds)
    return {"atoms": atoms, "bonds": bonds, "box": box, "messages": messages}


def _join_by_bonds(atoms: list[dict], bonds: list[tuple[int, int]]) -> None:
    """Molecules that a bond record spans become one."""
    of = {a["atomid"]: a["mol_id"] for a in atoms}
    parent = {m: m for m in of.values()}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a, b in bonds:
        if a in of and b in of:
            x, y = root(of[a]), root(of[b])
            parent[max(x, y)] = min(x, y)
    for a in atoms:
        a["mol_id"] = root(a["mol_id"])


def parse_gro(text: str, exclude: tuple[str, ...] = ("SOL",), ignore_h: bool = False) -> dict[str, list]:
    """The distance of the decimal points in the first atom line gives the width of numbers; six points mean velocities."""
    lines = text.splitlines()
    n = int(lines[1])
    atoms: list[dict] = []
    body = lines[2 : 2 + n]
    if body:
        a = body[0].index(".", 20)
        width = body[0].index(".", a + 1) - a
        names = ["x", "y", "z"] + (["vx", "vy", "vz"] if body[0][20:].count(".") == 6 else [])
        for line in body:
            row = {"resid": int(line[:5]), "resname": line[5:10].strip(), "atomname": line[10:15].strip(), "atomid": int(line[15:20]), "chain": "", "mol_id": 0}
            row |= {c: float(line[20 + i * width : 20 + (i + 1) * width]) for i, c in enumerate(names)}
            row["element"] = _letter(row["atomname"])
            if row["resname"] not in exclude and not (ignore_h and row["element"] == "H"):
                atoms.append(row)
    box = [float(x) for x in lines[2 + n].split()] if len(lines) > 2 + n else None
    return {"atoms": atoms, "bonds": [], "box": box, "messages": []}


_CIF_TOKEN = re.compile(r"""(?m)^;(?P<block>.*?)^;|'(?P<single>(?:[^'\n]|'(?=\S))*)'(?=\s|$)|"(?P<double>(?:[^"\n]|"(?=\S))*)"(?=\s|$)|\#[^\n]*|(?P<bare>[^\s]+)""", re.S)


def _cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    for m in _CIF_TOKEN.finditer(text):
        for kind in ("block", "single", "double", "bare"):
            if m[kind] is not None:
                yield m[kind], kind != "bare"


def cif_blocks(text: str) -> dict[str, dict[str, list[str | None]]]:
    """name -> item -> values of every data block; '.' and '?' are missing."""
    out: dict[str, dict[str, list]] = {}
    block: dict[str, list] = {}
    heads: list[str] = []
    at, loop, item = 0, False, None
    for tok, quoted in _cif_tokens(text):
        low = tok.lower()
        if not quoted and low.startswith("data_"):
            block = out.setdefault(tok[5:], {})
            loop, item = False, None
        elif not quoted and low == "loop_":
            loop, heads, at, item = True, [], 0, None
        elif not quoted and tok.startswith("_"):
            if loop and at == 0:
                heads.append(tok)
                block[tok] = []
            else:
                loop, item = False, tok
        else:
            value = None if not quoted and tok in (".", "?") else tok
            if loop and heads:
                block[heads[at % len(heads)]].append(value)
                at += 1
            elif item:
                block[item], item = [value], None
    return out


#: Our column and the mmCIF item that fills it (the first that is there).
CIF_ITEMS = {
    "atomid": ("id",), "atomname": ("auth_atom_id", "label_atom_id", "type_symbol"), "altloc": ("label_alt_id",), "resname": ("auth_comp_id", "label_comp_id"), "chain": ("auth_asym_id", "label_asym_id"),
    "resid": ("auth_seq_id", "label_seq_id"), "insertion_code": ("pdbx_PDB_ins_code",), "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",),
    "occupancy": ("occupancy",), "temp_factor": ("B_iso_or_equiv",), "element": ("type_symbol",), "charge": ("pdbx_formal_charge",), "model": ("pdbx_PDB_model_num",),
}
_CAST = {"atomid": int, "resid": int, "model": int, "x": float, "y": float, "z": float, "occupancy": float, "temp_factor": float, "charge": float}


def _cast(name: str, value: str | None):
    try:
        return None if value is None else _CAST.get(name, str)(value)
    except ValueError:
        return None


def parse_cif(text: str, exclude: tuple[str, ...] = ("SOL", "HOH"), ignore_h: bool = False, model: int = 1) -> dict[str, list]:
    """One molecule for each data block; values that cannot be cast are missing; without a cell it is 1, 1, 1, 90, 90, 90."""
    atoms, box = [], None
    for mol, block in enumerate(cif_blocks(text).values()):
        cell = [_cast("x", (block.get(f"_cell.{k}") or [None])[0]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")]
        box = box or [d if c is None else c / s for c, d, s in zip(cell, (1, 1, 1, 90, 90, 90), (10, 10, 10, 1, 1, 1))]
        sites = {c: next((block[f"_atom_site.{i}"] for i in items if f"_atom_site.{i}" in block), None) for c, items in CIF_ITEMS.items()}
        n = max((len(v) for v in sites.values() if v), default=0)
        for i in range(n):
            row = {c: _cast(c, v[i]) if v else None for c, v in sites.items()}
            row["element"] = row["element"] or (_letter(row["atomname"]) if row["atomname"] else None)
            row["atomname"] = row["atomname"] or row["element"]
            if row["altloc"] not in (None, "", "A") or row["model"] not in (None, model) or row["resname"] in exclude or (ignore_h and row["element"] == "H"):
                continue
            for c in "xyz":
                row[c] = None if row[c] is None else row[c] / 10
            atoms.append(row | {"mol_id": mol, "insertion_code": row["insertion_code"] or "", "altloc": row["altloc"] or ""})
    return {"atoms": atoms, "bonds": [], "box": box, "messages": []}


PARSERS = {"pdb": parse_pdb, "ent": parse_pdb, "gro": parse_gro, "cif": parse_cif}


def resolve_format(path: str) -> str:
    ext = PurePath(path).suffix.lower().lstrip(".")
    if ext not in PARSERS:
        raise ValueError(f"unknown structure file extension {ext!r}")
    return ext


def read_structures(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Bundle:
    """atom, edge, molecule and message of all files that the path names; system_id is the file."""
    parse = PARSERS[fmt or resolve_format(path)]
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("system_id"), "value")
    names = columns(ATOM)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for system, text in zip(pdf["system_id"], pdf["value"]):
                got = parse(text, **options)
                rows = [a | {"system_id": system, "node": i, "ord": i} for i, a in enumerate(got["atoms"])]
                yield frame(rows, names)

    def bonds(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for system, text in zip(pdf["system_id"], pdf["value"]):
                got = parse(text, **options)
                at = {a.get("atomid"): (a["mol_id"], i) for i, a in enumerate(got["atoms"])}
                pairs = sorted({(at[a][0], min(at[a][1], at[b][1]), max(at[a][1], at[b][1])) for a, b in got["bonds"] if a in at and b in at})
                yield frame([(system, m, u, v, None) for m, u, v in pairs], columns(EDGE))

    def rest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for system, text in zip(pdf["system_id"], pdf["value"]):
                got = parse(text, **options)
                yield frame([(system, got["box"], [dict(zip(("level", "type", "text"), m)) for m in got["messages"]])], ["system_id", "box", "messages"])

    other = files.mapInPandas(rest, "system_id string, box array<double>, messages array<struct<level:string,type:string,text:string>>")
    return Bundle({
        "atom": files.mapInPandas(run, ATOM),
        "edge": files.mapInPandas(bonds, EDGE),
        "system": other.select("system_id", "box"),
        "message": other.select("system_id", F.inline("messages")),
    })


# --- writers: lines as a relation, written as text ------------------------------------------------------------------


def pdb_lines(atoms: DataFrame, edges: DataFrame | None = None, omit_charges: bool = True, nan_missing: bool = False) -> DataFrame:
    """system_id, line_no, line: atom and TER records of each molecule, CONECT records, END."""
    from pyspark.sql import Window as W

    key = ["system_id"]
    mol = F.dense_rank().over(W.partitionBy(*key).orderBy("mol_id")) - 1
    place = F.row_number().over(W.partitionBy(*key).orderBy("mol_id", F.asc_nulls_last("atomid"), "node"))
    a = atoms.withColumn("__m", mol).withColumn("serial", place + F.col("__m"))  # one serial for each TER before
    missing = F.lit(float("nan")) if nan_missing else F.raise_error(F.lit("an atom has no position"))

    def s(c: str, n: int, right: bool = False):
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.lpad(F.when(F.char_length(t) > n, F.substring(t, -n, n)).otherwise(t), n, " ") if right else F.rpad(t, n, " ")

    def number(c, fmt: str, n: int):
        t = F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string(fmt, c))
        return F.lpad(F.when(F.char_length(t) > n, F.substring(t, -n, n)).otherwise(t), n, " ")

    sign = F.when(F.coalesce("charge", F.lit(0.0)) == 0, F.lit("")).otherwise(F.reverse(F.format_string("%+d", F.col("charge").cast("int"))))
    xyz = [number(F.coalesce(F.col(c) * 10, missing), "%.3f", 8) for c in "xyz"]
    line = F.concat(
        F.lit("ATOM  "), s("serial", 5, True), F.lit(" "), s("atomname", 4), s("altloc", 1), s("resname", 3), F.lit(" "), s("chain", 1), s("resid", 4, True), s("insertion_code", 1), F.lit("   "),
        *xyz, number(F.coalesce("occupancy", F.lit(1.0)), "%.2f", 6), number(F.coalesce("temp_factor", F.lit(0.0)), "%.2f", 6), F.lit(" " * 10), s("element", 2), F.lit("  ") if omit_charges else F.rpad(sign, 2, " "))
    body = a.select(*key, F.lit(0).alias("part"), F.col("serial").alias("at"), F.lit(0).alias("sub"), line.alias("line"))
    last = a.groupBy(*key, "__m").agg(F.max_by(F.struct("resname", "chain", "resid", "insertion_code"), "serial").alias("t"), (F.max("serial") + 1).alias("serial")).select(*key, "serial", "t.*")
    ter = last.select(*key, F.lit(0).alias("part"), F.col("serial").alias("at"), F.lit(0).alias("sub"), F.concat(F.lit("TER   "), s("serial", 5, True), F.lit("      "), s("resname", 3), F.lit(" "), s("chain", 1), s("resid", 4, True), s("insertion_code", 1)).alias("line"))
    out = body.union(ter)
    if edges is not None:
        n = a.select(*key, "mol_id", "node", "serial")
        both = edges.join(n.withColumnsRenamed({"node": "u", "serial": "su"}), [*key, "mol_id", "u"]).join(n.withColumnsRenamed({"node": "v", "serial": "sv"}), [*key, "mol_id", "v"])
        held = both.groupBy(*key, "su").agg(F.sort_array(F.collect_list("sv")).alias("vs"))
        fours = held.select(*key, "su", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("vs") - 1) / 4).cast("int")), lambda i: F.slice("vs", i * 4 + 1, F.lit(4)))).alias("k", "four"))
        text = F.concat(F.lit("CONECT "), F.lpad(F.col("su").cast("string"), 4, " "), F.array_join(F.transform("four", lambda x: F.concat(F.lit(" "), F.lpad(x.cast("string"), 4, " "))), ""))
        out = out.union(fours.select(*key, F.lit(1), F.col("su"), F.col("k"), text))
    out = out.union(a.select(*key).distinct().select(*key, F.lit(2), F.lit(0), F.lit(0), F.lit("END   ")))
    return out.select(*key, F.row_number().over(W.partitionBy(*key).orderBy("part", "at", "sub")).alias("line_no"), "line")


def gro_lines(atoms: DataFrame, title: str = "", box: tuple[float, ...] = (0.0, 0.0, 0.0), precision: int = 7) -> DataFrame:
    """system_id, line_no, line of a GRO file; velocities where every atom has them."""
    from pyspark.sql import Window as W

    w = W.partitionBy("system_id").orderBy("mol_id", "node")
    i = F.row_number().over(w)
    tail = lambda t, n: F.lpad(F.when(F.char_length(t) > n, F.substring(t, -n, n)).otherwise(t), n, " ")
    pos = F.concat(*[F.lpad(F.format_string(f"%.{precision - 4}f", c), precision + 1, " ") for c in "xyz"])
    vel = F.when(F.count("vx").over(W.partitionBy("system_id")) == F.count(F.lit(1)).over(W.partitionBy("system_id")), F.concat(*[F.lpad(F.format_string("%.4f", c), precision + 1, " ") for c in ("vx", "vy", "vz")])).otherwise("")
    line = F.concat(tail(F.col("resid").cast("string"), 5), F.rpad("resname", 5, " "), F.lpad("atomname", 5, " "), tail(i.cast("string"), 5), pos, vel)
    body = atoms.select("system_id", (i + 2).alias("line_no"), line.alias("line"))
    n = atoms.groupBy("system_id").count()
    head = n.select("system_id", F.inline(F.array(F.struct(F.lit(1).alias("line_no"), F.lit(title).alias("line")), F.struct(F.lit(2).alias("line_no"), F.col("count").cast("string").alias("line")))))
    end = n.select("system_id", (F.col("count") + 3).cast("int").alias("line_no"), F.lit(" ".join(str(b) for b in box)).alias("line"))
    return head.union(body).union(end)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file for each system, lines in order: systems are dealt out, each is written by one task."""
    lines.repartition("system_id").sortWithinPartitions("system_id", "line_no").select("system_id", "line").write.mode("error").partitionBy("system_id").text(path)


def distances(points: list[tuple[float, float, float]]) -> list[list[float]]:
    return [[math.dist(a, b) for b in points] for a in points]
