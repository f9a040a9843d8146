import pytest
from pyspark.sql import functions as F

from latticework.operators import contacts, topology
from latticework.plans.store import Store
from latticework.sources import reports, rules, structures
from latticework.sources import topology as files

PDB = """CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 1           1
ATOM      1  N   ALA A   1       0.000   0.000   0.000  1.00  0.00           N
ATOM      2  CA  ALA A   1       1.450   0.000   0.000  1.00  0.00           C
ATOM      3  CA BALA A   1       1.450   0.100   0.000  1.00  0.00           C
TER
HETATM    4 ZN   ZN  B   2       5.000   0.000   0.000  1.00  0.00          ZN2+
CONECT    2    4
END
"""
GRO = """title
    2
    1ALA      N    1   0.000   0.100   0.200
    1ALA     CA    2   1.000   1.100   1.200
   1.0 2.0 3.0
"""
CIF = """data_X
_cell.length_a 10.0
loop_
_atom_site.id
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.type_symbol
1 "C'" ALA 1 1.0 2.0 3.0 C
2 N ALA ? 4.0 . 6.0 N
"""
FF = """
[ macros ]
prot "ALA|GLY"
[ variables ]
fc 500
[ moleculetype ]
ALA 1
[ atoms ]
1 P2 1 ALA BB 1 0
2 C1 1 ALA SC1 2 0
[ bonds ]
#meta {"group": "Side chain"}
BB SC1 1 0.27 5000
[ link ]
resname $prot
[ bonds ]
BB {"resname": $prot} +BB {"resname": $prot} 1 dist(BB,+BB|.3f) 1250 {"group": "Backbone"}
[ angles ]
SC1 BB +BB 2 100 25
[ modification ]
N-ter
[ atoms ]
BB {"replace": {"atype": "Q5", "charge": 1}}
"""


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_pdb(spark, tmp_path):
    b = structures.read_structures(spark, write(tmp_path, "a.pdb", PDB))
    got = b["atom"].orderBy("node").collect()
    assert [(r["atomname"], r["mol_id"], r["charge"], round(r["x"], 4)) for r in got] == [("N", 0, 0.0, 0.0), ("CA", 0, 0.0, 0.145), ("ZN", 0, 2.0, 0.5)]
    assert b["message"].count() == 1 and b["edge"].select("u", "v").collect()[0][:] == (1, 2)
    assert b["system"].first()["box"][:3] == [1.0, 2.0, 3.0]
    lines = [r["line"] for r in structures.pdb_lines(b["atom"], b["edge"]).orderBy("line_no").collect()]
    assert lines[0].startswith("ATOM      1 N    ALA A   1       0.000") and lines[-1] == "END   " and any(x.startswith("CONECT") for x in lines)
    again = structures.parse_pdb("\n".join(lines))
    assert [a["atomname"] for a in again["atoms"]] == ["N", "CA", "ZN"]
    with pytest.raises(KeyError):
        structures.parse_pdb("WHATISIT")


def test_gro_cif(spark, tmp_path):
    g = structures.parse_gro(GRO)
    assert [a["z"] for a in g["atoms"]] == [0.2, 1.2] and g["box"] == [1.0, 2.0, 3.0]
    b = structures.read_structures(spark, write(tmp_path, "a.gro", GRO))
    lines = [r["line"] for r in structures.gro_lines(b["atom"], "t", (1.0, 2.0, 3.0)).orderBy("line_no").collect()]
    assert structures.parse_gro("\n".join(lines))["atoms"][1]["y"] == pytest.approx(1.1)
    c = structures.parse_cif(CIF)
    assert c["atoms"][0]["atomname"] == "C'" and c["atoms"][1]["resid"] is None and c["atoms"][1]["y"] is None and c["box"] == [1.0, 1, 1, 90, 90, 90] or c["box"][0] == 1.0
    with pytest.raises(ValueError):
        structures.resolve_format("x.xyz")


def test_rules():
    ff = rules.read_ff(FF, rules.ForceField("t"))
    assert ff.variables["fc"] == 500 and list(ff.blocks["ALA"].nodes) == ["BB", "SC1"] and ff.blocks["ALA"].edges == [("BB", "SC1")]
    link = ff.links[0]
    assert link.nodes["+BB"]["order"] == 1 and link.edges == [("BB", "+BB"), ("SC1", "BB")]
    assert isinstance(link.interactions["bonds"][0].params[1], rules.ParamFunction) and link.interactions["bonds"][0].meta == {"group": "Backbone"}
    assert ff.modifications["N-ter"].nodes["BB"]["replace"] == {"atype": "Q5", "charge": 1}
    with pytest.raises(ValueError):
        rules.tokens("a {b")
    m = rules.read_map("[ molecule ]\nALA\n[ from ]\ncharmm\n[ to ]\nm3\n[ atoms ]\n1 N BB\n2 CA BB BB SC1\n3 HN !BB\n")[0]
    assert m.weights[1, "CA"] == {(1, "BB"): 2 / 3, (1, "SC1"): 1 / 3} and m.weights[1, "HN"] == {(1, "BB"): 0.0}
    n = rules.read_mapping("[ molecule ]\n[ from ]\na\n[ to ]\nb\n[ from blocks ]\nALA\n[ to blocks ]\nALA\n[ mapping ]\nN BB\nCA BB\n[ reference atoms ]\nBB CA\n")[0]
    assert n.weights[1, "N"] == {(1, "BB"): 0.5} and n.references == {(1, "BB"): (1, "CA")} and len(rules.self_mappings(ff)) == 2
    bib = rules.read_bib('@article{k, title={A {B} c}, author = "X and Y", year=2020}')
    assert bib["k"]["title"] == "A {B} c" and "X, Y" in rules.citation_line(bib["k"])
    rtp = rules.read_rtp("[ bondedtypes ]\n1 5 9 2\n[ ALA ]\n [ atoms ]\n N NH1 -0.47 0\n C C 0.5 1\n [ bonds ]\n N C\n -C N\n", rules.ForceField("r"))
    assert rtp.blocks["ALA"].interactions["bonds"][0].atoms == ("N", "C") and rtp.links[0].nodes["-C"]["order"] == -1


def test_links_and_polish(spark):
    ff = rules.read_ff(FF, rules.ForceField("t"))
    atoms = spark.createDataFrame([(0, 0, "BB", "ALA", 1, 0.0), (0, 1, "SC1", "ALA", 1, 0.3), (0, 2, "BB", "GLY", 2, 0.35), (0, 3, "BB", "TRP", 3, 0.7)], "mol_id bigint, node bigint, atomname string, resname string, resid int, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    edges = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 2, 3)], "mol_id bigint, u bigint, v bigint")
    none = spark.createDataFrame([], "mol_id bigint, itype string, seq bigint, atoms array<bigint>, params array<string>, version int")
    _, inter = topology.apply_links(ff.links, atoms, edges, none, Store(spark))
    got = sorted((r["itype"], r["atoms"], r["params"]) for r in inter.collect())
    assert got == [("angles", [1, 0, 2], ["2", "100", "25"]), ("bonds", [0, 2], ["1", "0.350", "1250"])]
    made = topology.polish(atoms, edges, none)
    assert sorted((r["itype"], r["atoms"]) for r in made.collect()) == [("angles", [0, 2, 3]), ("angles", [1, 0, 2]), ("dihedrals", [1, 0, 2, 3]), ("pairs", [1, 3])]


def test_itp_round_trip(spark, tmp_path):
    text = "[ moleculetype ]\nM 1\n[ atoms ]\n1 P2 1 ALA BB 1 0.0 72\n2 C1 1 ALA SC1 2\n[ bonds ]\n2 1 1 0.27\n#ifdef F\n1 2 1 0.3\n#endif\n[ virtual_sitesn ]\n1 2 2\n"
    t = files.read_itp(spark, write(tmp_path, "m.itp", text))
    inter = t["interaction"].orderBy("seq").collect()
    assert [(r["itype"], r["atoms"], r["ifdef"]) for r in inter] == [("bonds", [2, 1], None), ("bonds", [1, 2], "F"), ("virtual_sitesn", [1, 2], None)]
    lines = files.itp_lines(t["atom"].withColumn("atomid", F.col("node")), t["interaction"], "M", 1, ("made",), {"K": "1"}).orderBy("part", "at").collect()
    out = "\n".join(r["line"] for r in lines)
    atoms, again = files.parse_itp(out.replace("#define", "; #define"))
    assert len(atoms) == 2 and sorted(i[3] for i in again) == [[1, 2], [1, 2], [1, 2]] and "#ifdef F" in out
    top = files.topology_lines(spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "A")], "ord int, moltype string"), ["a.itp"], "sys").orderBy("at").collect()
    assert [r["line"].split() for r in top[-3:]] == [["A", "2"], ["B", "1"], ["A", "1"]]


def test_staged(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "n int, line string")
    s = files.Staged(spark, str(tmp_path / "out"))
    s.add("x", lines, ["n"])
    assert not s.publish(1) and not (tmp_path / "out").exists()
    for _ in range(2):
        s = files.Staged(spark, str(tmp_path / "out"))
        s.add("x", lines, ["n"])
        assert s.publish()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out/x")).collect()] == ["a", "b"] and (tmp_path / "out.1").exists()


def test_reports(spark, tmp_path):
    dssp = "junk\n  #  RESIDUE\n" + "".join(f"{i:5d}{i:5d} A A  {s}\n" for i, s in ((1, "H"), (2, " "), (3, "E"))) + "    4        !*\n"
    assert [r["letter"] for r in reports.read_secondary_structure(spark, write(tmp_path, "d.ssd", dssp)).orderBy("res_id").collect()] == ["H", "C", "E"]
    line = "R 1 1 ALA A 5 2 GLY B 7 5.0 1 0 0 0 1 1 0"
    assert reports.read_contacts(spark, write(tmp_path, "c.out", line + "\nR 2 bad\n")).select("resid_a", "chain_a", "resid_b", "chain_b").first()[:] == (5, "A", 7, "B")


def test_bonds_repair_contacts(spark):
    atoms = spark.createDataFrame([(0, 0, "N", "ALA", "A", 1, "", "N", 0.0), (0, 1, "CA", "ALA", "A", 1, "", "C", 0.145), (0, 2, "N", "GLY", "A", 2, "", "N", 0.29), (0, 3, "Q", "GLY", "A", 9, "", "C", 2.0)], "mol_id bigint, node bigint, atomname string, resname string, chain string, resid int, insertion_code string, element string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    templates = spark.createDataFrame([("ALA", "N", "CA")], "resname string, a string, b string")
    bonds, placed = topology.make_bonds(atoms, templates, Store(spark), fudge=1.0)
    assert sorted(tuple(r) for r in bonds.collect()) == [(0, 1), (1, 2)]
    assert {r["node"]: r["mol_id"] for r in placed.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    want = spark.createDataFrame([("ALA", "N", "N"), ("ALA", "CA", "C"), ("ALA", "CB", "C")], "resname string, atomname string, element string")
    fixed, _ = topology.repair(atoms.where("resname = 'ALA'"), want)
    assert {(r["atomname"], r["node"], r["x"]) for r in fixed.collect()} == {("CA", 1, 0.145), ("CB", 2, None), ("N", 0, 0.0)}
    c = spark.createDataFrame([(0, 0, 0, 0.0, 1.64, 3), (0, 1, 1, 3.0, 1.42, 2), (0, 2, 2, 30.0, 1.88, 4)], "s bigint, node bigint, residue bigint, x double, vrad double, ctype int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = contacts.contact_map(c, ["s"]).orderBy("ri").collect()
    assert [(r["ri"], r["rj"], r["over"]) for r in got] == [(0, 1, 1), (1, 0, 1)] and got[0]["stab"] > 0
    assert abs((contacts.sphere() ** 2).sum(axis=1) - 1).max() < 1e-12


def test_streaming(spark, tmp_path):
    from latticework.streaming import structures as st

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.pdb", PDB)
    q = st.run_stream(st.stream_atoms(spark, str(tmp_path / "in")), lambda df: df.groupBy("system_id").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 3
