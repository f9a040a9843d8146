from latticework import cli
from latticework.sources.structures import parse_pdb
from latticework.sources.topology import parse_itp

FF = """
[ moleculetype ]
GLY 1
[ atoms ]
1 P4 1 GLY BB 1 0
[ moleculetype ]
ALA 1
[ atoms ]
1 P2 1 ALA BB 1 0
2 C1 1 ALA SC1 2 0
[ bonds ]
BB SC1 1 0.27 5000
[ link ]
[ bonds ]
BB +BB 1 0.35 1250
"""
MAP = """
[ molecule ]
ALA
[ from ]
universal
[ to ]
cg
[ atoms ]
1 N BB
2 CA BB
3 C BB
4 CB SC1
[ molecule ]
GLY
[ from ]
universal
[ to ]
cg
[ atoms ]
1 N BB
2 CA BB
3 C BB
"""


def test_structure_to_topology(spark, tmp_path):
    lines, serial, x = [], 0, 0.0
    for resid, resname in enumerate(("GLY", "ALA", "GLY", "ALA", "GLY"), 1):
        for name in ("N", "CA", "C"):
            serial += 1
            lines.append(f"ATOM  {serial:5d}  {name:<3s} {resname:<4s}A{resid:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00          {name[0]:>2s}")
            if name == "CA" and resname == "ALA":
                serial += 1
                lines.append(f"ATOM  {serial:5d}  CB  {resname:<4s}A{resid:4d}    {x:8.3f}{1.5:8.3f}{0:8.3f}  1.00  0.00           C")
            x += 1.4
    (tmp_path / "a.pdb").write_text("\n".join(lines) + "\nTER\nEND\n")
    for folder, name, text in (("ff/cg", "a.ff", FF), ("maps", "a.map", MAP)):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / name).write_text(text)
    args = ["-f", str(tmp_path / "a.pdb"), "-x", str(tmp_path / "out"), "-ff-dir", str(tmp_path / "ff"), "-map-dir", str(tmp_path / "maps"), "-ff", "cg", "-elastic", "-el", "0.5", "-eu", "2.0", "-bonds-from", "distance", "-bonds-fudge", "1.0"]
    assert cli.run(spark, args)
    read = lambda name: "\n".join(p.read_text() for p in sorted((tmp_path / "out" / name).glob("part-*")))
    atoms, inter = parse_itp(read("molecule_0.itp"))
    assert [a[6] for a in atoms] == ["BB", "BB", "SC1", "BB", "BB", "SC1", "BB"]
    bonds = sorted((tuple(i[3]), len(i[4])) for i in inter if i[1] == "bonds")
    assert [b for b, _ in bonds] == [(1, 2), (1, 5), (1, 7), (2, 3), (2, 4), (2, 7), (4, 5), (5, 6), (5, 7)]
    assert "molecule_0    1" in read("topol.top") and len(parse_pdb(read("beads.pdb"))["atoms"]) == 7
