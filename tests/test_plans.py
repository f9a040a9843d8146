import math
import random
from itertools import combinations, permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.functions import geometry as geo
from latticework.functions import predicates as pr
from latticework.functions import scalars as sc
from latticework.operators import mapping, match, molecules, network, residues
from latticework.operators import subgraphs as sg
from latticework.plans import graph, ordered, radius
from latticework.plans.broadcasts import if_small
from latticework.plans.components import components
from latticework.plans.store import Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_radius_join_finds_every_pair(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(120)]
    df = spark.createDataFrame([*pts, (500, float("nan"), 0.0, 0.0)], "node bigint, x double, y double, z double")
    got = radius.radius_join(df, df, ["x", "y", "z"], 0.4, condition=lambda a, b: a("node") < b("node"))
    want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 0.4)
    assert rows(got.select("node_a", "node_b")) == want
    own = rows(radius.nearest(df, df, ["x", "y", "z"], 0.4, "node", "node", condition=lambda a, b: a("node") != b("node")).select("node", "owner"))
    for n, o in own:
        best = min((math.dist(pts[n][1:], p[1:]), p[0]) for p in pts if p[0] != n)
        assert o == best[1]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    e = [(1, 2), (2, 3), (10, 11), (30, 20), (20, 25), (3, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(rows(components(spark.createDataFrame(e, "a bigint, b bigint"), Store(spark), one_task)))
    assert got[3] == 1 and got[11] == 10 and got[30] == 20 and got[140] == 100 and 7 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Store(spark), one_task).count() == 0


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_of_all_lines(spark, tmp_path, monkeypatch, one_task):
    from latticework import queries

    rng = random.Random(4)
    lines = [(rng.randrange(60), rng.randrange(80), rng.choice("RAN"), rng.choice("FO"), float(rng.randrange(1, 50))) for _ in range(55)] + [(None, 3, "R", "F", 1.0), (5, None, "R", "F", 1.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(queries, "connected", lambda e, store: components(e, store, one_task))
    edges = [(o, -p - 1) for o, p, *_ in lines if o is not None and p is not None]
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(want.values())) > 2
    assert sorted(rows(queries.QUERIES["components"](spark, str(tmp_path)))) == sorted(want.items())


def test_hops_paths_quotient(spark):
    e = graph.both_ways(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 6)], "u bigint, v bigint"))
    hop = {(a, b): d for a, b, d in rows(graph.k_hop(e, 2))}
    assert hop[1, 1] == 0 and hop[1, 2] == 1 and hop[1, 3] == 2 and (1, 4) not in hop
    assert rows(graph.simple_paths(e, 3)) == [(1, 2, 3, 4), (2, 3, 4, 5), (4, 3, 2, 6)] or len(rows(graph.simple_paths(e, 3))) == 3
    nodes = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "y"), (4, "B", None), (5, None, "z"), (6, None, "z")], "node bigint, part string, tag string")
    parts, outer = graph.quotient(nodes, spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 6)], "u bigint, v bigint"), ["part"], ("tag",))
    got = {r["part"]: r for r in parts.collect()}
    assert got["A"]["part_id"] == 0 and got["A"]["nedges"] == 1 and got["A"]["density"] == 1.0 and got["A"]["tag"] == "x"
    assert got["B"]["tag"] is None and got[None]["nnodes"] == 2 and got[None]["nedges"] == 0
    assert rows(outer) == [(0, 1, 1), (0, 2, 1), (1, 2, 1)]
    values = spark.createDataFrame([(5, "five"), (1, "one"), (6, None)], "node bigint, value string")
    assert {r["node"]: r["value"] for r in graph.nearest_attribute(e, values, 3).collect()}[3] in ("one", "five")


def test_products(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "node int, k string")
    assert rows(graph.categorical_product(a, a, ["k"])) == [(0, 0), (1, 1), (2, 2)]
    e = graph.both_ways(spark.createDataFrame([(0, 1)], "u int, v int"))
    assert rows(graph.modular_product(graph.categorical_product(a, a, ["k"]), e, e)) == [(0, 0, 1, 1), (0, 0, 2, 2), (1, 1, 2, 2)]


def test_ordered(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, None), (2, 2, None)], "p int, o int, v string")
    assert rows(ordered.islands(df, "v", ["o"], ["p"]).select("p", "island", "n")) == [(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 1, 2)]
    assert rows(ordered.running_offset(df, "o", ["o"], ["p"]).select("p", "o", "offset"))[:4] == [(1, 1, 0), (1, 2, 1), (1, 3, 3), (1, 4, 6)]
    shapes = spark.createDataFrame([(5, "q"), (1, "z"), (2, "q"), (3, "z"), (9, "m")], "k int, shape string")
    assert {r["k"]: r["shape_id"] for r in ordered.dense_id(shapes, "shape", "k").collect()} == {1: 0, 3: 0, 2: 1, 5: 1, 9: 2}
    assert rows(ordered.last_wins(df.where("v is not null"), ["p"], ["o"])) == [(1, 4, "a")]
    assert rows(ordered.all_maxima(spark.createDataFrame([(1, 2), (1, 2), (1, 1)], "k int, v int"), ["k"], "v")) == [(1, 2), (1, 2)]


def test_predicates(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("ab\n",)], "c string")
    check = lambda p: [r[0] for r in df.select(p.column(F.col("c"))).collect()]
    assert check(pr.Choice(("a", None))) == [True, False, True, False]
    assert check(pr.Choice(("a",))) == [True, False, False, False]
    assert check(pr.FullRegex("ab?")) == [True, False, False, False]
    assert check(pr.FullRegex("<ABS.*")) == [False, False, True, False]
    assert check(pr.NotDefinedOrNot("a")) == [False, True, True, True]
    assert df.where(pr.any_matches([{"c": "a"}, {"c": None}])).count() == 2
    num = spark.createDataFrame([(1.0, 1.000001), (1.0, 1.1), (float("nan"), float("nan")), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in num.select(pr.nearly_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]


@pytest.mark.parametrize("n", range(1, 13))
def test_helix_runs(spark, n):
    rules = [(".H.", ".3."), (".HH.", ".33."), (".HHH.", ".333."), (".HHHH.", ".3333."), (".HHHHH.", ".13332."), (".HHHHHH.", ".113322."), (".HHHHHHH.", ".1113222."), (".HHHH", ".1111"), ("HHHH.", "2222.")]
    s = "C" + "H" * n + "E"
    mask = "." + s.replace("C", ".").replace("E", ".") + "."
    for a, b in rules:
        while a in mask:
            mask = mask.replace(a, b)
    want = "C" + mask[2 : 2 + n] + "E"
    got = spark.createDataFrame([(s,), ("H" * n,)], "s string").select(sc.helix_letters(F.col("s"))).collect()
    assert got[0][0] == want and got[1][0] == want[1:-1]


def test_geometry(spark):
    df = spark.createDataFrame([(0,)], "k int")
    p = [[F.lit(float(c)) for c in q] for q in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    angle, dih, phase = df.select(F.degrees(geo.angle(*p[:3])), F.degrees(geo.dihedral(*p)), F.degrees(geo.dihedral_phase(*p))).first()
    assert abs(angle - 90) < 1e-9 and abs(abs(dih) - 90) < 1e-9 and abs(((dih - 180 - phase + 180) % 360) - 180) < 1e-9
    f = [df.select(geo.decay_force(F.lit(d), 0.5, 0.9, 0.8, 1.0, 700.0, 1.0)).first()[0] for d in (0.1, 0.5, 0.7, 0.95)]
    assert f[0] == 700 and f[1] == 700 and abs(f[2] - 700 * math.exp(-0.16)) < 1e-9 and f[3] == 0
    assert abs(sum(c * c for c in geo.fibonacci_sphere(7)[3]) - 1) < 1e-12


def test_scalars(spark):
    df = spark.createDataFrame([("2-", "1HB", "SP2", "ABCDEFGHIJ", 1234567)], "q string, n string, t string, w string, i int")
    got = df.select(sc.charge(F.col("q")), sc.first_letter(F.col("n")), sc.bead_size(F.col("t")), sc.truncate_right(F.col("w"), 4), sc.truncate_left(F.col("i"), 5), sc.mass(F.lit("S")), sc.mass(F.lit("Zn"))).first()
    assert tuple(got) == (-2.0, "H", "small", "ABCD", "34567", 32.0, 30.0)
    with pytest.raises(Exception):
        spark.createDataFrame([("123",)], "n string").select(sc.first_letter(F.col("n"))).collect()


def test_pattern_and_order(spark):
    nodes = spark.createDataFrame([(1, "N", 1), (2, "C", 1), (3, "N", 2), (4, "C", 2), (5, "N", 4)], "node bigint, atomname string, resid int").withColumn("mol_id", F.lit(0))
    edges = graph.both_ways(spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5)], "mol_id int, u bigint, v bigint"), keys=("mol_id",))
    p = match.Pattern({"a": {"atomname": "C"}, "b": {"atomname": "N"}}, [("a", "b")])
    every = match.find(p, nodes, edges, ("mol_id",))
    assert rows(every.select("a", "b")) == [(2, 1), (2, 3), (4, 3), (4, 5)]
    nxt = match.find(p, nodes, edges, ("mol_id",), [lambda g: match.order_condition(0, g("a", "resid"), 1, g("b", "resid"))])
    assert rows(nxt.select("a", "b")) == [(2, 3)]
    later = match.find(p, nodes, edges, ("mol_id",), [lambda g: match.order_condition(0, g("a", "resid"), ">", g("b", "resid"))])
    assert rows(later.select("a", "b")) == [(2, 3), (4, 5)]


@pytest.mark.parametrize("o1, r1, o2, r2, want", [(0, 1, 1, 2, True), (0, 1, 1, 3, False), (1, 2, -1, 0, True), (0, 1, ">", 5, True), (0, 1, "<", 5, False), (">", 3, ">>", 5, True), (">", 3, ">", 4, False), (">", 3, "<", 1, True), (0, 1, "*", 1, False), ("*", 2, "*", 2, True), ("*", 2, "**", 2, False), (1, 4, ">", 1, True), (2, 4, "*", 4, True)])
def test_order_matrix(spark, o1, r1, o2, r2, want):
    assert spark.range(1).select(match.order_condition(o1, F.lit(r1), o2, F.lit(r2))).first()[0] is want


def path(n):
    return sg.Graph({i: "" for i in range(n)}, [(i, i + 1) for i in range(n - 1)])


def test_symmetry():
    assert sg.bounds(path(3)) == ([(0, 2)], 2)
    ring = sg.Graph({i: "" for i in range(6)}, [(i, (i + 1) % 6) for i in range(6)])
    assert sg.bounds(ring)[1] == 12 and len(set(sg.refine(ring).values())) == 1
    propane = sg.Graph({0: "C", 1: "C", 2: "C"} | {i: "H" for i in range(3, 11)}, [(0, 1), (1, 2), (0, 3), (0, 4), (0, 5), (1, 6), (1, 7), (2, 8), (2, 9), (2, 10)])
    ascending, size = sg.bounds(propane)
    assert size == 144 and len(list(sg.matches(propane, propane, ascending))) == 1 and len(list(sg.matches(propane, propane))) == 144
    assert sg.bounds(sg.Graph({0: "a", 1: "b"}, [(0, 1)]))[1] == 1 and sg.bounds(sg.Graph({}, []))[1] == 1
    with pytest.raises(ValueError):
        sg.symmetry_of(path(3), 0, 1)
    assert path(4).connected() and not path(4).only({0, 1, 3}).connected() and sg.Graph({}, []).connected()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_one_match_for_each_symmetry_class(seed):
    rng = random.Random(seed)

    def graph(n):
        return sg.Graph({i: rng.choice("ab") for i in range(n)}, [p for p in combinations(range(n), 2) if rng.random() < 0.5])

    big, small = graph(rng.randint(1, 5)), graph(rng.randint(1, 4))
    every = [m for m in permutations(big.near, len(small.near)) if all(big.kinds[m[p]] == k for p, k in small.kinds.items()) and all((m[b] in big.near[m[a]]) == (b in small.near[a]) for a, b in combinations(small.near, 2))]
    own = [m for m in permutations(small.near) if all(small.kinds[m[p]] == k for p, k in small.kinds.items()) and all((m[b] in small.near[m[a]]) == (b in small.near[a]) for a, b in combinations(small.near, 2))]
    ascending, size = sg.bounds(small)
    assert size == len(own)
    assert sorted(tuple(m[p] for p in sorted(m)) for m in sg.matches(big, small)) == sorted(every)
    classes = {min(tuple(m[i] for i in s) for s in own) for m in every}
    found = [tuple(m[p] for p in sorted(m)) for m in sg.matches(big, small, ascending)]
    assert {min(tuple(m[i] for i in s) for s in own) for m in found} == classes and len(found) == len(classes)
    most = max((len(k) for r in range(1, len(small.near) + 1) for k in combinations(small.near, r) if any(True for _ in sg.matches(big, small.only(k)))), default=0)
    common = sg.largest_common(big, small)
    assert max((len(m) for m in common), default=0) == most and all(len(m) == most for m in common)
    cliques = sg.common_pairs(big, small)
    assert max((len(c) for c in cliques), default=0) == most


def test_searches(spark):
    ring = sg.Graph({i: "a" for i in range(5)}, [(i, (i + 1) % 5) for i in range(5)])
    assert len(list(sg.matches(ring, sg.Graph({i: "a" for i in range(3)}, [(0, 1), (1, 2)]), [(0, 2)]))) == 5
    common = sg.common_pairs(ring, sg.Graph({i: "a" for i in range(3)}, [(0, 1), (1, 2)]))
    assert len(common) == 10 and all(len(c) == 3 for c in common)
    assert match.cover({1, 2, 3}, [[1, 2], [2, 3], [1], [3]]) == [0, 3]
    assert match.cover({1, 2}, [[1], [1, 2, 3]]) is None and match.cover(set(), [[1]]) == []
    nodes = spark.createDataFrame([(0, 1, "C"), (0, 2, "N"), (0, 3, "C"), (1, 1, "C"), (1, 2, "C")], "mol_id bigint, node bigint, element string")
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "mol_id bigint, u bigint, v bigint")
    p = sg.Graph({0: "C", 1: "N", 2: "C"}, [(0, 1), (1, 2)])
    assert rows(sg.pattern_matches(nodes, edges, p, "element")) == [(0, [1, 2, 3])]
    assert len(rows(sg.pattern_matches(nodes, edges, p, "element", symmetric=False))) == 2
    assert rows(sg.common_subgraphs(nodes, edges, p, "element", connected_parts=True).where("mol_id = 1").select("node", "template_node")) == [(1, "0"), (2, "2")]
    assert rows(sg.candidates(nodes, graph.both_ways(edges, keys=("mol_id",)), p, "element")) == [(0, 1, "0"), (0, 1, "2"), (0, 2, "1"), (0, 3, "0"), (0, 3, "2")]
    with pytest.raises(ValueError):
        match.find(match.Pattern({"a": {}, "b": {}}, []), nodes, edges)


def test_repair_by_graph(spark):
    t = residues.template_graph({"N": "N", "CA": "C", "CB": "C", "C": "C", "O": "O"}, [("N", "CA"), ("CA", "CB"), ("CA", "C"), ("C", "O")])
    head = "mol_id bigint, node bigint, atomname string, element string, resname string, chain string, resid int, insertion_code string, mutation string"
    whole = [(0, i, n, e, "ALA", "A", 1, None, None) for i, (n, e) in enumerate([("N", "N"), ("CA", "C"), ("CB", "C"), ("C", "C"), ("O", "O")])]
    # names all wrong, one atom missing, one atom more
    odd = [(0, 10 + i, n, e, "ALA", "A", 2, None, None) for i, (n, e) in enumerate([("X1", "N"), ("X2", "C"), ("X3", "C"), ("X4", "O"), ("P9", "P")])]
    other = [(1, 0, "N", "N", "GLY", "A", 1, None, "ALA"), (1, 1, "CA", "C", "GLY", "A", 1, None, "ALA"), (1, 2, "Q", "S", "GLY", "A", 1, None, "ALA"), (1, 3, "ZN", "Zn", "ION", "A", 9, None, None)]
    atoms = spark.createDataFrame(whole + odd + other, head)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 3, 4), (0, 10, 11), (0, 11, 12), (0, 12, 13), (0, 13, 14), (0, 3, 10), (1, 0, 1), (1, 1, 2)], "mol_id bigint, u bigint, v bigint")
    fixed, bonds, gone = residues.repair_by_graph(atoms, edges, {"ALA": t}, Store(spark))
    got = {(r["mol_id"], r["node"]): (r["atomname"], r["old_atomname"], r["ptm_atom"], r["resname"]) for r in fixed.collect()}
    assert [got[0, i][0] for i in range(5)] == ["N", "CA", "CB", "C", "O"]
    assert [got[0, i][0] for i in (10, 11, 12, 13)] == ["N", "CA", "C", "O"] and got[0, 10][1] == "X1" and got[0, 14] == ("P9", "P9", True, "ALA")
    assert got[0, 15][0] == "CB" and {got[1, i][0] for i in (4, 5, 6)} == {"C", "CB", "O"} and got[1, 0][3] == "ALA" and got[1, 3] == ("ZN", "ZN", False, "ION")
    assert rows(gone.select("mol_id", "node")) == [(1, 2)] and (1, 2) not in got
    made = {(m, *sorted((u, v))) for m, u, v in rows(bonds)}
    assert (0, 11, 15) in made and (0, 3, 10) in made and (1, 1, 2) not in made and len([x for x in made if x[0] == 1]) == 4


def test_modifications_on_the_graph(spark):
    head = "mol_id bigint, node bigint, atomname string, element string, resid int, ptm_atom boolean"
    atoms = [(0, 0, "N", "N", 1, False), (0, 1, "P", "P", 1, True), (0, 2, "O1", "O", 1, True), (0, 3, "O1", "O", 1, True), (0, 4, "CA", "C", 2, False), (0, 5, "P", "P", 2, True), (0, 6, "SG", "S", 3, False), (0, 7, "SG", "S", 4, False), (0, 8, "X", "C", 3, True), (1, 1, "P", "P", 7, True), (1, 0, "N", "N", 7, False)]
    edges = [(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 4, 5), (0, 6, 8), (0, 7, 8), (1, 0, 1)]
    known = {
        "PO2": residues.modification_graph({"N": (False, "N"), "P": (True, "P"), "a": (True, "O"), "b": (True, "O")}, [("N", "P"), ("P", "a"), ("P", "b")]),
        "PO": residues.modification_graph({"N": (False, "N"), "P": (True, "P"), "a": (True, "O")}, [("N", "P"), ("P", "a")]),
        "P": residues.modification_graph({"N": (False, "N"), "P": (True, "P")}, [("N", "P")]),
        "S2": residues.modification_graph({"s": (False, "SG"), "t": (False, "SG"), "c": (True, "C")}, [("s", "c"), ("t", "c")]),
    }
    got = residues.identify_modifications(spark.createDataFrame(atoms, head), spark.createDataFrame(edges, "mol_id bigint, u bigint, v bigint"), known, Store(spark))
    # repeated names are kept apart, an anchor of another name is no match, an anchor may lie in another residue
    assert rows(got) == [(0, 1, [1], ["PO2"]), (0, 5, [2], None), (0, 8, [3, 4], ["S2"]), (1, 1, [7], ["P"])]


def test_links_tell_modifications(spark):
    from latticework.operators import topology
    from latticework.sources import rules

    nodes = spark.createDataFrame([(0, 1, "A", 1, ["m"]), (0, 2, "A", 2, None)], "mol_id bigint, node bigint, atomname string, resid int, modifications array<string>")
    none = spark.createDataFrame([], "mol_id bigint, u bigint, v bigint")
    for want, hit in ((None, [2]), (["m"], [1]), ("m", [1]), (["m", "k"], [])):
        link = rules.Template("x")
        link.nodes = {"A": {"atomname": "A"} | ({"modifications": want} if want else {})}
        assert [r[0] for r in topology.match_link(link, nodes, none).select("`@A`").collect()] == hit


def test_bridges_and_strands(spark):
    head = "mol_id bigint, node bigint, resname string, atomname string, x double"
    atoms = spark.createDataFrame([(0, 0, "CYS", "SG", 0.0), (0, 1, "CYS", "SG", 0.2), (1, 0, "CYS", "SG", 0.41), (0, 2, "CYS", "CB", 0.1), (2, 0, "DA5", "N6", 5.0), (3, 0, "DT", "O4", 5.29), (2, 1, "DA", "N1", 5.1), (3, 1, "DT3", "N3", 5.3)], head).withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    bonds = spark.createDataFrame([(0, 0, 2), (2, 0, 1), (3, 0, 1)], "mol_id bigint, u bigint, v bigint")
    assert rows(network.cysteine_bridges(atoms, bonds).select("mol_a", "u", "mol_b", "v")) == [(0, 0, 0, 1), (0, 1, 1, 0)]
    assert rows(network.nucleic_strands(atoms, bonds).select("mol_a", "u", "mol_b", "v")) == [(2, 0, 3, 0), (2, 1, 3, 1)]
    every = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "mol_id bigint, u bigint, v bigint")
    assert rows(network.without_bridges(every, atoms)) == [(0, 0, 2)]
    assert [network.bridge_option(x) for x in ("Auto", "none", " 0.3")] == ["auto", "none", 0.3]
    with pytest.raises(ValueError):
        network.bridge_option("near")


def test_mapping(spark):
    m = spark.createDataFrame([(1, 1.0, 0.0), (1, 3.0, 4.0), (2, 0.0, 5.0), (1, 2.0, None)], "bead int, w double, x double")
    assert {r["bead"]: r["x"] for r in mapping.weighted_centroid(m, ["bead"], ["x"], "w").collect()} == {1: 3.0, 2: None}
    listed = spark.createDataFrame([(1, 7), (1, 7), (1, 8)], "from_id int, to_id int")
    assert {r["to_id"]: round(r["weight"], 6) for r in mapping.multiplicity_weights(listed).collect()} == {7: 0.666667, 8: 0.333333}
    member = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (4, "A")], "atom int, bead string")
    assert rows(mapping.induced_edges(spark.createDataFrame([(1, 2), (2, 3)], "u int, v int"), member)) == [("A", "B")]
    assert rows(mapping.overlap(member)) == [(4, 2)]


def test_molecule_operators(spark):
    atoms = spark.createDataFrame([(0, 0, "A", 1, 1), (0, 1, "A", 2, 1), (1, 0, "B", 1, 1), (2, 0, "A", 5, 2)], "mol_id bigint, node bigint, chain string, resid int, charge_group bigint")
    into = molecules.merge_chains(atoms, ["A"])
    assert rows(into) == [(0, 0), (1, 1), (2, 0)]
    merged = molecules.merge_molecules(atoms, into)
    assert rows(merged.where("mol_id = 0").select("node", "resid", "charge_group")) == [(0, 1, 1), (1, 2, 1), (2, 7, 3)]
    meta = spark.createDataFrame([(0, {"a": "1", "b": "2"})], "mol_id int, meta map<string,string>")
    assert molecules.set_meta(meta, {"b": "3"}).first()["meta"] == {"a": "1", "b": "3"}
    res = spark.createDataFrame([(0, i, "H") for i in range(6)], "mol_id int, res_id int, aasecstruct string")
    assert "".join(r[0] for r in molecules.annotate_helices(res).orderBy("res_id").select("cgsecstruct").collect()) == "113322"
    assert [r["q"] for r in molecules.annotate_residues(res, "abcdef", "q").orderBy("res_id").collect()] == list("abcdef")
    with pytest.raises(Exception):
        molecules.annotate_residues(res, "ab", "q").collect()
    assert molecules.residue_spec("A-ALA3") == {"chain": "A", "resname": "ALA", "resid": 3} and molecules.residue_spec("#5") == {"resid": 5} and molecules.residue_spec("PO4#3") == {"resname": "PO4", "resid": 3}
    msgs = spark.createDataFrame([("w",)] * 5 + [("x",)] * 3, "level string")
    assert rows(molecules.remaining_messages(msgs, "level", {"w": 2})) == [("w", 3), ("x", 3)]


def test_networks(spark):
    b = spark.createDataFrame([(i, i, 0.4 * i, 0.0, 0.0) for i in range(6)], "node bigint, residue bigint, x double, y double, z double")
    chain = graph.both_ways(spark.createDataFrame([(i, i + 1) for i in range(5)], "u bigint, v bigint"))
    near = graph.k_hop(chain, 1).select(F.col("src").alias("residue_a"), F.col("dst").alias("residue_b"))
    got = network.elastic_network(b, near, 0.5, 0.9, 0.0, 1.0, 500.0, 0.0)
    assert rows(got.select("u", "v", "length", "force")) == [(i, i + 2, 0.8, 500.0) for i in range(4)]
    atoms = spark.createDataFrame([(1, 0, "C", 0.0), (2, 0, "H", 0.11), (3, 1, "H", 0.22), (4, 1, "X", 0.3)], "node bigint, residue int, element string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert rows(network.distance_bonds(network.with_radius(atoms)).select("u", "v")) == [(1, 2)]
    assert rows(network.symmetric(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a int, b int"))) == [(1, 2)]


def test_broadcasts_are_checked(spark):
    table = spark.createDataFrame([(i, str(i)) for i in range(5)], "a int, b string")
    many = spark.range(20).select(F.col("id").cast("int").alias("a"))
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(if_small(table)) and hint(if_small(table, 5)) and not hint(if_small(table, 4))
    for most in (4, 5):
        assert rows(many.join(if_small(table, most), "a")) == [(i, str(i)) for i in range(5)]


def test_merging_whole_molecules(spark):
    atoms = spark.createDataFrame([(m, n, 1 + n // 2, n + 1, f"m{m}n{n}") for m in range(4) for n in range(3)], "mol_id bigint, node bigint, resid int, charge_group int, atomname string")
    want = [(0, i, f"m{i // 3}n{i % 3}") for i in range(12)]
    assert rows(molecules.merge_all(atoms).select("mol_id", "node", "atomname")) == want
    assert [r["resid"] for r in molecules.merge_all(atoms).orderBy("node").collect()] == [1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 7, 8]
    edges = spark.createDataFrame([(3, 1), (1, 1)], "mol_a bigint, mol_b bigint")
    got = rows(molecules.merge_by_edges(atoms, edges, Store(spark)).select("mol_id", "node", "atomname"))
    assert got == sorted([(m, n, f"m{m}n{n}") for m in (0, 1, 2) for n in range(3)] + [(1, 3 + n, f"m3n{n}") for n in range(3)])
    assert molecules.merge_all(atoms.limit(0)).count() == 0


def test_pruning_and_cascades(spark):
    edge = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 3, 2), (2, 1, 2)], "mol_id bigint, u bigint, v bigint")
    atom = edge.select("mol_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    inter = spark.createDataFrame([(1, "bonds", 0, [0, 1]), (1, "angles", 0, [0, 1, 2]), (1, "bonds", 1, [3]), (2, "bonds", 0, [1, 2])], "mol_id bigint, itype string, seq bigint, atoms array<bigint>")
    gone = spark.createDataFrame([(1, 1)], "mol_id bigint, node bigint")
    left = molecules.drop_nodes({"atom": atom, "edge": edge, "interaction": inter, "message": None}, gone)
    assert rows(left["atom"]) == [(1, 0), (1, 2), (1, 3), (2, 1), (2, 2)] and rows(left["edge"]) == [(1, 3, 2), (2, 1, 2)]
    assert rows(left["interaction"].select("mol_id", "itype", "seq")) == [(1, "bonds", 1), (2, "bonds", 0)]
    pick = lambda *n: spark.createDataFrame([(i,) for i in n], "node bigint")
    one = edge.where("mol_id = 1").select("u", "v")
    assert rows(molecules.prune_edges(one, pick(2), pick(3))) == [(0, 1), (1, 2)] and rows(molecules.prune_edges(one, pick(0), pick(0))) == rows(one)
