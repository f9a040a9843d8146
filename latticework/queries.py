"""The registered queries of the engine's own operators, bound to the star-schema tables, with their SQL.

Each binding gives an operator a relation of the shape that it works on: an
order is a molecule, a line an atom, a vector a position, an event a residue.
Doubles are quantised before they are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import geometry as geo
from latticework.functions import predicates as pr
from latticework.functions import scalars as sc
from latticework.operators import mapping, match, molecules, network, subgraphs
from latticework.plans import graph, ordered, radius
from latticework.plans.components import components as connected
from latticework.plans.store import Store

QUERIES: dict = {}
SQL: dict[str, str] = {}
Q = "floor(({}) * 1e6 + 0.5) / 1e6"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as atoms: the first three dimensions are the position, the label is the domain."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


P = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"


# --- aggregates -------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, CASE WHEN sum(CAST(l_quantity AS DECIMAL(12,2))) = 0 THEN NULL ELSE
 floor(CAST(sum(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) * 1e6 + 0.5) / 1e6 END AS center,
 count(*) AS n_members FROM lineitem GROUP BY l_orderkey""")
def weighted_centroid(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("decimal(12,2)").alias("w"), F.col("l_extendedprice").cast("decimal(14,2)").alias("x"))
    out = mapping.weighted_centroid(members, ["l_orderkey"], ["x"], "w")
    return out.select("l_orderkey", geo.quantise(F.col("x")).alias("center"), "n_members")


@query("""
SELECT o_custkey, CASE WHEN count(o_orderstatus) = count(*) AND count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus,
 CASE WHEN count(o_orderpriority) = count(*) AND count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY o_custkey""")
def consensus_attrs(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[graph.consensus(c).alias(c) for c in ("o_orderstatus", "o_orderpriority")])


def _trade(spark, sf_dir):
    """Customers and suppliers as nodes of their nation, joined where an order brings them together."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("node"), F.col("s_nationkey").alias("nation"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    e = li.join(o, li.l_orderkey == o.o_orderkey).select((-F.col("l_suppkey") - 1).alias("u"), F.col("o_custkey").alias("v")).distinct()
    return c.union(s), e


_TRADE = """n AS (SELECT c_custkey AS node, c_nationkey AS nation FROM customer UNION ALL SELECT -s_suppkey - 1, s_nationkey FROM supplier),
e AS (SELECT DISTINCT -l_suppkey - 1 AS u, o_custkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT a.nation AS p, b.nation AS q FROM e JOIN n a ON a.node = e.u JOIN n b ON b.node = e.v)"""


@query(f"""WITH {_TRADE}, g AS (SELECT nation, min(node) AS f, count(*) AS nnodes FROM n GROUP BY nation),
i AS (SELECT p, count(*) AS nedges FROM x WHERE p = q GROUP BY p)
SELECT nation, row_number() OVER (ORDER BY f) - 1 AS part_id, nnodes, coalesce(nedges, 0) AS nedges,
 CASE WHEN nnodes > 1 THEN floor(2.0e0 * coalesce(nedges, 0) / (nnodes * (nnodes - 1)) * 1e6 + 0.5) / 1e6 ELSE 0.0e0 END AS density
FROM g LEFT JOIN i ON i.p = g.nation""")
def quotient_nodes(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    parts, _ = graph.quotient(nodes, edges, ["nation"])
    return parts.select("nation", "part_id", "nnodes", "nedges", geo.quantise(F.col("density")).alias("density"))


@query(f"""WITH {_TRADE}, g AS (SELECT nation, row_number() OVER (ORDER BY min(node)) - 1 AS id FROM n GROUP BY nation)
SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, count(*) AS n_edges FROM x JOIN g a ON a.nation = x.p JOIN g b ON b.nation = x.q WHERE p <> q GROUP BY 1, 2""")
def quotient_graph(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return graph.quotient(nodes, edges, ["nation"])[1]


@query("""WITH m AS (SELECT l_partkey AS f, l_suppkey AS t, count(*) AS k FROM lineitem GROUP BY 1, 2)
SELECT f AS from_id, t AS to_id, floor(CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY f) * 1e6 + 0.5) / 1e6 AS weight FROM m""")
def mapping_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    return mapping.multiplicity_weights(rows).withColumn("weight", geo.quantise(F.col("weight")))


@query("""SELECT p_brand AS brand_a, n_name AS nation_b, CAST(sum(k) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS pairs FROM
 (SELECT l_partkey, l_suppkey, count(*) AS k FROM lineitem GROUP BY 1, 2) m JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def sparse_projection(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("v"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("brand_a"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return mapping.project(entries, rows, s.select(F.col("s_suppkey").alias("j"), F.col("n_name").alias("nation_b")), ["brand_a"], ["nation_b"])


@query("SELECT l_shipmode_class, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'bonds' WHEN l_linestatus = 'O' THEN 'angles' ELSE 'dihedrals' END AS l_shipmode_class FROM lineitem) GROUP BY 1")
def interaction_summary(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "bonds").when(F.col("l_linestatus") == "O", "angles").otherwise("dihedrals")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("l_shipmode_class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT o_custkey, max(CASE WHEN r = 1 THEN o_orderstatus END) AS value, count(DISTINCT o_orderstatus) > 1 AS inconsistent FROM f GROUP BY o_custkey""")
def attribute_carry(spark, sf_dir):
    return mapping.carry_first(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey")


# --- predicates -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size >= 0 AND p_size = 7")
def template_match(spark, sf_dir):
    return table(spark, sf_dir, "part").where(pr.matches({"p_brand": "Brand#11", "p_size": 7})).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') OR event_type IS NULL")
def choice_match(spark, sf_dir):
    return table(spark, sf_dir, "events").where(pr.matches({"event_type": pr.Choice(("click", "view", None))})).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NULL OR json_extract_string(props, '$.k') <> '87'")
def not_defined_or_not(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    return e.where(pr.NotDefinedOrNot("87").column(F.col("k"))).select("event_id")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(coalesce(p_type, '<ABSENT>'), '[A-Z]+MY')")
def regex_full(spark, sf_dir):
    return table(spark, sf_dir, "part").where(pr.matches({"p_type": pr.FullRegex("[A-Z]+MY")})).select("p_partkey")


@query("SELECT p_partkey, p_size BETWEEN 1 AND 5 OR p_size BETWEEN 20 AND 30 AS idr FROM part")
def range_regions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pr.in_regions(F.col("p_size"), [(1, 5), (30, 20)]).alias("idr"))


@query("SELECT p_partkey FROM part WHERE (p_brand = 'Brand#11' AND p_size BETWEEN 1 AND 10) OR (p_size BETWEEN 40 AND 45)")
def chain_regions(spark, sf_dir):
    return table(spark, sf_dir, "part").where(pr.in_chain_regions(F.col("p_brand"), F.col("p_size"), [("Brand#11", 10, 1), (None, 40, 45)])).select("p_partkey")


@query("SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE (a.l_returnflag = 'R' AND b.l_returnflag = 'A') OR (a.l_linestatus = 'O' AND b.l_linestatus = 'F')")
def any_pattern(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    a, b = li.alias("a"), li.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    hit = match.any_pattern([{"a": {"l_returnflag": "R"}, "b": {"l_returnflag": "A"}}, {"a": {"l_linestatus": "O"}, "b": {"l_linestatus": "F"}}])
    return pairs.where(hit).select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus IN ('O', 'P'))")
def all_residues_protein(spark, sf_dir):
    return molecules.all_in_category(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ("O", "P"))


# --- joins ------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT a.vec_id AS id_a, b.vec_id AS id_b, floor({D} * 1e6 + 0.5) / 1e6 AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {D} <= 0.03")
def radius_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    out = radius.radius_join(p, p, list("xyz"), 0.03, condition=lambda a, b: a("vec_id") < b("vec_id"))
    return out.select(F.col("vec_id_a").alias("id_a"), F.col("vec_id_b").alias("id_b"), geo.quantise(F.col("distance")).alias("distance"))


@query(f"WITH {P} SELECT a.vec_id AS id_a, b.vec_id AS id_b, floor({D} * 1e6 + 0.5) / 1e6 AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {D} < 0.05")
def radius_pairs_same_domain(spark, sf_dir):
    p = points(spark, sf_dir)
    out = radius.radius_join(p, p, list("xyz"), 0.05, on=["label"], strict=True, condition=lambda a, b: a("vec_id") < b("vec_id"))
    return out.select(F.col("vec_id_a").alias("id_a"), F.col("vec_id_b").alias("id_b"), geo.quantise(F.col("distance")).alias("distance"))


@query(f"""WITH {P}, r AS (SELECT *, CASE WHEN label % 3 = 0 THEN 0.01 WHEN label % 3 = 1 THEN 0.02 ELSE 0.03 END AS radius, label % 3 = 0 AS h FROM p)
SELECT a.vec_id AS u, b.vec_id AS v, floor({D} * 1e6 + 0.5) / 1e6 AS distance FROM r a JOIN r b ON a.vec_id < b.vec_id
WHERE NOT (a.h AND b.h) AND NOT (a.label <> b.label AND (a.h OR b.h)) AND {D} <= 0.5 * (a.radius + b.radius) * 1.2""")
def distance_bonds(spark, sf_dir):
    p = points(spark, sf_dir)
    kind = F.col("label") % 3
    atoms = p.select(F.col("vec_id").alias("node"), F.col("label").alias("residue"), *"xyz", F.when(kind == 0, "H").otherwise("C").alias("element"), F.when(kind == 0, 0.01).when(kind == 1, 0.02).otherwise(0.03).alias("radius"))
    return network.distance_bonds(atoms, fudge=1.2).select("u", "v", geo.quantise(F.col("distance")).alias("distance"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def non_edge_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return match.without_neighbour(o, li, ["o_orderkey"])


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)
SELECT a.s AS s1, a.o AS o, b.s AS s2 FROM e a JOIN e b ON a.o = b.o AND a.s < b.s""")
def pattern_path3(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_orderkey").alias("v")).distinct()
    return match.bipartite_path(e).select(F.col("a").alias("s1"), F.col("b").alias("o"), F.col("c").alias("s2"))


_LATTICE = "SELECT a.c_custkey AS u, b.c_custkey AS v FROM (SELECT c_custkey, unnest([1, 2, 5]) AS k FROM customer) a JOIN customer b ON b.c_custkey = a.c_custkey + a.k"


def _lattice(spark, sf_dir):
    """Customers joined with those one, two and five numbers on: a sparse graph that grows with the table."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"))
    steps = c.withColumn("v", F.explode(F.array(*[F.col("u") + k for k in (1, 2, 5)])))
    return steps.join(c.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")


@query(f"WITH e AS ({_LATTICE}) SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.v = y.u JOIN e z ON z.u = x.u AND z.v = y.v")
def pattern_triangle(spark, sf_dir):
    e = _lattice(spark, sf_dir)
    pattern = match.Pattern({"a": {}, "b": {}, "c": {}}, [("a", "b"), ("b", "c"), ("a", "c")], ordered=[("a", "b"), ("b", "c")])
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    return match.find(pattern, nodes, graph.both_ways(e)).select("a", "b", "c")


@query(f"""WITH e AS ({_LATTICE}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)
SELECT x.u AS n0, x.v AS n1, y.v AS n2, z.v AS n3 FROM s x JOIN s y ON x.v = y.u JOIN s z ON y.v = z.u
WHERE x.u <> y.v AND z.v <> x.u AND z.v <> x.v AND x.u < z.v""")
def simple_paths3(spark, sf_dir):
    return graph.simple_paths(graph.both_ways(_lattice(spark, sf_dir)), 3)


@query(f"""WITH e AS ({_LATTICE}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)
SELECT x.u AS n0, x.v AS n1, y.v AS n2 FROM s x JOIN s y ON x.v = y.u WHERE x.u < y.v AND NOT EXISTS (SELECT 1 FROM s z WHERE z.u = x.u AND z.v = y.v)""")
def induced_paths2(spark, sf_dir):
    e = graph.both_ways(_lattice(spark, sf_dir))
    pattern = match.Pattern({"a": {}, "b": {}, "c": {}}, [("a", "b"), ("b", "c")], ordered=[("a", "c")])
    nodes = e.select(F.col("u").alias("node")).distinct()
    return match.find(pattern, nodes, e).select(F.col("a").alias("n0"), F.col("b").alias("n1"), F.col("c").alias("n2"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b, 'next' AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber = 1 WHERE a.l_returnflag = 'R'
UNION ALL SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber, 'after' FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber > a.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'
UNION ALL SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber, 'other' FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber <> a.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'N'""")
def order_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    first = li.where("l_returnflag = 'R'").alias("a")
    out = None
    for kind, order, flag in (("next", 1, None), ("after", ">", "A"), ("other", "*", "N")):
        other = (li if flag is None else li.where(F.col("l_returnflag") == flag)).alias("b")
        same = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & match.order_condition(0, F.col("a.l_linenumber"), order, F.col("b.l_linenumber"))
        got = first.join(other, same).select("a.l_orderkey", F.col("a.l_linenumber").alias("line_a"), F.col("b.l_linenumber").alias("line_b"), F.lit(kind).alias("kind"))
        out = got if out is None else out.union(got)
    return out


@query("""WITH t AS (SELECT o_orderkey, unnest(range(1, 5)) AS line FROM orders), f AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, CAST(coalesce(line, l_linenumber) AS BIGINT) AS line,
 CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra' ELSE 'found' END AS state
FROM t FULL OUTER JOIN f ON o_orderkey = l_orderkey AND line = l_linenumber""")
def repair_outer(spark, sf_dir):
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).alias("line"))
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("bigint").alias("line"))
    return match.compare_with_template(have, want, ["orderkey", "line"])


@query("""WITH x AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT a, b FROM x JOIN (SELECT a AS a2, b AS b2 FROM x) y ON a = b2 AND b = a2 WHERE a < b""")
def symmetric_contacts(spark, sf_dir):
    """Who buys from whom, by number, that is listed both ways."""
    p = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return network.symmetric(p.select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct())


@query(f"""WITH {P}, q AS (SELECT a.label AS ra, b.label AS rb, a.vec_id AS u, b.vec_id AS v, {D} AS d FROM p a JOIN p b ON a.vec_id < b.vec_id AND abs(a.label - b.label) > 2 WHERE {D} <= 0.06),
f AS (SELECT u, v, d, 700.0 * exp(-0.8 * pow(d - 0.01, 1.0)) AS k FROM q)
SELECT u, v, floor(floor(d * 1e5 + 0.5) / 1e5 * 1e6 + 0.5) / 1e6 AS length, floor(CASE WHEN k < 0.5 THEN 0 WHEN k > 700.0 THEN 700.0 ELSE k END * 1e6 + 0.5) / 1e6 AS force FROM f WHERE CASE WHEN k < 0.5 THEN 0 WHEN k > 700.0 THEN 700.0 ELSE k END > 0.5""")
def elastic_network(spark, sf_dir):
    p = points(spark, sf_dir)
    beads = p.select(F.col("vec_id").alias("node"), F.col("label").cast("bigint").alias("residue"), *"xyz")
    chain = spark.range(9).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    near = graph.k_hop(graph.both_ways(chain), 2).select(F.col("src").alias("residue_a"), F.col("dst").alias("residue_b"))
    out = network.elastic_network(beads, near, low=0.01, up=0.06, rate=0.8, power=1.0, base=700.0, minimum=0.5)
    return out.select("u", "v", geo.quantise(F.col("length")).alias("length"), geo.quantise(F.col("force")).alias("force"))


@query(f"""WITH {P}, r AS (SELECT a.vec_id AS id, b.vec_id AS o, {D} AS d FROM p a JOIN p b ON a.label <> b.label WHERE {D} <= 0.05)
SELECT id AS vec_id, owner, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM (SELECT id, o AS owner, d, row_number() OVER (PARTITION BY id ORDER BY d, o) AS k FROM r) WHERE k = 1""")
def nearest_owner(spark, sf_dir):
    p = points(spark, sf_dir)
    out = radius.nearest(p, p, list("xyz"), 0.05, "vec_id", "vec_id", condition=lambda a, b: a("label") != b("label"))
    return out.withColumn("distance", geo.quantise(F.col("distance")))


@query("""SELECT a.p_partkey AS ia, b.p_partkey AS ib FROM part a JOIN part b ON a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type AND a.p_size IS NOT DISTINCT FROM b.p_size
WHERE a.p_partkey <> b.p_partkey""")
def categorical_product(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_type", "p_size")
    return graph.categorical_product(n, n, ["p_brand", "p_type", "p_size"]).where("ia <> ib")


@query("""WITH e AS (SELECT n_nationkey AS u, m AS v FROM nation, (SELECT unnest([1, 2, 5]) AS k), (SELECT n_nationkey AS m FROM nation) WHERE m = (n_nationkey + k) % 25 ),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), p AS (SELECT a.n_nationkey AS ia, b.n_nationkey AS ib FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT x.ia AS ua, x.ib AS ub, y.ia AS va, y.ib AS vb FROM p x JOIN p y ON x.ia < y.ia AND x.ib <> y.ib
WHERE EXISTS (SELECT 1 FROM s WHERE s.u = x.ia AND s.v = y.ia) = EXISTS (SELECT 1 FROM s WHERE s.u = x.ib AND s.v = y.ib)""")
def modular_product(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey")
    e = graph.both_ways(n.select(F.col("node").alias("u"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 5)])).alias("k")).select("u", ((F.col("u") + F.col("k")) % 25).cast("int").alias("v")))
    return graph.modular_product(graph.categorical_product(n, n, ["n_regionkey"]), e, e)


@query("SELECT count(*) AS n, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'A' GROUP BY l_suppkey")
def edges_between(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_suppkey").alias("v"), "l_returnflag")
    a = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return molecules.edges_between(e.where("l_returnflag = 'A'"), a, b).groupBy(F.col("v").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n"))


# --- graphs -----------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS u, -l_partkey - 1 AS v FROM lineitem),
s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
cc(id, comp) USING KEY (id) AS (
 SELECT u, min(least(u, v)) FROM s GROUP BY u
 UNION SELECT s.v, min(cc.comp) FROM cc JOIN s ON s.u = cc.id JOIN recurring.cc r ON r.id = s.v WHERE cc.comp < r.comp GROUP BY s.v)
SELECT id AS node, comp AS component FROM cc""")
def components(spark, sf_dir):
    """Components of the whole order-part graph."""
    e = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    return connected(e.select(F.col("l_orderkey").cast("bigint").alias("a"), (-F.col("l_partkey") - 1).cast("bigint").alias("b")).distinct(), Store(spark))


@query(f"""WITH RECURSIVE e AS ({_LATTICE}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
d1 AS (SELECT u, v FROM s), d2 AS (SELECT DISTINCT a.u, b.v FROM d1 a JOIN s b ON a.v = b.u), d3 AS (SELECT DISTINCT a.u, b.v FROM d2 a JOIN s b ON a.v = b.u),
n AS (SELECT DISTINCT u FROM s), al AS (SELECT u, u AS v, 0 AS d FROM n UNION ALL SELECT u, v, 1 FROM d1 UNION ALL SELECT u, v, 2 FROM d2 UNION ALL SELECT u, v, 3 FROM d3)
SELECT u AS src, v AS dst, CAST(min(d) AS INT) AS depth FROM al GROUP BY 1, 2""")
def k_hop(spark, sf_dir):
    return graph.k_hop(graph.both_ways(_lattice(spark, sf_dir)), 3)


@query(f"""WITH e AS ({_LATTICE}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), val AS (SELECT c_custkey AS node, c_name AS value FROM customer WHERE c_mktsegment = 'BUILDING'),
d2 AS (SELECT DISTINCT a.u, b.v FROM s a JOIN s b ON a.v = b.u), d3 AS (SELECT DISTINCT a.u, b.v FROM d2 a JOIN s b ON a.v = b.u), n AS (SELECT DISTINCT u FROM s),
al AS (SELECT u, u AS v, 0 AS d FROM n UNION ALL SELECT u, v, 1 FROM s UNION ALL SELECT u, v, 2 FROM d2 UNION ALL SELECT u, v, 3 FROM d3),
r AS (SELECT al.u AS node, value, d, row_number() OVER (PARTITION BY al.u ORDER BY d, v) AS k FROM al JOIN val ON val.node = al.v)
SELECT node, value, CAST(d AS INT) AS depth FROM r WHERE k = 1""")
def nearest_attr(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("value"))
    return graph.nearest_attribute(graph.both_ways(_lattice(spark, sf_dir)), values, 3)


@query("SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1")
def degree(spark, sf_dir):
    return graph.degree(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")))


# --- ordered operators ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS atomid FROM orders")
def renumber(spark, sf_dir):
    return ordered.renumber(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "atomid")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS size FROM orders)
SELECT o_orderkey, size, CAST(coalesce(sum(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n""")
def merge_offsets(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("size"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return ordered.running_offset(o, "size", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "size", "offset")


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n FROM g GROUP BY 1, 2, 3""")
def islands(spark, sf_dir):
    return ordered.islands(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], ["user_id"])


@query("""WITH m AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || l_returnflag, ',' ORDER BY l_linenumber, CAST(l_linenumber AS VARCHAR) || l_returnflag) AS shape FROM lineitem GROUP BY 1), f AS (SELECT shape, min(l_orderkey) AS k FROM m GROUP BY 1),
r AS (SELECT shape, row_number() OVER (ORDER BY k) - 1 AS shape_id FROM f) SELECT l_orderkey, shape_id FROM m JOIN r ON r.shape = m.shape""")
def moltype_names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("a"))
    shapes = molecules.shape_of(li, ["l_orderkey"], "l_linenumber", "a")
    return ordered.dense_id(shapes, "shape", "l_orderkey").select("l_orderkey", "shape_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return ordered.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH m AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, max(n) AS best FROM m GROUP BY 1) SELECT m.o_custkey, o_orderpriority, n FROM m JOIN b ON b.o_custkey = m.o_custkey WHERE n = best""")
def all_maxima(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return ordered.all_maxima(m, ["o_custkey"], "n")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return ordered.first_match(o, ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT l_orderkey AS k, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_orderkey AS k, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
ks AS (SELECT k FROM a UNION SELECT k FROM b), d AS (SELECT DISTINCT coalesce(a.k, b.k) AS k FROM a FULL OUTER JOIN b ON a.k = b.k AND a.p = b.p WHERE a.n IS DISTINCT FROM b.n)
SELECT ks.k AS l_orderkey, d.k IS NULL AS same FROM ks LEFT JOIN d ON d.k = ks.k""")
def set_equality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return molecules.same_multiset(li.where("l_linestatus = 'F'").select("l_orderkey", "l_partkey"), li.where("l_returnflag <> 'N'").select("l_orderkey", "l_partkey"), ["l_orderkey"], ["l_partkey"])


# --- updates ----------------------------------------------------------------------------------------------------


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW') SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("node"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_linenumber").alias("v"))
    return molecules.drop_edges_of(e, gone, ends=("u",)).select(F.col("u").alias("l_orderkey"), F.col("v").alias("l_linenumber"))


@query("""WITH c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS s, min(o_orderkey) AS f FROM orders GROUP BY 1), m AS (SELECT o_custkey, CASE WHEN len(list_filter(s, lambda x: x NOT IN ('F', 'O'))) = 0 THEN (SELECT min(o_custkey) FROM c WHERE len(list_filter(s, lambda x: x NOT IN ('F', 'O'))) = 0) ELSE o_custkey END AS merged FROM c)
SELECT o_custkey, merged FROM m""")
def merge_chains(spark, sf_dir):
    atoms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mol_id"), F.col("o_orderstatus").alias("chain"))
    return molecules.merge_chains(atoms, ["F", "O"]).select(F.col("mol_id").alias("o_custkey"), F.col("merged_id").alias("merged"))


@query("SELECT s_suppkey, s_nationkey AS resid, s_nationkey + 100 AS new_resid FROM supplier")
def stash_attributes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("resid"))
    kept = molecules.stash(s, ["resid"]).withColumn("resid", F.col("resid") + 100)
    return molecules.stash(kept, ["resid"]).select("s_suppkey", F.col("stash_resid").alias("resid"), F.col("resid").alias("new_resid"))


# --- mapping ----------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT p_partkey, p_brand AS bead, 1.0e0 AS weight FROM part UNION ALL SELECT p_partkey, p_type, 0.5e0 FROM part WHERE p_size > 25)
SELECT bead, count(*) AS members, sum(weight) AS weight, floor(CAST(sum(CAST(p_size AS DOUBLE) * weight) AS DOUBLE) / sum(weight) * 1e6 + 0.5) / 1e6 AS center FROM w JOIN part USING (p_partkey) GROUP BY bead""")
def mapping_nm(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    table_ = part.select(F.col("p_partkey").alias("atom"), F.col("p_brand").alias("bead"), F.lit(1.0).alias("weight")).union(part.where("p_size > 25").select("p_partkey", "p_type", F.lit(0.5)))
    atoms = part.select(F.col("p_partkey").alias("atom"), F.col("p_size").cast("double").alias("x"))
    members = mapping.bead_members(atoms, table_)
    out = mapping.weighted_centroid(members, ["bead"], ["x"], "weight", keep_weight=True)
    return out.select("bead", F.col("n_members").alias("members"), "weight", geo.quantise(F.col("x")).alias("center"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, p_brand AS bead FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT DISTINCT least(a.bead, b.bead) AS u, greatest(a.bead, b.bead) AS v FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.bead <> b.bead""")
def bead_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("atom"), "l_partkey")
    member = li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("bead")), "l_partkey").select("atom", "bead")
    edges = li.select(F.col("atom").alias("u"), (F.col("atom") + 1).alias("v"))
    return mapping.induced_edges(edges, member)


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def uncovered_atoms(spark, sf_dir):
    atoms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("atom"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return mapping.uncovered(atoms, urgent.select(F.col("o_custkey").alias("atom"))).select(F.col("atom").alias("c_custkey"))


@query("SELECT l_partkey AS atom, count(DISTINCT l_suppkey) AS beads FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def overlapping_atoms(spark, sf_dir):
    return mapping.overlap(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("atom"), F.col("l_suppkey").alias("bead")))


# --- scalars ----------------------------------------------------------------------------------------------------

_LETTERS = "CASE event_type WHEN 'click' THEN 'H' WHEN 'view' THEN 'H' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'T' ELSE 'S' END"


@query(f"""WITH c AS (SELECT user_id, {_LETTERS} AS ch, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, ch = 'H' ORDER BY i) AS run FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ch = 'H', run ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY user_id, ch = 'H', run) AS n FROM g)
SELECT user_id, string_agg(CASE WHEN ch <> 'H' THEN ch WHEN n <= 4 THEN '3' WHEN k < least(n - 4, 4) THEN '1' WHEN k >= n - least(n - 4, 4) THEN '2' WHEN n < 8 THEN '3' ELSE 'H' END, '' ORDER BY i) AS ss FROM r GROUP BY 1""")
def ss_rewrite(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("click", "view"), "H").when(F.col("event_type") == "purchase", "E").when(F.col("event_type") == "signup", "T").otherwise("S")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("c"))
    seq = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "c"))), lambda x: x["c"]), "").alias("seq"))
    return seq.select("user_id", sc.helix_letters(F.col("seq")).alias("ss"))


_AT = ", ".join(f"CAST(embedding[{3 * k + i + 1}] AS DOUBLE) AS {c}{k}" for k in range(4) for i, c in enumerate("xyz"))
_U = [f"({c}1-{c}0)" for c in "xyz"]
_V = [f"({c}2-{c}1)" for c in "xyz"]
_W = [f"({c}3-{c}2)" for c in "xyz"]


def _cross(a, b):
    return [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]


def _dot(a, b):
    return "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"


_M = [f"(-1*{u})" for u in _U]


@query(f"""WITH q AS (SELECT vec_id, {_AT} FROM embeddings)
SELECT vec_id, floor(degrees(acos(greatest(-1.0, least(1.0, {_dot(_M, _V)} / (sqrt({_dot(_M, _M)}) * sqrt({_dot(_V, _V)})))))) * 1e4 + 0.5) / 1e4 AS angle,
 floor(degrees(atan2({_dot(_U, _cross(_V, _W))} * sqrt({_dot(_V, _V)}), {_dot(_cross(_U, _V), _cross(_V, _W))})) * 1e4 + 0.5) / 1e4 AS dihedral FROM q""")
def angle_dihedral(spark, sf_dir):
    e = F.col("embedding")
    pt = [[e[3 * k + i].cast("double") for i in range(3)] for k in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.quantise(F.degrees(geo.angle(*pt[:3])), 1e4).alias("angle"), geo.quantise(F.degrees(geo.dihedral(*pt)), 1e4).alias("dihedral"))


@query("SELECT p_partkey, CAST(coalesce(CASE substr(p_name, 1, 1) WHEN 'h' THEN 1 WHEN 'c' THEN 12 WHEN 'n' THEN 14 WHEN 'o' THEN 16 WHEN 's' THEN 32 WHEN 'p' THEN 31 END, 30) AS DOUBLE) AS mass, regexp_extract(p_name, '[A-Za-z]') AS element FROM part WHERE regexp_matches(p_name, '[A-Za-z]')")
def attach_mass(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").rlike("[A-Za-z]"))
    return p.select("p_partkey", sc.mass(F.upper(F.substring("p_name", 1, 1))).alias("mass"), sc.first_letter(F.col("p_name")).alias("element"))


@query("SELECT s_suppkey, CASE WHEN starts_with(s_name, 'S') THEN 'small' WHEN starts_with(s_name, 'T') THEN 'tiny' ELSE 'regular' END AS size, rpad(s_name, 8, ' ') AS left_text, lpad(right(CAST(s_suppkey * 1000 AS VARCHAR), 5), 5, ' ') AS right_number FROM supplier")
def text_columns(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", sc.bead_size(F.col("s_name")).alias("size"), sc.truncate_right(F.col("s_name"), 8).alias("left_text"), sc.truncate_left(F.col("s_suppkey") * 1000, 5).alias("right_number"))


@query("""SELECT p_partkey, floor(p_size / pow(2.0, 1.0/6) * 1e6 + 0.5) / 1e6 AS sigma, floor(4 * 0.5 * pow(p_size / 50.0, 6.0) * 1e6 + 0.5) / 1e6 AS c6, floor(4 * 0.5 * pow(p_size / 50.0, 6.0) * pow(p_size / 50.0, 6.0) * 1e6 + 0.5) / 1e6 AS c12 FROM part""")
def lennard_jones(spark, sf_dir):
    c6, c12 = geo.c6_c12(F.col("p_size") / F.lit(50.0), F.lit(0.5))
    return table(spark, sf_dir, "part").select("p_partkey", *[geo.quantise(c).alias(n) for n, c in (("sigma", geo.sigma_from_distance(F.col("p_size").cast("double"))), ("c6", c6), ("c12", c12))])


@query("""WITH l AS (SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1) SELECT level, CAST(greatest(n - CASE level WHEN 'error' THEN 10 WHEN 'click' THEN n ELSE 0 END, 0) AS BIGINT) AS remaining FROM l""")
def warning_gate(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(F.col("event_type").alias("level"))
    return molecules.remaining_messages(messages, "level", {"error": 10, "click": None})


# --- networks and sites -----------------------------------------------------------------------------------------


@query(f"""WITH e AS ({_LATTICE}), gone AS (SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey BETWEEN 3 AND 9) OR c_nationkey BETWEEN 20 AND 22)
SELECT u, v FROM e WHERE u NOT IN (SELECT c_custkey FROM gone) AND v NOT IN (SELECT c_custkey FROM gone)""")
def disorder_removal(spark, sf_dir):
    residues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("chain"), F.col("c_nationkey").alias("resid"))
    return network.drop_disordered(_lattice(spark, sf_dir), residues, [("BUILDING", 9, 3), (None, 20, 22)]).select("u", "v")


@query("SELECT o_custkey AS mol_id, o_orderkey AS atom, '1 POSRES_FC POSRES_FC POSRES_FC' AS params FROM orders WHERE o_orderstatus = 'O'")
def position_restraints(spark, sf_dir):
    atoms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mol_id"), F.col("o_orderkey").alias("node"), "o_orderstatus")
    made = molecules.position_restraints(atoms, F.col("o_orderstatus") == "O", 1000.0)
    return made.select("mol_id", F.col("atoms")[0].alias("atom"), F.array_join("params", " ").alias("params"))


@query("""WITH m AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1)
SELECT o.o_custkey AS mol_id, last + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) AS site, o_orderkey AS anchor FROM orders o JOIN m ON m.o_custkey = o.o_custkey WHERE o_orderstatus = 'F'""")
def virtual_sites(spark, sf_dir):
    atoms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mol_id"), F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("atomname"), F.col("o_orderpriority").alias("atype"), F.lit(1).cast("bigint").alias("charge_group"))
    return molecules.virtual_sites(atoms, "mol", anchor="F")[1].select("mol_id", F.col("atoms")[0].alias("site"), F.col("atoms")[1].alias("anchor"))


@query(f"""WITH {P} SELECT a.vec_id AS node_a, b.vec_id AS node_b, floor({D} / pow(2.0, 1.0/6) * 1e6 + 0.5) / 1e6 AS sigma FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 WHERE {D} > 0.05 AND {D} < 0.2""")
def go_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    residues = p.select(F.col("vec_id").alias("resid"), F.col("label").cast("string").alias("chain"), F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("atype"), F.col("vec_id").alias("node"), *"xyz")
    who = p.select(F.col("vec_id").alias("r"), F.col("label").cast("string").alias("c"))
    nxt = p.select((F.col("vec_id") - 1).alias("r"), F.col("vec_id").alias("r2"), F.col("label").cast("string").alias("c2"))
    there = who.join(nxt, "r").select(F.col("r").alias("resid_a"), F.col("c").alias("chain_a"), F.col("r2").alias("resid_b"), F.col("c2").alias("chain_b"))
    back = there.select(F.col("resid_b").alias("resid_a"), F.col("chain_b").alias("chain_a"), F.col("resid_a").alias("resid_b"), F.col("chain_a").alias("chain_b"))
    none = residues.select(F.col("node").alias("u"), F.col("node").alias("v"))
    out = network.go_pairs(there.union(back), residues, none, low=0.05, up=0.2)
    return out.select("node_a", "node_b", geo.quantise(F.col("sigma")).alias("sigma"))


# --- searches in small graphs -----------------------------------------------------------------------------------

#: An order as a molecule: its lines are nodes, joined where they follow each other, or share a flag and differ in status.
_LINE_GRAPH = """e AS (SELECT DISTINCT a.l_orderkey AS m, a.l_linenumber AS u, b.l_linenumber AS v FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND (a.l_returnflag = b.l_returnflag AND a.l_linestatus <> b.l_linestatus OR abs(a.l_linenumber - b.l_linenumber) = 1)),
n AS (SELECT DISTINCT l_orderkey AS m, l_linenumber AS x FROM lineitem)"""


def _line_graph(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nodes = li.select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").cast("bigint").alias("node")).distinct()
    a, b = li.alias("a"), li.alias("b")
    alike = (F.col("a.l_returnflag") == F.col("b.l_returnflag")) & (F.col("a.l_linestatus") != F.col("b.l_linestatus"))
    joined = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") != F.col("b.l_linenumber")) & (alike | (F.abs(F.col("a.l_linenumber") - F.col("b.l_linenumber")) == 1)))
    return nodes, joined.select(F.col("a.l_orderkey").alias("mol_id"), F.col("a.l_linenumber").cast("bigint").alias("u"), F.col("b.l_linenumber").cast("bigint").alias("v")).distinct()


_PATH = subgraphs.Graph({0: "", 1: "", 2: ""}, [(0, 1), (1, 2)])


@query(f"""WITH {_LINE_GRAPH}, p AS (SELECT x.m, x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON x.m = y.m AND x.v = y.u AND y.v <> x.u WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.m = x.m AND z.u = x.u AND z.v = y.v)),
pc AS (SELECT m, count(*) AS k FROM p GROUP BY m), ec AS (SELECT m, count(*) AS k FROM e GROUP BY m), nc AS (SELECT m, count(*) AS k FROM n GROUP BY m)
SELECT nc.m AS mol_id, CASE WHEN pc.k > 0 THEN 3 WHEN nc.k > 1 THEN 2 ELSE 1 END AS size,
 CASE WHEN pc.k > 0 THEN pc.k WHEN nc.k > 1 THEN 2 * coalesce(ec.k, 0) + (nc.k * (nc.k - 1) - coalesce(ec.k, 0)) ELSE 3 END AS ties
FROM nc LEFT JOIN pc ON pc.m = nc.m LEFT JOIN ec ON ec.m = nc.m""")
def common_subgraph(spark, sf_dir):
    """Size and number of the largest subgraphs that each order's lines have in common with a path of three."""
    nodes, edges = _line_graph(spark, sf_dir)
    found = subgraphs.common_subgraphs(nodes, edges, _PATH)
    return found.groupBy("mol_id").agg((F.count(F.lit(1)) / F.count_distinct("rank")).cast("int").alias("size"), F.count_distinct("rank").alias("ties"))


@query(f"""WITH {_LINE_GRAPH} SELECT x.m AS mol_id, x.u AS n0, x.v AS n1, y.v AS n2 FROM e x JOIN e y ON x.m = y.m AND x.v = y.u WHERE x.u < y.v AND NOT EXISTS (SELECT 1 FROM e z WHERE z.m = x.m AND z.u = x.u AND z.v = y.v)""")
def isomorphisms(spark, sf_dir):
    """Matches of a path of three in the lines of each order, one for each symmetry class."""
    nodes, edges = _line_graph(spark, sf_dir)
    return subgraphs.pattern_matches(nodes, edges, _PATH).select("mol_id", *[F.col("match")[i].alias(f"n{i}") for i in range(3)])


@query(f"""WITH {_LINE_GRAPH}, k AS (SELECT DISTINCT l_orderkey AS m, l_linenumber AS x, l_returnflag AS f FROM lineitem),
c AS (SELECT e.m, e.u AS x, count(DISTINCT CASE WHEN k.f = 'A' THEN e.v END) AS a, count(DISTINCT CASE WHEN k.f = 'N' THEN e.v END) AS n FROM e JOIN k ON k.m = e.m AND k.x = e.v GROUP BY 1, 2)
SELECT k.m AS mol_id, k.x AS node, p.q AS pattern_node FROM k LEFT JOIN c ON c.m = k.m AND c.x = k.x, (SELECT unnest(['0', '1', '2']) AS q) p
WHERE (q = '0' AND f = 'A' AND n >= 1) OR (q = '1' AND f = 'N' AND a >= 2) OR (q = '2' AND f = 'A' AND n >= 1)""")
def match_candidates(spark, sf_dir):
    """Lines that could be an end (A) or the middle (N) of a path, by the kinds of their neighbours."""
    nodes, edges = _line_graph(spark, sf_dir)
    kinds = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").cast("bigint").alias("node"), "l_returnflag").distinct()
    return subgraphs.candidates(kinds, edges, subgraphs.Graph({0: "A", 1: "N", 2: "A"}, [(0, 1), (1, 2)]), "l_returnflag")


@query("""WITH o AS (SELECT l_orderkey AS m, list(DISTINCT l_linenumber) AS x FROM lineitem GROUP BY 1),
t AS (SELECT m, x, list_has_all(x, [1, 2]) AS a, list_has_all(x, [3, 4]) AS b, list_has_all(x, [5, 6]) AS c FROM o)
SELECT m AS mol_id, concat_ws(',', CASE WHEN a THEN '0' END, CASE WHEN b THEN '1' END, CASE WHEN c THEN '2' END, CASE WHEN list_contains(x, 1) AND NOT a THEN '3' END, CASE WHEN list_contains(x, 2) AND NOT a THEN '4' END,
 CASE WHEN list_contains(x, 3) AND NOT b THEN '5' END, CASE WHEN list_contains(x, 4) AND NOT b THEN '6' END, CASE WHEN list_contains(x, 5) AND NOT c THEN '7' END, CASE WHEN list_contains(x, 6) AND NOT c THEN '8' END, CASE WHEN list_contains(x, 7) THEN '9' END) AS options FROM t""")
def exact_covers(spark, sf_dir):
    """The lines of each order covered exactly by pairs and single lines, larger options first."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").alias("item"))
    covered = match.exact_covers(li, [[1, 2], [3, 4], [5, 6], [1], [2], [3], [4], [5], [6], [7]])
    return covered.select("mol_id", F.array_join(F.transform("options", lambda x: x.cast("string")), ",").alias("options"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS m, l_linenumber AS x, l_returnflag AS f, l_linestatus AS s FROM lineitem),
e AS (SELECT a.m, a.x AS u, b.x AS v FROM n a JOIN n b ON a.m = b.m AND a.x <> b.x AND (a.f = b.f OR a.s = b.s AND abs(a.x - b.x) = 1)),
r AS (SELECT m, min(x) AS x FROM n GROUP BY m UNION SELECT e.m, e.v FROM r JOIN e ON e.m = r.m AND e.u = r.x)
SELECT m AS mol_id, count(*) = (SELECT count(DISTINCT x) FROM n WHERE n.m = r.m) AS connected FROM r GROUP BY m""")
def connected_lines(spark, sf_dir):
    """Whether the lines of each order hang together, joined by their flag or, next to each other, by their status."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").alias("x"), "l_returnflag", "l_linestatus", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("node")).distinct()
    a, b = li.alias("a"), li.alias("b")
    near = (F.col("a.l_returnflag") == F.col("b.l_returnflag")) | ((F.col("a.l_linestatus") == F.col("b.l_linestatus")) & (F.abs(F.col("a.x") - F.col("b.x")) == 1))
    edges = a.join(b, (F.col("a.mol_id") == F.col("b.mol_id")) & (F.col("a.x") < F.col("b.x")) & near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return graph.connected(li, edges, Store(spark))
