"""Searches in small labelled graphs, one molecule or residue to a task.

A template is analysed once: partition refinement splits its nodes into classes that no symmetry can mix, and a
chain of orbits (each with the nodes before held in place) gives bounds "the match of a stands before the match
of b". Every symmetry class of matches has exactly one member that keeps all bounds, so the search never lists
the others. Matches are induced: pairs without an edge must stay without one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from latticework.plans.workers import prepare


class Graph:
    """Nodes with a kind each, and undirected edges."""

    def __init__(self, kinds: dict, edges: Iterable[tuple]):
        self.kinds = dict(kinds)
        self.near = {n: set() for n in self.kinds}
        for a, b in edges:
            if a != b and a in self.near and b in self.near:
                self.near[a].add(b)
                self.near[b].add(a)

    def only(self, keep) -> Graph:
        return Graph({n: self.kinds[n] for n in sorted(keep)}, [(a, b) for a in keep for b in self.near[a] if b in keep])

    def connected(self) -> bool:
        """Whether every node can be reached from every other."""
        if not self.near:
            return True
        todo = [next(iter(self.near))]
        seen = set(todo)
        while todo:
            new = self.near[todo.pop()] - seen
            seen |= new
            todo += new
        return len(seen) == len(self.near)


def _split(graph: Graph, *colours: dict) -> list[dict]:
    """The coarsest colourings under which nodes of a colour have the same colours around them, told apart alike in all."""
    held = list(colours)
    while True:
        seen = [{n: (c[n], tuple(sorted(c[m] for m in graph.near[n]))) for n in graph.near} for c in held]
        rank = {s: i for i, s in enumerate(sorted({s for x in seen for s in x.values()}))}
        if len(rank) == len({v for c in held for v in c.values()}):
            return held
        held = [{n: rank[s] for n, s in x.items()} for x in seen]


def refine(graph: Graph, colour: dict | None = None) -> dict:
    """The stable colouring that refines a colouring (the kinds, if none is given)."""
    if colour is None:
        rank = {k: i for i, k in enumerate(sorted(set(graph.kinds.values()), key=repr))}
        colour = {n: rank[k] for n, k in graph.kinds.items()}
    return _split(graph, colour)[0]


def _cells(colour: dict) -> dict:
    out: dict = {}
    for n in sorted(colour):
        out.setdefault(colour[n], []).append(n)
    return out


def symmetry(graph: Graph, left: dict, right: dict) -> dict | None:
    """A symmetry that takes nodes coloured by `left` to nodes coloured by `right`, if there is one."""
    left, right = _split(graph, left, right)
    if Counter(left.values()) != Counter(right.values()):
        return None
    from_, to = _cells(left), _cells(right)
    open_ = [c for c in from_ if len(from_[c]) > 1]
    if not open_:
        moved = {from_[c][0]: to[c][0] for c in from_}
        return moved if all(moved[b] in graph.near[moved[a]] for a in graph.near for b in graph.near[a]) else None
    c = min(open_, key=lambda x: (len(from_[x]), x))
    fresh = max(left.values()) + 1
    for w in to[c]:
        got = symmetry(graph, left | {from_[c][0]: fresh}, right | {w: fresh})
        if got is not None:
            return got
    return None


def bounds(graph: Graph) -> tuple[list[tuple], int]:
    """(pairs a, b whose matches must ascend, number of symmetries)."""
    colour, out, size = refine(graph), [], 1
    while True:
        loose = sorted(n for held in _cells(colour).values() if len(held) > 1 for n in held)
        if not loose:
            return out, size
        v, fresh = loose[0], max(colour.values()) + 1
        orbit = [w for w in _cells(colour)[colour[v]] if w == v or symmetry(graph, colour | {v: fresh}, colour | {w: fresh}) is not None]
        out += [(v, w) for w in orbit if w != v]
        size *= len(orbit)
        colour = refine(graph, colour | {v: fresh})


def fitting(graph: Graph, pattern: Graph, fits: Callable = lambda want, have: want == have) -> dict:
    """Pattern node -> nodes of its kind that have as many neighbours of each kind as it has, or more."""
    def around(g: Graph, n) -> list:
        return [g.kinds[m] for m in g.near[n]]

    def enough(p, n) -> bool:
        have = around(graph, n)
        return len(have) >= len(pattern.near[p]) and all(sum(fits(k, h) for h in have) >= c for k, c in Counter(around(pattern, p)).items())

    return {p: {n for n in graph.near if fits(k, graph.kinds[n]) and enough(p, n)} for p, k in pattern.kinds.items()}


def matches(graph: Graph, pattern: Graph, ascending: Iterable[tuple] = (), fits: Callable = lambda want, have: want == have) -> Iterator[dict]:
    """Induced matches of a pattern, lowest nodes first, keeping the bounds."""
    pool = fitting(graph, pattern, fits)
    above, below = {}, {}
    for a, b in ascending:
        above.setdefault(a, []).append(b)
        below.setdefault(b, []).append(a)

    def grow(found: dict) -> Iterator[dict]:
        if len(found) == len(pattern.near):
            yield dict(found)
            return
        p = min((q for q in pattern.near if q not in found), key=lambda q: (-len(pattern.near[q] & found.keys()), len(pool[q]), q))
        held = pool[p] - set(found.values())
        for q, n in found.items():
            held = held & graph.near[n] if q in pattern.near[p] else held - graph.near[n]
        for n in sorted(held):
            if all(found[b] > n for b in above.get(p, ()) if b in found) and all(found[a] < n for a in below.get(p, ()) if a in found):
                found[p] = n
                yield from grow(found)
                del found[p]

    yield from grow({})


def largest_common(graph: Graph, pattern: Graph, fits: Callable = lambda want, have: want == have) -> list[dict]:
    """Matches of the largest parts of a pattern that are in a graph, one for each symmetry class of a part.

    Parts lose one node at a time. Of two parts that a symmetry of the pattern exchanges only one is tried.
    """
    turns = [symmetry_of(pattern, a, b) for a, b in bounds(pattern)[0]]
    level = {frozenset(pattern.near)}
    while level:
        out = []
        for keep in sorted(level, key=sorted):
            part = pattern.only(keep)
            out += list(matches(graph, part, bounds(part)[0], fits))
        if out:
            return out
        level = {keep - {n} for keep in level for n in keep if len(keep) > 1}
        done: set = set()
        for keep in sorted(level, key=sorted):
            if not any(frozenset(t[n] for n in keep) in done for t in turns):
                done.add(keep)
        level = done
    return []


def symmetry_of(graph: Graph, a, b) -> dict:
    """A symmetry that takes a to b (there must be one); the nodes before a in the chain of bounds stay where they can."""
    colour = refine(graph)
    fresh = max(colour.values()) + 1
    got = symmetry(graph, colour | {a: fresh}, colour | {b: fresh})
    if got is None:
        raise ValueError(f"no symmetry takes {a!r} to {b!r}")
    return got


def maximum_cliques(near: dict) -> list[tuple]:
    """All largest cliques (Bron-Kerbosch with pivots)."""
    best: list[tuple] = []

    def grow(r: tuple, p: set, x: set) -> None:
        nonlocal best
        if best and len(r) + len(p) < len(best[0]):
            return
        if not p and not x:
            best = [*best, r] if best and len(r) == len(best[0]) else [r]
            return
        pivot = max(p | x, key=lambda v: len(near[v] & p))
        for v in sorted(p - near[pivot]):
            grow((*r, v), p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow((), set(near), set())
    return sorted(tuple(sorted(c)) for c in best if c)


def common_pairs(graph: Graph, template: Graph, fits: Callable = lambda want, have: want == have) -> list[tuple]:
    """Largest common induced subgraphs, connected or not, as cliques of the modular product: tuples of (node, template node)."""
    pairs = [(a, b) for a, ka in graph.kinds.items() for b, kb in template.kinds.items() if fits(kb, ka)]
    near = {p: set() for p in pairs}
    for p, q in combinations(pairs, 2):
        if p[0] != q[0] and p[1] != q[1] and (q[0] in graph.near[p[0]]) == (q[1] in template.near[p[1]]):
            near[p].add(q)
            near[q].add(p)
    return maximum_cliques(near)


# --- the searches over tables -----------------------------------------------------------------------------------


def gathered(nodes: DataFrame, edges: DataFrame, attributes: list[str], keys: list[str]) -> DataFrame:
    """keys, nodes (array of node and attributes), edges (array of u, v): each molecule as one row, so that a worker takes many at a time.

    Molecules are small, systems are not.
    """
    prepare(nodes.sparkSession)
    left = nodes.groupBy(*keys).agg(F.collect_list(F.struct("node", *attributes)).alias("nodes"))
    right = edges.groupBy(*keys).agg(F.collect_list(F.struct("u", "v")).alias("edges"))
    return left.join(right, keys, "left")


def each(rows: DataFrame, run: Callable[[dict], Iterable[tuple]], schema: str, keys: list[str]) -> DataFrame:
    """keys and the rows that run(row) gives for every row of `gathered`; values keep their type beside nulls."""
    names = [c.strip().split()[0] for c in schema.split(", ")]
    own = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    target = to_arrow_schema(StructType.fromDDL(f"{own}, {schema}"))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*(row[c] for c in keys), *made) for row in batch.to_pylist() for made in run(row | {"edges": row["edges"] or []})]
            cols = list(zip(*out)) if out else [()] * (len(keys) + len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, target)], schema=target)

    return rows.mapInArrow(over, f"{own}, {schema}")


def by_molecule(nodes: DataFrame, edges: DataFrame, run: Callable[[Graph], Iterable[tuple]], schema: str, kind: str | None = None, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """keys and the rows that run(graph) gives for each molecule: nodes (keys, node, kind), edges (keys, u, v, either way)."""
    k = list(keys)
    rows = gathered(nodes.select(*k, "node", (F.col(kind) if kind else F.lit("")).alias("kind")), edges, ["kind"], k)

    def one(row: dict) -> Iterable[tuple]:
        return run(Graph({n["node"]: n["kind"] for n in row["nodes"]}, [(e["u"], e["v"]) for e in row["edges"]]))

    return each(rows, one, schema, k)


def pattern_matches(nodes: DataFrame, edges: DataFrame, pattern: Graph, kind: str | None = None, symmetric: bool = True, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """keys, match: the nodes under the pattern's nodes in their order; one match of each symmetry class, or all."""
    ascending, order = bounds(pattern)[0] if symmetric else [], sorted(pattern.near)
    return by_molecule(nodes, edges, lambda g: [([m[p] for p in order],) for m in matches(g, pattern, ascending)], "match array<bigint>", kind, keys)


def common_subgraphs(nodes: DataFrame, edges: DataFrame, template: Graph, kind: str | None = None, connected_parts: bool = False, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """keys, rank, node, template_node of every largest common subgraph: cliques of the modular product, or parts of the template by symmetry class."""
    def run(graph: Graph) -> Iterator[tuple]:
        found = [[(n, p) for p, n in m.items()] for m in largest_common(graph, template)] if connected_parts else common_pairs(graph, template)
        return ((i, n, str(p)) for i, c in enumerate(found) for n, p in c)

    return by_molecule(nodes, edges, run, "rank int, node bigint, template_node string", kind, keys)


def candidates(nodes: DataFrame, edges: DataFrame, pattern: Graph, kind: str, keys: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """keys, node, pattern_node: nodes of a pattern node's kind with enough neighbours of each kind (edges both ways), as a plan."""
    k = list(keys)
    around = edges.join(nodes.select(*k, F.col("node").alias("v"), F.col(kind).alias("__k")), [*k, "v"]).groupBy(*k, F.col("u").alias("node"), "__k").agg(F.count(F.lit(1)).alias("__n"))
    seen = around.groupBy(*k, "node").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__n"))).alias("__around"))
    held = nodes.select(*k, "node", F.col(kind).alias("__kind")).join(seen, [*k, "node"], "left")
    fits = []
    for p in sorted(pattern.near):
        ok = F.col("__kind") == F.lit(pattern.kinds[p])
        for want, n in sorted(Counter(pattern.kinds[m] for m in pattern.near[p]).items()):
            ok = ok & (F.coalesce(F.try_element_at("__around", F.lit(want)), F.lit(0)) >= n)
        fits.append(F.when(ok, F.lit(str(p))))
    return held.select(*k, "node", F.explode(F.array_compact(F.array(*fits))).alias("pattern_node"))
