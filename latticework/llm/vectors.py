"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors at cosine >= t have squared distance <= 2 - 2t. After a fixed
rotation a vector is cut into blocks of eight dimensions; by the pigeonhole
principle a linked pair has, in some block, at most its proportional share of
that budget. Each block is range-joined on its own: every dimension is cut into
equal shares of a bounded sample, two sides up to a million vectors of a label
and more beyond (`sides`), a vector stands in one cell and also visits the
later cells that its range reaches. All vectors
met in a cell are checked exactly in double precision, and a pair counts only
in the first block that holds its share, so it counts once.

Links are counted and joined to stars where they are found; pairs are never
written out. Equal vectors of a label are one class first. Cells of more than
`TILE` rows are cut into tiles and joined tile by tile.

Defined cases: a null or zero vector, one with null or non-finite components,
an empty one, and any vector with a null label link with nothing; vectors of
different length are not compared; repeated vec_ids are one node and each row
counts as a vector; a null vec_id is its own null component; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.components import components, stars
from latticework.llm.runtime import Store, map_frames, prepare

BLOCK, TILE = 8, 4096
#: Vectors of the sample that fits the cuts.
SAMPLE = 5000
#: Cells over TILE rows that may be broadcast (about 40 bytes each).
MOST_HOT = 100_000


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def _blocks(dim: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


def sides(rows: int) -> int:
    """Sides a dimension is cut into: two, and more once a label's vectors would fill more than TILE rows of every cell."""
    s = 2
    while TILE * s**BLOCK < rows:
        s += 1
    return s


def _unit(raw: Iterable[bytes], kind: str) -> np.ndarray:
    v = np.stack([np.frombuffer(x, dtype=kind) for x in raw]).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # very small or large components
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cells(unit: np.ndarray, cuts: np.ndarray, budget: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, row, cell, visits) of every cell that a vector stands in or visits."""
    dim, count = unit.shape[1], cuts.shape[1] + 1
    r = unit @ rotation(dim)
    end = np.full((dim, 1), np.inf)
    low, high = np.hstack([-end, cuts]), np.hstack([cuts, end])
    for b, (lo, hi) in enumerate(_blocks(dim)):
        share = budget * (hi - lo) / dim * (1 + 1e-9) + 1e-15
        own = np.zeros(len(r), dtype=np.int64)
        rows, cell, used = np.arange(len(r)), own, np.zeros(len(r))
        for d in range(lo, hi):  # a cell is reached while the gaps to its sides fit in the share
            x = r[:, d, None]
            own = own * count + (x > cuts[d]).sum(axis=1)
            spent = used[:, None] + (np.maximum(np.maximum(low[d] - x, x - high[d]), 0) ** 2)[rows]
            at, side = np.nonzero(spent <= share)
            rows, cell, used = rows[at], cell[at] * count + side, spent[at, side]
        keep = cell >= own[rows]
        yield b, rows[keep], cell[keep], cell[keep] > own[rows][keep]


def _first_block(d: np.ndarray, budget: float) -> np.ndarray:
    """The first block whose squared distance is within its share."""
    dim = d.shape[1]
    fits = np.stack([(d[:, lo:hi] ** 2).sum(axis=1) <= budget * (hi - lo) / dim * (1 + 1e-9) + 1e-15 for lo, hi in _blocks(dim)], axis=1)
    return fits.argmax(axis=1)


def _group(pdf: pd.DataFrame, kind: str, threshold: float, budget: float) -> pd.DataFrame | None:
    """Links among the rows of one tile pair of a cell: counts and stars."""
    unit = _unit(pdf["vec"], kind)
    turned = unit @ rotation(unit.shape[1])
    visits, tile, size, node = (pdf[c].to_numpy() for c in ("visits", "tile", "size", "node"))
    b, i, j = (int(pdf[c].iloc[0]) for c in ("block", "ti", "tj"))
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    count = np.zeros(len(pdf), dtype=np.int64)
    ea, eb = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step = max(1, 2_000_000 // max(1, len(right)))
    for s in range(0, len(left), step):
        part = left[s : s + step]
        x, y = np.nonzero(unit[part] @ unit[right].T >= threshold)
        x, y = part[x], right[y]
        keep = ~(visits[x] & visits[y]) & (node[x] != node[y])
        if i == j:
            keep &= x < y
        x, y = x[keep], y[keep]
        for k in range(0, len(x), 100_000):
            u, v = x[k : k + 100_000], y[k : k + 100_000]
            here = _first_block(turned[u] - turned[v], budget) == b
            u, v = u[here], v[here]
            count += np.bincount(u, weights=size[v], minlength=len(pdf)).astype(np.int64) + np.bincount(v, weights=size[u], minlength=len(pdf)).astype(np.int64)
            a, c = stars(np.concatenate([ea[0], node[u]]), np.concatenate([eb[0], node[v]])) if len(u) else (ea[0], eb[0])
            ea, eb = [a], [c]
    seen = count > 0
    if not seen.any():
        return None
    return pd.DataFrame({"a": np.concatenate([node[seen], ea[0]]), "b": np.concatenate([np.full(seen.sum(), -1), eb[0]]), "links": np.concatenate([count[seen], np.full(len(ea[0]), -1)])})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vec_id, embedding, label."""
    spark = prepare(vectors.sparkSession)
    store = Store(spark)
    budget = 2 - 2 * threshold
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    e = F.col("embedding")
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(
        (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = store.put("classes", rows.where("good").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")))

    fit: dict[int, np.ndarray] = {}
    n, most = classes.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    cut_at = np.arange(1, sides(most or 0)) / sides(most or 0)
    sample = classes.where(F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(1, n or 0)) * 1_000_000)).select("embedding").limit(2 * SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]), []).append(np.array(r[0], dtype=kind).tobytes())
    for d, raw in by_dim.items():
        fit[d] = np.quantile(_unit(raw, kind) @ rotation(d), cut_at, axis=0).T

    def place(batches: Iterable[pd.DataFrame], with_vector: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            dims = pdf["embedding"].map(len)
            for d, part in pdf.groupby(dims):
                raw = np.array([np.asarray(x, dtype=kind).tobytes() for x in part["embedding"]], dtype=object)
                label, node, size = (part[c].to_numpy() for c in ("label", "node", "size"))
                for b, row, cell, visits in cells(_unit(raw, kind), fit.get(d, np.zeros((d, 1))), budget):
                    out = {"label": label[row], "dim": d, "block": b, "cell": cell}
                    yield pd.DataFrame(out | {"visits": visits, "node": node[row], "size": size[row], "vec": raw[row]} if with_vector else out)

    label_type = vectors.schema["label"].dataType.simpleString()
    key = f"label {label_type}, dim int, block int, cell bigint"
    crowded = map_frames(classes.select("label", "node", "size", "embedding"), lambda it: place(it, False), key, 500).groupBy("label", "dim", "block", "cell").count().where(F.col("count") > TILE)
    hot = store.put("hot", crowded.select("label", "dim", "block", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    placed = map_frames(classes.select("label", "node", "size", "embedding"), lambda it: place(it, True), f"{key}, visits boolean, node bigint, size bigint, vec binary", 500)
    small = hot.count() <= MOST_HOT
    placed = placed.join(F.broadcast(hot) if small else hot, ["label", "dim", "block", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["label", "dim", "block", "cell", "ti", "tj"]
    dealt = placed.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")}).select(*keys, "tile", "visits", "node", "size", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def meet(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            out = _group(frame, kind, threshold, budget) if len(frame) > 1 else None
            if out is not None:
                yield out

        for pdf in batches:
            if not len(pdf):
                continue
            k = pdf[keys]
            change = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(axis=1)) + 1
            parts_ = np.split(np.arange(len(pdf)), change)
            for at in parts_:
                part = pdf.iloc[at]
                if held and (held[0][keys].iloc[0] != part[keys].iloc[0]).any():
                    yield from flush(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    found = store.put("found", map_frames(dealt, meet, "a bigint, b bigint, links bigint", 5000))
    linked = found.where("links >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("links < 0").select("a", "b"), store)
    named = store.put("named", classes.select("label", "h1", "h2", "node", "size").join(linked, "node", "left").join(comp, "node", "left").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    for name in ("hot", "found", "classes", "cc0"):
        store.drop(name)
    label = F.when(F.col("good"), F.col("label"))
    out = rows.select("vec_id", label.alias("label"), "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: Every pair of a label by cosine, classes by a closure.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: coalesce(x, 'nan')::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0)
  WHERE len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98::DOUBLE * a.n * b.n
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM good
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node WHERE reach.root < link.b
), component AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component ON node = vec_id LEFT JOIN degree ON degree.a = vec_id
"""
