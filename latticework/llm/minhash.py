"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a
document's set holds its distinct five-word shingles (64-bit hashes). A
sketch has 128 coordinates. In round i < 128 every shingle is hashed into one
random coordinate; in round 128 + j every shingle goes to coordinate j; a
coordinate keeps the smallest (round, value) that it gets, and the rounds end
once all are filled. Each coordinate of two sketches agrees with probability
equal to the Jaccard similarity, with concentration.

32 bands of 4 coordinates propose pairs. Documents with the same set are one
class, so copies cost one row. A bucket first proposes a star (its smallest
id with all other members), confirmed on full sets. Buckets whose members then
hang in several components propose further stars, each with a random centre of
its own and only across components, so that a dense group comes together
without its pairs being listed. What still stands apart is compared pair by
pair across components, where sketches of 1024 coordinates agree in 706 (at
similarity 0.75 some 768 are expected, so 4.5 deviations more); this happens
block by block inside a task, so only pairs that agree become rows. In a bucket
of more than a block the members of the largest component meet those outside
it only, so a crowd that has come together is sent once a block of outsiders.
A pair of similarity 0.75 meets in no band with probability 5e-6, a likelier
one with less.

Defined cases: null or blank text has the empty set and links with nothing;
fewer than five words are one shingle; repeated doc_ids are one node; a null
doc_id is not linked and its component is null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.components import components
from latticework.llm.flat import mix, places, slices, within
from latticework.llm.runtime import Store, map_frames, prepare, release

WORDS, PERCENT = 5, 75
COORDS, BANDS = 128, 32
ROWS = COORDS // BANDS
#: Further rounds of stars with random centres.
STARS = 1
#: Coordinates of the wide sketch, and how many must agree before a pair across components is confirmed on full sets.
WIDE, AGREE = 1024, 706
#: Members of a bucket that are compared in one block.
TILE = 1024
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 2**63, size=256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, size=WORDS, dtype=np.uint64) | np.uint64(1)
_SALT = mix(np.arange(2 * WIDE, dtype=np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, one text after another, and each text's number of them."""
    raw = [t.encode("utf-8", "replace") + b" " for t in texts]
    data = _LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    doc_end = np.cumsum([len(r) for r in raw])
    word = ~_SEP[data]
    edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    at = np.flatnonzero(word)
    lens = ends - starts
    place = within(lens)
    words = mix(np.add.reduceat(_BYTE[data[at]] * places(place), np.cumsum(lens) - lens) ^ (lens.astype(np.uint64) << np.uint64(40)))
    per_doc = np.diff(np.concatenate([[0], np.searchsorted(starts, doc_end)]))
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(WORDS):
        rolled[: max(0, n - j)] += words[j:] * _STEP[j]
    first = np.cumsum(per_doc) - per_doc
    held = np.maximum(per_doc - WORDS + 1, 0)
    index = np.repeat(first, held) + within(held)
    doc = np.repeat(np.arange(len(texts)), held)
    values = mix(rolled[index])
    for i in np.flatnonzero((per_doc > 0) & (per_doc < WORDS)).tolist():
        own = words[first[i] : first[i] + per_doc[i]]
        one = mix(np.array([int((own * _STEP[: len(own)]).sum(dtype=np.uint64)) ^ (0x5851F42D4C957F2D * len(own) % 2**64)], dtype=np.uint64))
        values, doc = np.concatenate([values, one]), np.concatenate([doc, [i]])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def sketches(values: np.ndarray, counts: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """[texts, coords] of the sets; a row of an empty set has no meaning."""
    n = len(counts)
    none = np.uint64(2**64 - 1)
    out = np.full(n * coords, none, dtype=np.uint64)
    doc = np.repeat(np.arange(n), counts)
    live = values
    for r in range(2 * coords):
        h = mix(live ^ _SALT[r])
        bin_ = (h & np.uint64(coords - 1)).astype(np.int64) if r < coords else np.full(len(h), r - coords)
        np.minimum.at(out, doc * coords + bin_, (np.uint64(r) << np.uint64(52)) | (h >> np.uint64(12)))
        if r % 4 == 1 or r < 4:
            keep = (out.reshape(n, coords) == none).any(axis=1)[doc]
            live, doc = live[keep], doc[keep]
        if not len(live):
            break
    return mix(out).reshape(n, coords)


def _digest_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums of its mixed members."""
    a, b = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        start = (np.cumsum(counts) - counts)[full]
        a[full] = np.add.reduceat(mix(values), start)
        b[full] = np.add.reduceat(mix(values ^ np.uint64(0xD6E8FEB86659FD93)), start)
    return mix(a + counts.astype(np.uint64)), mix(b ^ counts.astype(np.uint64))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (hash of the set), bands."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [t if t is not None else "" for t in pdf["text"]]
            for lo, hi in slices(whole):
                values, counts = shingle_sets(whole[lo:hi])
                s1, s2 = _digest_sets(values, counts)
                k = sketches(values, counts)
                bands = np.zeros((len(counts), BANDS), dtype=np.uint64)
                for j in range(ROWS):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + k[:, j::ROWS])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[lo:hi].array, "n_shingles": counts, "s1": s1.view(np.int64), "s2": s2.view(np.int64),
                    "bands": list(bands.view(np.int64)),
                })
        release()

    return map_frames(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes as bytes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [t if t is not None else "" for t in pdf["text"]]
            for lo, hi in slices(whole):
                values, counts = shingle_sets(whole[lo:hi])
                ends = np.cumsum(counts).tolist()
                raw = values.tobytes()
                yield pd.DataFrame({"node": pdf["doc_id"].iloc[lo:hi].array, "members": [raw[8 * a : 8 * b] for a, b in zip([0, *ends[:-1]], ends)]})

    return map_frames(docs.select("doc_id", "text"), run, "node bigint, members binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"]):
                u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield pdf.loc[keep, ["a", "b"]]

    held = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    held = held.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    return map_frames(held.select("a", "b", "x", "y"), run, "a bigint, b bigint", 256)


def _wide_sketches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["members"]]
        if sets:
            k = sketches(np.concatenate(sets), np.array([len(x) for x in sets]), WIDE)
            yield pd.DataFrame({"node": pdf["node"], "wide": [x.tobytes() for x in (k & np.uint64(255)).astype(np.uint8)]})


def _across(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a block whose wide sketches agree enough: different components, fitting sizes, first common bucket."""
    keys, held = ["bucket", "ti", "tj"], None
    for pdf in batches:
        both = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(both):
            continue
        k = both[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        blocks = np.split(np.arange(len(both)), cuts)
        for at in blocks[:-1]:
            yield _block_pairs(both.iloc[at])
        held = both.iloc[blocks[-1]].reset_index(drop=True)
    if held is not None:
        yield _block_pairs(held)


def _block_pairs(block: pd.DataFrame) -> pd.DataFrame:
    bucket, i, j = (int(block[c].iloc[0]) for c in ("bucket", "ti", "tj"))
    node, n, comp, tile = (block[c].to_numpy() for c in ("node", "n", "component", "tile"))
    wide = np.frombuffer(b"".join(block["wide"]), dtype=np.uint8).reshape(-1, WIDE)
    bands = np.stack(block["bands"].to_list())
    right = np.flatnonzero(tile == j)
    out_a, out_b = [], []
    for u in np.flatnonzero(tile == i):
        v = right[right > u] if i == j else right
        v = v[(comp[v] != comp[u]) & (np.minimum(n[v], n[u]) * 100 >= np.maximum(n[v], n[u]) * PERCENT)]
        if len(v):
            v = v[(wide[v] == wide[u]).sum(axis=1) >= AGREE]
        if len(v):
            common = bands[v] == bands[u]
            v = v[bands[v][np.arange(len(v)), common.argmax(axis=1)] == bucket]
            out_a.append(np.minimum(node[v], node[u]))
            out_b.append(np.maximum(node[v], node[u]))
    none = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


def _could(n: str, m: str):
    """Sizes that a similar pair can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with their tile and each other tile they meet. In a crowded bucket the members of its largest component meet only the rest, never one another."""
    main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    others = F.coalesce("others", F.lit(1))
    hashed = F.xxhash64("node")
    tile = F.when(main, others + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, others))
    last = F.when(main, others).otherwise(others + F.coalesce("mains", F.lit(0))) - 1
    return rows.withColumn("tile", tile.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = prepare(docs.sparkSession)
    store = Store(spark)
    sketch = store.put("sketch", sketch_documents(docs))
    classes = store.put("classes", sketch.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    band = classes.select("node", "n", F.explode("bands").alias("bucket"))
    ends = band.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lo"), F.max("node").alias("hi")).where(F.col("lo.node") < F.col("hi"))
    member = store.put("members", band.join(store.put("ends", ends.drop("hi")), "bucket"))
    store.drop("ends")
    first = member.where((F.col("node") != F.col("lo.node")) & _could("n", "lo.n")).select(F.col("lo.node").alias("a"), F.col("node").alias("b")).distinct()
    first = store.put("pairs0", first)
    rows = docs.select("doc_id", "text").join(member.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = store.put("sets", full_sets(rows).dropDuplicates(["node"]))
    links = store.put("links0", _verified(first, sets))
    now = store.put("now0", components(links, store))
    asked = first

    def split(i: int) -> DataFrame:
        """Members of the buckets that still hold several components."""
        tagged = store.put(f"tagged{i}", member.select("bucket", "node", "n").join(now, "node", "left").withColumn("component", F.coalesce("component", "node")))
        several = tagged.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("k")).where("x < y and k > 2")
        return tagged.join(several.select("bucket"), "bucket")

    for i in range(1, STARS + 1):
        held = store.put(f"split{i}", split(i))
        centre = held.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "component"), F.xxhash64(F.lit(i), "bucket", "node")).alias("c"))
        star = held.join(store.put(f"centre{i}", centre), "bucket").where((F.col("component") != F.col("c.component")) & _could("n", "c.n"))
        pairs = star.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        pairs = store.put(f"pairs{i}", pairs)
        links = links.union(store.put(f"links{i}", _verified(pairs, sets)))
        now = store.put(f"now{i}", components(links, store))
        asked = asked.union(pairs)
        for name in ("tagged", "split", "centre"):
            store.drop(f"{name}{i}")

    rest = store.put("rest", split(STARS + 1))
    wide = map_frames(sets.join(rest.select("node").distinct(), "node"), _wide_sketches, "node bigint, wide binary", 256)
    wide = store.put("wide", wide.join(classes.select("node", "bands"), "node"))
    held = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("k"))
    crowded = held.where(F.col("k") > TILE).select(
        "bucket", F.col("main.component").alias("main"), F.ceil(F.col("main.k") / TILE).cast("int").alias("mains"), F.ceil((F.col("k") - F.col("main.k")) / TILE).cast("int").alias("others"))
    dealt = _dealt(rest.join(wide, "node").join(store.put("crowded", crowded), "bucket", "left"))
    dealt = dealt.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")}).select("bucket", "ti", "tj", "tile", "node", "n", "component", "wide", "bands")
    keys = ["bucket", "ti", "tj"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    across = map_frames(dealt, _across, "a bigint, b bigint")
    second = across.distinct().join(asked, ["a", "b"], "left_anti")
    second = store.put("second", second)
    more = store.put("more", _verified(second, sets))
    final = components(links.union(more), store) if not more.isEmpty() else now
    named = store.put("named", classes.select("s1", "s2", "node").join(final, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id")))
    done = [f"{n}{i}" for n in ("pairs", "links", "now") for i in range(STARS + 1)]
    for name in ("classes", "members", "sets", "second", "more", "rest", "wide", "crowded", f"tagged{STARS + 1}", "cc0", *done):
        store.drop(name)
    out = sketch.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: Distinct sets, pairs that share a shingle, classes by a closure.
SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM word
), sized AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM shingles),
class AS (SELECT k, min(doc_id) AS node, any_value(n) AS n, any_value(s) AS s FROM sized WHERE n > 0 GROUP BY k),
flat AS (SELECT node, n, unnest(s) AS x FROM class),
pair AS (
  SELECT a.node AS a, b.node AS b FROM flat a JOIN flat b ON a.x = b.x AND a.node <> b.node
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT node, node AS root FROM class
  UNION
  SELECT pair.b, reach.root FROM reach JOIN pair ON pair.a = reach.node WHERE reach.root < pair.b
), component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, sized.n::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM sized LEFT JOIN class ON class.k = sized.k AND sized.n > 0 LEFT JOIN component ON component.node = class.node
"""
