"""Removal of bytes under repeated 200-byte strings, by prefix-free parsing.

The parsing works on two levels, both by rolling hashes that trigger phrases.

*Over the cluster.* The trigger of a 200-byte string is the leftmost of its
32-byte strings with the smallest hash, and neighbouring strings with the same
trigger form one stretch. Equal strings have equal triggers, so a string can
only repeat among stretches of one trigger, which deals the work. Each distinct
stretch is held once, with its number of places: one with two places or more is
repeated as a whole, wherever it stands, and one that is its trigger's only one
is not looked at again.

*Inside a task* (`corpus_order`). Where a trigger has several distinct
stretches, these are parsed into phrases that begin and end with triggers of
`INNER` bytes. The suffixes of the distinct phrases (the dictionary) are sorted
by prefix doubling, as are the suffixes of the sequence of phrases (the parse).
No dictionary suffix longer than a trigger begins another, so a place of the
text is ordered by its dictionary suffix first and by the parse suffix that
follows next: both ranks combine into the order of all suffixes of the text.
Neighbours in that order that agree over 200 bytes are repeated strings.

Triggers with more than `FORKS` distinct stretches are not sorted in one task:
their strings are spread over the cluster by their hash and counted there.
Texts are known by 128 bits, strings by the hash of their trigger and their own.

Defined cases: null text is the empty text; texts under 200 bytes lose
nothing; repeated rows are each other's copies; null doc_ids are kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.flat import gather, mix, same_words, within
from latticework.llm.runtime import Store, map_frames, prepare

LENGTH, TRIGGER = 200, 32
#: Distinct stretches of one trigger that a task sorts together.
FORKS = 4096
#: Bytes of a trigger inside a task, and the share of places that are one.
INNER, INNER_SHARE = 8, 24
#: Symbols of nine bits in the first sort key of a suffix.
PACKED = 7
#: Bytes of one array; a longer text is cut into parts that overlap by 199 bytes.
PART = 4_000_000
_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 2**63, size=256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_POS = np.uint64((1 << 24) - 1)


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        back = pow(_BASE, -1, 2**64)
        while len(cls.up) <= n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 2**64))])
            cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(back, k, 2**64))])
        return cls.up, cls.down


class Rolling:
    """Polynomial hashes of any span of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.upto(len(data))
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.prefix[1:])

    def every(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of this width."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=x.dtype)
    rows = -(-len(x) // width)
    pad = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    pad[: len(x)] = x
    block = pad.reshape(rows, width)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def parse(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Stretches of byte strings: (part, start, strings in it, trigger hash, hash of the stretch)."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    end = np.cumsum([len(p) for p in parts])
    begin = end - [len(p) for p in parts]
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(data) < LENGTH:
        return empty
    roll = Rolling(data)
    trigger = roll.every(TRIGGER)
    key = (trigger & ~_POS) | np.arange(len(trigger), dtype=np.uint64)
    chosen = (_sliding_min(key, LENGTH - TRIGGER + 1) & _POS).astype(np.int64)
    live = np.zeros(len(chosen) + 1, dtype=np.int64)
    many = np.flatnonzero(end - begin >= LENGTH)
    if not len(many):
        return empty
    np.add.at(live, begin[many], 1)
    np.add.at(live, end[many] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(live[:-1]) > 0)
    c = chosen[at]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    start, anchor = at[first], c[first]
    n = np.diff(np.concatenate([first, [len(at)]]))
    part = np.searchsorted(end, start, side="right")
    whole = roll.spans(start, start + n + LENGTH - 1) ^ mix((n.astype(np.uint64) << np.uint64(32)) ^ (anchor - start).astype(np.uint64))
    return part, start - begin[part], n, mix(trigger[anchor] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64), whole.view(np.int64)


def _parts(texts: Iterable[str | None]) -> Iterator[tuple[int, int, bytes]]:
    """(row, offset, bytes): whole texts, long ones in overlapping parts."""
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        for s in range(0, max(1, len(raw) - LENGTH + 1), PART):
            yield i, s, raw[s : s + PART + LENGTH - 1] if len(raw) > PART else raw


def _together(parts: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for p in parts:
        if held and size + len(p[2]) > PART:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p[2])
    if held:
        yield held


def stretches(keyed: DataFrame) -> DataFrame:
    """keyed: k, k2, text. Returns k, k2, start, n, trigger, phrase (the hash of the stretch)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k, k2 = pdf["k"].to_numpy(), pdf["k2"].to_numpy()
            for held in _together(_parts(pdf["text"])):
                part, start, n, trigger, phrase = parse([x for _, _, x in held])
                if len(part):
                    row, offset = np.array([i for i, _, _ in held]), np.array([s for _, s, _ in held])
                    yield pd.DataFrame({"k": k[row[part]], "k2": k2[row[part]], "start": start + offset[part], "n": n, "trigger": trigger, "phrase": phrase})

    return map_frames(keyed, run, "k bigint, k2 bigint, start int, n int, trigger bigint, phrase bigint", 1000)


def _doubled(rank: np.ndarray, width: int, left: np.ndarray) -> np.ndarray:
    """Ranks of suffixes by all their symbols, from ranks by the first `width`; left: symbols from each place to its end."""
    longest = int(left.max()) if len(left) else 0
    classes = int(rank.max()) + 1 if len(rank) else 0
    at = np.arange(len(rank))
    while width < longest and classes < len(rank):
        after = np.where(left > width, rank[np.minimum(at + width, len(rank) - 1)] + 1, 0)
        _, rank = np.unique((rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64), return_inverse=True)
        width *= 2
        if int(rank.max()) + 1 == classes:
            break
        classes = int(rank.max()) + 1
    return rank


def inner_phrases(roll: Rolling, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the phrases of texts that stand one after another: each starts with a trigger or the text, and ends with the next trigger or the text."""
    hit = np.flatnonzero(roll.every(INNER) % np.uint64(INNER_SHARE) == 0)
    text = np.searchsorted(end, hit, side="right")
    inside = (hit > begin[text]) & (hit + INNER <= end[text])
    hit, text = hit[inside], text[inside]
    starts = np.concatenate([begin, hit])
    owner = np.concatenate([np.arange(len(begin)), text])
    order = np.argsort(starts, kind="stable")
    starts, owner = starts[order], owner[order]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    stops = np.where(last, end[owner], np.concatenate([starts[1:], [0]]) + INNER)
    return owner, starts, stops


def corpus_order(data: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of the given places of texts (one after another in data) by their suffixes, from the dictionary's and the parse's suffix ranks."""
    roll = Rolling(data)
    owner, starts, stops = inner_phrases(roll, begin, end)
    n = stops - starts
    final = np.concatenate([owner[1:] != owner[:-1], [True]])
    # the dictionary: distinct phrases; a text's last one is a phrase of its own kind, as no trigger ends it
    name = roll.spans(starts, stops) ^ mix(n.astype(np.uint64) * np.uint64(2) + final.astype(np.uint64))
    _, first, phrase = np.unique(name, return_index=True, return_inverse=True)
    alike = np.flatnonzero((n == n[first[phrase]]) & (final == final[first[phrase]]))
    odd = np.ones(len(n), dtype=bool)
    odd[alike[same_words(data, starts[alike], data, starts[first[phrase[alike]]], n[alike])]] = False
    if odd.any():  # phrases that only share a hash
        phrase[odd] = len(first) + np.arange(int(odd.sum()))
        first = np.concatenate([first, np.flatnonzero(odd)])
    size = n[first] + final[first]  # with the mark that ends a text
    held = np.zeros(int(size.sum()), dtype=np.int64)
    dict_from = np.cumsum(size) - size
    held[np.repeat(dict_from, n[first]) + within(n[first])] = gather(starts[first], n[first], data).astype(np.int64) + 2
    held[(dict_from + size - 1)[final[first]]] = 1
    left = np.repeat(size, size) - within(size)
    key = np.zeros(len(held), dtype=np.uint64)
    for i in range(PACKED):
        key = (key << np.uint64(9)) | np.where(left > i, held[np.minimum(np.arange(len(held)) + i, len(held) - 1)], 0).astype(np.uint64)
    rank = _doubled(np.unique(key, return_inverse=True)[1], PACKED, left)
    # the parse: each text's sequence of phrases, by their ranks
    run = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), [len(owner)]]))
    behind = np.repeat(run, run) - within(run)
    parse_rank = _doubled(np.unique(rank[dict_from[phrase]], return_inverse=True)[1], 1, behind)
    at = np.searchsorted(starts, places, side="right") - 1
    follows = np.where(final[at], 0, parse_rank[np.minimum(at + 1, len(parse_rank) - 1)] + 1)
    by = (rank[dict_from[phrase[at]] + places - starts[at]].astype(np.uint64) << np.uint64(32)) | follows.astype(np.uint64)
    return np.argsort(by, kind="stable")


def _strings(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place) of every 200-byte string of some stretches, each one's number of them, all bytes and their ends."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    end = np.cumsum(lens)
    count = lens - LENGTH + 1
    place = np.repeat(end - lens, count) + within(count)
    return Rolling(data).every(LENGTH)[place], place, count, data, end


def _agreeing(forks: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated strings in stretches that stand in one place, for all stretches of some triggers."""
    h, place, count, data, end = _strings(forks["bytes"])
    owner = np.repeat(np.arange(len(forks)), count)
    order = corpus_order(data, end - forks["bytes"].map(len).to_numpy(), end, place)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    cls = np.cumsum(new) - 1
    weight = np.bincount(cls, weights=np.minimum(forks["places"].to_numpy()[owner[order]], 2))
    hit = np.zeros(len(h), dtype=bool)
    hit[order] = weight[cls] >= 2
    hit &= forks["places"].to_numpy()[owner] == 1
    at = np.flatnonzero(hit)
    if not len(at):
        return pd.DataFrame({"k": [], "k2": [], "start": [], "stop": []}).astype("int64")
    inner = within(count)
    head = np.concatenate([[True], (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1])])
    a = at[head]
    b = at[np.concatenate([head[1:], [True]])]
    base = forks["start"].to_numpy()[owner[a]]
    return pd.DataFrame({"k": forks["k"].to_numpy()[owner[a]], "k2": forks["k2"].to_numpy()[owner[a]], "start": base + inner[a], "stop": base + inner[b] + LENGTH})


def _removed(raw: bytes, starts, stops) -> tuple[int, int, str]:
    """(bytes removed, runs, sha of the rest)."""
    if not len(starts):
        return 0, 0, hashlib.sha256(raw).hexdigest()
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(stops)[order])
    head = np.concatenate([[True], s[1:] > e[:-1]])
    s, e = s[head], e[np.concatenate([head[1:], [True]])]
    rest, at = [], 0
    for a, b in zip(s.tolist(), e.tolist()):
        rest.append(raw[at:a])
        at = b
    rest.append(raw[at:])
    return int((e - s).sum()), len(s), hashlib.sha256(b"".join(rest)).hexdigest()


def marks(keyed: DataFrame, store: Store) -> DataFrame:
    """keyed: k, k2, text. k, k2 and the array of (start, stop) byte runs that are repeated."""
    spark = prepare(keyed.sparkSession)
    key = ["k", "k2"]
    every = store.put("phrases", stretches(keyed))
    often = store.put("often", every.groupBy("trigger").count().where("count > 1").select("trigger"))
    shared = store.put("shared", every.join(often, "trigger"))
    store.drop("phrases")
    dictionary = store.put("dictionary", shared.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct(*key, "start", "n")).alias("at")))
    forked = store.put("forked", dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("forks")).where("forks > 1"))
    copies = store.put("copies", dictionary.where("places > 1").select("trigger", "phrase"))
    whole = store.put("whole", shared.join(copies, ["trigger", "phrase"]).select(*key, "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("stop")))
    for name in ("often", "shared", "copies"):
        store.drop(name)
    asked = dictionary.join(forked, "trigger").select("at.k", "at.k2", F.struct("at.start", "at.n", "trigger", "places", "forks").alias("p")).groupBy(*key).agg(F.collect_list("p").alias("ps"))
    asked = store.put("asked", asked)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, k2, text, ps in zip(pdf["k"], pdf["k2"], pdf["text"], pdf["ps"]):
                raw = (text or "").encode("utf-8", "replace")
                rows += [(p["trigger"], p["forks"], k, k2, p["start"], p["places"], raw[p["start"] : p["start"] + p["n"] + LENGTH - 1]) for p in ps]
            yield pd.DataFrame(rows, columns=["trigger", "forks", *key, "start", "places", "bytes"])

    pieces = map_frames(keyed.join(asked, key), cut, "trigger bigint, forks bigint, k bigint, k2 bigint, start int, places bigint, bytes binary", 200)
    pieces = store.put("pieces", pieces.dropDuplicates(["trigger", *key, "start"]))
    store.drop("asked")

    def sort(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the trigger that the next batch may go on with
        for pdf in batches:
            if not len(pdf):
                continue
            both = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            going = (both["trigger"] == both["trigger"].iloc[-1]).to_numpy()
            if not going.all():
                yield _agreeing(both[~going].reset_index(drop=True))
            held = [both[going]]
        if held:
            yield _agreeing(held[0].reset_index(drop=True))

    def explode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                h, _, count, _, _ = _strings(pdf["bytes"])
                held = {c: pdf[c].to_numpy().repeat(count) for c in ("trigger", *key, "start", "places")}
                yield pd.DataFrame(held | {"h": h.view(np.int64), "start": held["start"] + within(count)})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = pieces.where(F.col("forks") <= FORKS).repartition(parts, "trigger").sortWithinPartitions("trigger")
    few = map_frames(few, sort, "k bigint, k2 bigint, start bigint, stop bigint")
    out = whole.select(*key, F.col("start").cast("bigint"), F.col("stop").cast("bigint")).union(few)
    if not forked.where(F.col("forks") > FORKS).isEmpty():
        strings = map_frames(pieces.where(F.col("forks") > FORKS), explode, "trigger bigint, h bigint, k bigint, k2 bigint, start bigint, places bigint")
        strings = store.put("strings", strings)
        again = store.put("again", strings.groupBy("trigger", "h").agg(F.sum("places").alias("all")).where(F.col("all") > 1).select("trigger", "h"))
        out = out.union(strings.where("places = 1").join(again, ["trigger", "h"]).select(*key, "start", (F.col("start") + LENGTH).alias("stop")))
    merged = store.put("marks", out.groupBy(*key).agg(F.collect_list(F.struct("start", "stop")).alias("runs")))
    for name in ("dictionary", "forked", "whole", "pieces", "strings", "again"):
        store.drop(name)
    return merged


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of doc_id, text."""
    store = Store(docs.sparkSession)
    key = [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2")]
    rows = docs.select("doc_id", "text", *key)
    held = marks(rows.select("k", "k2", "text"), store)

    def finish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, runs in zip(pdf["text"], pdf["runs"]):
                raw = (text or "").encode("utf-8", "replace")
                runs = [] if runs is None else runs
                out.append((len(raw), *_removed(raw, [r["start"] for r in runs], [r["stop"] for r in runs])))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=pdf["doc_id"].array)

    joined = rows.join(held, ["k", "k2"], "left").select("doc_id", "text", "runs")
    return map_frames(joined, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", 500)


#: Every 200-byte string by its 128-bit digest, texts as hex in parts so that a string is found near a part's start.
SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
part AS (SELECT doc_id, f, substring(h, 2 * f + 1, 2 * (1024 + 199)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0), 1024)) AS f FROM doc)),
start AS (SELECT doc_id, f + i AS p, md5_number(substring(g, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, f, g, unnest(range(0, length(g) // 2 - 199)) AS i FROM part)
  WHERE i < 1024),
hit AS (SELECT doc_id, p FROM start WHERE k IN (SELECT k FROM start GROUP BY k HAVING count(*) > 1)),
island AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
run AS (SELECT doc_id, min(p) AS lo, max(p) + 200 AS hi FROM island GROUP BY doc_id, r),
edge AS (SELECT doc_id, lo, hi FROM run UNION ALL SELECT doc_id, n, n FROM doc),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS since FROM edge),
kept AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) - 1 AS spans, string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo, hi) AS g FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, removed::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(g)) AS kept_sha256 FROM kept JOIN doc USING (doc_id)
"""
