"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, P[i] = sum of (c[j] + 1) * B^j for j < i, modulo
two primes. Two prefix values give the hash of any span, so span equality is
answered at once and the longest common extension of two places by binary
search. A fingerprint holds the length, the hash of the whole text, a sketch
(the smallest mixed hashes of its 12-code-point spans: 64, or one for 128 code
points of a longer text) and a ladder (hashes of its first and of its last g
code points for the lengths g of `rungs`, five to a doubling).

The likeness of two fingerprints is the larger of two estimates of the share
of text that they have in common: 2J / (1 + J) of the Jaccard similarity J that
the sketches estimate, and twice the common beginning and end over both
lengths, where binary search over the rungs finds the longest that agree. The
second cannot exceed the true share, and a common beginning is found however
long the texts are.

Equal texts have equal fingerprints, and different texts differ in the whole
hash (62 bits). The fingerprint of an edited text is put together from the
prefix arrays of its parts; only the spans over the joint are hashed anew.

Defined cases: null text is the empty text; texts shorter than a span are one
span; two empty texts are alike (1), an empty and another text are not (0);
repeated doc_ids are ordered by text, a null doc_id comes first; other columns
are ignored; an empty table gives no rows; a single row is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.flat import mix
from latticework.llm.runtime import map_frames, prepare

PRIMES = (2147483647, 2147483629)
BASES = (1299721, 15485867)
#: Code points of a span, least hashes of a sketch, and code points of a text for one more hash.
SPAN, KEPT, SHARE = 12, 64, 128


class _Powers:
    """B^i and B^-i modulo each prime, grown when needed."""

    def __init__(self):
        self.up = [np.ones(1, dtype=np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, dtype=np.uint64) for _ in PRIMES]

    def upto(self, n: int):
        for tables, bases in ((self.up, BASES), (self.down, [pow(b, -1, p) for b, p in zip(BASES, PRIMES)])):
            for k, (p, b) in enumerate(zip(PRIMES, bases)):
                while len(tables[k]) <= n:
                    have = tables[k]
                    tables[k] = np.concatenate([have, have * np.uint64(pow(b, len(have), p)) % np.uint64(p)])
        return self.up, self.down


_powers = _Powers()


class PrefixHashes:
    """Prefix arrays of one array of code points (of one text, or of several one after another)."""

    def __init__(self, code: np.ndarray):
        self.n = len(code)
        self.up, self.down = _powers.upto(self.n)
        self.prefix = []
        c = code.astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(c * self.up[k][: self.n] % np.uint64(p), out=s[1:])
            self.prefix.append(s % np.uint64(p))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The hash of each span modulo each prime, independent of where it stands."""
        out = []
        for k, p in enumerate(PRIMES):
            d = self.prefix[k][ends] + np.uint64(p) - self.prefix[k][starts]
            out.append(d % np.uint64(p) * self.down[k][starts] % np.uint64(p))
        return out

    def all_spans(self, width: int) -> np.ndarray:
        """A mixed hash of the span of this width at every place that has one."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = []
        for k, p in enumerate(PRIMES):
            d = self.prefix[k][width:] + np.uint64(p) - self.prefix[k][:m]
            out.append(d % np.uint64(p) * self.down[k][:m] % np.uint64(p))
        return _mixed(out)

    def same(self, a: int, b: int, length: int) -> bool:
        x = self.spans(np.array([a, b]), np.array([a + length, b + length]))
        return all(v[0] == v[1] for v in x)

    def common_extension(self, a: int, b: int) -> int:
        """How far the texts from a and from b agree."""
        lo, hi = 0, self.n - max(a, b)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(a, b, mid) else (lo, mid - 1)
        return lo


def rungs(n: int) -> np.ndarray:
    """Lengths of beginnings and ends that a text of n code points is known by."""
    out, g = [], 16
    while g <= n:
        out.append(g)
        g = g * 8 // 7 + 1
    return np.array(out, dtype=np.int64)


def kept(n: int) -> int:
    """Hashes of the sketch of a text of n code points."""
    return max(KEPT, n // SHARE)


def _sketch(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest distinct values, as their upper 32 bits."""
    most = kept(n)
    take = 4 * most
    while True:
        small = np.partition(h, take)[:take] if len(h) > take else h
        u = np.unique(small >> np.uint64(32))
        if len(u) >= most or len(h) <= take:
            return u[:most]
        take *= 8


def _mixed(x: list[np.ndarray]) -> np.ndarray:
    return mix(x[0] << np.uint64(31) ^ x[1])


class Print:
    """A fingerprint: length, whole hash, sketch, ladder of beginnings and ladder of ends (upper 32 bits each)."""

    def __init__(self, n: int, whole: list[int], sketch: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.n, self.whole, self.sketch, self.first, self.last = n, whole, sketch, first, last

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole[0]:08x}{self.whole[1]:08x}." + ".".join(x.astype(">u4").tobytes().hex() for x in (self.sketch, self.first, self.last))

    @classmethod
    def read(cls, text: str) -> Print:
        n, whole, *rest = text.split(".")
        return cls(int(n, 16), [int(whole[:8], 16), int(whole[8:], 16)], *(np.frombuffer(bytes.fromhex(x), dtype=">u4").astype(np.uint64) for x in rest))

    def likeness(self, other: Print) -> float:
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        return max(_alike(self, other), _ends_alike(self, other))


def likeness(a: str, b: str) -> float:
    """Estimated share of common text of two fingerprints, 0 to 1."""
    return Print.read(a).likeness(Print.read(b))


def _alike(a: Print, b: Print) -> float:
    x, y = a.sketch, b.sketch
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[: min(kept(a.n), kept(b.n))]
    both = np.intersect1d(np.intersect1d(union, x, assume_unique=True), y, assume_unique=True)
    j = len(both) / len(union)
    return 2 * j / (1 + j)


def _climb(x: np.ndarray, y: np.ndarray) -> int:
    """How many rungs agree: if one does, so do all below it."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
    return lo


def _ends_alike(a: Print, b: Print) -> float:
    g = np.concatenate([[0], rungs(min(a.n, b.n))])
    held = min(int(g[_climb(a.first, b.first)] + g[_climb(a.last, b.last)]), a.n, b.n)
    return 2 * held / (a.n + b.n) if a.n + b.n else 1.0


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)


def _lone(whole: list[int]) -> np.ndarray:
    """The only span of a text that is shorter than one."""
    return mix(np.array([(whole[0] << 31) ^ whole[1]], dtype=np.uint64))


def _upper(x: list[np.ndarray]) -> np.ndarray:
    return _mixed(x) >> np.uint64(32)


def _print(h: PrefixHashes, spans: np.ndarray, a: int, b: int) -> Print:
    """The fingerprint of the text that stands from a to b."""
    n = b - a
    whole = [int(v[0]) for v in h.spans(np.array([a]), np.array([b]))]
    held = spans[a : b - SPAN + 1] if n >= SPAN else _lone(whole) if n else spans[:0]
    g = rungs(n)
    return Print(n, whole, _sketch(held, n), _upper(h.spans(np.full(len(g), a), a + g)), _upper(h.spans(b - g, np.full(len(g), b))))


def _joined(h: PrefixHashes, spans: np.ndarray, flat: np.ndarray, a: int, cut: int, c: int, d: int) -> Print:
    """The fingerprint of the text a..cut followed by c..d, from the same prefix arrays: only spans over the joint are hashed anew."""
    head, tail = cut - a, d - c
    n = head + tail

    def glued(a0, cut0, c0, d0):
        """Hashes of the strings a0..cut0 + c0..d0."""
        left, right = h.spans(a0, cut0), h.spans(c0, d0)
        return [(x + h.up[k][cut0 - a0] * y) % np.uint64(PRIMES[k]) for k, (x, y) in enumerate(zip(left, right))]

    whole = [int(v[0]) for v in glued(*(np.array([x]) for x in (a, cut, c, d)))]
    if n < SPAN:
        held = _lone(whole) if n else spans[:0]
    else:
        around = np.concatenate([flat[max(a, cut - SPAN + 1) : cut], flat[c : c + min(tail, SPAN - 1)]])
        held = np.concatenate([spans[a : max(a, cut - SPAN + 1)], PrefixHashes(around).all_spans(SPAN), spans[c : max(c, d - SPAN + 1)]])
    g = rungs(n)
    first = glued(np.full(len(g), a), a + np.minimum(g, head), np.full(len(g), c), c + np.maximum(g - head, 0))
    last = glued(cut - np.maximum(g - tail, 0), np.full(len(g), cut), d - np.minimum(g, tail), np.full(len(g), d))
    return Print(n, whole, _sketch(held, n), _upper(first), _upper(last))


def fingerprint(text: str | None) -> str:
    h = PrefixHashes(code := _code(text or ""))
    return str(_print(h, h.all_spans(SPAN), 0, len(code)))


def edited_rows(texts: list[str]) -> list[tuple]:
    """For each text but the last: n_chars, sha of the edited text, both fingerprints, likeness to the edited and to the next text."""
    codes = [_code(t) for t in texts]
    ends = np.cumsum([len(c) for c in codes]).tolist()
    begins = [e - len(c) for e, c in zip(ends, codes)]
    flat = np.concatenate(codes)
    h = PrefixHashes(flat)
    spans = h.all_spans(SPAN)
    prints = [_print(h, spans, a, b) for a, b in zip(begins, ends)]
    out = []
    for i in range(len(texts) - 1):
        a, b, c, d = begins[i], ends[i], begins[i + 1], ends[i + 1]
        q = (b - a) // 4
        cut, q = b - q, min(q, d - c)
        text = texts[i][: cut - a] + texts[i + 1][:q]
        edited = _joined(h, spans, flat, a, cut, c, c + q)
        out.append((b - a, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), str(prints[i]), str(edited), prints[i].likeness(edited), prints[i].likeness(prints[i + 1])))
    return out


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [fingerprint(t) for t in pdf["text"]]})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """SCHEMA for every row: rows in order of doc_id, each compared with the next one, the last with the first.

    Rows are dealt over ranges of doc_id, a few to a task; the first row of each range is also sent to the range
    before it. Only the ranges' bounds and first ids, one number each, come to the driver.
    """
    spark = prepare(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select("doc_id", "text", key.alias("k"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 3 * parts
    bounds = np.array(sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.5 / ranges))))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(dtype=float), side="right").astype(np.int32))

    firsts = rows.select("k").withColumn("r", range_of("k")).groupBy("r").agg(F.min("k").alias("k")).collect()
    firsts = sorted((r["r"], r["k"]) for r in firsts)
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def sent_to(k: pd.Series) -> pd.Series:
        r = np.searchsorted(bounds, k.to_numpy(dtype=float), side="right").tolist()
        return pd.Series([[x, before[v]] if v in before else [x] for x, v in zip(r, k.tolist())])

    dealt = rows.select("*", F.posexplode(sent_to("k")).alias("guest", "r")).repartition(parts, "r").sortWithinPartitions("r", "guest", "k", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, at, closed = [], [], 0, None, False

        def flush(last: bool):
            nonlocal ids, texts, size
            if len(texts) > 1:
                out = pd.DataFrame([(i, *r) for i, r in zip(ids, edited_rows(texts))], columns=[c.split()[0] for c in SCHEMA.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
            ids, texts = ([], []) if last else (ids[-1:], texts[-1:])
            size = 0

        for pdf in batches:
            for i, t, guest, r in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["guest"].tolist(), pdf["r"].tolist()):
                if r != at:
                    ids, texts, size, at, closed = [], [], 0, r, False
                if closed:
                    continue
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t or "")
                size += len(texts[-1])
                closed = guest == 1
                if closed or size > 1_000_000:
                    yield from flush(closed)

    return map_frames(dealt.select("doc_id", "text", "guest", "r"), run, SCHEMA, 500)
