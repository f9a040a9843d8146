"""Words of many texts as flat numpy arrays: hashing, distinct words, exact byte-pair merges, gathered output.

A batch of texts is one array of symbols cut into words. Each distinct word is
merged once (lowest rank first, then leftmost) and its ids are gathered back to
every place, so the cost follows the distinct words of a batch, and no list of
Python strings is made.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longest word, in symbols, that is merged in bulk.
LONGEST = 64
_rng = np.random.default_rng(20240607)
_NEAR, _FAR = (_rng.integers(1, 2**63, size=1 << 16, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def gather(starts: np.ndarray, lengths: np.ndarray, source: np.ndarray) -> np.ndarray:
    """source[start : start + length] of each, one after another."""
    return source[np.repeat(starts, lengths) + within(lengths)]


def places(at: np.ndarray) -> np.ndarray:
    """An odd 64-bit weight for each place below 2^32, without a period."""
    near = _NEAR[at & 0xFFFF]
    return near * _FAR[at >> 16] if len(at) and at.max() > 0xFFFF else near


def word_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (the words fill the array without gaps)."""
    h = mix(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * places(within(lengths))
    return mix(np.add.reduceat(h, starts) + lengths.astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)


class PairTable:
    """(left id, right id) -> rank; merged[rank] is the new id."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], base: int):
        self.base = np.uint64(base)
        keys = np.array([a * base + b for a, b in pairs], dtype=np.uint64)
        ranks = np.array([r for r, _ in pairs.values()], dtype=np.int32)
        self.merged = np.zeros(int(ranks.max()) + 1, dtype=np.int32)
        self.merged[ranks] = [m for _, m in pairs.values()]
        self.bits = 20
        size = 1 << self.bits
        self.k1, self.r1 = np.full(size, 2**64 - 1, dtype=np.uint64), np.full(size, NONE, dtype=np.int32)
        at = self._slot(keys)
        _, first = np.unique(at, return_index=True)
        self.k1[at[first]], self.r1[at[first]] = keys[first], ranks[first]
        rest = np.ones(len(keys), dtype=bool)
        rest[first] = False
        order = np.argsort(keys[rest])
        self.k2, self.r2 = keys[rest][order], ranks[rest][order]
        self.crowded = np.zeros(size, dtype=bool)
        self.crowded[at[rest]] = True

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * self.base + right.astype(np.uint64)
        at = self._slot(keys)
        out = np.where(self.k1[at] == keys, self.r1[at], NONE)
        again = np.flatnonzero(self.crowded[at] & (out == NONE))
        if len(again):
            k = keys[again]
            i = np.minimum(np.searchsorted(self.k2, k), len(self.k2) - 1)
            out[again] = np.where(self.k2[i] == k, self.r2[i], NONE)
        return out


def merge(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words of at most LONGEST symbols, one after another, and how many each has."""
    out, count = symbols.astype(np.int32).copy(), lengths.astype(np.int64).copy()
    for lo, hi in ((1, 4), (4, 8), (8, 12), (12, 20), (20, 36), (36, LONGEST)):
        pick = np.flatnonzero((lengths > lo) & (lengths <= hi))
        step = max(1, 40_000 // hi)
        for i in range(0, len(pick), step):
            part = pick[i : i + step]
            _merge_block(out, count, starts[part], lengths[part], part, hi, table)
    return gather(starts, count, out), count


def _merge_block(out, count, starts, lens, which, width, table):
    cols = np.arange(width)
    n = lens.astype(np.int64)
    inside = cols < n[:, None]
    at = np.minimum(starts[:, None] + cols, len(out) - 1)
    a = np.where(inside, out[at], 0).astype(np.int32)
    r = np.full(a.shape, NONE, dtype=np.int32)
    r[:, :-1] = np.where(inside[:, 1:], table.rank(a[:, :-1].ravel(), a[:, 1:].ravel()).reshape(len(a), -1), NONE)
    while len(a):
        m = r.argmin(axis=1)
        best = np.take_along_axis(r, m[:, None], 1)[:, 0]
        go = best != NONE
        if not go.all():
            done = ~go
            k = n[done]
            held = cols < k[:, None]
            out[(starts[done][:, None] + cols)[held]] = a[done][held]
            count[which[done]] = k
            a, r, m, best, n, starts, which = a[go], r[go], m[go], best[go], n[go], starts[go], which[go]
            if not len(a):
                return
        rows = np.arange(len(a))
        a[rows, m] = table.merged[best]
        after = cols[:-1] >= m[:, None]
        r[:, :-1] = np.where(after, r[:, 1:], r[:, :-1])
        after[rows, np.minimum(m, width - 2)] = False
        a[:, :-1] = np.where(after, a[:, 1:], a[:, :-1])
        r[:, -1] = NONE
        n -= 1
        right = m + 1 < n
        i = rows[right]
        r[i, m[right]] = table.rank(a[i, m[right]], a[i, m[right] + 1])
        r[rows[~right], m[~right]] = NONE
        left = m > 0
        i = rows[left]
        r[i, m[left] - 1] = table.rank(a[i, m[left] - 1], a[i, m[left]])


class WordMemory:
    """Symbols and ids of the first words that a worker has met, by hash, up to a fixed number."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.hashes = np.zeros(0, np.uint64)
        self.start, self.count, self.at, self.length = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.symbols = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Index of each word, or -1; a word is known only if all its symbols are the same."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.length[at] == lengths))
        hit = hit[same_words(symbols, starts[hit], self.symbols, self.at[at[hit]], lengths[hit])]
        out = np.full(len(hashes), -1, dtype=np.int64)
        out[hit] = at[hit]
        return out

    def add(self, hashes: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        room = self.most - len(self.hashes)
        if room <= 0 or not len(hashes):
            return
        hashes, lengths, count = hashes[:room], lengths[:room], count[:room]
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])[order]
        self.at = np.concatenate([self.at, len(self.symbols) + np.cumsum(lengths) - lengths])[order]
        self.count, self.length = np.concatenate([self.count, count])[order], np.concatenate([self.length, lengths])[order]
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.ids = np.concatenate([self.ids, ids[: int(count.sum())]])
        self.symbols = np.concatenate([self.symbols, symbols[: int(lengths.sum())].astype(np.int32)])


def same_words(x: np.ndarray, x_starts: np.ndarray, y: np.ndarray, y_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each word of x has the symbols of its word of y (all lengths above 0)."""
    if not len(lengths):
        return np.zeros(0, dtype=bool)
    inner, ends = within(lengths), np.cumsum(lengths)
    differ = x[np.repeat(x_starts, lengths) + inner] != y[np.repeat(y_starts, lengths) + inner]
    if not differ.any():
        return np.ones(len(lengths), dtype=bool)
    return ~np.logical_or.reduceat(differ, ends - lengths)


def distinct_words(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of its first word, each word's index) of the distinct words; words that only share a hash stay apart."""
    hashes, first, back = np.unique(word_hashes(symbols, starts, lengths), return_index=True, return_inverse=True)
    differ = np.flatnonzero(lengths != lengths[first[back]])
    alike = np.flatnonzero(lengths == lengths[first[back]])
    wrong = alike[~same_words(symbols, starts[alike], symbols, starts[first[back[alike]]], lengths[alike])]
    apart = np.concatenate([differ, wrong])
    if len(apart):
        back = back.copy()
        back[apart] = len(hashes) + np.arange(len(apart))
        hashes, first = np.concatenate([hashes, np.zeros(len(apart), np.uint64)]), np.concatenate([first, apart])
    return hashes, first, back


def encode_words(symbols: np.ndarray, starts: np.ndarray, table: PairTable, long_word, memory: WordMemory) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and each word's number of ids. long_word(symbols) encodes a longer word."""
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.concatenate([starts, [len(symbols)]]))
    hashes, first, back = distinct_words(symbols, starts, lengths)
    ulen, ufrom = lengths[first], starts[first]
    known = memory.find(hashes, symbols, ufrom, ulen)
    short, long = (known < 0) & (ulen <= LONGEST), (known < 0) & (ulen > LONGEST)
    s_syms = gather(ufrom[short], ulen[short], symbols)
    s_starts = np.cumsum(ulen[short]) - ulen[short]
    ids, count = merge(s_syms, s_starts, ulen[short], table)
    extra = [np.array(long_word(symbols[ufrom[j] : ufrom[j] + ulen[j]]), dtype=np.int32) for j in np.flatnonzero(long)]
    old = known >= 0
    base = len(memory.ids)
    ucount, ustart = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    ucount[short], ustart[short] = count, base + np.cumsum(count) - count
    ucount[old], ustart[old] = memory.count[known[old]], memory.start[known[old]]
    if extra:
        lens = np.array([len(x) for x in extra])
        ucount[long], ustart[long] = lens, base + len(ids) + np.cumsum(lens) - lens
    source = np.concatenate([memory.ids, ids, *extra])
    memory.add(hashes[short], s_syms, ulen[short], ids, count)
    return gather(ustart[back], ucount[back], source), ucount[back]


class ByteTable:
    """Byte strings by id, gathered for many ids at once."""

    def __init__(self, items: list[bytes]):
        self.lengths = np.array([len(x) for x in items], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(items), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes, and each id's end among them."""
        lens = self.lengths[ids]
        return gather(self.starts[ids], lens, self.blob).tobytes(), np.cumsum(lens)


def slices(texts: list[str], most: int = 400_000):
    """Neighbouring texts of at most so many characters together (one text may be longer): bounds of each slice."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
