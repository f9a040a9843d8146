"""Best-fit packing of documents into sequences of fixed length.

Tokens come from a word BPE file. A document's ids are followed by one
separator id and cut only where it is longer than a sequence. Pieces are dealt
over packers by a hash; each packer runs an online best-fit over a fixed
number of open bins, held in a bitset keyed by free space: the bin with the
least room that still fits is the lowest set bit at or above the piece's
length. When too many bins are open, the fullest closes first.

Only lengths and digests are shuffled, not texts. A packer's rows are sorted
by a hash first, so a task that is run again packs the same way.

Defined cases: null text is the empty text, whose only token is the
separator; repeated rows are packed each; null doc_ids are kept; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.flat import PairTable, WordMemory, encode_words, gather, slices
from latticework.llm.runtime import held, map_frames, plan_bytes, release

#: Input bytes for one packer, and the most packers.
PACKER_BYTES, MOST_PACKERS = 64 << 20, 20_000
#: First code point that the bulk path leaves to the library.
_WIDE = 0x250


class WordTokens:
    """A tokenizers file with byte symbols and word ends, encoded in bulk; unusual words go to the library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1 + len(spec["added_tokens"])
        suffix = model["end_of_word_suffix"]
        # the usual printable stand-ins for bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocab[stand[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[stand[b] + suffix] for b in range(256)], dtype=np.int32)
        pairs = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.memory = WordMemory()
        self.pairs = PairTable(pairs, self.size)
        back = {stand[b]: b for b in range(256)}
        self.raw = {i: bytes(back[c] for c in (t[: -len(suffix)] if t.endswith(suffix) else t)) for t, i in vocab.items() if len(t) <= 1 + len(suffix) and all(c in back for c in t.removesuffix(suffix))}
        kind = np.full(_WIDE, 3, dtype=np.int8)
        self.low = np.arange(_WIDE, dtype=np.int64)
        self.odd = np.zeros(_WIDE, dtype=bool)
        for c in range(_WIDE):
            k = unicodedata.category(chr(c))[0]
            kind[c] = 1 if k == "L" else 2 if k == "N" else 3
            low = chr(c).lower()
            self.odd[c] = len(low) != 1 or ord(low[0]) >= _WIDE or unicodedata.normalize("NFC", chr(c)) != chr(c) or (chr(c).isspace() and c not in (0x20, 0x0A))
            self.low[c] = c if self.odd[c] else ord(low)
        self.odd[ord("'")] = True
        kind[[0x20, 0x0A]] = 0
        self.kind = kind

    def _long(self, symbols: np.ndarray) -> list[int]:
        return self.lib.encode(b"".join(self.raw[s] for s in symbols.tolist()).decode("utf-8"), add_special_tokens=False).ids

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each ends."""
        joined = "\n".join(texts) + "\n" if texts else ""
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        doc_end = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        wide = code >= _WIDE
        small = np.where(wide, 0x61, code)
        gap = (small == 0x20) | (small == 0x0A)
        odd = wide | self.odd[small]
        odd[:-1] |= (code[:-1] == 0x3C) & (code[1:] == 0x7C)  # the strings of added tokens start with these two
        kind = self.kind[small]
        symbols_of = self.low[small]
        start = np.zeros(len(code), dtype=bool)
        if len(code):
            start[0] = True
            start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start &= ~gap
        hold = ~gap
        special = np.zeros(0, dtype=np.int64)
        chunks: list[str] = []
        if odd.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
            a, b = edge[::2], edge[1::2]
            hit = np.flatnonzero(np.add.reduceat(odd.astype(np.int64), a) > 0) if len(a) else []
            a, b = a[hit], b[hit]
            known: dict[str, int] = {}
            special = np.array([known.setdefault(joined[x:y], len(known)) for x, y in zip(a.tolist(), b.tolist())], dtype=np.int64)
            chunks = list(known)
            cover = np.zeros(len(code) + 1, dtype=np.int64)
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            inside = np.cumsum(cover[:-1]) > 0
            hold &= ~inside
            start &= ~inside
            hold[a] = start[a] = True
            symbols_of[a] = -1 - special
        got = [e.ids for e in self.lib.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []
        at = np.flatnonzero(hold)
        sym, first = symbols_of[at], start[at]
        two = sym >= 0x80
        n_bytes = 1 + two
        end = np.cumsum(n_bytes)
        place = end - n_bytes
        raw = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.int64)
        raw[place] = np.where(two, 0xC0 | (sym >> 6), sym)
        raw[place[two] + 1] = 0x80 | (sym[two] & 0x3F)
        begins = place[first]
        lasts = np.concatenate([begins[1:], [len(raw)]]) - 1 if len(begins) else begins
        ids = np.where(raw < 0, self.size - 1 - raw, self.inner[np.maximum(raw, 0)]).astype(np.int32)
        closing = lasts[raw[lasts] >= 0]
        ids[closing] = self.last[raw[closing]]
        out, count = encode_words(ids, begins, self.pairs, self._long, self.memory)
        word_ends = np.cumsum(count)
        words = np.searchsorted(at[first], doc_end)  # words that start before each document's end
        ends = np.concatenate([[0], word_ends])[words]
        if chunks:
            lens = np.array([len(x) for x in got], dtype=np.int64)
            flat = np.array([i for x in got for i in x], dtype=np.int32)
            big = out >= self.size
            grow = np.ones(len(out), dtype=np.int64)
            which = out[big] - self.size
            grow[big] = lens[which]
            source = np.concatenate([out, flat])
            begin = np.arange(len(out), dtype=np.int64)
            begin[big] = len(out) + (np.cumsum(lens) - lens)[which]
            out = gather(begin, grow, source)
            ends = np.concatenate([[0], np.cumsum(grow)])[ends]
        return out, ends

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def tokens(path: str) -> WordTokens:
    return held(("words", path), lambda: WordTokens(path))


def cut_pieces(docs: DataFrame, path: str, size: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bits, if asked for) of every piece."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokens(path)
        end = np.uint32(separator).tobytes()
        for pdf in batches:
            texts = [x if x is not None else "" for x in pdf["text"]]
            for lo, hi in slices(texts):
                ids, ends = t.encode_flat(texts[lo:hi])
                raw = ids.astype("<u4").tobytes()
                rows, row, a = [], [], 0
                for i, b in enumerate(ends.tolist(), lo):
                    whole = raw[4 * a : 4 * b] + end
                    for p, s in enumerate(range(0, len(whole), 4 * size)):
                        x = whole[s : s + 4 * size]
                        row.append(i)
                        rows.append((p, s // 4, len(x) // 4, zlib.crc32(x), *([x] if keep_ids else [])))
                    a = b
                out = pd.DataFrame(rows, columns=names[1:])
                yield out.assign(doc_id=pdf["doc_id"].array[row])
        release()

    return map_frames(docs.select("doc_id", "text"), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


class OpenBins:
    """Bins that may still take a piece, keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.by_free, self.next = 0, 0, [[] for _ in range(capacity + 1)], 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.next, self.capacity
            self.next += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(b)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return b, self.capacity - free

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        b = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b


def pack(pieces: DataFrame, packers: int, size: int = 2048, open_bins: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset."""
    names = pieces.columns
    by = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(packers, by).sortWithinPartitions(by, "doc_id", "piece", "ids_crc32", "length")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for pdf in batches:
            at = [bins.place(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[base + b for b, _ in at], offset=[o for _, o in at])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return map_frames(dealt, run, f"{schema}, sequence_id bigint, offset bigint", 10_000).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, separator: int = 0, open_bins: int = 4096, keep_ids: bool = False) -> DataFrame:
    size_known = plan_bytes(docs)
    packers = size_known // PACKER_BYTES + 1 if size_known < 1 << 50 else int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packers = min(MOST_PACKERS, packers)
    return pack(cut_pieces(docs, path, size, separator, keep_ids), packers, size, open_bins)
