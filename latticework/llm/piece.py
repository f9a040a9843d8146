"""SentencePiece encoding and decoding that keeps offsets.

Normalisation takes, at each place, the longest prefix that the model's
compiled character map knows (a double-array trie), and records for every
normalised byte the source byte it came from. Every piece is then projected to
a span of original bytes. No piece holds a mark after another character, so
words cut before marks are merged apart and each distinct word of a batch once.
Texts go through the map in bulk (`Normalizer.flat`): the trie is walked where
one of its keys may start, all other characters stand for themselves.

Defined cases: null text is the empty text, which has no ids; repeated rows
are repeated; null doc_ids stay null and leave others as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from latticework.llm.flat import ByteTable, PairTable, WordMemory, encode_words, slices, within
from latticework.llm.runtime import held, map_frames

MARK = "▁"

class CharMap:
    """A compiled character map: 4 bytes of trie size, a double-array trie, then replacement strings ended by NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if blob else []
        self.strings = blob[4 + size :]
        #: Bytes that a key may start with.
        self.starts = np.array([self._child(c) for c in range(256)], dtype=bool)

    def _child(self, c: int) -> bool:
        if not self.units or not c:
            return False
        root = self.units[0]
        at = ((root >> 10) << ((root & (1 << 9)) >> 6)) ^ c
        return at < len(self.units) and self.units[at] & ((1 << 31) | 0xFF) == c

    def longest(self, data: bytes, at: int, stop: int | None = None) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at this byte (and ends before stop), and what it becomes."""
        units = self.units
        if not units:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & (1 << 9)) >> 6)

        node = offset(units[0])
        best = None
        for i in range(at, len(data) if stop is None else stop):
            c = data[i]
            if c == 0:
                break
            node ^= c
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                v = units[node] & ((1 << 31) - 1)
                best = (i + 1 - at, v)
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1] : end]


class Normalizer:
    """text -> (normalised text, source byte of each normalised byte plus the end)."""

    def __init__(self, charsmap: bytes, add_prefix: bool, squeeze: bool, escape: bool, suffix: bool = False):
        self.map, self.add_prefix, self.squeeze, self.escape, self.suffix = CharMap(charsmap), add_prefix, squeeze, escape, suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode("utf-8", "replace")
        out, src = bytearray(), []
        space = MARK.encode() if self.escape else b" "
        at, n = 0, len(data)
        pieces: list[tuple[bytes, int, int]] = []
        while at < n:
            got = self.map.longest(data, at)
            if got:
                size, new = got
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + size]
            pieces.append((bytes(new), at, at + size))
            at += size
        end = n
        if self.squeeze:
            while pieces and pieces[0][0] in (b" ", b""):
                pieces.pop(0)
        if not pieces:
            return "", np.zeros(1, dtype=np.int64)
        first = pieces[0][1]
        if self.add_prefix and not self.suffix:
            out += space
            src += [first] * len(space)
        prev_space = self.squeeze
        for new, a, _ in pieces:
            if prev_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            for b in new:
                if b == 0x20:
                    out += space
                    src += [a] * len(space)
                else:
                    out.append(b)
                    src.append(a)
            prev_space = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                cut = len(space)
                end = src[-cut]
                del out[-cut:], src[-cut:]
        if self.add_prefix and self.suffix:
            out += space
            src += [end] * len(space)
        src.append(end)
        return out.decode("utf-8", "replace"), np.array(src, dtype=np.int64)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The normalised code points of all texts, the source byte under each, where each text ends among them, and its bytes.

        For models that keep spaces, mark them, and add a mark in front (`PieceModel.bulk`).
        """
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(n)
        text_from = at[ends - n]
        doc = np.repeat(np.arange(len(texts)), n)
        src = at[:-1] - text_from[doc]
        count = np.ones(len(code), dtype=np.int64)
        new: list[tuple[int, list[int]]] = []
        if self.map.units:
            data = joined.encode("utf-8", "replace")
            raw = np.frombuffer(data, dtype=np.uint8)
            done = 0
            for i in np.flatnonzero(self.map.starts[raw[at[:-1]]]).tolist():
                if i < done:
                    continue
                got = self.map.longest(data, int(at[i]), int(at[ends[doc[i]]]))
                if got:
                    done = int(np.searchsorted(at, at[i] + got[0]))
                    count[i:done] = 0
                    to = [ord(c) for c in got[1].decode("utf-8", "replace")]
                    count[i] = len(to)
                    new.append((i, to))
        if new:
            total = np.concatenate([[0], np.cumsum(count)])
            code, src = np.repeat(code, count), np.repeat(src, count)
            for i, to in new:
                code[total[i] : total[i] + len(to)] = to
            ends = total[ends]
            n = np.diff(np.concatenate([[0], ends]))
        space = (code == 0x20) | (code == ord(MARK))
        code[space] = ord(MARK)
        some = np.flatnonzero(n)
        front = (ends - n)[some]
        return np.insert(code, front, ord(MARK)), np.insert(src, front, 0), ends + np.cumsum(n > 0), at[np.cumsum([len(t) for t in texts], dtype=np.int64)] - text_from


class PieceModel:
    """A BPE model file of the sentencepiece format."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        fallback = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        # The bulk merge holds for BPE with byte fallback, spaces kept, no user symbols, words cut before marks.
        self.bulk = (
            proto.trainer_spec.model_type == 2 and len(fallback) == 256
            and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
            and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
            and not any(MARK in x.lstrip(MARK) for x in normal)
        )
        #: Bytes of the normalised text under each id.
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.decimal = ByteTable([b"%d," % i for i in range(len(proto.pieces))])
        if not self.bulk:
            return
        order = {i: r for r, (_, i) in enumerate(sorted((-proto.pieces[i].score, i) for i in normal.values()))}
        pairs = {}
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for x, i in normal.items():
            if len(x) == 1:
                self.char[ord(x)] = i
            for k in range(1, len(x)):
                a, b = normal.get(x[:k]), normal.get(x[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[i], i)
        self.alone = self.char < 0  # characters without a piece: never merged
        self.byte_ids = np.array([fallback[b] for b in range(256)], dtype=np.int32)
        plain = np.flatnonzero(self.alone[:128])
        self.char[plain] = self.byte_ids[plain]
        self.memory = WordMemory()
        self.pairs = PairTable(pairs, len(proto.pieces))
        strings = [b"" if p.type in (kinds.UNKNOWN, kinds.CONTROL) else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.strings = ByteTable(strings)

    def _long(self, symbols: np.ndarray) -> list[int]:
        """A long word by the library; one that has no mark before it is put after a line break."""
        text = self.strings(symbols)[0].decode("utf-8")
        return self.lib.encode(text[1:]) if text.startswith(" ") else self.lib.encode("\n" + text)[2:]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text ends among them."""
        return self.encode_aligned(texts)[:2]

    def encode_aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode_flat, and [ids, 2]: the original bytes (of its own text) under each piece. The added first mark has none of its own."""
        if not self.bulk:
            got = self.lib.encode(texts, num_threads=1)
            spans = [self._spans(t, np.array(i, dtype=np.int64)) for t, i in zip(texts, got)]
            return np.array([i for x in got for i in x], dtype=np.int32), np.cumsum([len(x) for x in got], dtype=np.int64), np.concatenate([np.zeros((0, 2), np.int64), *spans])
        code, src, doc_end, n_bytes = self.normalize.flat(texts)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        below = np.repeat(src, size)  # the source byte under each normalised byte
        mark = code == ord(MARK)
        alone = self.alone[code]
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        start |= alone
        start[1:] |= alone[:-1]
        start[doc_end[:-1][doc_end[:-1] < len(code)]] = True
        symbols = self.char[code]
        bad = np.flatnonzero(symbols < 0)
        if len(bad):  # a character outside the vocabulary becomes its bytes
            raw = [chr(c).encode("utf-8", "replace") for c in code[bad].tolist()]
            grow = np.ones(len(code), dtype=np.int64)
            grow[bad] = [len(x) for x in raw]
            new_end = np.cumsum(grow)
            place = new_end - grow
            wide = np.zeros(int(new_end[-1]), dtype=np.int32)
            wide[place] = symbols
            wide[np.repeat(place[bad], grow[bad]) + within(grow[bad])] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            new_start = np.zeros(len(wide), dtype=bool)
            new_start[place] = start
            symbols, start = wide, new_start
            doc_end = np.where(doc_end > 0, new_end[np.maximum(doc_end, 1) - 1], 0)
        starts = np.flatnonzero(start)
        ids, count = encode_words(symbols, starts, self.pairs, self._long, self.memory)
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, doc_end)]
        until = np.cumsum(self.width[ids])
        begins = below[until - self.width[ids]]
        stops = np.concatenate([begins[1:], [0]])[: len(begins)]
        some = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
        stops[ends[some] - 1] = n_bytes[some]
        return ids, ends, np.stack([begins, stops], axis=1)

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The spans of ids that the library gave, by the normaliser's alignment of one text."""
        if not len(ids):
            return np.zeros((0, 2), dtype=np.int64)
        _, src = self.normalize(text)
        ends = np.minimum(np.cumsum(self.width[ids]), len(src) - 1)
        return np.stack([src[np.concatenate([[0], ends[:-1]])], src[ends]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 of each text's decoding: pieces joined, marks as spaces, without the added one."""
        if not self.bulk:
            return [self.lib.decode(ids[a:b].tolist()).encode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        raw, at = self.strings(ids)
        at = np.concatenate([[0], at])[ends].tolist()
        out, a = [], 0
        for i, b in enumerate(at):
            x = raw[a:b]
            try:
                x.decode("utf-8")
                x = x[1:] if x[:1] == b" " else x
            except UnicodeDecodeError:  # ids that no text gives
                x = self.lib.decode(ids[(0 if i == 0 else int(ends[i - 1])) : int(ends[i])].tolist()).encode()
            out.append(x)
            a = b
        return out


def model(path: str) -> PieceModel:
    return held(("piece", path), lambda: PieceModel(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins and ends (original byte spans) of every text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            texts = [t if t is not None else "" for t in pdf["text"]]
            for lo, hi in slices(texts):
                ids, ends, spans = m.encode_aligned(texts[lo:hi])
                cut = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo:hi].array, "ids": [ids[a:b] for a, b in cut], "begins": [spans[a:b, 0] for a, b in cut], "ends": [spans[a:b, 1] for a, b in cut]})

    return map_frames(docs.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>", 500)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [m.decode([] if i is None else [int(x) for x in i]) for i in pdf["ids"]]})

    return map_frames(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", 500)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass, returning digests.

    spans_sha256 is the digest of all spans (begin, end of each piece as little-endian 64 bits), covered the number
    of original bytes from the first to the last.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            whole = [t if t is not None else "" for t in pdf["text"]]
            for lo, hi in slices(whole):
                ids, ends, spans = m.encode_aligned(whole[lo:hi])
                back = m.decode_flat(ids, ends)
                digits, at = m.decimal(ids)
                at = np.concatenate([[0], at])[ends].tolist()
                cut = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[lo:hi].array,
                    "n_tokens": [b - a for a, b in cut],
                    "ids_sha256": [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip([0, *at[:-1]], at)],
                    "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                    "spans_sha256": [hashlib.sha256(spans[a:b].astype("<i8").tobytes()).hexdigest() for a, b in cut],
                    "covered": [int(spans[b - 1, 1] - spans[a, 0]) if b > a else 0 for a, b in cut],
                })

    return map_frames(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered bigint")
