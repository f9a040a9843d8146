"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood in a language is the sum over all its segmentations,
found by a forward pass over its characters; a text's is the product over its
words. The forward pass runs over the distinct words of a batch in numpy; words
over `LONG` characters take a pass that keeps only as many places as the
longest piece has characters, so no word is cut. A worker remembers a bounded
number of words.

Piece probabilities are learned from a bounded sample of labelled rows
(sample_docs for each language, chosen by a hash of doc_id) and smoothed.

Defined cases: null text, or text without a letter, is ``und`` with score 0,
and so is every text when nothing could be learned; repeated rows are scored
alike and null doc_ids leave others as they are; ties go to the first language in order; a null doc_id counts as the
empty string for the fold; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.flat import distinct_words, mix, slices
from latticework.llm.piece import MARK, model
from latticework.llm.runtime import held, map_frames, prepare, release

#: Characters of a word up to which words are scored in blocks of one width.
LONG, FLOOR = 48, 1e-300
_BASE = np.uint64(0x9E3779B97F4A7C55)


@dataclass
class Languages:
    names: list[str]
    logp: np.ndarray  # [pieces, languages]
    unknown: float  # log probability of a character that no piece covers


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def learn(rows: DataFrame, path: str, sample_docs: int = 2000, smoothing: float = 0.5) -> Languages:
    """rows: doc_id, text, lang. At most about sample_docs rows of each language are read."""
    rows = rows.where(F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Languages([], np.zeros((0, 0)), 0.0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample_docs / r["count"]))])
    at = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = rows.where((at < share[F.col("lang")]) & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = [t.lower() for t in part["text"]]
                for lo, hi in slices(texts):
                    ids, _ = m.encode_flat(texts[lo:hi])
                    piece, n = np.unique(ids, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "piece": piece, "n": n})

    got = map_frames(sample, count, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(r["lang"] for r in counts)
    size = len(model(path).width)
    seen = np.zeros((size, len(names)))
    seen[got["piece"].to_numpy(dtype=np.int64), got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    p = (seen + smoothing) / (seen + smoothing).sum(axis=0)
    return Languages(names, np.log(p), float(np.log(p).min()))


class Scorer:
    """Word likelihoods in every language, with a memory of the first words met."""

    def __init__(self, path: str, languages: Languages, most: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.languages = languages
        self.k = max(1, len(languages.names))
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = [(p.piece, i) for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL]
        self.longest = max(len(x) for x, _ in pieces)
        size = 1 << 18
        self.mask = np.uint64(size - 1)
        self.keys, self.rows = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int64)
        rest_k, rest_r = [], []
        for x, i in pieces:
            h = 0
            for c in x:
                h = (h * int(_BASE) + ord(c) + 1) % 2**64
            at = int(mix(np.array([h], dtype=np.uint64))[0]) & int(self.mask)
            if self.rows[at] < 0:
                self.keys[at], self.rows[at] = h, i
            else:
                rest_k.append(h)
                rest_r.append(i)
        order = np.argsort(np.array(rest_k, dtype=np.uint64))
        self.rest_k, self.rest_r = np.array(rest_k, dtype=np.uint64)[order], np.array(rest_r, dtype=np.int64)[order]
        self.p = np.exp(languages.logp + 2.0 * np.array([len(p.piece) for p in proto.pieces])[:, None])  # a factor e^2 for each character keeps words in range
        self.unknown = np.exp(languages.unknown + 2.0)
        known = np.zeros(0x110000, dtype=bool)
        known[[ord(x) for x, _ in pieces if len(x) == 1]] = True
        self.alone = ~known
        letters = np.zeros(0x110000, dtype=bool)
        letters[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        self.letters = letters
        self.most, self.seen, self.seen_logp = most, np.zeros(0, dtype=np.uint64), np.zeros((0, self.k))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys) & self.mask).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        again = np.flatnonzero((self.rows[at] >= 0) & (out < 0))
        if len(again) and len(self.rest_k):
            k = keys[again]
            i = np.minimum(np.searchsorted(self.rest_k, k), len(self.rest_k) - 1)
            out[again] = np.where(self.rest_k[i] == k, self.rest_r[i], -1)
        return out

    def forward(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log P(word | language): [words, languages]."""
        out = np.zeros((len(starts), self.k))
        for lo, hi in ((0, 2), (2, 4), (4, 6), (6, 8), (8, 10), (10, 13), (13, 18), (18, 30), (30, LONG)):
            pick = np.flatnonzero((lengths > lo) & (lengths <= hi))
            for i in range(0, len(pick), 4000):
                w = pick[i : i + 4000]
                out[w] = self._block(code, starts[w], lengths[w], hi)
        pick = np.flatnonzero(lengths > LONG)
        for i in range(0, len(pick), 4000):
            w = pick[i : i + 4000]
            out[w] = self._ring(code, starts[w], lengths[w])
        return out

    def _ring(self, code, starts, lengths):
        """Words of any length: the last places only, scaled at every character."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n, size = len(starts), self.longest
        alpha, h, log = np.zeros((size, n, self.k)), np.zeros((size, n), dtype=np.uint64), np.zeros((n, self.k))
        alpha[0] = 1.0
        for j in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -j, side="left"))  # words longer than j
            slot = np.arange(max(0, j + 1 - size), j + 1) % size
            h[j % size] = 0
            now = h[slot, :live] * _BASE + (code[starts[:live] + j].astype(np.uint64) + np.uint64(1))
            h[slot, :live] = now
            row = self._find(now.ravel()).reshape(len(slot), live)
            p = np.where((row >= 0)[:, :, None], self.p[np.maximum(row, 0)], 0.0)
            p[-1, row[-1] < 0] = self.unknown
            new = (alpha[slot, :live] * p).sum(axis=0)
            log[:live] += np.log(new)
            alpha[:, :live] /= new
            alpha[(j + 1) % size, :live] = 1.0
        out = np.empty_like(log)
        out[order] = log - 2.0 * lengths[:, None]
        return out

    def _block(self, code, starts, lengths, width):
        n = len(starts)
        at = np.minimum(starts[:, None] + np.arange(width), len(code) - 1)
        c = code[at].astype(np.uint64) + np.uint64(1)
        alpha = np.zeros((width + 1, n, self.k))
        alpha[0] = 1.0
        h = np.zeros((width, n), dtype=np.uint64)  # hash of the piece that starts at each place and ends here
        result = np.zeros((n, self.k))
        for j in range(width):
            low = max(0, j + 1 - self.longest)
            h[low : j + 1] = h[low : j + 1] * _BASE + c[:, j]
            row = self._find(h[low : j + 1].ravel()).reshape(j + 1 - low, n)
            i, w = np.nonzero(row >= 0)
            new = np.zeros((n, self.k))
            terms = alpha[i + low, w] * self.p[row[i, w]]
            for k in range(self.k):
                new[:, k] = np.bincount(w, weights=terms[:, k], minlength=n)
            uncovered = row[-1] < 0
            new[uncovered] += alpha[j, uncovered] * self.unknown
            alpha[j + 1] = new
            ended = lengths == j + 1
            result[ended] = np.log(np.maximum(new[ended], FLOOR)) - 2.0 * (j + 1)
        return result

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """([texts, languages] log-likelihoods, whether each has a letter)."""
        marked = [MARK + t.lower().replace(" ", MARK) if t else "" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        end = np.cumsum([len(t) for t in marked], dtype=np.int64)
        total = np.zeros((len(texts), self.k))
        lettered = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(self.letters[code])])[end]])) > 0
        if not len(code):
            return total, lettered
        mark = code == ord(MARK)
        alone = self.alone[code]
        start = mark | alone
        start[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
        start[end[:-1][end[:-1] < len(code)]] = True
        start[0] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.concatenate([starts, [len(code)]]))
        hashes, first, back = distinct_words(code, starts, lengths)
        logp = np.zeros((len(hashes), self.k))
        at = np.minimum(np.searchsorted(self.seen, hashes), max(0, len(self.seen) - 1))
        old = (self.seen[at] == hashes) & (hashes != 0) if len(self.seen) else np.zeros(len(hashes), dtype=bool)
        old &= lengths[first] <= LONG
        logp[old] = self.seen_logp[at[old]]
        new = np.flatnonzero(~old)
        logp[new] = self.forward(code, starts[first[new]], lengths[first[new]])
        new = new[lengths[first[new]] <= LONG][: max(0, self.most - len(self.seen))]
        if len(new):
            joined = np.concatenate([self.seen, hashes[new]])
            order = np.argsort(joined)
            self.seen, self.seen_logp = joined[order], np.concatenate([self.seen_logp, logp[new]])[order]
        doc = np.searchsorted(end, starts, side="right")
        for k in range(self.k):
            total[:, k] = np.bincount(doc, weights=logp[back, k], minlength=len(texts))
        return total, lettered


def predict(docs: DataFrame, languages: Languages, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score (the posterior of the best language under equal priors)."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(languages)
    key = hash((tuple(languages.names), languages.logp.tobytes()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        scorer = held(("scorer", path, key), lambda: Scorer(path, known))
        names = np.array(known.names, dtype=object)
        for pdf in batches:
            whole = [t if t is not None else "" for t in pdf["text"]]
            for lo, hi in slices(whole):
                total, lettered = scorer.score(whole[lo:hi])
                part = pdf.iloc[lo:hi][list(keep)]
                if not len(names):
                    yield part.assign(lang_pred="und", score=0.0)
                    continue
                best = total.argmax(axis=1)
                top = total[np.arange(len(total)), best]
                score = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
                yield part.assign(lang_pred=np.where(lettered, names[best], "und"), score=np.where(lettered, score, 0.0))
        release()

    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_frames(picked, run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, path: str, sample_docs: int = 2000) -> DataFrame:
    """Learn from the rows outside the held-out fold, then doc_id, held_out, lang_pred, score of all rows."""
    docs = docs.withColumn("held_out", fold(F.col("doc_id")) == 2)
    languages = learn(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"), path, sample_docs)
    return predict(docs, languages, path, ("doc_id", "held_out"))
