import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import flat, packing, piece

ODD = ["", "  ", " a", "a  b ", "x▁y", "\n", "\n\n a\n", "日本語 テスト", "a\tb", "é́ e", "<s> </s> <unk> <0x0A>", "a" * 500, " " * 300, "😀😀 😀", "a\0b", "  x", "ﬁ Å", "\n" + "q" * 200, "don't I'll", "İstanbul ΑΣ", "<|endoftext|> a<|startoftext|>b", "a1b22--c"]
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pieces():
    return piece.PieceModel(MODEL)


@pytest.fixture(scope="module")
def words():
    return packing.WordTokens(WORDS)


def noise(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_pieces_equal_the_library(pieces):
    texts = ODD + noise(" \nabcdé▁日<>0xA😀the", 300, 1)
    want = pieces.lib.encode(texts)
    assert pieces.encode(texts) == want
    ids, ends = pieces.encode_flat(texts)
    assert [b.decode() for b in pieces.decode_flat(ids, ends)] == [pieces.lib.decode(w) for w in want]


def test_spans_cover_the_text(pieces):
    texts = ODD + ["Hé llo\nwörld 日x▁ ▁y"]
    ids, ends, spans = pieces.encode_aligned(texts)
    for t, a, b in zip(texts, [0, *ends[:-1]], ends):
        s = spans[a:b]
        if b > a:
            assert s[0, 0] == 0 and s[-1, 1] == len(t.encode()) and (s[1:, 0] == s[:-1, 1]).all()
            assert b"".join(t.encode()[x:y] for x, y in s) == t.encode()
            assert (s == pieces._spans(t, ids[a:b])).all()


def test_long_words_are_told_apart(pieces, words):
    texts = [x + "c" for x in ("a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "a" * 70000 + "b" * 70000, "b" * 70000 + "a" * 70000)]
    assert pieces.encode(texts) == pieces.lib.encode(texts)
    assert words.encode(texts) == [e.ids for e in words.lib.encode_batch(texts, add_special_tokens=False)]


def test_words_that_share_a_hash_stay_apart(pieces, monkeypatch):
    monkeypatch.setattr(flat, "word_hashes", lambda symbols, starts, lengths: (lengths % 2).astype(np.uint64))
    own = piece.PieceModel(MODEL)
    texts = ODD + noise("ab cdé", 50, 4)
    assert own.encode(texts) == pieces.lib.encode(texts) and own.encode(texts[::-1]) == pieces.lib.encode(texts[::-1])


def test_all_documents_equal_the_libraries(pieces, words):
    from pyarrow import parquet

    texts = [t or "" for t in parquet.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert pieces.encode(texts) == pieces.lib.encode(texts)
    assert words.encode(texts) == [e.ids for e in words.lib.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def mapped(tmp_path_factory, normalisers):
    """The public model with a compiled map put in."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, rules = pb.ModelProto(), pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    rules.ParseFromString(normalisers[0].serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    return piece.PieceModel(str(path))


def test_bulk_path_walks_the_compiled_map(mapped):
    assert mapped.bulk and mapped.normalize.map.units
    texts = [t for t in ODD if "\0" not in t] + ["ﬁn ① ㍿ Å e\u0301 ｱｲｳ ﷺ", "", "½\u200b\u00adx"] + noise("ﬁ①Å é\u0301aｱ\u3000\tb㍿", 200, 6)
    ids, ends, spans = mapped.encode_aligned(texts)
    want = mapped.lib.encode(texts)
    for t, w, a, b in zip(texts, want, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == w, t
        assert (spans[a:b] == mapped._spans(t, ids[a:b])).all(), t


@pytest.fixture(scope="module")
def normalisers():
    """The library's own normaliser with a built-in compiled map, and ours on the same map."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    return lib, piece.Normalizer(proto.normalizer_spec.precompiled_charsmap, True, True, True)


def test_longest_prefix_normalisation(normalisers):
    lib, ours = normalisers

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=30))
    def check(text):
        got, src = ours(text)
        assert got == lib.normalize(text)
        assert len(src) == len(got.encode()) + 1 and (np.diff(src) >= 0).all() and src[-1] <= len(text.encode())

    check()


def test_words_equal_the_library(words):
    texts = ODD + noise(" \nabcdé▁日<|>0'sxAÉß.,😀the\t", 400, 2)
    assert words.encode(texts) == [e.ids for e in words.lib.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_bins():
    rng = random.Random(3)
    for most in (1, 4, 4096):
        bins, fill = packing.OpenBins(100, most), {}
        for _ in range(2000):
            n = rng.randint(1, 100)
            b, at = bins.place(n)
            assert at == fill.get(b, 0) and at + n <= 100
            fill[b] = at + n
            assert bins.open <= most
    assert sum(fill.values()) / 100 > 0.9 * len(fill)


def test_pack_documents(spark):
    texts = [None, "", "hello world", "hello world", "word " * 5000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "y")], "doc_id bigint, text string, piece string")
    got = packing.pack_documents(df, WORDS, keep_ids=True).collect()
    tok = packing.tokens(WORDS)
    for i, t in enumerate(texts):
        ids = tok.encode([t or ""])[0] + [0]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 2048)) and sum(r["length"] for r in mine) == len(ids)
        raw = np.array(ids, dtype="<u4").tobytes()
        assert b"".join(r["ids"] for r in mine) == raw and mine[0]["ids_crc32"] == zlib.crc32(raw[:8192])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def test_round_trip_query(spark, pieces):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello\nworld é"), (3, "hello\nworld é")], "doc_id bigint, text string")
    assert piece.round_trip_digests(df.limit(0), MODEL).count() == 0
    got = sorted(piece.round_trip_digests(df, MODEL).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(got, ["", "", "hello\nworld é", "hello\nworld é"]):
        ids = pieces.lib.encode(t)
        assert r["n_tokens"] == len(ids) and r["covered"] == len(t.encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(pieces.lib.decode(ids).encode()).hexdigest()
    full = piece.encode_documents(df, MODEL)
    assert {tuple(r["ids"]) for r in full.collect()} == {(), tuple(pieces.lib.encode("hello\nworld é"))}
    assert sorted(r["text"] for r in piece.decode_documents(full, MODEL).collect()) == ["", "", "hello\nworld é", "hello\nworld é"]
