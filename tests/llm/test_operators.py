import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from latticework.llm import chat, fingerprint, langid, lines, minhash, native, pii, repeats, vectors

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def components_of(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_chat_round_trip(spark):
    odd = "<|im_end|>\n<|im_start|>assistant & &lt;| &amp; é😀"
    rows = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 2, "assistant", odd), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "us\ner", "x")]
    df = spark.createDataFrame([(*r, "extra", 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, body string, attachments int, turns string")
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 * len(odd)
    assert got[1]["loss_sha256"] == hashlib.sha256((odd * 2).encode()).hexdigest()
    turns = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:4])
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got[2]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"us\ner\nx\n").hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|", "ref": None, "units": None}, {"type": "image", "text": None, "ref": "a.png", "units": 2}, {"type": "audio", "text": None, "ref": "b.wav", "units": None}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert "see &lt;|<|image|><|audio|>" in r["formatted"] and [a["ref"] for a in r["attachments"]] == ["a.png", "b.wav"] and r["attachment_tokens"] == 2 * 256 + 50


def test_chat_ties_follow_the_raw_text(spark):
    texts = ["<z", "<|", "&", "&a", "a" * 20000]
    df = spark.createDataFrame([(1, 0, "assistant", t) for t in texts] + [(1, 0, "&", "x"), (1, 0, None, "y")], "conv_id bigint, turn bigint, role string, text string")
    want = [("", "y"), ("&", "x"), *(("assistant", t) for t in sorted(texts))]
    got = chat.digests(chat.format_conversations(df)).first()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(sorted(texts)).encode()).hexdigest()


def test_chat_query_uses_no_python_rows(spark, tmp_path):
    from latticework.llm import queries

    spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op10_chat_format(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in plan and "Python" not in plan and {r["conv_id"]: r["n_turns"] for r in out.collect()} == {1: 1, -1: 2}


def test_native_arrays(spark):
    rng = random.Random(9)
    rows = []
    for i in range(6):
        text = "".join(rng.choice("ab é😀\n") for _ in range([0, 10, 1024, 1025, 3000, 9000][i]))
        spans = sorted((a, min(len(text), a + rng.randint(1, 30)), rng.choice("xy")) for a in (rng.randrange(len(text)) for _ in range([0, 2, 40, 40, 700, 1500][i])))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:bigint,end:bigint,kind:string>>")
    out = df.select("i", native.running(F.transform("s", lambda s: s["end"] - s["start"])).alias("at"), F.when(F.size("s") > 0, native.replace_spans(F.col("t"), F.col("s"), F.char_length("t").cast("bigint"))).otherwise(F.col("t")).alias("new"))
    got = {r["i"]: r for r in out.collect()}
    for i, text, spans in rows:
        at, sums = 0, []
        for a, b, _ in spans:
            sums.append(at)
            at += b - a
        new, end, merged = "", 0, []
        for a, b, k in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, k])
        for a, b, k in merged:
            new += text[end:a] + f"[{k.upper()}]"
            end = b
        assert got[i]["at"] == sums and got[i]["new"] == new + text[end:]


def test_chat_text_goes_through_the_visitor(spark, monkeypatch):
    seen, visit = [], chat.visit
    monkeypatch.setattr(chat, "visit", lambda p, units: seen.append(p) or visit(p, units))
    df = spark.createDataFrame([(1, 0, "user", "a <| b"), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(df)
    assert seen and out.columns == ["conv_id", "formatted", "loss"] and "a &lt;| b" in out.first()["formatted"]


def test_line_dedup(spark):
    rows = [(i, f"menu\nown {i}\n\nmenu", "h") for i in range(10)] + [(20, "menu\nother", "g"), (21, None, "h"), (22, "menu", None), (23, "", "h")]
    rows += [(30 + i, "copied prose", "h") for i in range(10)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, n_kept int")
    for most in (lines.BROADCAST_LINES, 0):
        lines.BROADCAST_LINES, kept = most, lines.BROADCAST_LINES
        got = {r["doc_id"]: r for r in lines.line_dedup(df, ratio=0.5, min_pages=3).collect()}
        lines.BROADCAST_LINES = kept
        assert got[3]["text"] == "own 3\n" and got[3]["n_removed"] == 2 and got[3]["n_lines"] == 4 and got[3]["n_kept"] == 5
        assert got[20]["text"] == "menu\nother" and got[21]["text"] is None and got[22]["text"] == "menu" and got[23]["text"] == "" and got[35]["text"] == "copied prose"
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, f"menu\nown {i}", "h", -1, "a", "b", "c") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, N_LINES int, row string, __drop string, __host string")
    out = lines.line_dedup(df)
    assert out.columns == ["doc_id", "text", "source", "N_LINES", "row", "__drop", "__host", "n_removed"]
    assert {tuple(r)[1:] for r in out.where("doc_id = 3").collect()} == {("own 3", "h", 2, "a", "b", "c", 1)}
    long = spark.createDataFrame([(1, "x\n" * 50_000 + "y", "h")], "doc_id bigint, text string, source string")
    assert lines.line_dedup(long).first()["n_lines"] == 50_001


def brute_pii(t):
    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_against_patterns(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c", "a@b.co_m@c.de.f", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 41111111111111111111", "é😀 a.b@c.d.e. +123456789.", "0" * 30 + ".1.2.3", "5--4111111111111111", "a" * 3000 + "@b.c", "1" * 6000, "a@" + "b." * 4000 + "c"]
    texts += ["".join(rng.choice(["1", "2", "4", "5", ".", "-", " ", "@", "a", "b", "+", "(", ")", "_", "é", "😀", "\n", "411", "1111", ".1"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string").withColumn("own", F.lit("o")).withColumn("row", F.lit("r")).withColumn("t", F.lit("t"))
    model = pii.learn(df)
    assert pii.find(df, model).columns == df.columns
    got = {r["doc_id"]: r for r in pii.digests(pii.find(df, model)).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_pii(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.PiiModel({}, {})).where("own = 'o' and row = 'r' and t = 't' and spans = 'x'").collect()}
    assert len(red) == len(texts)
    assert red[0] is None and red[2] == "[EMAIL]" and red[7] == "é😀 [EMAIL]. [PHONE]."
    assert pii.digests(pii.find(df.limit(0), pii.learn(df.limit(0)))).count() == 0


def test_pii_wider_forms(spark):
    rng = random.Random(5)

    def card(ok):
        d = [4, *(rng.randrange(10) for _ in range(14))]
        d.append(next(x for x in range(10) if (sum(y if i % 2 == 0 else y * 2 - 9 * (y > 4) for i, y in enumerate(reversed([*d, x]))) % 10 == 0) == ok))
        return ".".join("".join(map(str, d[i : i + 4])) for i in range(0, 16, 4))

    def n(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    kinds = [
        lambda: ("phone", f"({n(3)}) {n(3)}-{n(4)}", True), lambda: ("phone", f"{n(3)}-{n(3)}-{n(4)}", True), lambda: ("phone", f"{n(2)}-{n(3)}-{n(3)}", False),
        lambda: ("card", card(True), True), lambda: ("card", card(False), False), lambda: ("email", f"u{n(3)} [at] host{n(2)} [dot] org", True), lambda: ("email", f"u{n(3)} [at] host{n(2)}", False),
    ]
    made = [rng.choice(kinds)() for _ in range(1500)]
    df = spark.createDataFrame([(i, f"see {v} for more words") for i, (_, v, _) in enumerate(made)], "doc_id bigint, text string")
    model = pii.learn(df)
    assert set(model.report) == {"email", "card", "phone", "secret"} and all(n > 50 and p >= 0.98 and r >= 0.95 for n, p, r in model.report.values())
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find(df, model)).collect()}
    for i, (k, v, ok) in enumerate(made):
        assert got[i] == (f"{k}:4:{4 + len(v)}" if ok else ""), v
    one = spark.createDataFrame([(0, "pay 4111 1111 1111 1111 now")], "doc_id bigint, text string")
    assert pii.digests(pii.find(one, pii.learn(df))).first()["spans"] == "card:4:23"


def test_pii_learns_from_every_text(spark, monkeypatch):
    rng = random.Random(11)
    texts = [f"{i} {'é' * rng.randrange(40)} u{i}@host{i % 7}.org, +{rng.randrange(10**9, 10**10)} and 4111 1111 1111 {rng.randrange(1000, 10000)} é" for i in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.learn(df)
    # a third of 5000 addresses with the two planted in each text, of 5000 numbers with three, of 5000 cards with three
    for kind, each in (("email", 3), ("phone", 4), ("card", 4)):
        assert abs(model.report[kind][0] - each * 5000 / 3) < 0.05 * each * 5000 / 3, kind
    again = pii.learn(df.union(df).repartition(7))
    assert again.thresholds == model.thresholds and again.report == model.report
    assert {k: (m.base, m.trees) for k, m in again.trees.items()} == {k: (m.base, m.trees) for k, m in model.trees.items()}
    monkeypatch.setattr(pii, "IN_MEMORY", 0)
    spread = pii.learn(df)
    assert spread.report == model.report
    for k, m in model.trees.items():
        assert [t[:2] for t in spread.trees[k].trees] == [t[:2] for t in m.trees], k
        for a, b in zip(spread.trees[k].trees, m.trees):
            assert np.allclose(a[2:], b[2:], atol=1e-6), k


def test_pii_examples_are_all_counted(spark):
    filler = "word " * 300
    texts = [f"{filler}call +1 (415) 555-26{i % 10}{i % 7}.x {filler}ip: 10.0.0.{i}, 1.2.3.{i + 200} {'é' * i}a@b{i}.c {filler}" for i in range(100)] + [None, "", "a@b.c " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    every = pii.examples(df, "text")
    t, s = F.col("text"), F.col("s")
    spans = F.concat(*[pii._located(t, pii.PATTERNS[k], pii.NEEDS[k], k, True) for k in pii.KINDS])
    whole = df.select("doc_id", t.alias("t"), F.explode(spans).alias("s")).select("doc_id", s["kind"].alias("kind"), F.expr(pii.FEATURE_VECTOR).alias("x"), s["base"].cast("double").alias("y"))
    want = Counter((r["kind"], tuple(r["x"]), r["y"]) for r in whole.collect())
    got = Counter()
    for r in every.collect():
        got[r["kind"], tuple(r["x"]), r["y"]] += r["n"]
    assert sum(want.values()) == 3400 and all(got[k] >= n for k, n in want.items())
    kinds = Counter()
    for (k, _, _), n in (got - want).items():
        kinds[k] += n
    assert kinds["email"] <= 2 * 102 and kinds["ip"] == 0 and 3 * 102 >= kinds["secret"] > 2 * 102


def test_pii_spans_end_where_the_token_ends(spark):
    rng = random.Random(7)
    token = "".join(rng.choice("ABCDEFabcdef0123456789_-") for _ in range(300))
    texts = [f"token={token} end", f"key: {token * 50} end", f"{'n' * 70} [at] {'h' * 80} [dot] {'o' * 70} end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"]) for s in got[i]] == [(0, len(t) - 4)]
    every = pii.PiiModel({"secret": pii.Boosted().fit(np.zeros((0, 1)), np.zeros(0))}, {"secret": 0.0})
    assert [r["text"] for r in pii.redact(df.limit(2), every).orderBy("doc_id").collect()] == ["[SECRET] end"] * 2


def test_boosted_column_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = pii.Boosted().fit(x, y)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, x array<double>")
    got = [r[0] for r in df.orderBy("i").select(F.expr(m.sql("x"))).collect()]
    assert np.allclose(got, m.predict(x))


def test_language_scores_sum_all_segmentations():
    import math

    rng = np.random.default_rng(0)
    m = langid.model(MODEL)
    known = langid.Languages(["a", "b"], np.log(rng.random((len(m.width), 2)) / len(m.width)), -15.0)
    s = langid.Scorer(MODEL, known)
    pieces = {m.lib.id_to_piece(i): i for i in range(259, len(m.width))}

    def brute(w, k):
        total = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                if w[i:j] in pieces:
                    total[j] += total[i] * math.exp(known.logp[pieces[w[i:j]], k])
            if w[j - 1] not in pieces:
                total[j] += total[j - 1] * math.exp(known.unknown)
        return math.log(total[-1])

    texts = ["hello world", "Straße  über 日本 x", "12 !!", ""]
    got, letters = s.score(texts)
    for t, row in zip(texts[:3], got):
        assert np.allclose(row, [brute("▁" + t.lower().replace(" ", "▁"), k) for k in (0, 1)])
    assert letters.tolist() == [True, True, False, False]
    assert np.allclose(s.score(["a" * 500, *texts])[0][1:], got)
    long = ["thelongest" * 12 + "é日" + "of" * 30, "a" * 49, "日" * 60 + "words" * 20, "x" * 3000]
    for t, row in zip(long, s.score(long)[0]):
        assert np.allclose(row, [brute_scaled("▁" + t, k, pieces, known) for k in (0, 1)])
    assert np.allclose(s.score(long)[0], s.score(long)[0])


def brute_scaled(w, k, pieces, known):
    """The sum over all segmentations in logarithms, as long words leave the range of doubles."""
    total = [0.0] + [-np.inf] * len(w)
    for j in range(1, len(w) + 1):
        terms = [total[i] + known.logp[pieces[w[i:j]], k] for i in range(max(0, j - 20), j) if w[i:j] in pieces]
        if w[j - 1] not in pieces:
            terms.append(total[j - 1] + known.unknown)
        total[j] = np.logaddexp.reduce(terms)
    return total[-1]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "123 !!", None), (None, "the and of", "en")], "doc_id bigint, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").union(more), MODEL)
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert joined.where("lang = lang_pred").count() >= 0.97 * joined.count()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.where("doc_id >= 1000000 or doc_id is null").collect()}
    assert odd[10**6] == ("und", 0.0) and odd[10**6 + 1] == ("und", 0.0) and None in odd
    none = langid.identify(more.limit(1), MODEL).first()
    assert none["lang_pred"] == "und"


def test_corpus_order_sorts_suffixes():
    rng = random.Random(8)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    for made in (lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 300))), lambda: base[rng.randint(0, 200):][: rng.randint(1, 200)], lambda: rng.choice([b"a" * 90, b"ab" * 40, b"\xff\0" * 30, bytes(rng.randrange(256) for _ in range(150))])):
        texts = [made() for _ in range(25)]
        data, end = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])
        begin = end - [len(t) for t in texts]
        # places whose suffix is longer than a trigger
        places = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
        order = places[repeats.corpus_order(data, begin, end, places)]
        text_of = np.searchsorted(end, order, side="right")
        suffix = [bytes(data[p : end[i]]) for p, i in zip(order, text_of)]
        assert suffix == sorted(suffix)


@pytest.mark.parametrize("forks", [4096, 2])
def test_repeats_against_brute_force(spark, forks, monkeypatch):
    monkeypatch.setattr(repeats, "FORKS", forks)
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(260))
    docs = [(k, "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 300))) + shared[rng.randint(0, 40):] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))) for k in range(40)]
    docs += [(100, "a" * 1000), (101, "ab" * 150), (102, None), (103, ""), (104, "x" * 199), (105, "y" * 200), (106, "z" * 201), (107, shared), (107, shared)]
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[p : p + 200] for _, r in raw for p in range(len(r) - 199))
    got = defaultdict(list)
    for r in repeats.remove_repeats(spark.createDataFrame([(*d, "e") for d in docs], "doc_id bigint, text string, k string")).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    for i, r in raw:
        m = np.zeros(len(r), dtype=bool)
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                m[p : p + 200] = True
        keep = np.frombuffer(r, dtype=np.uint8)[~m].tobytes()
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert (len(r), int(m.sum()), runs, hashlib.sha256(keep).hexdigest()) in got[i]
    assert len([x for v in got.values() for x in v]) == len(docs)


def test_sides_grow_with_the_vectors():
    assert [vectors.sides(n) for n in (0, 4096 * 2**8, 4096 * 2**8 + 1, 4096 * 3**8 + 1)] == [2, 2, 3, 4]


@pytest.mark.parametrize("count", [2, 3, 5])
def test_cells_reach_every_near_vector(count):
    """Every pair within the budget stands in, or visits, a common cell of the first block that holds its share."""
    rng = np.random.default_rng(count)
    base = rng.standard_normal((40, 64))
    unit = np.repeat(base, 5, axis=0) + 0.1 * rng.standard_normal((200, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ vectors.rotation(64)
    cuts = np.quantile(turned, np.arange(1, count) / count, axis=0).T
    stand = defaultdict(dict)
    for b, row, cell, visits in vectors.cells(unit, cuts, 0.04):
        for r, c, v in zip(row.tolist(), cell.tolist(), visits.tolist()):
            stand[b, r][c] = v
    x, y = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    assert len(x) > 100
    for u, v, b in zip(x.tolist(), y.tolist(), vectors._first_block(turned[x] - turned[y], 0.04).tolist()):
        common = [c for c in stand[b, u] if c in stand[b, v] and not (stand[b, u][c] and stand[b, v][c])]
        assert len(common) == 1


@pytest.mark.parametrize("tile, count", [(4096, 2), (20, 2), (20, 3)])
def test_vectors_against_brute_force(spark, tile, count, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "sides", lambda rows: count)
    rng = np.random.default_rng(0)
    base = rng.standard_normal(64)
    rows = [(k, [float(x) for x in base + rng.standard_normal(64) * rng.choice([0, 0.05, 0.15, 0.2])], int(k % 2)) for k in range(120)]
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, rows[0][1], None), (1006, [1.0, 2.0, 3.0], 2), (1007, [2.0, 4.0, 6.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    v = np.array([np.array(r[1], dtype="f4").astype(float) for r in rows[:120]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.98) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2)
    np.fill_diagonal(link, False)
    comp = components_of([r[0] for r in rows], [*zip(*np.nonzero(link)), (1006, 1007)])
    for i, *_ in rows:
        n = int(link[i].sum()) if i < 120 else int(i in (1006, 1007))
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, comp[i], comp[i] == i)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "é😀"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs += [(100, ""), (101, None), (102, "abc"), (103, docs[0][1])]
    got = {r["doc_id"]: r for r in fingerprint.with_next(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(got) == len(docs)
    for j, (i, t) in enumerate(docs):
        t, n = t or "", docs[(j + 1) % len(docs)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        f = fingerprint.fingerprint
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), f(t), f(e), fingerprint.likeness(f(t), f(e)), fingerprint.likeness(f(t), f(n)))
        assert tuple(got[i])[1:] == want
    for j, (i, t) in enumerate(docs):  # naive: all spans as strings, common beginnings by characters
        t, n = t or "", docs[(j + 1) % len(docs)][1] or ""
        a, b = ({x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in (t, n))
        share = 2 * len(a & b) / (len(a) + len(b)) if t or n else 1.0
        assert abs(got[i]["near_next"] - share) < 0.35 if t != n else got[i]["near_next"] == 1.0
        assert got[i]["near_edited"] >= 0.65 or len(t) < 200
    h = fingerprint.PrefixHashes(fingerprint._code("abcabcabd"))
    assert h.common_extension(0, 3) == 5 and h.common_extension(0, 1) == 0 and h.same(0, 3, 3)
    text = "".join(rng.choice("abc") for _ in range(3000))
    for cut in (0, 15, 16, 500, 2999):
        other = text[:cut] + "Z" + text[cut + 1 :]
        x, y = (fingerprint.Print.read(fingerprint.fingerprint(v)) for v in (text, other))
        g = fingerprint.rungs(3000)
        first, last = (max([int(v) for v in g if v <= m], default=0) for m in (cut, 2999 - cut))
        assert fingerprint._ends_alike(x, y) == 2 * (first + last) / 6000 and fingerprint.likeness(str(x), str(y)) >= 0.8
    assert fingerprint.with_next(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    one = fingerprint.with_next(spark.createDataFrame([(7, "some text")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


@pytest.mark.parametrize("n", range(7))
def test_short_texts_have_sets(n):
    for texts in ([" ".join("abcdefg"[:n])], ["long " * 3000, " ".join("abcdefg"[:n])], [" ".join("abcdefg"[:n]), "", "x"]):
        values, counts = minhash.shingle_sets(texts)
        want = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)) for w in (t.split() for t in texts)]
        assert counts.tolist() == want and len(values) == sum(want)


def test_short_tables(spark):
    df = spark.createDataFrame([(7, "a b")], "doc_id bigint, text string")
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(7, 1, 7, True)]


def test_words_in_other_order_differ():
    a, b = "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096
    values, counts = minhash.shingle_sets([a, b])
    assert values[0] != values[1]


def test_ids_stay_exact_beside_nulls(spark):
    from latticework.llm import packing, piece

    ids = [2**60 + 1, None, 2**60 + 2]
    df = spark.createDataFrame([(i, "some words of a text that is here", "en", "clash", 1) for i in ids], "doc_id bigint, text string, lang string, held_out string, k int")
    words = public_tokenizers.path("word_bpe_49k.json")
    for out in (piece.round_trip_digests(df, MODEL), piece.encode_documents(df, MODEL), packing.pack_documents(df, words), langid.identify(df, MODEL), repeats.remove_repeats(df), fingerprint.with_next(df), fingerprint.fingerprint_documents(df), minhash.near_duplicates(df)):
        assert {r["doc_id"] for r in out.collect()} == set(ids), out.columns
    kept = langid.predict(df, langid.learn(df, MODEL), MODEL, ("doc_id", "text", "k"))
    assert {(r["doc_id"], r["k"]) for r in kept.collect()} == {(i, 1) for i in ids}
    vec = spark.createDataFrame([(i, [1.0, 2.0], 1, "c") for i in ids], "vec_id bigint, embedding array<float>, label int, node string")
    assert {(r["vec_id"], r["component_id"]) for r in vectors.near_duplicates(vec).collect()} == {(2**60 + 1, 2**60 + 1), (2**60 + 2, 2**60 + 1), (None, None)}


def test_frames_are_bounded_in_bytes(spark):
    from latticework.llm import runtime

    df = spark.range(300).coalesce(1).selectExpr("id", "repeat('x', 100000) AS t")
    before = dict(spark.conf.getAll)
    sizes = runtime.map_frames(df, lambda it: ({"n": [len(f)]} and __import__("pandas").DataFrame({"n": [len(f)]}) for f in it), "n bigint").collect()
    assert sum(r["n"] for r in sizes) == 300 and max(r["n"] for r in sizes) <= 42 and dict(spark.conf.getAll) == before


def test_minhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = random.Random(2)
    base = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) + str(rng.randint(0, 30)) for _ in range(80)) for _ in range(4)]
    docs = []
    for k in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"X{rng.randint(0, 10**6)}"
        docs.append((k, " ".join(w)))
    docs += [(1000, ""), (1001, None), (1002, "A b"), (1003, "a  B\n"), (1004, " \t "), (1005, "a b c d e"), (1006, "a b c d"), (None, "a b")]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in docs if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components_of(sets, pairs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert got[None]["component_id"] is None
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    k = minhash.sketches(*minhash.shingle_sets([base[0], base[0] + " more", "one"]), 128)
    assert 0.8 < (k[0] == k[1]).mean() <= 1 and (k[2] != 2**64 - 1).all()


def test_crowded_buckets_meet_across_components_once(spark):
    """A crowd in one component is sent once a block of outsiders; every pair across components meets in exactly one block."""
    tiles = [("a", 7, 3, 2), ("b", None, None, None)]
    member = [("a", i, 7) for i in range(60)] + [("a", 100 + i, 8 + i % 5) for i in range(12)] + [("b", 200 + i, i // 2) for i in range(6)]
    rows = spark.createDataFrame(member, "bucket string, node bigint, component bigint")
    crowded = spark.createDataFrame(tiles, "bucket string, main bigint, mains int, others int")
    got = minhash._dealt(rows.join(crowded, "bucket", "left")).collect()
    assert Counter(r["node"] for r in got if r["component"] == 7 and r["bucket"] == "a") == Counter({i: 2 for i in range(60)})
    blocks = defaultdict(list)
    for r in got:
        blocks[r["bucket"], min(r["tile"], r["other"]), max(r["tile"], r["other"])].append(r)
    met = Counter()
    for (_, i, j), held in blocks.items():
        left, right = [r for r in held if r["tile"] == i], [r for r in held if r["tile"] == j]
        met.update({(min(u["node"], v["node"]), max(u["node"], v["node"])) for u in left for v in right if u["component"] != v["component"]})
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in member for y in member if x[0] == y[0] and x[2] != y[2]}
    assert met == Counter(dict.fromkeys(want, 1))
