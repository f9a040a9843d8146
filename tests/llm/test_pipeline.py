def test_stages(spark):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"] and p.ORACLE_SQL is None
    copied = "the quick words of a text that is long enough to be kept by every stage of it all"
    rows = [(i, f"{copied} and then some more words with number {i} at the end of it", "en", f"s{i % 3}", 1) for i in range(8)]
    rows += [(20, copied, "en", "s0", 1), (21, copied, "en", "s1", 1), (22, None, None, None, None), (23, "12 34", "en", "s0", 1), (24, "write to a.b@c.org now please or call", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = []
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        out = stage(spark, docs, "")
        if name != names[-1]:
            assert out.columns == list(p.COLUMNS)
            docs = spark.createDataFrame(out.collect(), docs.schema)
            seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        else:
            assert {r["doc_id"] for r in out.collect()} == set(seen[-1])
    assert 22 not in seen[0] and 23 not in seen[0] and 0 in seen[0]
    assert 20 in seen[2] and 21 not in seen[2]
    assert seen[3][24] == "write to [EMAIL] now please or call"


def test_near_copies_keep_their_prose(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(11)

    def words(k):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(k))

    menu, passage = "menu of the site", [words(12) for _ in range(5)]
    rows = [(i, f"{menu}\n{words(40)}\n{words(20)}", "en", "s", 1) for i in range(120)]
    for i in range(60):
        lines = [x.split() for x in passage]
        lines[i % 5][i % 12] = f"changed{i}"
        rows.append((200 + i, "\n".join([menu, *(" ".join(x) for x in lines)]), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r["text"] for r in p.line_stage(spark, docs, "").collect()}
    for i, text, *_ in rows:
        assert out[i] == text.split("\n", 1)[1]
    left = {r["doc_id"]: r["text"] for r in p.near_duplicate_stage(spark, p.line_stage(spark, docs, ""), "").collect()}
    assert [(i, len(x.split("\n"))) for i, x in left.items() if i >= 200] == [(200, 5)] and len(left) == 121
