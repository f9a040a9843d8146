"""The operators' SQL on small tables with what the sample tables lack: links, nulls, short and multi-byte texts."""

import random

import numpy as np
import pandas as pd
import pytest

from latticework.llm import minhash, repeats, vectors

duckdb = pytest.importorskip("duckdb")


def agree(df, sql, name, source):
    c = duckdb.connect()
    c.register("held", source)
    c.execute(f"CREATE TABLE {name} AS SELECT * FROM held")
    cursor = c.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == want
    return [dict(zip(names, r)) for r in want]


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    made = [[float(np.float32(x)) for x in base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])] for _ in range(60)]
    rows = [(k, v, k % 2) for k, v in enumerate(made)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [1.0, float("nan")], 1), (103, [1.0, None], 1), (104, [], 1), (105, made[0], None), (106, [1.0, 2.0], 1), (107, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    import pyarrow as pa

    source = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": pa.array([r[2] for r in rows], pa.int32())})
    out = agree(vectors.near_duplicates(df), vectors.SQL, "embeddings", source)
    assert 10 < sum(r["n_links"] > 0 for r in out) < 62


def documents(texts):
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts})


def test_sets(spark):
    rng = random.Random(6)
    base = " ".join(f"W{rng.randint(0, 40)}" for _ in range(60))
    texts = [base, None, "", " \t\n", "a b", "A  b", "a b c d e", "É b c d e f", "é b c d e f", "x\x0by z q r\x0cs"]
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = str(rng.random())
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = agree(minhash.near_duplicates(df), minhash.SQL, "documents", documents(texts))
    assert 5 < sum(not r["kept"] for r in out) < 30


def test_repeats(spark):
    rng = random.Random(7)
    shared = "".join(rng.choice("abcdé 😀") for _ in range(900))
    texts = [None, "", "a" * 199, "b" * 200, "c" * 201, "ab" * 700, shared, shared[300:], "x" + shared[200:], "é" * 100, "é" * 101, "".join(rng.choice("abcd") for _ in range(3000)) + shared[:150] + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = agree(repeats.remove_repeats(df), repeats.SQL, "documents", documents(texts))
    assert {r["n_spans"] for r in out} >= {0, 1}
