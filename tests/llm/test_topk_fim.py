"""Bit-sliced search and fill-in-middle against brute force, with their edges."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import fim, topk

VECTORS = "vec_id long, embedding array<float>, block int, `a b` string"


def brute(rows, k, every):
    ok = [(i, np.floor(np.array(np.array(v, np.float32), np.float64) * 1024).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            best = sorted((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def searched(spark, rows, k, every):
    df = spark.createDataFrame(rows, VECTORS)
    got = topk.search(topk.index(df), df.where(F.col("vec_id") % every == 0), k)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize(("block", "slices", "weight"), [(64, 3, 2), (100, 6, 5), (1 << 14, 1, 1), (70, 40, 40)])
def test_search_equals_brute_force(spark, monkeypatch, block, slices, weight):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLICES", slices)
    monkeypatch.setattr(topk, "WEIGHT", weight)
    monkeypatch.setattr(topk, "GROUP", 7)
    r = np.random.default_rng(block)
    rows = [(int(i), r.normal(0, 0.2, 16).tolist(), 1, "x") for i in r.permutation(700)]
    rows += [(1000 + i, rows[i % 3][1], 1, "x") for i in range(60)]  # ties
    rows += [(2000 + i, r.normal(0, 3, 5).tolist(), 1, "x") for i in range(40)] + [(3000, [1e5] * 16, 1, "x"), (3010, [0.0] * 16, 1, "x")]
    rows += [(4000, None, 1, "x"), (4010, [1.0, None], 1, "x"), (4020, [float("nan")] * 16, 1, "x"), (4030, [float("inf")] * 16, 1, "x"), (None, [0.1] * 16, 1, "x")]
    rows += [(5000, [], 1, "x"), (5010, [], 1, "x"), rows[0], rows[0]]
    assert searched(spark, rows, 10, 10) == brute(rows, 10, 10)
    assert searched(spark, rows[:4], 10, 1) == brute(rows[:4], 10, 1)


def test_equal_vectors_all_reach_the_boundary(spark):
    rows = [(i, [0.25, -0.5, 0.125], 1, "x") for i in range(300)]
    assert searched(spark, rows, 3, 100) == brute(rows, 3, 100)


def test_search_of_nothing_and_of_what_does_not_fit(spark):
    assert searched(spark, [], 5, 1) == []
    assert searched(spark, [(0, [1.0], 1, "x")], 5, 1) == []
    with pytest.raises(Exception, match="64 bits"):
        searched(spark, [(i, [1e10] * 4, 1, "x") for i in range(2)], 5, 1)


def cut(doc_id, text):
    text = text or ""
    n, hexed = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab<PSM>é€😀\n ") for _ in range(r.randrange(60)))) for i in range(600)]
    rows += [(None, "null id é"), (7000, None), (7001, ""), (7002, "é" * 300_000 + "a" * 300_000), (7003, "<<S"), (7004, "x<M>y"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("h0"), F.lit("x").alias("form"), F.lit("y").alias("fim"), F.lit(2).alias("a b"))
    done = fim.transform(df)
    assert done.columns == ["doc_id", "text", "h0", "form", "fim", "a b", "_fim"]
    back = fim.restore(done, "_fim").collect()
    want = sorted((d or -1, *map(str, cut(d, t))) for d, t in rows)
    assert sorted((x.doc_id or -1, *map(str, x._fim)) for x in back) == want
    assert all(x.restored.text == (x.text or "") and (x.restored.prefix_chars, x.restored.middle_chars) == (x._fim.prefix_chars, x._fim.middle_chars) for x in back)
    assert {x._fim.form for x in back} == {"plain", "psm", "spm"}


def test_fim_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(df)).collect() == []
