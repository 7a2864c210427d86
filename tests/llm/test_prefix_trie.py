"""The trie of beginnings against brute force: copies, deep shared lines, odd turns, ids and columns, empty tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from provenir.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, node string, `a b` string"


def sequences(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            d = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
            by.setdefault(c, []).append(((t is not None, t or 0, d), (r, x)))
    return {c: [s for _, s in sorted(v, key=lambda k: k[0])] for c, v in by.items()}


def rebuilt(own):
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def brute(convs):
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in members.items():
        under = [n for n in members if n[: len(k)] == k]
        children = [n for n in under if len(n) == len(k) + 1]
        leaves = [n for n in under if not any(o[: len(n)] == n and len(o) == len(n) + 1 for o in under)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda t: (t[0], t[1]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: (t[0], t[1]))


def made(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 60, 61, 63, 90]:
        for t in range(r.randrange(0, 14)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["é", "b", "", None, "cc"]), "x", "y", "z"))
    return rows + [(None, 1, "user", "lost", "x", "y", "z")] + [(7, 3, "user", "again", "x", "y", "z")] * 3


def test_rebuilt_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        turns, lengths = prefixtrie.rebuilt(prefixtrie.numbered(spark.createDataFrame(rows, SCHEMA)), 5, 9)
        assert got(prefixtrie.trie(turns, lengths)) == brute(rebuilt(sequences(rows)))


@pytest.mark.parametrize("band", [2, 3])
def test_deep_lines_over_many_bands(spark, monkeypatch, band):
    monkeypatch.setattr(prefixtrie, "BAND", band)
    monkeypatch.setattr(prefixtrie, "HOT", 3)
    monkeypatch.setattr(prefixtrie, "ENDS", 2)
    monkeypatch.setattr(prefixtrie, "PIECE", 4)
    r = random.Random(band)
    line = [("user", "w" * r.randrange(4)) for _ in range(40)]
    convs = {c: line[: r.choice([5, 20, 33, 40])] + [("user", f"end {r.randrange(3)}")] * r.randrange(3) for c in range(30)} | {c: line for c in range(100, 112)}
    rows = [(c, i, *t, "", "", "") for c, v in convs.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(prefixtrie.trie(*prefixtrie.plain(prefixtrie.numbered(df)))) == brute(sequences(rows))
    monkeypatch.setattr(prefixtrie, "MAX_BROADCAST", 0)
    assert got(prefixtrie.trie(*prefixtrie.plain(prefixtrie.numbered(df)))) == brute(sequences(rows))


def test_empty_one_and_turnless(spark):
    run = lambda rows: got(prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.numbered(spark.createDataFrame(rows, SCHEMA)), 5, 9)))
    assert run([]) == []
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(c, 0, "user", "only", "", "", "")]
    assert run(rows) == brute(rebuilt(sequences(rows))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert brute(rebuilt(sequences(made(1))))[0][2] is None


def test_long_text_counts_bytes(spark):
    big = "é" * 1_000_000
    df = spark.createDataFrame([(1, 0, "user", "", "", "", ""), (2, 0, "user", "", "", "", "")], SCHEMA).withColumn("text", F.repeat(F.lit("é"), 1_000_000))
    rows = got(prefixtrie.trie(*prefixtrie.plain(prefixtrie.numbered(df))))
    assert [t[6] for t in rows] == [len(big.encode())] * 2
