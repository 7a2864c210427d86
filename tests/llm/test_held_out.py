"""Held-out accuracy of the two classifiers on the given tables, and the whole pipeline against plain Python."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import queries

SMALL = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not there")


@given
def test_language_of_held_out_texts(spark):
    out = queries.op7_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 200 and r.a >= 0.98


@given
def test_toxicity_of_held_out_texts(spark):
    big = "/root/testdata/sf0.1"
    out = queries.op9_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    r = out.groupBy("toxic").agg(F.avg(F.col("predicted").cast("double")).alias("a"), F.count("*").alias("n")).collect()
    rate = {x.toxic: x.a for x in r}
    assert rate[1] >= 0.8 and rate[0] <= 0.02


def plain_pipeline(rows, items):
    """The stages after language identification, by plain Python: (doc_id, ids_sha256)."""
    from tokenizers import Tokenizer

    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    for _ in range(10):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = min(least[i], least[j])
    kept = {i: t for i, t in rows if least[i] == i}
    data, w = {i: t.encode() for i, t in kept.items()}, 240
    seen = collections.Counter(b[k : k + w] for b in data.values() for k in range(len(b) - w + 1))
    cut = {}
    for i, b in data.items():
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - w + 1):
            if seen[b[k : k + w]] > 1:
                gone[k : k + w] = True
        cut[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    bad = set()
    for item in map(words, items):
        n = min(10, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        bad |= {i for i, t in cut.items() if any(tuple(words(t)[k : k + n]) in windows for k in range(len(words(t)) - n + 1))}
    from provenir.llm.queries import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path())
    return {(i, hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in cut.items() if i not in bad}


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(3)
    text = lambda n, k: " ".join("".join(random.Random(k * 1000 + j).choice("abcdeéghij") for _ in range(random.Random(k * 77 + j).randint(2, 6))) for j in range(n))
    passage, item = text(60, 900), text(14, 901)
    rows = [(i, f"{text(80, i)} {passage if i % 4 == 0 else ''} {text(30, 500 + i)} {item if i % 9 == 1 else ''}") for i in range(24)]
    for k in range(8):  # near copies
        w = rows[k][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "kurz"), (203, "É " * 300)]
    full = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in rows]
    extra = [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, "123 !!", None, "s", 6)]
    spark.createDataFrame(full + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.ids_sha256) for x in p.run(spark, str(tmp_path)).collect()}
    assert got == plain_pipeline(rows, [item])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as p

    text = lambda n, k: " ".join("".join(random.Random(k * 1000 + j).choice("abcdefghij") for _ in range(5)) for j in range(n))
    names = ["_said", "_id", "_hash", "_cut", "gone", "id_hash", "a b", "x.y"]
    d = spark.createDataFrame([(i, text(60, i), "en", "s", 300) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.select("*", *[F.lit(c).alias(c) for c in names])
    spark.createDataFrame([(1, text(12, 50))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in (p.STAGES[0], p.STAGES[2], p.STAGES[3]):  # the join's are among the operators' tests
        d2 = stage(spark, d, str(tmp_path))
        assert d2.columns == d.columns and d2.count() == 4
