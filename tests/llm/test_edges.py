"""Edges of the operators: nested and shared texts, clashing columns, empty tables, repeated rows, very long texts, decisions by strings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import bpe, decontaminate, embeddup, htmltext, langid, ngramjoin, substrings, toxicity, urlfilter, warc
from provenir.llm.queries import vocabulary_path

NAMES = ["_id", "_hash", "_spans", "_cut", "_gone", "_lang", "_read", "_stream", "id", "hash", "gone", "said", "kept", "runs", "spans", "id_hash", "text_hash", "a b", "x.y"]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def brute_components(rows, n, percent):
    table = {c: c + 32 for c in range(65, 91)}
    s = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        s.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}))
    least = {i: i for i, _ in s}
    for _ in range(len(s)):
        was = dict(least)
        for i, a in s:
            for j, b in s:
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    least[i] = min(least[i], least[j])
        if was == least:
            break
    return least


def test_nested_windows_keep_their_links(spark):
    b = words(14, 1).split()
    rows = [(1, b), (3, b[:12]), (6, b[3:12]), (20, b[4:]), (21, b[5:])]
    c = words(300, 2).split()
    rows += [(100 + 7 * k, c[k : k + 150]) for k in range(0, 60, 3)] + [(900, c[:200] + words(40, 3).split()), (901, words(40, 4).split() + c[:200])]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = {r.doc_id: r.component_id for r in ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)
    assert got[21] == got[20]


def test_families_of_near_copies(spark):
    r = random.Random(5)
    rows = []
    for f in range(6):
        base = words(120, 100 + f).split()
        passage = words(30, 7).split()
        for k in range(14):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = "".join(r.choice("klmnop") for _ in range(4))
            rows.append((1000 * f + k, " ".join(t + (passage if k % 3 == 0 else []))))
    rows += [(9000, rows[0][1]), (9000, rows[20][1])]  # one id, two texts
    old = ngramjoin.STAR, ngramjoin.COMMON
    try:
        ngramjoin.STAR, ngramjoin.COMMON = 500, 50
        got = {x.doc_id: x.component_id for x in ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    finally:
        ngramjoin.STAR, ngramjoin.COMMON = old
    assert got == brute_components(rows, 4, 85)


def wide(spark, rows, extra=NAMES):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id")).alias(c) for c in extra])


def test_columns_of_any_name_stay(spark):
    item = words(12, 1)
    rows = [(1, item + " " + words(80, 2)), (2, words(90, 3)), (3, words(90, 3)), (4, None)]
    d = wide(spark, rows)
    items = spark.createDataFrame([("a", item)], "item_id string, text string")

    def check(out, ids, more=()):
        assert out.columns == [*d.columns, *more]
        got = out.collect()
        assert sorted(r.doc_id for r in got) == ids
        for r in got:
            assert all(r[c] == f"{c}-{r.doc_id}" for c in NAMES if c not in more)

    check(decontaminate.decontaminate(d, items), [2, 3, 4])
    check(decontaminate.decontaminate(d, items, mode="spans"), [1, 2, 3, 4])
    check(ngramjoin.deduplicated(d), [1, 2, 4])
    check(substrings.deduplicated(d, 60), [1, 2, 3, 4])
    check(bpe.encode(d, vocabulary_path()), [1, 2, 3, 4], ["ids"])
    model = langid.train(d.withColumn("lang", F.lit("en")))
    check(langid.predict(d, model), [1, 2, 3, 4], ["lang_pred", "lang_score"])
    check(toxicity.predict(d, (np.zeros(0, np.int64), np.zeros(0), 0.0)), [1, 2, 3, 4], ["toxicity"])
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in NAMES])
    out = htmltext.main_text(pages)
    assert out.columns == ["page_id", "url", *NAMES, "text"] and all(r[c] == f"{c}-{r.page_id}" for r in out.collect() for c in NAMES)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    assert embeddup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert bpe.round_trip(d, vocabulary_path()).count() == 0
    assert urlfilter.filter_urls(pages, rules).count() == 0
    assert ngramjoin.link_components(d, 4, 85).count() == 0 and ngramjoin.deduplicated(d).count() == 0
    assert langid.predict(d, langid.train(d)).count() == 0
    assert substrings.report(d).count() == 0 and substrings.deduplicated(d).count() == 0
    assert toxicity.predict(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert htmltext.main_text(pages).count() == 0 and warc.round_trip(pages).count() == 0


def test_repeated_rows_repeat(spark):
    rows = [(1, words(80, 1)), (1, words(80, 1)), (2, words(30, 2)), (2, words(30, 2)), (None, words(30, 3)), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert bpe.round_trip(d, vocabulary_path()).count() == 6
    kept = substrings.deduplicated(d, 100).collect()
    assert sorted(len(r.text or "") for r in kept)[:5] == [0, 0, 0, 0, 0]  # all text of repeated rows goes, a null stays
    got = ngramjoin.link_components(d, 4, 85).collect()
    assert len(got) == 6 and [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert ngramjoin.deduplicated(d).count() == 6  # rows that share a doc_id and a text stay together
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component_id) for r in embeddup.near_duplicates(v).collect()) == [(1, 1), (1, 1), (2, 1)]
    p = spark.createDataFrame([(1, "http://a.com/", "<p>x</p>")] * 2, "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string")
    assert urlfilter.filter_urls(p, rules).count() == 2 and [r.text for r in htmltext.main_text(p).collect()] == ["x", "x"]
    model = langid.train(d.withColumn("lang", F.lit("en")))
    assert langid.predict(d, model).count() == 6


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    r = random.Random(9)
    word = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    long = words(200_000, 11)
    d = spark.createDataFrame([(1, word), (2, long), (3, long[1000:-1000]), (4, "x")], "doc_id long, text string")
    got = {x.doc_id: x for x in bpe.round_trip(d.where("doc_id in (1, 4)"), vocabulary_path()).collect()}
    part = word[:3000]
    tok = Tokenizer.from_file(vocabulary_path())
    assert got[1].n_tokens > 100_000 and bpe.encode(spark.createDataFrame([(1, part)], "doc_id long, text string"), vocabulary_path()).first().ids == tok.encode(part, add_special_tokens=False).ids
    assert {x.doc_id: x.component_id for x in ngramjoin.link_components(d, 4, 85).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    kept = {x.doc_id: x for x in substrings.report(d).collect()}
    assert (kept[1].n_removed, kept[3].n_removed, kept[2].n_bytes - kept[2].n_removed) == (0, kept[3].n_bytes, 2000)
    model = langid.train(d.withColumn("lang", F.lit("en")))
    assert langid.predict(d, model).where("lang_pred = 'en'").count() == 4
    items = spark.createDataFrame([(1, " ".join(long.split()[100_000:100_012]))], "item_id long, text string")
    assert sorted(x.doc_id for x in decontaminate.report(d, items).where("contaminated").collect()) == [2, 3]


def shared_blocks(streams, least):
    """Brute force: which blocks of each stream are covered by strings of `least` bytes that another distinct stream has."""
    out = []
    for s in streams:
        covered = [False] * len(s)
        others = [o for o in streams if o != s]
        for i in range(len(s) - least + 1):
            if any(s[i : i + least] in o for o in others):
                covered[i : i + least] = [True] * least
        blocks, at = [], 0
        for b in s.split("\n"):
            blocks.append(all(covered[at : at + len(b)]))
            at += len(b) + 1
        out.append(blocks)
    return out


def test_strings_decide_blocks_in_doubt(spark):
    notice, bar = words(20, 1), "Share this story with all your friends on the network of your choice today"
    own = [[words(60, 10 + k), words(50, 30 + k)] for k in range(4)]
    plain = [(k, "http://h.org/x", f"<div>{notice}</div><p>{own[k][0]}</p><p>{own[k][1]}</p>") for k in range(3)]
    marked = [(10 + k, "http://g.org/x", f'<article><h2 id="related-work">{words(8, 50 + k)}</h2><p class="related">{own[k][0]}</p><div class="share">{bar}</div><table class="menu"><tr><td>{words(30, 60 + k)}</td></tr></table><div class="ad">Buy</div></article>') for k in range(3)]
    alone = [(20, "http://other.org/", f"<div>{notice}</div><p>{own[3][0]}</p>")]
    copies = [(30, "http://c.org/", f"<p>{own[0][0]}</p><p>{own[1][0]}</p><p>{words(12, 90)}</p>"), (31, "http://c.org/", f"<p>{own[0][0]}</p><p>{own[1][0]}</p><p>{words(12, 91)}</p>")]
    rows = plain + marked + alone + copies
    got = {r.page_id: r.text.split("\n\n") for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    said = shared_blocks(["\n".join([notice, *own[k]]) for k in range(3)], htmltext.MIN_SHARED)
    for k in range(3):
        assert got[k] == [b for b, gone in zip([notice, *own[k]], said[k], strict=True) if not gone] == own[k]
        assert got[10 + k] == [words(8, 50 + k), own[k][0], words(30, 60 + k)]  # the bar goes, what is unique stays, whatever it is called
    assert got[20] == [notice, own[3][0]]  # nobody else on its host has the notice
    assert len(got[30]) == len(got[31]) == 3  # copies stay whole


def test_links_of_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    to = lambda tag: f"<html><head>{tag}</head></html>"
    rows = [
        (1, "http://a.org/d/p1", to('<link rel=canonical href="p2">')), (2, "http://a.org/d/p2", to('<link rel="canonical" href="http://x.net/">')),
        (3, "http://b.org/", to('<!-- <link rel="canonical" href="http://x.net/"> -->')), (4, "http://c.org/", to("<script>'<link rel=canonical href=http://x.net/>'</script>")),
        (5, "http://d.org/", to('<base href="http://y.net/z/"><link rel="canonical" href="q">')),
    ]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_samples_are_never_empty(spark):
    from provenir.llm.common import sampled

    d = spark.range(2000)
    assert 0 < d.where(sampled(F.col("id"), 0.1, "x")).count() < 400
    assert d.where(sampled(F.col("id"), 1.0, "x")).count() == 2000


@pytest.mark.parametrize("rows", [[(1, None, None), (2, "und das", None)], [(1, "alpha", "en"), (2, "alpha", "de")]])
def test_language_ties_and_nulls(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, langid.train(d)).collect()}
    assert got in ({1: "und", 2: "und"}, {1: "de", 2: "de"})


def test_long_words_that_powers_of_two_confuse(spark):
    """Words of Thue and Morse and their complements: equal under any polynomial of odd base modulo 2 ** 64."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w), (2, other), (3, w.upper()), (4, f"x {other} y z"), (5, f"x {w} y z"), (6, f"X {w} y Z")]
    got = {r.doc_id: r.component_id for r in ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}


@pytest.mark.parametrize("size", [ngramjoin.LONG_WORD - 1, ngramjoin.LONG_WORD, ngramjoin.LONG_WORD + 1])
def test_words_about_the_length_of_long_ones(size):
    a, b = "é" + "K" * (size - 2), "é" + "k" * (size - 2)
    one, two, three = ngramjoin.sets([f"{a} v w x y".encode(), f"{b} V w x y".encode(), f"{b}k v w x y".encode()], 4)
    assert one.tolist() == two.tolist()
    assert len(set(one.tolist()) & set(three.tolist())) == 1
