"""Profile, scanning, cleaning and verdict functions on hand-made texts, one positive and one negative case each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from provenir import queries, rules
from provenir.functions import clean, rx, text
from provenir.operators import detect, explain, verdict
from provenir.plans.analyze import analyzed


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, t, column):
    return frame(spark, t).select(column.alias("x")).first().x


def test_dialect():
    assert rx.re2(r"\bA\s[\s\d]$", "i") == rf"(?i)\bA[{rx.WS}][{rx.WS}0-9]\z" and rx.java(r"\p{Script=Latin}\u{E0041}") == r"\p{IsLatin}\x{E0041}"


def test_boundaries(spark):
    assert one(spark, "éa a_ a", F.regexp_count("text", F.lit(rx.java(r"\ba\b")))) == 2  # as ASCII rules have it
    assert one(spark, "x y﻿z", F.regexp_count("text", F.lit(rx.java(r"\s")))) == 2


def test_profile(spark):
    t = "First sentence goes here. Second one is a bit longer than that!\n\nNew paragraph — with a dash. No.\n- bullet line here now"
    r = text.profiled(frame(spark, t, None, "")).orderBy("doc_id").collect()
    assert (r[0].words, r[0].sentences, r[0].paragraphs) == (22, 4, 2) and r[0].bullet_line_ratio == 0.33 and r[0].language == "en"
    assert r[1].words == 0 == r[2].words and r[1].language == "autre" and r[2].sentence_length_cv == 0
    assert text.profiled(frame(spark, "the cat is on the mat and it was there")).first().language == "en"


@pytest.mark.parametrize("n", [1, 49, 50, 51, 140])
def test_lexical_diversity(spark, n):
    ws = [f"w{(i * i) % 37}" for i in range(n)]
    windows = [ws] if n <= 50 else [ws[i : i + 50] for i in range(n - 49)]
    want = sum(len({*w}) for w in windows) / (len(windows) * min(n, 50))
    assert text.lexical_diversity(frame(spark, " ".join(ws)), "doc_id").first().lexical_diversity == pytest.approx(want, abs=0.0051)
    assert text.lexical_diversity(frame(spark, ""), "doc_id").first().lexical_diversity == 0


def test_intervals(spark):
    t = "ab--c---d-"
    got = one(spark, t, text.intervals(F.col("text"), "-+"))
    assert [(h.start, h.end) for h in got] == [(2, 4), (5, 8), (9, 10)] and one(spark, "none", text.intervals(F.col("text"), "-+")) == []


def test_disjoint_against_brute_force(spark):
    r = random.Random(2)
    rows = [(k, lv, a, a + r.randint(1, 6)) for k in range(60) for lv in range(3) for a in (r.randrange(60) for _ in range(r.randrange(25)))]
    want = []
    for key in range(60):
        kept = []
        for k, lv, a, b in sorted(rows):
            if k == key and not any(a < y and x < b for _, _, x, y in kept):
                kept.append((k, lv, a, b))
        want += kept
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, r int, start int, end int")
    assert sorted(map(tuple, explain.disjoint(df, "k", "r", ["start", "end"]).collect())) == sorted(want)


def test_many_matches_in_one_text_take_seconds(spark):
    df = spark.range(1).select("id", F.repeat(F.lit("ab! "), 250_000).alias("text"))
    began = time.time()
    one = lambda r, p: F.transform(text.intervals(F.col("text"), p), lambda h: F.struct(F.lit(r).alias("r"), h.start.alias("start"), h.end.alias("end")))
    x = explain.disjoint(df.select("id", F.explode_outer(F.concat(one(1, "!"), one(0, "b!")))).select("id", "col.*"), "id", "r", ["start"])
    assert tuple(x.agg(F.count("*"), F.max("end"), F.max("r")).first()) == (250_000, 999_999, 0)
    assert time.time() - began < 60


def test_verse_and_prose(spark):
    poem = "\n".join(["The night is falling over the sea", "And all the birds are calling me", "The wind is cold upon the land", "I hold a flower in my hand", "The stars are shining far away", "And I will dream until the day"])
    assert one(spark, poem, text.verse(F.col("text"))) is True and one(spark, "One long line of prose that goes on.", text.verse(F.col("text"))) is False
    line = "This line holds plain prose with several ordinary lower case words inside"
    t = "\n".join(["1. Contents ... 4"] + [line] * 6 + ["x = {y}"] + [line] * 2)
    assert one(spark, t, text.prose_sample(F.col("text"))) == " ".join([line] * 6) + "\n\n" + " ".join([line] * 2)
    assert one(spark, "short\ntext", text.prose_sample(F.col("text"))) == "short\ntext"


def test_cleaning(spark):
    t = "See contentReference[oaicite:3]{index=3} this​ and https://a.b/?utm_source=openai&x=1 pаy [^1^] end ."
    r = clean.cleaned(frame(spark, t, "nothing here .", None)).orderBy("doc_id").collect()
    assert r[0].clean_text == "See  this and https://a.b/?x=1 pay  end." and r[0].removed == 5
    assert (r[1].clean_text, r[1].removed) == ("nothing here .", 0) and r[2].removed == 0
    again = clean.cleaned(frame(spark, r[0].clean_text)).first()
    assert again.removed == 0


FIRES = {
    "art-oaicite": "x oaicite:12", "art-oai-brackets": "【3†source】", "art-citeturn": "turn0search3", "art-oai-images": "https://images.openai.com/thumbnails/a", "art-gemini-cite": "[cite: 1, 2]", "art-claude-tags": "<antArtifact id=1>", "art-deepseek-cite": "[citation:3]",
    "art-think": "<think>", "art-copilot-cite": "[^2^]", "art-grok-render": "<grok:render x>", "art-numeric-cites": "[1][2] and [3][4]", "art-share-link": "chatgpt.com/share/ab-1", "art-self-vendor": "I am Claude", "art-self-ai": "As an AI language model", "art-refusal": "I'm sorry, but I can't help",
    "art-opening": "Bien sûr ! Voici la liste", "art-closing": "I hope this helps", "art-placeholders": "[Votre nom]", "art-utm": "utm_source=chatgpt.com", "art-emoji-bullets": "✅ a\n🚀 b\n👉 c", "art-latex": r"\( x \)", "art-markdown": "**a b** and **c d**",
}


def test_every_marker_rule(spark):
    d = frame(spark, *FIRES.values(), "an ordinary sentence without any of it")
    got = detect.detected(text.profiled(d)).select("doc_id", F.transform("signals", lambda s: s.id).alias("ids")).orderBy("doc_id").collect()
    for r, name in zip(got, FIRES, strict=False):
        assert name in r.ids, name
    assert [i for i in got[-1].ids if i.startswith("art-")] == [] and {r.id for r in rules.ARTEFACTS} < FIRES.keys()


def test_unicode_rules(spark):
    d = frame(spark, "ab", "a​b", "a\U000e0041b", "a️b", "a b c", "pаypal", "a‮b", "👩‍👩 ❤️ ﻿"[:-1])
    got = [[s.id for s in r.signals if s.id.startswith("uni-")] for r in detect.detected(text.profiled(d)).orderBy("doc_id").collect()]
    assert got == [["uni-oai-pua"], ["uni-zero-width"], ["uni-tags"], ["uni-vs"], ["uni-nnbsp"], ["uni-homoglyph"], ["uni-bidi"], []]


def test_quote_mode_and_verdict(spark):
    marks = "contentReference[oaicite:1] [cite: 3] [citation:2] <think>"
    d = analyzed(frame(spark, marks, "oaicite:3 " * 2, "plain", None)).orderBy("doc_id").collect()
    assert "art-discussion" in [s.id for s in d[0].signals] and all(s.strength in ("faible", "info") for s in d[0].signals if s.category == "artefact")
    assert d[1].verdict == verdict.LABELS[1] and d[1].confidence == "élevée" and d[1].score >= 85
    assert d[2].undetermined and d[2].verdict == verdict.LABELS[0] and d[3].undetermined and all(1 <= r.score <= 99 for r in d)
    v = {r.vendor: (r.score, r.level) for r in verdict.vendors_of(analyzed(frame(spark, "oaicite:3")), "doc_id").collect()}
    assert v["chatgpt"] == (72, "trace") and v["claude"] == (0, "aucun") and len(v) == 10
    o = verdict.origins_of(analyzed(frame(spark, "oaicite:3", "x")), "doc_id", F.when(F.col("doc_id") == 0, 0.9)).collect()
    assert {r.vendor: r.score for r in o if r.doc_id == 0}["chatgpt"] == 90 and all(r.score is None for r in o if r.doc_id == 1)


def test_registered_queries_have_names():
    from provenir import oracle

    assert oracle.SQL.keys() <= queries.QUERIES.keys() and len(queries.QUERIES) > 35


def test_sql_functions(spark):
    from provenir.functions.sql import register

    assert "text_words" in register(spark)
    r = spark.sql("SELECT text_words('it''s two-fold été') AS w, text_word_count('a b') AS n, text_paragraph_count('a\n \nb\n\n') AS p, text_trim(' x ') AS t, text_matches('Ab ab b', 'a?b') AS m").first()
    assert (r.w, r.n, r.p, r.t, r.m) == (["it's", "two-fold", "été"], 2, 2, "x", ["ab", "b"])
