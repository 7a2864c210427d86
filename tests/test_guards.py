"""What spares the search for a rule is held by every match of it, and the counts are those of the plain patterns."""

import itertools
import random
import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from provenir import queries, rules
from provenir.functions.rx import java
from provenir.functions.text import language, matches, words
from provenir.operators import detect

GUARDED = [(r.id, r.pattern, r.flags, r.needs) for r in (*rules.ARTEFACTS, rules.MARKDOWN) if r.needs] + [
    ("lexicon-fr", "|".join(rules.LEXICON_FR), "i", rules.LEXICON_FR_NEEDS), ("lexicon-en", "|".join(rules.LEXICON_EN), "i", rules.LEXICON_EN_NEEDS),
    ("not-x-fr", rules.NOT_X_FR, "i", rules.NOT_X_FR_NEEDS), ("not-x-en", rules.NOT_X_EN, "i", rules.NOT_X_EN_NEEDS), ("transition", rules.TRANSITION, "", rules.TRANSITION_NEEDS),
]


def samples(pattern: str) -> list[str]:
    """Strings that the pattern matches: every branch, the fewest repeats, \\0 for what a class leaves open."""
    def of(items) -> list[str]:
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                got = [chr(arg)]
            elif name == "BRANCH":
                got = [x for b in arg[1] for x in of(b)]
            elif name == "SUBPATTERN":
                got = of(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                one = of(arg[2])
                got = [""] if arg[0] == 0 else [x * arg[0] for x in one]
                got += one if arg[0] == 0 else []  # an optional part is tried both ways
            elif name == "IN":
                plain = [chr(a) for o, a in arg if str(o) == "LITERAL"]
                got = plain if plain and len(plain) == len(arg) else ["\0"]
            else:
                assert name in ("AT", "ASSERT", "ASSERT_NOT", "NOT_LITERAL", "ANY"), name
                got = [""] if name in ("AT", "ASSERT", "ASSERT_NOT") else ["\0"]
            out = ["".join(p) for p in itertools.product(out, dict.fromkeys(got))]
            assert len(out) < 200_000
        return out

    plain = re.sub(r"\\p\{\w+\}", "\\\\w", pattern)
    return [x for branch in _branches(plain) for x in of(parser.parse(branch))]


def _branches(pattern: str) -> list[str]:
    depth, start, out, i = 0, 0, [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


@pytest.mark.parametrize("name,pattern,flags,needs", GUARDED, ids=[g[0] for g in GUARDED])
def test_every_match_holds_what_is_needed(name, pattern, flags, needs):
    missed = [x for x in samples(pattern) if not any(n in (x.lower() if "i" in flags else x) for n in needs)]
    assert not missed, missed[:5]
    assert all(n == n.lower() for n in needs) or "i" not in flags


TEXTS = [
    "", "plain words", "I AM CLAUDE, and ı am gemını", "Aſ an AI language model I do not have acceſſ to browſing", "ſhowcaſing delve UNDERſCORING a TAPEſTRY", "İt is ımportant to note", "booſter, K levıer ſynergies À RETENIR, AU CŒUR DE",
    "Not Juſt this, but that. It's not only x, it's y. pas ſeulement un, mais", "De plus, x. En outre, y. Ainsi z. Moreover, k. a. b. c. d. e.", "a  b  c   d", "\ufeffa\ufeffb\u200dc\u200b", "x\ufe0f ©\ufe0f \U000e0101", "pаypal ΩHm \u2126hm Kopie", "utm_ſource=openai UTM_SOURCE=OPENAI",
    "[cite: 1] 【3†x】 turn0search1 <think> [^1^] [1][2] [citation:2] chatGPT.com/ſhare/x **bold** --- # Title\n# Two", "<argument name=\"citation_id\"> \\frac{1} \\( x", "je suis désolée, je ne peux pas répondre; i'm ſorry but i cannot help",
]


def test_counts_are_those_of_the_plain_patterns(spark):
    """Odd letters whose case folds to ASCII among them: a search that is spared would have found nothing."""
    r = random.Random(3)
    made = [" ".join(r.sample(TEXTS, 4)) for _ in range(40)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + made)], "i int, t string").withColumn("low", detect.folded(F.col("t")))
    t, low = F.col("t"), F.col("low")
    count = lambda p, f="": F.regexp_count(t, F.lit(java(p, f)))
    plain = {x.id: F.regexp_count(detect._zone(t, x.zone), F.lit(java(x.pattern, x.flags))) for x in (*rules.ARTEFACTS, rules.MARKDOWN)}
    plain |= {"uni-vs": count(rules.VARIATION), "uni-homoglyph": F.size(F.filter(F.regexp_extract_all(t, F.lit(java(rules.LETTERS)), 0), lambda w: w.rlike(java(rules.LATIN)) & w.rlike(java(rules.LOOKALIKE))))}
    plain["uni-zero-width"] = count(rules.ZERO_WIDTH) + F.regexp_count(F.substring(t, 2, 2**31 - 1), F.lit(rules.BOM)) + count(f"(?<!{rules.EMOJI_TAIL}){rules.ZWJ}")
    fast = {**detect.rule_counts(t, low), **detect.unicode_counts(t, F.lit("en"))}
    for en, lexicon, not_x in ((True, rules.LEXICON_EN, rules.NOT_X_EN), (False, rules.LEXICON_FR, rules.NOT_X_FR)):
        p = detect.style_parts(t, low, F.lit(en))
        fast |= {f"{k}-{en}": p[k] for k in ("lexicon", "distinct", "not_x", "transitions", "double")}
        plain |= {f"lexicon-{en}": count(detect.bounded(lexicon), "i"), f"distinct-{en}": F.size(matches(t, java(detect.bounded(lexicon), "i"))), f"not_x-{en}": count(not_x, "i"), f"double-{en}": count(rules.DOUBLE_SPACE)}
    both = d.select("t", *[F.struct(plain[k].cast("int").alias("a"), fast[k].cast("int").alias("b")).alias(k) for k in plain]).collect()
    assert [(x.t, k, x[k]) for x in both for k in plain if x[k].a != x[k].b] == []
    assert all(any(x[k].a for x in both) for k in ("lexicon-True", "lexicon-False", "art-self-ai", "art-utm", "art-share-link", "uni-vs", "uni-homoglyph", "uni-zero-width"))


def test_language_looks_at_every_short_word(spark):
    d = spark.createDataFrame([("the THE xylophones ÊTRE être",), ("Être ou ne pas être, qu'importe",), ("İn the",), ("",), ("Wörter ohne Bedeutung",)], "t string")
    ws = words(F.col("t"))
    share = lambda stop: F.size(F.filter(ws, lambda w: F.lower(w).isin(*stop)))
    fr, en, n = share(rules.STOP_FR), share(rules.STOP_EN), F.greatest(F.lit(1), F.size(ws))
    want = F.when((fr / n < 0.06) & (en / n < 0.06), "autre").when(fr >= en, "fr").otherwise("en")
    assert all(r.a == r.b for r in d.select(language(ws).alias("a"), want.alias("b")).collect())


def test_quote_mode_finds_signals_once(spark, tmp_path):
    """The texts are searched once: no join of the signals with themselves."""
    quoting = " contentReference[oaicite:1]{index=1} [cite: 3] [citation:2] <think>"
    rows = [(1, "none"), (2, quoting), (2, quoting), (3, quoting), (None, quoting)]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    x = queries.quote_mode(spark, str(tmp_path))
    assert "Join" not in x._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.points, r.signals) for r in x.collect()}
    assert set(got) == {2, 3} and got[2] == tuple(2 * v for v in got[3])
