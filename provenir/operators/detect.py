"""Detectors as columns: each gives an array of signals, and all arrays are joined in a fixed order.

A signal is a struct (seq, id, category, strength, direction, points, vendors, count). Everything is per row, so a
table of any size is one narrow stage.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.rx import WS, java
from ..functions.text import matches, once, paragraphs, pieces, trimmed, variation, words

VENDORS = "array<struct<vendor:string,weight:int>>"
SIGNAL = f"struct<seq:int,id:string,category:string,strength:string,direction:string,points:int,vendors:{VENDORS},count:bigint>"
#: Order of detectors: the last tie-break of a report's signals.
SEQ = {"artefact": 1000, "unicode": 2000, "style": 4000, "stats": 5000, "watermark": 6000, "model": 7000}


def signal(seq: int, id_: str | Column, category: str, strength: str | Column, direction: str | Column, points: int | Column, count: Column | None = None, vendors: Column | tuple = ()) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    hints = vendors if isinstance(vendors, Column) else F.array(*[F.struct(F.lit(v).alias("vendor"), F.lit(w).alias("weight")) for v, w in vendors]) if vendors else F.array()
    return F.struct(F.lit(seq).alias("seq"), lit(id_).alias("id"), F.lit(category).alias("category"), lit(strength).alias("strength"), lit(direction).alias("direction"), lit(points).cast("int").alias("points"), hints.cast(VENDORS).alias("vendors"), (F.lit(None) if count is None else count).cast("bigint").alias("count")).cast(SIGNAL)


def vendor_of(text: Column, patterns: tuple = rules.VENDOR_PATTERNS + rules.PUBLISHERS) -> Column:
    """The assistant that a piece of text names, by the first pattern that matches; null if none does."""
    out = F.when(text.rlike(java(patterns[0][0], "i")), patterns[0][1])
    for p, v in patterns[1:]:
        out = out.when(text.rlike(java(p, "i")), v)
    return out


def _zone(t: Column, zone: str) -> Column:
    return F.left(t, F.lit(rules.HEAD_CHARS)) if zone == "head" else F.right(t, F.lit(rules.TAIL_CHARS)) if zone == "tail" else t


def folded(t: Column) -> Column:
    """The text in lower case, the few other letters that patterns take for ASCII ones among them."""
    odd = reduce(operator.or_, [F.contains(t, F.lit(c)) for c in FOLDED[0]])
    return F.lower(F.when(odd, F.translate(t, *FOLDED)).otherwise(t))


def has_any(t: Column, needs: tuple[str, ...]) -> Column:
    return reduce(operator.or_, [F.contains(t, F.lit(n)) for n in needs])


def rule_count(r: rules.Rule, text: Column, low: Column) -> Column:
    """Number of matches of a marker rule in its zone; only a text that holds what it needs is searched."""
    n = F.regexp_count(_zone(text, r.zone), F.lit(java(r.pattern, r.flags)))
    return F.when(has_any(low if "i" in r.flags else text, r.needs), n).otherwise(0) if r.needs else n


def rule_counts(text: Column, low: Column) -> dict[str, Column]:
    """Number of matches of each marker rule in its zone. low: the folded text, a column that is made once."""
    return {r.id: rule_count(r, text, low) for r in (*rules.ARTEFACTS, rules.MARKDOWN)}


def artefacts(t: Column, low: Column, kind: Column, urls: Column | None = None) -> Column:
    found = []
    counts = rule_counts(t, low)
    for i, r in enumerate(rules.ARTEFACTS):
        n = counts[r.id]
        hints: Column | tuple = r.vendors
        if r.id in rules.FROM_MATCH:
            named = F.array_distinct(F.filter(F.transform(matches(t, java(r.pattern, r.flags)), lambda m: vendor_of(m)), lambda v: v.isNotNull()))
            hints = F.transform(named, lambda v: F.struct(v.alias("vendor"), F.lit(rules.FROM_MATCH_WEIGHT).alias("weight")))
        fires = n >= r.least
        if r.skip:
            fires = fires & ~kind.isin(*r.skip)
        found.append(F.when(fires, signal(SEQ["artefact"] + i, r.id, "artefact", r.strength, "ia", r.points, n, hints)))
    if urls is not None:
        hidden = F.filter(urls, lambda u: u.rlike(java(rules.HIDDEN_UTM, "i")))
        v = vendor_of(F.try_element_at(hidden, F.lit(1)), rules.VENDOR_PATTERNS)
        hint = F.when(v.isNotNull(), F.array(F.struct(v.alias("vendor"), F.lit(3).alias("weight")))).otherwise(F.array().cast(VENDORS))
        found.append(F.when((F.size(hidden) > 0) & (counts["art-utm"] == 0), signal(SEQ["artefact"] + 100, "art-utm", "artefact", "fort", "ia", 45, F.size(hidden), hint)))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def quoted(signals: Column) -> Column:
    """Signals of a text that has the markers of several assistants: it writes about them, so they count for little."""
    named = F.array_distinct(F.flatten(F.transform(F.filter(signals, lambda s: s.id.isin(*rules.SIGNATURES)), lambda s: F.transform(F.filter(s.vendors, lambda v: v.weight >= 2), lambda v: v.vendor))))
    total = F.aggregate(signals, F.lit(0), lambda a, s: a + s.points)
    less = F.transform(signals, lambda s: F.struct(s.seq.alias("seq"), s.id.alias("id"), s.category.alias("category"), F.lit("faible").alias("strength"), s.direction.alias("direction"), F.greatest(F.lit(1), F.floor(F.try_divide(s.points * rules.DISCUSSION_POINTS, total) + 0.5).cast("int")).alias("points"), F.transform(s.vendors, lambda v: F.struct(v.vendor.alias("vendor"), F.lit(1).alias("weight"))).alias("vendors"), s["count"].alias("count")).cast(SIGNAL))
    return F.when(F.size(named) >= rules.DISCUSSION_VENDORS, F.concat(less, F.array(signal(SEQ["artefact"] + 200, "art-discussion", "artefact", "info", "neutre", 0)))).otherwise(signals)


def markdown(t: Column, kind: Column) -> Column:
    n = rule_count(rules.MARKDOWN, t, t)
    points = F.when(kind.isin("docx", "pdf"), 20).otherwise(rules.MARKDOWN.points)
    return F.when((n >= rules.MARKDOWN.least) & ~kind.isin(*rules.MARKDOWN.skip), signal(SEQ["artefact"] + 300, rules.MARKDOWN.id, "artefact", "moyen", "ia", points, n))


def unicode_counts(t: Column, lang: Column) -> dict[str, Column]:
    n = lambda p: F.regexp_count(t, F.lit(java(p)))
    some = lambda p, c: F.when(t.rlike(java(p)), c).otherwise(0)  # noqa: E731  what any match needs, found without looking around
    held = lambda c, found: F.when(F.contains(t, F.lit(c)), found).otherwise(0)
    mixed = F.filter(F.regexp_extract_all(t, F.lit(java(rules.LETTERS)), 0), lambda w: w.rlike(java(rules.LATIN)) & w.rlike(java(rules.LOOKALIKE)))
    return {
        "uni-oai-pua": n(rules.PRIVATE_CITATION),
        "uni-zero-width": n(rules.ZERO_WIDTH) + held(rules.BOM, F.regexp_count(F.substring(t, 2, 2**31 - 1), F.lit(rules.BOM))) + held(rules.ZWJ, n(f"(?<!{rules.EMOJI_TAIL}){rules.ZWJ}")),
        "uni-tags": n(rules.TAGS), "uni-vs": some(rules.ANY_VARIATION, n(rules.VARIATION)), "uni-nnbsp": F.when(lang == "fr", n(rules.NARROW_SPACE_FR)).otherwise(n(rules.NARROW_SPACE)),
        "uni-homoglyph": some(rules.MAY_LOOK_ALIKE, F.when(t.rlike(java(rules.LOOKALIKE)), F.size(mixed)).otherwise(0)), "uni-bidi": n(rules.BIDI),
    }


def unicodes(c: dict[str, Column]) -> Column:
    z, h, s = c["uni-zero-width"], c["uni-homoglyph"], SEQ["unicode"]
    return F.filter(F.array(
        F.when(c["uni-oai-pua"] > 0, signal(s, "uni-oai-pua", "unicode", "fort", "ia", 40, c["uni-oai-pua"], (("chatgpt", 3),))), F.when(z > 0, signal(s + 1, "uni-zero-width", "unicode", "moyen", "ia", F.when(z >= 3, 18).otherwise(10), z)),
        F.when(c["uni-tags"] > 0, signal(s + 2, "uni-tags", "unicode", "fort", "ia", 25, c["uni-tags"])), F.when(c["uni-vs"] > 0, signal(s + 3, "uni-vs", "unicode", "moyen", "ia", 15, c["uni-vs"])), F.when(c["uni-nnbsp"] >= 2, signal(s + 4, "uni-nnbsp", "unicode", "moyen", "ia", 12, c["uni-nnbsp"])),
        F.when(h > 0, signal(s + 5, "uni-homoglyph", "unicode", F.when(h >= 3, "fort").otherwise("moyen"), "ia", F.when(h >= 3, 30).otherwise(15), h)), F.when(c["uni-bidi"] > 0, signal(s + 6, "uni-bidi", "unicode", "faible", "neutre", 4, c["uni-bidi"])),
    ), lambda x: x.isNotNull())


def bounded(body: str | tuple[str, ...], ascii_edges: bool = False) -> str:
    """An expression of the lexicons between edges: no letter or number beside it, or ASCII word edges on both sides.

    ASCII edges are what SQL without look-around can say. An expression that ends in a comma then needs a word right after it.
    """
    one = body if isinstance(body, str) else "|".join(body)
    return rf"\b(?:{one})\b" if ascii_edges else rf"(?<![\p{{L}}\p{{N}}])(?:{one})(?![\p{{L}}\p{{N}}])"


def casual(body: str, ascii_edges: bool = False) -> str:
    """Casual words between edges: no letter beside them, or ASCII word edges, which digits (of a key, say) take away too."""
    return bounded(body, True) if ascii_edges else rf"(?<![\p{{L}}])(?:{body})(?![\p{{L}}])"


def not_x(english: bool, ascii_edges: bool = False) -> str:
    return rules.NOT_X_EN if english else rules.NOT_X_FR.replace(r"(?<![\p{L}])", r"\b") if ascii_edges else rules.NOT_X_FR


def style_parts(t: Column, low: Column, english: Column, ascii_edges: bool = False) -> dict[str, Column]:
    """Counts that the style rules look at; lexicons are English for English texts and French for all others. low: see rule_counts; ascii_edges: see bounded."""
    by = lambda make, fr, en: F.when(english, make(en)).otherwise(make(fr))
    where = lambda fr, en, c: F.when(F.when(english, has_any(low, en)).otherwise(has_any(low, fr)), c).otherwise(0)
    spoken = lambda c: where(rules.LEXICON_FR_NEEDS, rules.LEXICON_EN_NEEDS, c)
    count = lambda p, flags="": F.regexp_count(t, F.lit(java(p, flags)))
    sents = F.filter(F.transform(pieces(t), trimmed), lambda s: s != "")
    return {
        "lexicon": spoken(by(lambda w: count(bounded(w, ascii_edges), "i"), rules.LEXICON_FR, rules.LEXICON_EN)), "distinct": spoken(by(lambda w: F.size(matches(t, java(bounded(w, ascii_edges), "i"))), rules.LEXICON_FR, rules.LEXICON_EN)),
        "not_x": where(rules.NOT_X_FR_NEEDS, rules.NOT_X_EN_NEEDS, by(lambda p: count(p, "i"), not_x(False, ascii_edges), not_x(True, ascii_edges))), "starts": F.size(sents),
        "transitions": F.when(has_any(t, rules.TRANSITION_NEEDS), F.size(F.filter(sents, lambda s: s.rlike(java(rules.TRANSITION))))).otherwise(0),
        "labels": count(rules.LABEL_LIST, "m"), "dashes": F.length(t) - F.length(F.replace(t, F.lit(rules.EM_DASH), F.lit(""))), "casual": by(lambda b: count(casual(b, ascii_edges), "i"), rules.CASUAL_FR, rules.CASUAL_EN),
        "punct": count(rules.REPEATED_PUNCTUATION), "lower": count(rules.LOWER_START), "double": F.when(F.contains(t, F.lit("  ")), count(rules.DOUBLE_SPACE)).otherwise(0),
    }


def styles(p: dict[str, Column], kind: Column, n_words: Column, n_sentences: Column, dash_rate: Column) -> Column:
    s = SEQ["style"]
    ia = lambda k, i, fires, points, n, strength="faible": F.when(fires, signal(s + k, i, "style", strength, "ia", points, n))
    human = lambda k, i, fires, points, n=None: F.when(fires, signal(s + k, i, "style", "faible", "humain", points, n))
    lex, d = p["lexicon"], p["distinct"]
    dense = lambda least: lex * 1000 >= least * n_words
    tier = F.when((d >= 6) & dense(8), 22).when((d >= 4) & dense(5), 14).when(d >= 2, 6).when(d == 1, 2)
    strength = F.when(tier == 22, "moyen").when(tier == 2, "info").otherwise("faible")
    double = F.when(kind == "pdf", 0).otherwise(p["double"])
    all_ = F.filter(F.array(
        ia(0, "sty-lexicon", tier.isNotNull(), tier, lex, strength), human(1, "sty-no-lexicon", tier.isNull() & (n_words >= 300), -4),
        ia(2, "sty-not-x", (p["not_x"] >= 2) | (p["not_x"] == 1) & (n_words < 300), 8, p["not_x"]), ia(3, "sty-transitions", (p["starts"] >= 8) & (p["transitions"] >= 3) & (p["transitions"] * 100 >= p["starts"] * 15), 8, p["transitions"]),
        ia(4, "sty-label-list", (p["labels"] >= 3) & (kind != "md"), 8, p["labels"]), ia(5, "sty-emdash", (dash_rate >= 4) & (p["dashes"] >= 3), 10, p["dashes"]), human(6, "sty-casual", p["casual"] >= 2, -10, p["casual"]),
        human(7, "sty-punct", p["punct"] >= 2, -5, p["punct"]), human(8, "sty-sloppy", (p["lower"] >= 3) & (p["lower"] * 10 > F.greatest(n_sentences, F.lit(1))) | (double >= 3), -6),
    ), lambda x: x.isNotNull())
    return F.when((kind != "code") & (n_words >= 25), all_).otherwise(F.array().cast(f"array<{SIGNAL}>"))


def stats(t: Column, kind: Column, n_words: Column, n_sentences: Column, cv: Column, bullets: Column) -> Column:
    s = SEQ["stats"]
    sizes = F.filter(F.transform(paragraphs(t), lambda q: F.size(words(q))), lambda n: n >= 15)
    even = once(sizes, lambda z: (F.size(z) >= 4) & (variation(z) < 0.25))
    rhythm = F.when(cv < 0.35, signal(s + 1, "stat-burstiness", "stats", "faible", "ia", 10)).when(cv < 0.45, signal(s + 1, "stat-burstiness", "stats", "faible", "ia", 4)).when(cv > 0.7, signal(s + 1, "stat-burstiness", "stats", "faible", "humain", -8))
    measured = F.filter(F.array(rhythm, F.when(even, signal(s + 2, "stat-paragraphs", "stats", "faible", "ia", 6)), F.when((kind != "md") & (bullets > 0.4), signal(s + 3, "stat-bullets", "stats", "faible", "ia", 5))), lambda x: x.isNotNull())
    none = F.array().cast(f"array<{SIGNAL}>")
    short = F.when(n_words > 0, F.array(signal(s, "stat-too-short", "stats", "info", "neutre", 0))).otherwise(none)
    return F.when(kind == "code", none).when((n_words < 120) | (n_sentences < 8), short).otherwise(measured)


def watermark(n_words: Column) -> Column:
    return F.when(n_words >= 20, signal(SEQ["watermark"], "watermark-vendor", "watermark", "info", "neutre", 0))


#: Letters beyond ASCII whose case folds to ASCII letters, and these.
FOLDED = ("\u017f\u212a\u0131\u0130", "skii")
Detector = Callable[[DataFrame], Column]


def detected(profile: DataFrame, text: str = "text", kind: Column | None = None, urls: Column | None = None, more: tuple[Detector, ...] = (), ascii_edges: bool = False) -> DataFrame:
    """A profiled table with the array `signals`. `more` are further detectors: from the table to an array of signals. ascii_edges: see bounded."""
    k = F.lit("text") if kind is None else kind
    t = F.coalesce(F.col(text), F.lit(""))
    x = profile.withColumn("_t", t).withColumn("_low", folded(F.col("_t"))).withColumn("_art", artefacts(F.col("_t"), F.col("_low"), k, urls))
    uni = unicode_counts(F.col("_t"), F.col("language"))
    x = x.select("*", *[c.alias(f"_{i}") for i, c in uni.items()])
    said = style_parts(F.col("_t"), F.col("_low"), F.col("language") == "en", ascii_edges)
    said["starts"] = F.when(said["transitions"] >= 3, said["starts"]).otherwise(0)  # what the rule asks for first
    x = x.select("*", *[c.alias(f"_s_{i}") for i, c in said.items()])
    col = F.col
    style = styles({i[3:]: col(i) for i in x.columns if i.startswith("_s_")}, k, col("words"), col("sentences"), col("em_dash_per_1000"))
    one = lambda c: F.filter(F.array(c), lambda s: s.isNotNull())
    parts = [quoted(col("_art")), one(markdown(col("_t"), k)), unicodes({i: col(f"`_{i}`") for i in uni}), style, stats(col("_t"), k, col("words"), col("sentences"), col("sentence_length_cv"), col("bullet_line_ratio")), one(watermark(col("words")))]
    parts += [d(x) for d in more]
    return x.select(*profile.columns, F.flatten(F.array(*parts)).alias("signals"))


def ordered(signals: Column) -> Column:
    """Signals by category, strength, falling points, and order of detection."""
    rank = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c)
    keyed = F.transform(signals, lambda s: F.struct(rank(s.category, rules.CATEGORIES).alias("a"), rank(s.strength, rules.STRENGTHS).alias("b"), (-s.points).alias("c"), s.seq.alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k.s)
