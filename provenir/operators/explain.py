"""What signals point at: evidence (short excerpts) and highlights (intervals of the text), as columns.

Offsets are in code points from 0, half open. Excerpts show what cannot be seen by names in double brackets.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.rx import WS, java
from ..functions.text import intervals_of, once, pieces, trimmed
from .detect import bounded, casual, not_x

HIGHLIGHT = "struct<start:int,end:int,id:string,level:string>"
MAX_SHOWN = 60_000
# fixed values: names of characters that cannot be seen
NAMES = (("\u200b", "ZWSP"), ("\u200c", "ZWNJ"), ("\u200d", "ZWJ"), ("\u2060", "WJ"), ("\ufeff", "BOM"), ("\u202f", "NNBSP"), ("\u00ad", "SHY"))
PRIVATE = r"[\x{E000}-\x{F8FF}]"
TAGS = r"[\x{E0000}-\x{E007F}]+"


def visible(text: Column) -> Column:
    """The text on one line, with names for what cannot be seen."""
    out = text
    for c, name in NAMES:
        out = F.replace(out, F.lit(c), F.lit(f"⟦{name}⟧"))
    named = lambda t: F.array_join(F.transform(F.filter(F.split(t, f"(?<={PRIVATE})|(?={PRIVATE})"), lambda p: p != ""), lambda p: F.when(p.rlike(f"^{PRIVATE}$"), F.concat(F.lit("⟦U+"), F.hex(F.ascii(p)), F.lit("⟧"))).otherwise(p)), "")
    out = once(out, lambda t: F.when(t.rlike(PRIVATE), named(t)).otherwise(t))
    return F.regexp_replace(F.regexp_replace(out, TAGS, "⟦TAG⟧"), f"[{WS}]+", " ")


def excerpt(text: Column, start: Column, end: Column, radius: int = 40) -> Column:
    """The stretch with what is around it; dots where the text goes on."""
    a, b = F.greatest(F.lit(0), start - radius), F.least(F.length(text), end + radius)
    dots = lambda more: F.when(more, "…").otherwise("")
    return F.concat(dots(a > 0), F.trim(visible(F.substring(text, a + 1, b - a))), dots(b < F.length(text)))


def hidden_messages(text: Column) -> Column:
    """What runs of tag characters spell; the first three that are not blank."""
    runs = F.regexp_extract_all(text, F.lit(TAGS), 0)
    spelled = F.transform(runs, lambda r: F.array_join(F.transform(F.filter(F.split(r, ""), lambda c: c != ""), lambda c: F.char(F.ascii(c) - 0xE0000)), ""))
    return F.slice(F.filter(spelled, lambda s: F.trim(s) != ""), 1, 3)


RULE = "ord int, id string, language string, pattern string, zone string, level string, how string, most int, radius int, shown boolean"


def rule_table(ascii_edges: bool = False) -> list[tuple]:
    """Where each rule looks, by language (en, fr, autre), and how its matches are shown.

    how: excerpts around the matches, distinct matches, sentences that begin so, words of mixed scripts, or none; most:
    pieces of evidence. A null level is that of the signal.
    """
    rows = [(r.id, java(r.pattern, r.flags), None, r.zone, r.strength, "excerpt", 5, 40, True) for r in rules.ARTEFACTS]
    rows += [
        (rules.MARKDOWN.id, java(rules.MARKDOWN.pattern, rules.MARKDOWN.flags), None, "all", "moyen", "excerpt", 5, 40, True),
        ("uni-oai-pua", java(rules.PRIVATE_CITATION), None, "all", "fort", "excerpt", 4, 25, True),
        ("uni-zero-width", java(rf"(?:{rules.ZERO_WIDTH})|(?<!^){rules.BOM}|(?<!{rules.EMOJI_TAIL}){rules.ZWJ}"), None, "all", "moyen", "excerpt", 4, 25, True),
        ("uni-tags", TAGS, None, "all", "fort", "excerpt", 4, 25, True),
        ("uni-vs", java(rules.VARIATION), None, "all", "moyen", "excerpt", 4, 25, True),
        ("uni-nnbsp", java(rules.NARROW_SPACE), java(rules.NARROW_SPACE_FR), "all", "moyen", "excerpt", 4, 25, True),
        ("uni-homoglyph", java(rules.LETTERS), None, "all", "moyen", "mixed", 4, 0, True),
        ("uni-bidi", java(rules.BIDI), None, "all", "faible", "none", 0, 0, True),
        ("sty-lexicon", java(bounded(rules.LEXICON_EN, ascii_edges), "i"), java(bounded(rules.LEXICON_FR, ascii_edges), "i"), "all", None, "distinct", 10, 0, True),
        ("sty-not-x", java(not_x(True, ascii_edges), "i"), java(not_x(False, ascii_edges), "i"), "all", "faible", "excerpt", 4, 40, True),
        ("sty-transitions", java(rules.TRANSITION), None, "all", "faible", "sentences", 4, 0, False),
        ("sty-label-list", java(rules.LABEL_LIST, "m"), None, "all", "faible", "excerpt", 4, 40, True),
        ("sty-emdash", rules.EM_DASH, None, "all", "faible", "none", 0, 0, True),
        ("sty-casual", java(casual(rules.CASUAL_EN, ascii_edges), "i"), java(casual(rules.CASUAL_FR, ascii_edges), "i"), "all", "faible", "distinct", 8, 0, True),
        ("sty-punct", java(rules.REPEATED_PUNCTUATION), None, "all", "faible", "excerpt", 4, 40, False),
    ]
    own = lambda r, lang: r[1] if lang == "en" or r[2] is None or lang == "autre" and r[0] == "uni-nnbsp" else r[2]
    return [(i, r[0], lang, own(r, lang), *r[3:]) for i, r in enumerate(rows) for lang in ("en", "fr", "autre")]


def explained(df: DataFrame, key: str, text: str = "text", ascii_edges: bool = False) -> DataFrame:
    """(key, id, ord, evidence, at, level, shown): a row for each signal of df (key, text, language, signals) that a rule explains.

    The rules are a small table that is broadcast, so that one expression looks for whatever has fired. Narrow. ascii_edges: as in `detected`.
    """
    table = F.broadcast(df.sparkSession.createDataFrame(rule_table(ascii_edges), RULE))  # three rows a rule
    x = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), "language", F.explode_outer("signals").alias("_s"))
    x = x.withColumn("id", F.col("_s.id")).join(table, ["id", "language"])
    zone = F.when(F.col("zone") == "head", F.left("_t", F.lit(rules.HEAD_CHARS))).when(F.col("zone") == "tail", F.right("_t", F.lit(rules.TAIL_CHARS))).otherwise(F.col("_t"))
    offset = F.when(F.col("zone") == "tail", F.greatest(F.lit(0), F.length("_t") - rules.TAIL_CHARS)).otherwise(0)
    x = x.select(key, "id", "ord", F.coalesce("level", F.col("_s.strength")).alias("level"), "how", "most", "radius", "shown", "pattern", zone.alias("_z"), offset.alias("_o"))
    x = x.withColumn("_found", F.regexp_extract_all("_z", F.col("pattern"), F.lit(0)))
    x = x.withColumn("_at", intervals_of(F.split("_z", F.col("pattern"), -1), F.col("_found")))
    mixed = lambda w: w.rlike(java(rules.LATIN)) & w.rlike(java(rules.LOOKALIKE))
    paired = F.zip_with("_found", "_at", lambda w, h: F.struct(w.alias("w"), h.alias("h")))
    x = x.withColumn("_at", F.when(F.col("how") == "mixed", F.transform(F.filter(paired, lambda e: mixed(e.w)), lambda e: e.h)).otherwise(F.col("_at")))
    around = F.transform(F.slice("_at", F.lit(1), F.col("most")), lambda h: F.struct(F.greatest(F.lit(0), h.start - F.col("radius")).alias("a"), F.least(F.length("_z"), h.end + F.col("radius")).alias("b")))
    excerpts = F.transform(around, lambda h: F.concat(F.when(h.a > 0, "…").otherwise(""), F.trim(visible(F.substring(F.col("_z"), h.a + 1, h.b - h.a))), F.when(h.b < F.length("_z"), "…").otherwise("")))
    hidden = F.transform(hidden_messages(F.col("_z")), lambda m: F.concat(F.lit("Texte caché : « "), F.left(m, F.lit(120)), F.lit(" »")))
    distinct = F.array_distinct(F.transform(F.filter("_found", lambda m: m != ""), lambda m: trimmed(F.regexp_replace(F.lower(m), f"[{WS}]+", " "))))
    starts = F.transform(F.filter(F.transform(pieces(F.col("_z")), trimmed), lambda s: s.rlike(java(rules.TRANSITION))), lambda s: F.left(s, F.lit(80)))
    said = F.when((F.col("id") == "uni-tags") & (F.size(hidden) > 0), hidden).when(F.col("how") == "excerpt", excerpts).when(F.col("how") == "distinct", distinct).when(F.col("how") == "sentences", starts).when(F.col("how") == "mixed", F.filter("_found", mixed)).otherwise(F.array().cast("array<string>"))
    at = F.transform("_at", lambda h: F.struct((h.start + F.col("_o")).cast("int").alias("start"), (h.end + F.col("_o")).cast("int").alias("end")))
    return x.select(key, "id", "ord", F.slice(said, F.lit(1), F.col("most")).alias("evidence"), at.alias("at"), "level", "shown")


def disjoint(rows: DataFrame, key: str, level: str, order: list[str]) -> DataFrame:
    """Of rows (key, level, start, end, ...) those that overlap no row of their key that comes before, by level and order.

    The rows of a key come sorted, level by level, and `order` begins with the start: a row is compared with the last one kept of
    its own level, and by halving with those kept of earlier levels. Of a key only the kept intervals are held.
    """
    names = rows.columns
    place = [names.index(c) for c in (key, level, "start", "end")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, of, held, own, starts = None, None, [], [], []
        for b in batches:
            keep = []
            for k, r, start, end in zip(*(b.column(i).to_pylist() for i in place), strict=True):
                if not keep and at is None or k != at:
                    at, of, held, own, starts = k, r, [], [], []
                elif r != of:
                    held, own, of = sorted(held + own), [], r  # two sorted runs
                    starts = [x for x, _ in held]
                i = bisect.bisect_right(starts, start)
                clear = (not own or own[-1][1] <= start) and (not i or held[i - 1][1] <= start) and (i == len(held) or starts[i] >= end)
                keep.append(clear)
                if clear:
                    own.append((start, end))
            yield b.filter(pa.array(keep, type=pa.bool_()))

    return rows.repartition(key).sortWithinPartitions(key, level, *order).mapInArrow(run, rows.schema)


def highlighted(explained_rows: DataFrame, key: str, most: int = MAX_SHOWN) -> DataFrame:
    """(key, highlights): disjoint intervals (start, end, id, level) in order, that start before `most`.

    Of those that overlap the stronger stays, of equally strong ones the first; only intervals travel, no text.
    """
    rank = F.array_position(F.array(*map(F.lit, rules.STRENGTHS)), F.col("level")).cast("int")
    rows = explained_rows.where("shown").select(key, "ord", rank.alias("r"), "id", "level", F.posexplode_outer("at").alias("k", "h")).where(F.col("h.start") < most)
    kept = disjoint(rows.select(key, "r", "h.start", "h.end", "ord", "k", "id", "level"), key, "r", ["start", "ord", "k", "end"])
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "id", "level"))).alias("highlights"))


def flagged(metadata: Column, evidence: Column) -> Column:
    """Facts about a file (key, value) with whether the evidence of its metadata signals holds the value."""
    return F.transform(metadata, lambda m: F.struct(m.key.alias("key"), m.value.alias("value"), ((F.length(m.value) >= 3) & F.exists(evidence, lambda e: F.contains(e, m.value))).alias("flagged")))
