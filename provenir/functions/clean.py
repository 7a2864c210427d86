"""Cleaning: ordered removals of the traces that copying from an assistant leaves, and prose out of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .rx import WS, java
from .text import trimmed

# fixed values: what is removed, in this order (pattern, flags)
REMOVALS = (
    (r"^[ \t]*!\[[^\]\n]*\]\(https?:\/\/images\.openai\.com\/[^)\s]+\)[ \t]*(?:\n[ \t]*(?=\n)|$)\n?", "m"),
    (r":?contentReference\[oaicite:\d+\](\{index=\d+\})?", ""),
    (r"【\d+(?::\d+)?†[^】\n]{0,60}】", ""),
    (r"\b(?:cite|filecite|navlist)?turn\d+(?:search|news|view|fetch|file|image|academia|forecast|finance|product)\d+\b", ""),
    (r"\[cite_start\]|\[cite:\s*[\d,\s-]+\]", ""),
    (r"<think>[\s\S]*?<\/think>\s*", ""),
    (r"\s?\[citation:\s?\d+\]", ""),
    (r"\[\^\d+\^\]", ""),
    (r"""<argument name="citation_id">[^<]*<\/argument>|<\/?grok:render[^>]*>""", ""),
    (r"[\uE000-\uF8FF]", ""),
    (r"[\u{E0000}-\u{E007F}]", ""),
    (r"[\u200B\u200C\u2060\u180E\u202A-\u202E\u2066-\u2069]", ""),
    (r"(?<!^)\uFEFF", ""),
    (rules.VARIATION, ""),
    (r"(?<!" + rules.EMOJI_TAIL + r")\u200D", ""),
)
# fixed values: what assistants put into utm_source
SOURCES = r"utm_source=(?:chatgpt\.com|openai|perplexity(?:\.ai)?|copilot(?:\.com)?|gemini|claude(?:\.ai)?|bard|you\.com|mistral|deepseek|grok)"
#: The separator stays (as group 1) where another parameter follows.
TRACKED = rf"([?&]){SOURCES}&|[?&]{SOURCES}"
URL = r"""https?:\/\/[^\s)\]"'>]+"""
# fixed values: Cyrillic and Greek letters and the Latin ones they look like
LOOKALIKES = "\u0430\u0435\u043E\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u04BB\u0501\u051B\u051D\u0410\u0412\u0415\u041A\u041C\u041D\u041E\u0420\u0421\u0422\u0425\u0406\u0408\u0405\u03BF\u03B1\u03BD\u03C1\u03B9\u03BA\u03C4\u03C5\u039F\u0391\u0392\u0395\u0399\u039A\u039C\u039D\u03A4\u03A7\u0396\u0397\u03A1\u03A5"
LATIN = "aeopcyxijshdqwABEKMHOPCTXIJSoavpiktuOABEIKMNTXZHPY"


def without_tracker(url: Column) -> Column:
    """A url without the parameters by which assistants mark links; its other parameters stay."""
    kept = F.regexp_replace(url, java(TRACKED, "i"), "$1")  # once, from the left: a match ends where the next begins
    return F.when(kept.endswith("?") | kept.endswith("&"), F.left(kept, F.length(kept) - 1)).otherwise(kept)


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    """df with clean_text and removed: what was taken out; the text itself and 0 where there was nothing."""
    x = df.withColumn("_out", F.coalesce(F.col(text), F.lit(""))).withColumn("_n", F.lit(0).cast("long"))
    for pattern, flags in REMOVALS:
        p = java(pattern, flags)
        x = x.select(*df.columns, F.regexp_replace("_out", p, "").alias("_out"), (F.col("_n") + F.regexp_count("_out", F.lit(p))).alias("_n"))
    between, urls = F.split("_out", java(URL), -1), F.regexp_extract_all("_out", F.lit(java(URL)), 0)
    x = x.withColumn("_new", F.transform(urls, without_tracker)).withColumn("_n", F.col("_n") + F.size(F.filter(F.zip_with(urls, "_new", lambda a, b: a != b), lambda c: c)))
    x = x.withColumn("_out", F.when(F.size("_new") == 0, F.col("_out")).otherwise(F.array_join(F.zip_with(between, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")))
    letters = java(rules.LETTERS)
    mixed = lambda w: w.rlike(java(rules.LATIN)) & w.rlike(java(rules.LOOKALIKE))
    between, found = F.split("_out", letters, -1), F.regexp_extract_all("_out", F.lit(letters), 0)
    swapped = F.transform(found, lambda w: F.when(mixed(w), F.translate(w, LOOKALIKES, LATIN)).otherwise(w))
    changed = F.aggregate(F.filter(found, mixed), F.lit(0).cast("long"), lambda a, w: a + F.length(w) - F.length(F.translate(w, LOOKALIKES, "")))
    suspect = F.col("_out").rlike(java(rules.LOOKALIKE))
    x = x.withColumn("_n", F.col("_n") + F.when(suspect, changed).otherwise(0)).withColumn("_out", F.when(suspect, F.array_join(F.zip_with(between, swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(F.col("_out")))
    tidy = F.regexp_replace("_out", java(r"(\S) +([.,])(?=\s|$)", "m"), "$1$2")
    return x.select(*df.columns, F.when(F.col("_n") > 0, tidy).otherwise(F.col(text)).alias("clean_text"), F.col("_n").alias("removed"))


def prose_of_html(html: Column) -> Column:
    """Text of a piece of HTML: no notes, styles or tags, references decoded, note numbers and blanks squeezed."""
    out = html
    for pattern, to in ((r"(?s)<sup[^>]*class=\"[^\"]*reference[^\"]*\"[^>]*>.*?</sup>", ""), (r"(?s)<style.*?</style>", ""), (r"(?s)<script.*?</script>", ""), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"\[[0-9]+\]", ""), (f"[{WS}]+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return trimmed(out)
