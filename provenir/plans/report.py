"""One call for a whole report: everything that is said of a text or a file, a row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import cleaned
from ..operators import explain, files, places, software
from ..operators.verdict import assistants
from ..sources.shared import written
from .analyze import MAX_ANALYSED, MAX_SHOWN, analyzed

PROFILE = ("chars", "words", "sentences", "paragraphs", "language", "avg_sentence_length", "sentence_length_cv", "avg_word_length", "em_dash_per_1000", "bullet_line_ratio")


def _pieces(x: DataFrame, key: str, text: str, kind: Column, extension: Column | None) -> DataFrame:
    """Evidence and places of the signals (key, id, ord, evidence, at, level, shown): rules over texts, and those of code."""
    found = explain.explained(x.select(key, text, "language", "signals"), key, text)
    if extension is None:
        return found
    code = x.where(kind == "code").select(key, F.explode_outer(places.code_places(F.coalesce(F.col(text), F.lit("")), extension)).alias("p")).where("p is not null")
    return found.unionByName(code.select(key, "p.id", (F.col("p.ord") + 1000).alias("ord"), "p.evidence", "p.at", "p.level", F.lit(True).alias("shown")))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None, urls: Column | None = None, raw: str | None = None, extension: str | None = None, measures: DataFrame | None = None, limit: int | None = MAX_ANALYSED) -> DataFrame:
    """(key, the verdict with its summary, vendors, origins, signals with evidence, metadata, profile, text, text_truncated, highlights, cleaned).

    raw: column of a file's facts (map), extension: that of its extension; both for files only. The first `limit` characters
    are analysed and the first MAX_SHOWN shown; cleaned is null where nothing was taken out. Evidence and highlights are made
    beside the rows and joined to them by key: keys are unique and not null.
    """
    k = F.lit("text") if kind is None else kind
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), k.alias("kind"), *([F.col(raw).alias("raw")] if raw else []), *([F.col(extension).alias("extension")] if extension else []), *([urls.alias("urls")] if urls is not None else []))
    more = (files.file_signals("kind", "raw", "extension", "text"),) if raw and extension else ()
    x = analyzed(base, "text", F.col("kind"), F.col("urls") if urls is not None else None, measures, key, limit, more)
    x = written(x, "analyzed")  # read three times below; the rules run once
    pieces = written(_pieces(x, key, "text", F.col("kind"), F.col("extension") if extension else None), "pieces")  # read twice
    said = pieces.where(F.size("evidence") > 0).groupBy(key).agg(F.collect_list(F.struct("id", "evidence")).alias("_e"))  # a rule has one row
    shown = explain.highlighted(pieces, key)
    # the steps of the cleaner stay a plan of their own
    x = written(cleaned(x, "text").withColumn("cleaned", F.when(F.col("removed") > 0, F.struct(F.col("clean_text").alias("text"), "removed"))).drop("clean_text", "removed"), "cleaned")
    probability = F.when(~F.col("undetermined"), F.col("score") / 100)
    none = F.array().cast(f"array<{software.SOFTWARE}>")
    tools = F.when(F.col("kind").isin("pdf", "docx"), software.software_of(F.col("raw"))).otherwise(none) if raw else none
    x = x.withColumn("vendors", assistants(F.col("signals"))).withColumn("origins", software.origins(F.col("signals"), tools, probability))
    if raw:
        x = x.withColumn("_m", files.metadata_evidence(F.col("raw"), F.filter("signals", lambda s: s.category == "metadata")))
        x = x.withColumn("metadata", explain.flagged(files.metadata_rows(F.col("raw"), F.col("kind")), F.col("_m")))
    x = written(x, "judged")  # without a shuffle: the joins below would have these columns planned anew after each
    x = x.join(said, key, "left").join(shown, key, "left")
    mine = lambda s: F.get(F.transform(F.filter("_e", lambda e: e.id == s.id), lambda e: e.evidence), F.lit(0))
    fields = [f.split(":")[0] for f in ("seq", "id", "category", "strength", "direction", "points", "vendors", "count")]
    told = F.transform("signals", lambda s: F.struct(*[s[f].alias(f) for f in fields], F.coalesce(mine(s), F.array().cast("array<string>")).alias("evidence")))
    verdict = ("score", "technical_score", "style_score", "model_score", "verdict", "undetermined", "confidence", "summary")
    model = [c for c in ("model_status", "model_domain", "model_probability") if c in x.columns]
    marks = F.coalesce("highlights", F.array().cast(f"array<{explain.HIGHLIGHT}>"))
    return x.select(key, "kind", *verdict, *model, "vendors", "origins", told.alias("signals"), *(["metadata"] if raw else []), F.struct(*[c for c in PROFILE if c in x.columns]).alias("stats"), F.left("text", F.lit(MAX_SHOWN)).alias("text"), "text_truncated", marks.alias("highlights"), "cleaned")
