"""The whole analysis of a table of documents as one transform: profile, signals, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import cleaned
from ..functions.rx import WS
from ..functions.text import profiled, prose_sample, trimmed, verse
from ..operators.detect import SEQ, SIGNAL, Detector, detected, ordered, signal
from ..operators.likelihood import model_signal
from ..operators.likelihood import scored as scored_measures
from ..operators.verdict import hints_of, level_of, ranked, scored

MAX_ANALYSED, MAX_SHOWN = 400_000, 60_000
#: Share of prose under which a file is technical.
TECHNICAL_PROSE = 0.75


def domain_of(text: Column, kind: Column) -> Column:
    """verse, technical or prose: what a language model's measure of the text is worth. Only files can be technical."""
    sample = prose_sample(text)
    ratio = F.when(sample == text, 0.0).otherwise(F.length(sample) / F.greatest(F.lit(1), F.length(text)))
    return F.when(verse(text), "verse").when(kind.isin("pdf", "docx") & (ratio < TECHNICAL_PROSE), "technical").otherwise("prose")


def measured_text(text: Column, kind: Column) -> Column:
    """What a language model is given of the text: the prose of a file, all of other texts."""
    return F.when(kind.isin("pdf", "docx") & ~verse(text), prose_sample(text)).otherwise(text)


def with_model(x: DataFrame, measures: DataFrame, key: str, text: str, kind: Column) -> DataFrame:
    """x with model_domain, model_probability, model_reliability, model_status and the model's signal.

    measures: (key, tokens, mean_log_prob, mean_entropy, criterion, binoculars) of the texts that a model measured. A text
    that none measured has the signal model-unavailable; code and texts under five words are skipped.
    """
    m = scored_measures(measures).select(F.col(key).alias("_k"), F.struct("tokens", "logit", "probability", "reliability").alias("_m"))
    x = x.join(m, F.col(key) == F.col("_k"), "left").drop("_k")
    asked = (kind != "code") & (F.col("words") >= 5)
    x = x.withColumn("model_status", F.when(~asked, "skipped").when(F.col("_m").isNull(), "unavailable").otherwise("used"))
    used = F.col("model_status") == "used"
    x = x.withColumn("model_domain", F.when(used, domain_of(F.col(text), kind)))
    x = x.select("*", *[F.when(used, F.col(f"_m.{c}")).alias(c) for c in ("logit", "probability", "reliability")])
    mute = (F.col("model_domain") == "verse") & (F.col("probability") < 0.5)
    said = F.when(used, F.array(model_signal(F.col("model_domain")))).when(F.col("model_status") == "unavailable", F.array(signal(SEQ["model"], "model-unavailable", "model", "info", "neutre", 0))).otherwise(F.array())
    x = x.withColumn("signals", F.concat("signals", said.cast(f"array<{SIGNAL}>")))
    x = x.withColumn("model_probability", F.col("probability")).withColumn("model_reliability", F.when(mute, F.least(F.col("reliability"), F.lit(0.4))).otherwise(F.col("reliability")))
    return x.drop("_m", "logit", "probability", "reliability")


def analyzed(docs: DataFrame, text: str = "text", kind: Column | None = None, urls: Column | None = None, measures: DataFrame | None = None, key: str = "doc_id", limit: int | None = None, more: tuple[Detector, ...] = (), ascii_edges: bool = False) -> DataFrame:
    """docs with profile, ordered signals, scores and verdict. Without measures there is no shuffle.

    measures: what a language model measured, joined by key (see with_model). more: further detectors, such as those of
    `operators.files`. limit: characters of a text that are analysed (MAX_ANALYSED in an interactive report); without
    it whole texts are. ascii_edges: see `operators.detect.bounded`.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    x = docs.withColumn(text, whole if limit is None else F.left(whole, F.lit(limit))).withColumn("text_truncated", F.coalesce(F.length(F.col(text)) > MAX_SHOWN, F.lit(False)))
    x = detected(profiled(x, text), text, kind, urls, more, ascii_edges)
    if measures is not None:
        x = with_model(x, measures, key, text, F.lit("text") if kind is None else kind)
    return scored(x.withColumn("signals", ordered(F.col("signals"))), measures is not None, None if kind is None else kind == "code")


def excerpt_of(text: str = "text") -> Column:
    return trimmed(F.regexp_replace(F.left(F.col(text), F.lit(140)), f"[{WS}]+", " "))


def summary(reports: DataFrame, text: str = "text") -> DataFrame:
    """reports with a short excerpt of their text on one line."""
    return reports.withColumn("excerpt", excerpt_of(text))


def summaries(reports: DataFrame, text: str = "text") -> DataFrame:
    """What a list of reports shows: score, verdict, the best traced assistant and an excerpt, beside the other columns."""
    hints = F.transform(hints_of(F.col("signals")), lambda h, i: F.struct(h.vendor.alias("vendor"), F.least(F.lit(100), F.floor(F.coalesce(h.weight, F.lit(0.0)) * 8 + 0.5)).cast("int").alias("score"), level_of(h).alias("level"), i.alias("ord")))
    top = F.try_element_at(F.filter(ranked(hints), lambda v: v.level == "trace"), F.lit(1)).vendor
    return reports.withColumn("top_vendor", top).withColumn("excerpt", excerpt_of(text)).drop("signals")


def with_cleaned(reports: DataFrame, text: str = "text") -> DataFrame:
    return cleaned(reports, text)
