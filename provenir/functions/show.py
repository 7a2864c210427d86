"""How reports show things: sizes, dates, tendencies, warnings, names of models, and which signals come first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TECHNICAL_DATE = r"D?:?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([Zz]|[+-][0-9]{2}'?[0-9]{2}'?)?"


def pdf_date(d: Column) -> Column:
    """A date of a PDF file as day, time and zone; other strings stay, null stays null."""
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(d, TECHNICAL_DATE, k), F.lit("")), F.lit(default))
    zone = F.replace(part(7, ""), F.lit("'"), F.lit(""))
    named = F.when(zone == "", "fuseau non précisé").when(F.upper(zone) == "Z", "UTC").otherwise(F.concat(F.lit("UTC"), F.regexp_replace(zone, r"([0-9]{2})([0-9]{2})\z", "$1:$2")))
    shown = F.concat(part(3, "01"), F.lit("/"), part(2, "01"), F.lit("/"), part(1, ""), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), F.lit(" ("), named, F.lit(")"))
    return F.when(F.regexp_extract(d, TECHNICAL_DATE, 1) != "", shown).otherwise(d)


def size(n: Column) -> Column:
    """Bytes as o, Ko or Mo."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" o"))).when(n < 1024 * 1024, F.concat(one(n / 1024), F.lit(" Ko"))).otherwise(F.concat(one(n / 1024 / 1024), F.lit(" Mo")))


def date(t: Column) -> Column:
    """A time of day as the reports show it, in the session's time zone."""
    return F.date_format(t, "dd.MM.yyyy HH:mm")


def tendency(score: Column) -> Column:
    return F.when(score < 35, "plutôt humain").when(score > 65, "plutôt IA").otherwise("aucune tendance nette")


def warnings(sentences: Column, cv: Column, dashes: Column, n_words: Column) -> Column:
    """Which statistics of a text are out of the ordinary."""
    return F.filter(F.array(F.when((sentences >= 8) & (cv < 0.4), "sentence_length_cv"), F.when((dashes >= 4) & (n_words >= 250), "em_dash_per_1000")), lambda w: w.isNotNull())


def main_signals(signals: Column) -> Column:
    """Signals that say something, and strongly; all if none does."""
    main = F.filter(signals, lambda s: (s.direction != "neutre") & s.strength.isin("fort", "moyen"))
    return F.when(F.size(main) > 0, main).otherwise(signals)


def model_uri(uri: Column) -> Column:
    """(name, parameters, quantization) that the address of a model file says."""
    last = F.element_at(F.split(uri, "/"), -1)
    name = F.regexp_replace(F.element_at(F.split(last, ":"), 1), r"(?i)-GGUF\z", "")
    billions = F.nullif(F.regexp_extract(name, r"(?i)([0-9]+(?:\.[0-9]+)?)B\b", 1), F.lit(""))
    quantization = F.nullif(F.regexp_extract(F.element_at(F.split(uri, ":"), -1), r"(?i)^Q\w+$", 0), F.lit(""))
    return F.struct(name.alias("name"), F.replace(billions, F.lit("."), F.lit(",")).alias("parameters"), quantization.alias("quantization"))


def pooled_others(origins: Column, score: Column) -> Column:
    """(identified, others): assistants that stand out, and the score of all others together.

    An assistant stands out by a trace or a score above the least; if none does, the others have the report's score.
    """
    ai = F.filter(origins, lambda o: o.kind == "ia")
    least = F.array_min(F.transform(ai, lambda o: F.coalesce(o.score, F.lit(0))))
    stands = lambda o: (o.level == "trace") | (F.coalesce(o.score, F.lit(0)) > least)
    known = F.filter(ai, stands)
    rest = F.aggregate(F.filter(ai, lambda o: ~stands(o)), F.lit(0), lambda a, o: a + F.coalesce(o.score, F.lit(0)))
    total = F.when(F.forall(ai, lambda o: o.score.isNull()), None).when(F.size(known) == 0, score).otherwise(rest)
    return F.struct(F.transform(known, lambda o: o.id).alias("identified"), total.cast("int").alias("others"))
