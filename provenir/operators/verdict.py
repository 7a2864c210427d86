"""Verdicts over signals: score, label, confidence, and which assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

MAX_STYLE, SCALE, DECLARED_SHARE = 45, 11, 0.85
SCRIPT = "script"
DECLARATIONS = ("meta-ai-name", "meta-c2pa", "project-git-assistant")
LABELS = ("Indéterminable : aucune trace exploitable", "Généré par IA, trace technique détectée", "Très probablement généré par IA", "Probablement généré ou retravaillé par IA", "Indices faibles, impossible de conclure", "Aucun indice d'IA détecté")

# fixed values: what a verdict is summed up by
VERSE_SUMMARY = "Poème ou texte en vers sans trace technique. Le modèle n'est pas fiable sur ce genre : rimes et images rendent tout poème peu prévisible, qu'il vienne d'un humain ou d'une IA. Rien ne permet de trancher."
SHORT_SUMMARY = ("Texte court (", " mots) sans trace technique, trop court aussi pour une mesure fiable par le modèle. Copié proprement, un texte d'IA de cette taille ne se distingue pas d'un texte humain. Analysez plutôt le fichier d'origine ou un texte plus long.")
NOTHING_SUMMARY = "Ni trace technique ni indice exploitable : rien ne permet de trancher. Un texte d'IA retouché ne laisse pas forcément de trace."
COUNTED = (" trace(s) technique(s)", "aucune trace technique", " indice(s) de style", " marque(s) humaine(s)")
RESTS_ON = (" Au moins une trace quasi certaine a été trouvée.", " Sans trace technique, le verdict repose surtout sur la mesure statistique du modèle de langage : un indice solide sur un texte long, jamais une preuve.", " Sans trace technique, le résultat repose sur le style : c'est une tendance, pas une preuve.")


def _summary(s: Column, words: Column, undetermined: Column, strong: Column, reliable: Column, domain: Column) -> Column:
    """The verdict in a sentence or two: what was found, and what the verdict rests on."""
    count = lambda keep: F.size(F.filter(s, keep))
    tech, style = count(lambda q: (q.direction == "ia") & technical(q)), count(lambda q: (q.direction == "ia") & ~technical(q) & (q.category != "model"))
    human = count(lambda q: q.direction == "humain")
    said = lambda n, text: F.concat(n.cast("string"), F.lit(text))
    found = F.concat_ws(", ", F.when(tech > 0, said(tech, COUNTED[0])).otherwise(COUNTED[1]), said(style, COUNTED[2]), F.when(human > 0, said(human, COUNTED[3])))
    rests = F.when(strong, RESTS_ON[0]).when(reliable, RESTS_ON[1]).when(tech == 0, RESTS_ON[2]).otherwise("")
    untold = F.when(F.coalesce(domain == "verse", F.lit(False)), VERSE_SUMMARY).when(words < 150, F.concat(F.lit(SHORT_SUMMARY[0]), words.cast("string"), F.lit(SHORT_SUMMARY[1]))).otherwise(NOTHING_SUMMARY)
    return F.when(undetermined, untold).otherwise(F.concat(found, F.lit("."), rests))


def _sum(signals: Column, keep) -> Column:
    return F.aggregate(F.filter(signals, keep), F.lit(0), lambda a, s: a + s.points)


def technical(s: Column) -> Column:
    return s.category.isin(*rules.TECHNICAL)


def saturated(points: Column, k: int = 30) -> Column:
    return F.floor(100 * (1 - F.exp(-F.greatest(F.lit(0), points) / k)) + 0.5).cast("int")


def scored(df: DataFrame, measured: bool = False, code: Column | None = None) -> DataFrame:
    """df (signals, words) with score, technical_score, style_score, model_score, undetermined, verdict, confidence, summary.

    measured: df has model_probability, model_reliability and model_domain (null where a text was not measured).
    """
    s = F.col("signals")
    p, r, domain = (F.col("model_probability"), F.col("model_reliability"), F.col("model_domain")) if measured else (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    x = df.withColumn("_tech", _sum(s, technical)).withColumn("_model", _sum(s, lambda q: q.category == "model"))
    x = x.withColumn("_style", F.least(F.lit(MAX_STYLE), _sum(s, lambda q: ~technical(q) & (q.category != "model"))))
    prior = -2 * (1 - F.coalesce(r, F.lit(0.0)))
    prior = prior if code is None else F.when(code, F.lit(-1.0)).otherwise(prior)
    z = (F.col("_tech") + 0.6 * F.col("_style") + F.col("_model")) / float(SCALE) + prior
    x = x.withColumn("score", F.least(F.lit(99), F.greatest(F.lit(1), F.floor(100 / (1 + F.exp(-z)) + 0.5))).cast("int"))
    ia = lambda keep: F.exists(s, lambda q: (q.direction == "ia") & keep(q))
    x = x.withColumn("_strong", ia(lambda q: technical(q) & (q.strength == "fort"))).withColumn("_medium", ia(lambda q: technical(q) & (q.strength == "moyen")))
    human = F.exists(s, lambda q: (q.direction == "humain") & (q.points != 0))
    reliable = F.coalesce((r >= 0.5) & (p >= 0.5), F.lit(False))
    x = x.withColumn("undetermined", ~F.col("_strong") & ~F.col("_medium") & ~reliable & ~human & (~ia(lambda q: q.points > 0) | (F.col("words") < 80) & (F.col("score") < 50) | F.coalesce(domain == "verse", F.lit(False)) & (F.col("score") < 50)))
    any_tech = ia(lambda q: technical(q) & (q.points > 0))
    score = F.col("score")
    label = F.when(F.col("undetermined"), LABELS[0]).when((score >= 85) & F.col("_strong"), LABELS[1]).when((score >= 85) | (score >= 70) & any_tech, LABELS[2]).when(score >= 50, LABELS[3]).when(score >= 30, LABELS[4]).otherwise(LABELS[5])
    x = x.withColumn("technical_score", saturated(F.col("_tech"))).withColumn("style_score", saturated(F.col("_style"))).withColumn("model_score", F.floor(p * 100 + 0.5).cast("int")).withColumn("verdict", label)
    sure = F.when(F.col("undetermined"), "faible").when(F.col("_strong"), "élevée").when(F.col("_medium"), "moyenne").when(F.coalesce((r >= 0.9) & (p > 0.9), F.lit(False)), "moyenne").when(F.col("words") < 150, "faible").when((F.col("style_score") >= 60) | (F.col("style_score") <= 10), "moyenne").otherwise("faible")
    x = x.withColumn("summary", _summary(s, F.col("words"), F.col("undetermined"), F.col("_strong"), reliable, domain))
    return x.withColumn("confidence", sure).drop("_tech", "_model", "_style", "_strong", "_medium")


def hints_of(signals: Column, vendors: tuple[str, ...] = rules.AI_VENDORS) -> Column:
    """(vendor, weight, trace, declared) for every assistant, in the fixed order; the weight is null without a hint."""
    factor = F.create_map(*[F.lit(x) for kv in rules.STRENGTH_FACTOR.items() for x in kv])
    own = F.flatten(F.transform(F.filter(signals, lambda s: s.direction == "ia"), lambda s: F.transform(s.vendors, lambda h: F.struct(
        h.vendor.alias("vendor"), (h.weight * factor[s.strength]).alias("weight"), ((h.weight >= 2) & s.strength.isin("fort", "moyen")).alias("trace"),
        (s.id.isin(*DECLARATIONS) & (h.weight >= 3) & (s.strength == "fort")).alias("declared"),
    ))))

    def per(found: Column, v: Column) -> Column:
        mine = F.filter(found, lambda h: h.vendor == v)
        total = F.aggregate(mine, F.lit(0.0), lambda a, h: a + h.weight)
        return F.struct(v.alias("vendor"), F.when(F.size(mine) > 0, total).alias("weight"), F.exists(mine, lambda h: h.trace).alias("trace"), F.exists(mine, lambda h: h.declared).alias("declared"))

    names = F.array(*map(F.lit, vendors))
    return F.flatten(F.transform(F.array(own), lambda found: F.transform(names, lambda v: per(found, v))))  # hints are gathered once


def level_of(hint: Column) -> Column:
    return F.when(hint.weight.isNull(), "aucun").when(hint.trace, "trace").otherwise("indice")


def _with_script(signals: Column) -> Column:
    """Hints at every assistant, and at a program of no assistant where there is one."""
    return F.filter(hints_of(signals, (*rules.AI_VENDORS, SCRIPT)), lambda h: (h.vendor != SCRIPT) | h.weight.isNotNull())


def vendors_of(df: DataFrame, key: str) -> DataFrame:
    """(key, ord, vendor, score, level): every assistant for every document, those without a hint with 0. Narrow."""
    x = df.select(key, _with_script(F.col("signals")).alias("h")).select(key, F.posexplode_outer("h").alias("ord", "h"))  # not posexplode: the optimizer would look into all rules again to see whether there are hints
    return x.select(key, "ord", "h.vendor", F.least(F.lit(100), F.coalesce(F.floor(F.col("h.weight") * 8 + 0.5), F.lit(0))).cast("int").alias("score"), level_of(F.col("h")).alias("level"))


def assistants(signals: Column) -> Column:
    """(vendor, score, level, reasons) by falling score, ties in the fixed order; reasons: the signals that hint at it, once each."""

    def of(found: Column) -> Column:
        why = lambda v: F.array_distinct(F.transform(F.filter(found.s, lambda s: (s.direction == "ia") & F.exists(s.vendors, lambda h: h.vendor == v)), lambda s: s.id))
        row = lambda h, i: F.struct(h.vendor.alias("vendor"), F.least(F.lit(100), F.coalesce(F.floor(h.weight * 8 + 0.5), F.lit(0))).cast("int").alias("score"), level_of(h).alias("level"), why(h.vendor).alias("reasons"), i.alias("ord"))
        return F.transform(ranked(F.transform(found.h, row)), lambda v: F.struct(v.vendor.alias("vendor"), v.score.alias("score"), v.level.alias("level"), v.reasons.alias("reasons")))

    return F.element_at(F.transform(F.array(F.struct(signals.alias("s"), _with_script(signals).alias("h"))), of), 1)


def ranked(vendors: Column) -> Column:
    """Assistants (ord, score, ...) by falling score, ties in the fixed order."""
    return F.transform(F.array_sort(F.transform(vendors, lambda v: F.struct((-v.score).alias("s"), v.ord.alias("o"), v.alias("v")))), lambda k: k.v)


def shares(signals: Column, probability: Column) -> Column:
    """(vendor, score, level): the probability shared among assistants; null where it can't be told.

    Traced assistants share among themselves where there is one, else all do, by 1 and their weight; what the file
    itself declares takes DECLARED_SHARE.
    """
    total = lambda x, keep: F.aggregate(F.filter(x, keep), F.lit(0.0), lambda a, e: a + e.w)

    def weighed(hints: Column) -> Column:
        traced = F.exists(hints, lambda h: h.trace)
        return F.transform(hints, lambda h: F.struct(h.vendor.alias("vendor"), F.when(traced, F.when(h.trace, h.weight).otherwise(0.0)).otherwise(1 + F.coalesce(h.weight, F.lit(0.0))).alias("w"), h.declared.alias("d"), level_of(h).alias("level")))

    def settled(x: Column) -> Column:
        some, mine, others = F.exists(x, lambda e: e.d), total(x, lambda e: e.d), total(x, lambda e: ~e.d)
        return F.transform(x, lambda e: F.struct(e.vendor.alias("vendor"), F.when(~some, e.w).when(e.d, F.try_divide(DECLARED_SHARE * e.w, mine)).otherwise(F.coalesce(F.try_divide((1 - DECLARED_SHARE) * e.w, others), F.lit(0.0))).alias("w"), e.level.alias("level")))

    def scored_(x: Column) -> Column:
        every = F.aggregate(x, F.lit(0.0), lambda a, e: a + e.w)
        return F.transform(x, lambda e: F.struct(e.vendor.alias("vendor"), F.floor(probability * (e.w / every) * 100 + 0.5).cast("int").alias("score"), e.level.alias("level")))

    once = lambda c, f: F.flatten(F.transform(F.array(c), f))  # noqa: E731  so that each step is made once
    return once(once(once(hints_of(signals), weighed), settled), scored_)


def origins_of(df: DataFrame, key: str, probability: Column) -> DataFrame:
    """(key, vendor, score) of `shares`, a row for each assistant. Narrow."""
    return df.select(key, F.explode(shares(F.col("signals"), probability)).alias("e")).select(key, "e.vendor", "e.score")
