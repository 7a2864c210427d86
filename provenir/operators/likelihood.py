"""Predictability of texts from token distributions, and the calibrated score made of it.

Token distributions come as a table (key, pos, actual, total_weight, logits ARRAY<STRUCT<token,logit>> from the
largest down); where they come from (a language model run elsewhere) is not this module's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import SEQ, signal
from .ordered import running

# fixed values: default calibration, (mean, sd, weight) by feature, bias, and offset by number of tokens
THREE_MEASURES = {"features": {"mean_log_prob": (-2.2857, 0.634, 0.6101), "mean_entropy": (2.117, 0.5398, -0.3328), "criterion_per_token": (-0.0763, 0.135, 0.7473), "log_tokens": (4.4628, 0.7093, -0.2212)}, "bias": -0.1958, "thresholds": ((30, 1.5936), (50, 1.5701), (80, 1.1173), (120, 0.9889), (200, 0.9861))}
BINOCULARS = {"features": {"binoculars": (1.0975, 0.1493, -1.0337), "log_tokens": (4.4628, 0.7093, -0.0897)}, "bias": -0.128, "thresholds": ((30, 1.6094), (50, 1.167), (80, 0.9351), (120, 0.837), (200, 0.6089))}
# fixed values: the calibration that holds until another is applied; rates by number of tokens: detected, false positives
_rates = lambda *detected: tuple((t, d, 0.05) for t, d in zip((30, 50, 80, 120, 200), detected, strict=True))
DEFAULT = {
    "measures": THREE_MEASURES | {"rates": _rates(0.21, 0.22, 0.26, 0.24, 0.21)}, "binoculars": BINOCULARS | {"rates": _rates(0.1, 0.24, 0.29, 0.29, 0.37)},
    "origin": "origine", "texts": {"ai": 240, "human": 400}, "answers": 0, "rates": _rates(0.21, 0.24, 0.29, 0.29, 0.37), "applied_at": None,
}
MIN_TOKENS, FULL_TOKENS, MAX_LOGIT, MAX_LOG_TOKENS, FALSE_ALARMS, BINOCULARS_FROM = 20, 60, 3.5, 240, 0.05, 50
BUCKETS = (30, 50, 80, 120, 200)
HUMAN_CAP = {"prose": 5, "technical": 2, "verse": 0}


def position_stats(logits: DataFrame, vocabulary: int) -> DataFrame:
    """log_prob of the written token, and mean and variance of log-probabilities, for each position that has it.

    What the kept logits leave of the mass lies evenly on the rest of the vocabulary.
    """
    log_z = F.col("logits")[0].logit + F.log("total_weight")
    own = F.element_at(F.filter("logits", lambda x: x.token == F.col("actual")), 1).logit
    x = logits.where(F.exists("logits", lambda x: x.token == F.col("actual"))).withColumn("_z", log_z).withColumn("_own", own)
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
    step = lambda a, e: F.struct((a.m + F.exp(e.logit - F.col("_z"))).alias("m"), (a.s1 + F.exp(e.logit - F.col("_z")) * (e.logit - F.col("_z"))).alias("s1"), (a.s2 + F.exp(e.logit - F.col("_z")) * (e.logit - F.col("_z")) * (e.logit - F.col("_z"))).alias("s2"))
    x = x.withColumn("_a", F.aggregate("logits", zero, step))
    tail, rest = 1 - F.col("_a.m"), vocabulary - F.size("logits")
    has_tail = (tail > 1e-9) & (rest > 0)
    lp = F.log(F.greatest(tail, F.lit(1e-300)) / F.greatest(rest, F.lit(1)))
    s1, s2 = F.col("_a.s1") + F.when(has_tail, tail * lp).otherwise(0.0), F.col("_a.s2") + F.when(has_tail, tail * lp * lp).otherwise(0.0)
    return x.withColumn("mean", s1).withColumn("variance", F.greatest(F.lit(0.0), s2 - s1 * s1)).withColumn("log_prob", F.col("_own") - F.col("_z")).drop("_z", "_own", "_a")


def crossed(x: DataFrame) -> DataFrame:
    """x with x_ppl, for rows that have the logits of both: logits and total_weight the performer's, observed the observer's."""
    top = F.col("observed")[0].logit
    x = x.withColumn("_z", F.col("logits")[0].logit + F.log("total_weight")).withColumn("_p", F.map_from_entries(F.transform("logits", lambda e: F.struct(e.token, e.logit))))
    x = x.withColumn("_mass", F.aggregate("observed", F.lit(0.0), lambda a, e: a + F.exp(e.logit - top)))
    cross = F.aggregate("observed", F.lit(0.0), lambda a, e: a - F.exp(e.logit - top) / F.col("_mass") * (F.try_element_at("_p", e.token) - F.col("_z")))
    return x.withColumn("x_ppl", cross).drop("_z", "_p", "_mass")


def cross_entropy(observer: DataFrame, performer: DataFrame, key: str) -> DataFrame:
    """(key, pos, x_ppl): expectation of the performer's -log p under the observer; null if it lacks a token."""
    x = observer.select(key, "pos", F.col("logits").alias("observed")).join(performer.select(key, "pos", "logits", "total_weight"), [key, "pos"])
    return crossed(x).select(key, "pos", "x_ppl")


def prefix_measures(positions: DataFrame, key: str, lengths: tuple[int, ...]) -> DataFrame:
    """Measures of each text's first tokens, for each length (the whole text where it is shorter, once).

    positions: (key, pos, log_prob, mean, variance, x_ppl or null). One grouping serves all lengths; it adds up where the
    positions are made, so that one row a text travels. Every position counts for a text's length.
    """
    lengths = tuple(sorted(set(lengths)))

    def part(k: int) -> Column:
        own = lambda c: F.when(F.col("pos") < k - 1, c)
        both = own(F.when(F.col("x_ppl").isNotNull(), -F.col("log_prob")))
        return F.struct(F.least(F.lit(k), F.max("pos") + 2).alias("size"), F.count(own(F.lit(1))).alias("k"), F.sum(own(F.col("log_prob"))).alias("lp"), F.sum(own(F.col("mean"))).alias("m"), F.sum(own(F.col("variance"))).alias("v"), F.avg(both).alias("a"), F.avg(own(F.col("x_ppl"))).alias("b"))

    g = positions.groupBy(key).agg(F.array(*map(part, lengths)).alias("_parts"))
    g = g.select(key, F.explode(F.filter("_parts", lambda x, i: (i == 0) | (x.size != F.get("_parts", i - 1).size))).alias("_part")).select(key, "_part.*")
    return g.where("v > 0").select(key, "size", (F.col("k") + 1).alias("tokens"), (F.col("lp") / F.col("k")).alias("mean_log_prob"), (-F.col("m") / F.col("k")).alias("mean_entropy"), ((F.col("lp") - F.col("m")) / F.sqrt("v")).alias("criterion"), F.try_divide("a", "b").alias("binoculars"))


def feature(name: str) -> Column:
    t = F.col("tokens").cast("double")
    return F.col("criterion") / F.sqrt(t) if name == "criterion_per_token" else F.log(F.least(t, F.lit(float(MAX_LOG_TOKENS)))) if name == "log_tokens" else F.col(name)


def raw_logit(formula: dict) -> Column:
    z = F.lit(float(formula["bias"]))
    for name, (mean, sd, weight) in formula["features"].items():
        z = z + F.lit(float(weight)) * (feature(name) - F.lit(float(mean))) / F.lit(float(sd))
    return z


def offset_at(thresholds: tuple, tokens: Column) -> Column:
    """Offset for a length: between the measured lengths by the logarithm, beyond them the nearest."""
    if not thresholds:
        return F.lit(0.0)
    t = sorted(thresholds)
    out = F.when(tokens <= t[0][0], float(t[0][1]))
    for (a, x), (b, y) in zip(t, t[1:], strict=False):
        out = out.when(tokens <= b, F.lit(float(x)) + (F.log(tokens.cast("double")) - F.log(F.lit(float(a)))) / (F.log(F.lit(float(b))) - F.log(F.lit(float(a)))) * (float(y) - float(x)))
    return out.otherwise(float(t[-1][1]))


def scored(measures: DataFrame, three: dict = THREE_MEASURES, binoculars: dict | None = BINOCULARS) -> DataFrame:
    """measures with logit, probability, reliability: Binoculars alone from BINOCULARS_FROM tokens on, else three measures."""
    z = raw_logit(three) - offset_at(three["thresholds"], F.col("tokens"))
    if binoculars:
        z = F.when(F.col("binoculars").isNotNull() & (F.col("tokens") >= BINOCULARS_FROM), raw_logit(binoculars) - offset_at(binoculars["thresholds"], F.col("tokens"))).otherwise(z)
    x = measures.withColumn("logit", F.greatest(F.lit(-MAX_LOGIT), F.least(F.lit(MAX_LOGIT), z)))
    return x.withColumn("probability", 1 / (1 + F.exp(-F.col("logit")))).withColumn("reliability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("tokens") - MIN_TOKENS) / float(FULL_TOKENS - MIN_TOKENS))))


def model_signal(domain: Column) -> Column:
    """The signal of a scored measure: points by logit and reliability, capped on the human side by domain."""
    p, r = F.col("probability"), F.col("reliability")
    cap = F.when(domain == "technical", HUMAN_CAP["technical"]).when(domain == "verse", HUMAN_CAP["verse"]).otherwise(HUMAN_CAP["prose"])
    points = F.greatest(-cap, F.floor(11 * r * F.col("logit") + 0.5)).cast("int")
    ia, size = p >= 0.5, F.abs(points)
    mute = (r == 0) | (domain == "verse") & ~ia
    strength = F.when(mute, "info").when(ia & ((p > 0.9) | (p < 0.1)) & (r == 1), "fort").when(size >= 8, "moyen").otherwise("faible")
    direction = F.when(mute | (size < 3), "neutre").when(ia, "ia").otherwise("humain")
    return signal(SEQ["model"], "model-likelihood", "model", strength, direction, F.when(mute, 0).otherwise(points))


def bucket(tokens: Column) -> Column:
    """The nearest measured length, the shorter on ties."""
    out = F.lit(BUCKETS[-1])
    for a, b in reversed(list(zip(BUCKETS, BUCKETS[1:], strict=False))):
        out = F.when(tokens * 2 <= a + b, a).otherwise(out)
    return out


def lowest_reaching(values: DataFrame, by: list[str], weight: str, reached: Column) -> DataFrame:
    """(by, offset): the least score at which `reached` holds, a condition on _upto and _all.

    values: by, score and a column of weights. _upto is the weight of the scores up to this one and _all that of the group.
    Groups are few and large, so the sums run over range partitions of all of them; weights add up as multiples of
    2^-20, which makes the sums the same in any order.
    """
    unit = 1 << 20
    per = values.groupBy(*by, "score").agg(F.sum(F.round(F.col(weight) * unit).cast("long")).alias("_w"))
    x = running(per, by, ["score"], {"_upto": "_w"})
    every = x.groupBy(*by).agg(F.sum("_w").alias("_all"))
    x = x.join(F.broadcast(every), by)  # a row for each formula and length
    x = x.withColumn("_upto", F.col("_upto") / unit).withColumn("_all", F.col("_all") / unit)
    return x.where(reached).groupBy(*by).agg(F.min("score").alias("offset"))


def thresholds_of(scores: DataFrame) -> DataFrame:
    """(bucket, offset): the score that all but FALSE_ALARMS of the human weight does not exceed."""
    human = scores.where(~F.col("ai")).withColumn("bucket", bucket(F.col("tokens")))
    return lowest_reaching(human, ["bucket"], "weight", F.col("_upto") >= (1 - FALSE_ALARMS) * F.col("_all"))


def rates_of(flagged: DataFrame) -> DataFrame:
    """(bucket, detected, false_positives): weighted shares of flagged samples; buckets with both classes."""
    x = flagged.withColumn("bucket", bucket(F.col("tokens")))
    share = lambda ai: F.floor(F.try_divide(F.sum(F.when((F.col("ai") == ai) & F.col("flag"), F.col("weight")).otherwise(0)), F.sum(F.when(F.col("ai") == ai, F.col("weight")).otherwise(0))) * 100 + 0.5) / 100.0
    return x.groupBy("bucket").agg(share(True).alias("detected"), share(False).alias("false_positives")).where("detected is not null and false_positives is not null")
