"""Calibration: weights by grouped cross-validation over labelled samples.

Samples: (sample_id, sample_group, ai, weight, tokens and the measures). Up to MAX_LOCAL samples
(counted before) folds are positions in a seeded order of the groups, and folds and formulas are independent groups of
a replicated table, so the fits run in parallel. Beyond that the fold is a seeded hash of the group, and each gradient
step is summed partition by partition over all samples: a job a step, none of which gathers rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .likelihood import BINOCULARS, THREE_MEASURES, feature

FOLDS, ITERATIONS, RATE, L2, ANSWER_WEIGHT, MIN_ANSWERS = 5, 3000, 0.1, 0.01, 5, 20
#: Samples whose groups are put in order by the driver and which are fitted in one task for each formula and part.
MAX_LOCAL = 100_000
FORMULAS = {"three": tuple(THREE_MEASURES["features"]), "binoculars": tuple(BINOCULARS["features"])}

FITTED = "formula string, part int, bias double, mean array<double>, sd array<double>, weight array<double>"


def seeded_order(groups: list[int], seed: float = 42.0) -> list[int]:
    """The groups in the order of a seeded shuffle; the generator works in doubles, as its results are fixed so."""
    state, order = seed, list(groups)
    for i in range(len(order) - 1, 0, -1):
        state = (state * 1_103_515_245.0 + 12_345.0) % 2_147_483_648.0
        j = int(state / 2_147_483_648.0 * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def folds(samples: DataFrame) -> DataFrame:
    """(sample_group, fold): position in the seeded order modulo FOLDS, groups taken in the order they first appear."""
    groups = [r[0] for r in samples.groupBy("sample_group").agg(F.min("sample_id").alias("first")).orderBy("first").select("sample_group").collect()]  # texts of a calibration corpus
    return samples.sparkSession.createDataFrame([(g, i % FOLDS) for i, g in enumerate(seeded_order(groups))], "sample_group long, fold int")


def fit(x: np.ndarray, ai: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, deviation and weight of each feature and the bias, by gradient steps with balanced classes."""
    mean = np.average(x, axis=0, weights=weight)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    z = (x - mean) / np.where(sd > 0, sd, 1)
    share = weight[ai].sum() / weight.sum()
    w = weight * np.where(ai, 0.5 / share, 0.5 / (1 - share))
    b, c = np.zeros(x.shape[1]), 0.0
    for _ in range(ITERATIONS):
        d = (1 / (1 + np.exp(-(z @ b + c))) - ai) * w
        b, c = b - RATE * (z.T @ d / len(z) + L2 * b), c - RATE * d.sum() / len(z)
    return mean, sd, b, float(c)


def _few(samples: DataFrame) -> bool:
    return samples.count() <= MAX_LOCAL


def fit_distributed(x: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """fit() of each formula and part of a _replicated() table, by sums over its partitions."""

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (name, fold), own in frame.groupby(["formula", "fold"]):
                yield pd.DataFrame({"formula": [name], "fold": [fold], "x": [np.stack(own["x"]).astype("f8").tobytes()], "ai": [own["ai"].to_numpy(dtype=bool).tobytes()], "weight": [own["weight"].to_numpy("f8").tobytes()]})

    def unpacked(r: Row) -> tuple:
        w = np.frombuffer(r.weight)
        return r.formula, r.fold, np.frombuffer(r.x).reshape(len(w), -1), np.frombuffer(r.ai, dtype=bool), w

    rows = x.select("formula", "fold", "ai", "weight", "x").mapInPandas(blocks, "formula string, fold int, x binary, ai binary, weight binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)

    def total(of: Callable[..., np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
        def add(part_rows: Iterator[tuple]) -> Iterator[dict]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for name, fold, v, ai, w in part_rows:
                for part in range(-1, FOLDS):
                    if part != fold:
                        sums[name, part] = sums.get((name, part), 0) + of((name, part), v, ai, w)
            yield sums

        return rows.mapPartitions(add).treeReduce(lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}})

    first = total(lambda k, v, ai, w: np.concatenate(([len(w), w.sum(), w[ai].sum()], w @ v)))
    mean = {k: s[3:] / s[1] for k, s in first.items()}
    sd = {k: np.sqrt(s / first[k][1]) for k, s in total(lambda k, v, ai, w: w @ (v - mean[k]) ** 2).items()}
    share = {k: s[2] / s[1] for k, s in first.items()}
    now = {k: (np.zeros(len(m)), 0.0) for k, m in mean.items()}

    def slope(k: tuple[str, int], v: np.ndarray, ai: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = (v - mean[k]) / np.where(sd[k] > 0, sd[k], 1)
        d = (1 / (1 + np.exp(-(z @ now[k][0] + now[k][1]))) - ai) * w * np.where(ai, 0.5 / share[k], 0.5 / (1 - share[k]))
        return np.append(z.T @ d, d.sum())

    for _ in range(ITERATIONS):
        g = total(slope)
        now = {k: (b - RATE * (g[k][:-1] / first[k][0] + L2 * b), c - RATE * g[k][-1] / first[k][0]) for k, (b, c) in now.items()}
    rows.unpersist()
    return {k: (mean[k], sd[k], b, float(c)) for k, (b, c) in now.items()}


def _replicated(samples: DataFrame) -> DataFrame:
    if _few(samples):
        x = samples.join(F.broadcast(folds(samples)), "sample_group")  # MAX_LOCAL rows at most
    else:
        x = samples.withColumn("fold", F.when(F.col("sample_group").isNotNull(), F.pmod(F.xxhash64(F.lit(42), "sample_group"), F.lit(FOLDS)).cast("int"))).where("fold is not null")
    parts = []
    for name, names in FORMULAS.items():
        own = x.select("sample_id", "ai", F.col("weight").cast("double").alias("weight"), "fold", F.lit(name).alias("formula"), F.array(*[feature(k).cast("double") for k in names]).alias("x"))
        parts.append(own.where(~F.exists("x", lambda v: v.isNull())))
    return parts[0].unionByName(parts[1])


def fitted(samples: DataFrame) -> DataFrame:
    """(formula, part, bias, features): weights without each fold (part 0 to 4) and of all samples (part -1)."""
    if not _few(samples):
        found = fit_distributed(_replicated(samples))
        out = [(name, part, c, mean.tolist(), sd.tolist(), b.tolist()) for (name, part), (mean, sd, b, c) in sorted(found.items())]
        return samples.sparkSession.createDataFrame(out, FITTED)
    x = _replicated(samples).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(-1, FOLDS)]))).where(F.col("part") != F.col("fold"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("sample_id")
        mean, sd, b, c = fit(np.stack(own["x"]), own["ai"].to_numpy(dtype=bool), own["weight"].to_numpy())
        return pd.DataFrame({"formula": [key[0]], "part": [key[1]], "bias": [c], "mean": [mean], "sd": [sd], "weight": [b]})

    return x.groupBy("formula", "part").applyInPandas(run, FITTED)


def out_of_fold(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(formula, sample_id, score): each sample scored by the weights that never saw its group."""
    w = F.broadcast(weights.withColumnRenamed("formula", "f").withColumnRenamed("weight", "b"))  # 12 rows
    x = _replicated(samples).join(w, (F.col("fold") == F.col("part")) & (F.col("formula") == F.col("f")))
    terms = F.transform("x", lambda v, i: F.get("b", i) * (v - F.get("mean", i)) / F.get("sd", i))
    return x.select("formula", "sample_id", F.aggregate(terms, F.col("bias"), lambda a, t: a + t).alias("score"))


def with_answers(base: DataFrame, answers: DataFrame) -> DataFrame:
    """Base samples and usable answers, which weigh ANSWER_WEIGHT and are groups of their own."""
    top = base.agg(F.max("sample_group").alias("g"), F.max("sample_id").alias("s"))
    usable = answers.where("domain = 'prose' and tokens >= 20 and mean_entropy is not null and criterion is not null")
    extra = usable.join(F.broadcast(top))  # top: one row
    n = F.col("answer_id")
    return base.unionByName(extra.select((F.col("s") + n + 1).alias("sample_id"), (F.col("g") + n + 1).alias("sample_group"), (F.col("label") == "ai").alias("ai"), F.lit(ANSWER_WEIGHT).cast("long").alias("weight"), "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars"))
