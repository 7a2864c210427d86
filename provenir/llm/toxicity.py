"""Toxicity: a logistic classifier regularised by counterfactuals.

Features of a text are which words and word beginnings (PREFIXES letters) occur in it. Spark counts them by label
over the labelled rows (at most about `max_train` of them, drawn by a hash of the id; a documented bound), the MAX_FEATURES
that tell the labels apart best are kept together with those of the identity terms, and a logistic model is fitted
to the rows' kept features. For each row that mentions a group, its counterfactual (every identity term replaced by
the next of its kind) is built as well, and the squared change of the score between the two is penalised, so that
the name of a group says little by itself. Every text is scored whole.

Defined results: a null or empty text has the score of a text without features; labels other than 0 and 1 and null
texts teach nothing; labelled ids without a document are ignored; without labelled rows all scores are 0; repeated
rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import light
from .common import sampled

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
MAX_FEATURES = 4096
MAX_WORDS = 400_000
#: Identity terms by kind; a term's counterfactual is the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "foreigners", "refugees"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, t in enumerate(kind)}


def features_of(word: str) -> tuple[int, ...]:
    """Numbers of a word's features: itself and its beginnings."""
    return (xxhash.xxh3_64_intdigest(word) >> 1, *(xxhash.xxh3_64_intdigest(f"{word[:n]}-") >> 1 for n in PREFIXES if len(word) >= n))


class Index:
    """Which kept features a word has; remembers words up to MAX_WORDS."""

    def __init__(self, kept: np.ndarray | None) -> None:
        self.at = None if kept is None else {int(f): i for i, f in enumerate(kept)}
        self.words: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            found = features_of(word)
            if self.at is not None:
                found = tuple(self.at[f] for f in found if f in self.at)
            self.words[word] = found
        return found

    def text(self, words: set[str]) -> set[int]:
        return {f for w in words for f in self.of(w)}


def words_of(text: str | None) -> set[str]:
    return {*WORD.findall((text or "").lower())}


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Kept features, their weights and the bias, learned from the rows of labels."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    n = known.count()
    if n > max_train:
        known = known.where(sampled(F.col("doc_id"), max_train / n, "toxicity"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").select("text", "y")  # known: max_train ids

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(None)
        sums: dict[int, list[int]] = {}
        for x in frames:
            for t, y in zip(x["text"], x["y"], strict=True):
                for f in index.text(words_of(t)):
                    sums.setdefault(f, [0, 0])[y] += 1
        yield pd.DataFrame({"feature": np.fromiter(sums, dtype=np.int64, count=len(sums)), "n0": [v[0] for v in sums.values()], "n1": [v[1] for v in sums.values()]})

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf if 1 not in sizes else np.inf
    n0, n1 = sizes[0], sizes[1]
    total = light(rows).mapInPandas(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    z = odds / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = total.where(F.col("n0") + F.col("n1") >= 3).select("feature", F.abs(z).alias("z")).where(F.col("z") > 3).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    kept = np.unique(np.concatenate([np.array([r.feature for r in best.collect()], dtype=np.int64), np.array([f for w in SWAP for f in features_of(w)], dtype=np.int64)]))
    held = spark.sparkContext.broadcast(kept)

    def matrix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value)
        for x in frames:
            out = []
            for t, y in zip(x["text"], x["y"], strict=True):
                words = words_of(t)
                own = index.text(words)
                swapped = index.text({SWAP.get(w, w) for w in words}) if not words.isdisjoint(SWAP) else None
                out.append((y, sorted(own), None if swapped is None else sorted(swapped)))
            yield pd.DataFrame(out, columns=["y", "own", "swapped"])

    fit = light(rows).mapInPandas(matrix, "y int, own array<int>, swapped array<int>").toPandas()  # max_train rows
    weights, bias = _fit(fit["own"].tolist(), fit["y"].to_numpy(dtype=np.float64), fit["swapped"].tolist(), len(kept), penalty)
    return kept, weights, bias


def _sparse(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = [0 if r is None else len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(r, dtype=np.int64) for r in rows if r is not None]])


def _fit(own: list, y: np.ndarray, swapped: list, n: int, penalty: float, rounds: int = 400, rate: float = 0.3, l2: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps on the log loss, with l2 and the counterfactual penalty."""
    r, c = _sparse(own)
    with_pair = np.array([s is not None for s in swapped], dtype=bool)
    sr, sc = _sparse(swapped)
    w, b, seen, seen_b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.full(n, 1e-8), 1e-8
    m = len(y)
    for _ in range(rounds):
        s = b + np.bincount(r, w[c], minlength=m)
        e = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y) / m
        g = np.bincount(c, e[r], minlength=n) + l2 * w
        if with_pair.any():
            change = np.where(with_pair, s - b - np.bincount(sr, w[sc], minlength=m), 0) * (2 * penalty / with_pair.sum())
            g += np.bincount(c, change[r], minlength=n) - np.bincount(sc, change[sr], minlength=n)
        gb = e.sum()
        seen += g * g
        seen_b += gb * gb
        w -= rate * g / np.sqrt(seen)
        b -= rate * gb / np.sqrt(seen_b)
    return w, float(b)


def predict(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with one more column: the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept, weights, bias = held.value
        index = Index(kept)
        for s in columns:
            raw = np.array([bias + sum(weights[f] for f in index.text(words_of(t))) for t in s])
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -500, 500))))

    return light(docs).withColumn(into, run(F.col(text)))
