"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are gathered by Spark from labelled rows (at most about `max_train` of them, drawn by
a hash of the id; a documented bound, prediction covers every row); the smoothed log-probabilities are a matrix of
BUCKETS rows that is broadcast, and whole texts are scored in numpy, batch by batch.

Defined results: `und` with score 0 for a null text and one without a letter; rows with null lang or null text teach
nothing; without labelled rows everything is `und`; ties go to the language first in the alphabet; repeated rows
give repeated rows; extra columns are kept, whatever they are called. All languages count as equally likely before a
text is read: the classes' shares among the labelled rows are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import light
from .common import sampled, unused

ORDERS = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
#: Characters of text that are scored at once.
CHUNK = 1 << 20


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams of the joined texts, and the bounds of the texts in them.

    Texts end with a space; the n-grams that run into the next text are left out by a bucket of BUCKETS.
    """
    code = np.frombuffer(" ".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) + 1 for t in texts])
    ends = np.cumsum(sizes)
    h = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x9E3779B1)) ^ (code[n - 1 :] * np.uint32(0x85EBCA6B))
        if n in ORDERS:
            x = h * np.uint32(0xC2B2AE35)
            buckets = ((x ^ (x >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int32)
            for k in range(1, n):
                buckets[np.minimum(ends - k, m - 1)] = BUCKETS
            yield buckets, np.concatenate(([0], np.minimum(ends[:-1], m - 1)))


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string")) % of


def train(docs: DataFrame, max_train: int = 20_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS + 1, languages) matrix of log-probabilities learned from docs."""
    rows = docs.where(F.col(lang).isNotNull())
    n = rows.count()
    if n > max_train:
        rows = rows.where(sampled(F.col(doc_id), max_train / n, "langid"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for x in frames:
            for name, own in x.groupby("lang"):
                texts = [t for t in own["text"] if t]
                total = sums.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                for a, b in chunks(texts):
                    for buckets, _ in grams(texts[a:b]):
                        total += np.bincount(buckets, minlength=BUCKETS + 1)
        for name, total in sums.items():
            at = np.flatnonzero(total[:BUCKETS])
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": total[at]})

    found = light(rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))).mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages times BUCKETS rows at most
    names = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(names)))
    counts[found["bucket"].to_numpy(dtype=np.int64), np.searchsorted(names, found["lang"].to_numpy())] = found["n"].to_numpy()
    logs = np.log(counts + 0.5) - np.log(counts[:BUCKETS].sum(0) + 0.5 * BUCKETS)
    logs[BUCKETS] = 0
    return names, logs.astype(np.float32)


def score(texts: list[str | None], names: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability, all languages being as likely before."""
    said, prob = ["und"] * len(texts), np.zeros(len(texts))
    where = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if names else []
    own = [texts[i] for i in where]
    for a, b in chunks(own):
        total = np.zeros((b - a, len(names)))
        for buckets, starts in grams(own[a:b]):
            for k in range(len(names)):
                total[:, k] += np.add.reduceat(logs[:, k][buckets], starts, dtype=np.float64)
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, k, v in zip(where[a:b], best.tolist(), p.tolist(), strict=True):
            said[i], prob[i] = names[k], v
    return said, prob


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", into: str = "lang_pred", score_into: str = "lang_score") -> DataFrame:
    """docs with two more columns: the predicted language and its score."""
    names, logs = model
    held = docs.sparkSession.sparkContext.broadcast((names, np.asfortranarray(logs)))

    @F.pandas_udf("said string, prob double")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in columns:
            said, prob = score(s.tolist(), *held.value)
            yield pd.DataFrame({"said": said, "prob": prob})

    (held_in,) = unused(docs, "said")
    out = light(docs).withColumn(held_in, run(F.col(f"`{text}`")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (into, score_into)]
    return out.select(*kept, F.col(held_in).said.alias(into), F.col(held_in).prob.alias(score_into))
