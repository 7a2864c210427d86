"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors are collapsed first. Each table gives a vector a bucket by the signs of its products with `bits` random
hyperplanes; the vectors of a bucket are compared exactly, in double precision, block against block. Buckets beyond
BLOCK vectors are dealt out in pairs of blocks, so no task gets a whole hot bucket and none is cut off. A pair is
counted only in the first table that brings it together, which the shipped signatures tell; instead of pairs, a
block gives each vector's count of links and the least vector it is connected with there. `bits` grows with the
logarithm of the number of vectors and the number of tables is what a pair exactly at the threshold needs to be
missed with probability `miss` at most; above the threshold misses are far rarer.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
vectors of different lengths; a null vec_id is kept, with a null component; rows that share a vec_id are one node, whose
vectors' links add up; repeated rows give repeated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import light
from .common import by_group, components, written

BLOCK = 512
#: Hot buckets that are broadcast at most.
MAX_BROADCAST = 100_000
SEED = 20240603


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a signature and number of tables for n vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2) / 32))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) of signatures of unit vectors."""
    planes = np.random.default_rng((SEED, x.shape[1])).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(x: np.ndarray, sig: np.ndarray, table: int, part: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows with cosine >= threshold that no earlier table has brought together."""
    cos = x @ x.T
    ok = np.triu(cos >= threshold, 1)
    if cross:
        ok &= part[:, None] != part[None, :]
    i, j = np.nonzero(ok)
    if table and len(i):
        new = np.ones(len(i), dtype=bool)
        for a in range(0, len(i), 65536):
            new[a : a + 65536] = ~(sig[i[a : a + 65536], :table] == sig[j[a : a + 65536], :table]).any(1)
        i, j = i[new], j[new]
    return i, j


def local_least(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row is connected with by the pairs."""
    least = ids.copy()
    while len(i):
        was = least.copy()
        np.minimum.at(least, i, was[j])
        np.minimum.at(least, j, least[i])
        if (least == was).all():
            break
    return least


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; ids are integers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    good = rows.where(finite & F.col("id").isNotNull()).dropDuplicates(["id", "v"])
    classes = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("v", "rep", "n", F.xxhash64("v").alias("key")), "classes")
    bits, tables = plan(classes.count(), threshold, miss)

    @F.pandas_udf("array<int>")
    def sign(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        size = v.map(len).to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            for k, s in zip(at, signatures(unit(np.stack(v.iloc[at].to_list()).astype(np.float64)), bits, tables), strict=True):
                out[k] = s
        return pd.Series(out)

    signed = written(light(classes).select("rep", "n", "key", "v", sign("v").alias("sig")), "signed")
    tabled = signed.select("rep", "n", "key", "v", "sig", F.size("v").alias("d"), F.posexplode("sig").alias("t", "bucket"))
    sizes = tabled.groupBy("t", "bucket", "d").agg(F.count("*").alias("m")).where("m > 1")
    sizes = written(sizes.select("t", "bucket", "d", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")), "buckets")
    hot = sizes.where("parts > 1")
    hot = F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = tabled.join(hot, ["t", "bucket", "d"], "left").withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = dealt.withColumn("other", other).select("t", "bucket", "d", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "key", "n", "v", "sig")

    def compare(x: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        out = []
        t, i, j, part_of, rep, key, n = (x[c].to_numpy() for c in ("t", "i", "j", "part", "rep", "key", "n"))
        v, sig = x["v"].to_numpy(), x["sig"].to_numpy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            p, q = linked(unit(np.stack(v[a:b])), np.stack(sig[a:b]), int(t[a]), part_of[a:b], i[a] != j[a], threshold)
            if len(p):
                count = np.bincount(p, n[a:b][q], minlength=b - a) + np.bincount(q, n[a:b][p], minlength=b - a)
                k = np.flatnonzero(count)
                out.append(pd.DataFrame({"key": key[a:b][k], "rep": rep[a:b][k], "links": count[k].astype(np.int64), "low": local_least(b - a, p, q, rep[a:b])[k]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"key": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})

    found = written(by_group(light(dealt), ["t", "bucket", "d", "i", "j"], compare, "key long, rep long, links long, low long", rows=4000), "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ties = good.join(classes.select("v", "rep"), "v").select("id", "rep")
    members = components(found.select("rep", "low").unionByName(ties.where("id <> rep").select(F.col("id").alias("rep"), F.col("rep").alias("low"))), "rep", "low")
    per_id = _counts(good, classes, links)
    out = rows.join(per_id, "id", "left").join(members.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _counts(good: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """n_links of each id: links of its vector's class to others, and the other members of the class."""
    per_class = classes.join(links, "key", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("k"))
    return good.join(per_class, "v").groupBy("id").agg(F.sum("k").alias("n_links"))
