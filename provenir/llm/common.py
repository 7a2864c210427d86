"""What several operators share: the shared folder, written tables, sorted groups and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_written, release, shared_dir, shared_path, unused, written  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(key: Column, share: float, salt: str) -> Column:
    """Whether a row is in a sample of this share, by a hash of its key; never an empty range for a share above 0."""
    return F.xxhash64(key.cast("string"), F.lit(salt)).bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(max(1, int(min(share, 1.0) * (1 << 62))))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str, rows: int = 20_000) -> DataFrame:
    """Run fn over whole groups of the rows with equal keys, many groups a call.

    The rows are dealt out by the keys and sorted; fn gets a frame of complete groups and the bounds of each
    group in it. Groups must be bounded: callers split hot keys before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def starts(x: pd.DataFrame) -> np.ndarray:
            new = np.zeros(len(x), dtype=bool)
            new[:1] = True
            for k in keys:
                v = x[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            size += len(frame)
            if size < rows:
                continue
            x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            at = starts(x)
            if len(at) > 1:
                out = fn(x.iloc[: at[-1]], at)
                if out is not None and len(out):
                    yield out
                x = x.iloc[at[-1] :].reset_index(drop=True)
            held, size = [x], len(x)
        if size:
            x = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            out = fn(x, np.append(starts(x), len(x)))
            if out is not None and len(out):
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the graph with these edges: (node, component), component the least node reachable.

    Alternates the two star operations of the map-reduce literature, which halve path lengths; every step is a
    grouping with partial aggregation and a join, so a hub with very many edges needs no task of its own.
    Nodes without an edge to another node do not appear. Edges with a null end are dropped.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v)).distinct()
    mark = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    e = written(e, "cc")
    was = tuple(mark(e))
    while was[0]:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "cc")
        drop_written(e)
        e, now = new, tuple(mark(new))
        if now == was:
            break
        was = now
    return e.select(u.alias("node"), v.alias("component")).unionByName(e.select(v.alias("node"), v.alias("component")).distinct())
