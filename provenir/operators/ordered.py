"""Ranks and running sums over ordered groups of any size: no group, however large, needs a task of its own.

The rows are range-partitioned by group and order, so a large group spans partitions. One pass over each sorted
partition adds up from where the partition begins; the totals of earlier partitions are then added to the rows of
the group that the partition begins with, the only one that can have begun before. What is known of a partition for
that is its first and its last row, so the step between holds two rows for each partition, whatever the groups are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.shared import unused, written


def _differs(now: pa.Array, before: pa.Array) -> pa.Array:
    """Where two arrays differ, nulls being equal to each other."""
    return pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))


def _begins(keys: list[pa.Array], last: list[pa.Array] | None, n: int) -> np.ndarray:
    """Where a row's group is another than that of the row before; last: the keys of the row before the first."""
    out = np.zeros(n, dtype=bool)
    out[0] = last is None
    for i, k in enumerate(keys):
        before = pa.concat_arrays([k.slice(0, 1) if last is None else last[i], k.slice(0, n - 1)])
        out |= _differs(k, before).to_numpy(zero_copy_only=False)
    return out


def _summed(values: np.ndarray, begins: np.ndarray, carried: int) -> np.ndarray:
    """Sums up to each row within its group; carried: the sum so far of the group that the rows begin in."""
    total = np.cumsum(values)
    at = np.flatnonzero(begins)
    return total - np.concatenate(([-carried], total[at] - values[at]))[np.cumsum(begins)]


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """df with the columns of `sums` (name: the long column that is added up, the row's own value included) and `rank`, from 1.

    group: columns of integers, strings, dates or binaries; without any, all rows are one group. order: columns or sort
    expressions; equal rows get places in any order. A null adds nothing. The result is a table in the shared folder
    with small corrections on top, so it may be read more than once and is the same each time.
    """
    sums = dict(sums or {})
    place, part, begun, head, last = unused(df, "place", "part", "begun", "head", "last")
    into = [*sums, *([rank] if rank else [])]
    dealt = df.withColumn(place, F.monotonically_increasing_id())
    by = [*[F.col(f"`{g}`") for g in group], *[F.col(o) if isinstance(o, str) else o for o in order], F.col(place)]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop(place)
    names = df.columns
    schema = StructType([*df.schema.fields, *[StructField(c, LongType()) for c in into], StructField(part, IntegerType()), StructField(begun, BooleanType()), StructField(head, BooleanType()), StructField(last, BooleanType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        keys: list[pa.Array] | None = None
        carried, groups, held = dict.fromkeys(into, 0), 0, None

        def out(b: pa.RecordBatch, own: list[pa.Array], first: np.ndarray, at_head: bool, at_last: bool) -> pa.RecordBatch:
            n = b.num_rows
            heads, lasts = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            heads[0], lasts[-1] = at_head, at_last
            flags = [pa.array(np.full(n, number, dtype=np.int32)), pa.array(first), pa.array(heads), pa.array(lasts)]
            return pa.RecordBatch.from_arrays([*b.columns, *own, *flags], names=schema.names)

        seen = False
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if held is not None:
                yield out(*held, at_head=not seen, at_last=False)
                seen = True
            now = [b.column(names.index(g)) for g in group]
            begins = _begins(now, keys, n) if group else np.arange(n) < (0 if groups else 1)
            own = []
            for c in into:
                values = np.ones(n, dtype=np.int64) if c == rank else pc.fill_null(b.column(names.index(sums[c])).cast(pa.int64()), 0).to_numpy()
                done = _summed(values, begins, carried[c])
                carried[c] = int(done[-1])
                own.append(pa.array(done, type=pa.int64()))
            held = (b, own, groups + np.cumsum(begins) == 1)
            groups += int(begins.sum())
            keys = [pa.concat_arrays([k.slice(n - 1, 1)]) for k in now]
        if held is not None:
            yield out(*held, at_head=not seen, at_last=True)

    done = written(dealt.mapInArrow(add, schema), "running")
    before = Window.partitionBy(*[F.col(f"`{g}`") for g in group] or [F.lit(0)]).orderBy(part, last).rowsBetween(Window.unboundedPreceding, -1)
    late = [f"{part}_{i}" for i in range(len(into))]
    edges = done.where(F.col(head) | F.col(last)).select(part, head, *[F.sum(F.when(F.col(last), F.col(f"`{c}`"))).over(before).alias(x) for c, x in zip(into, late, strict=True)])
    edges = edges.where(F.col(head)).select(part, *late)
    x = done.join(F.broadcast(edges), part, "left")  # a row for each partition
    total = [(F.col(f"`{c}`") + F.when(F.col(begun), F.coalesce(F.col(k), F.lit(0))).otherwise(F.lit(0))).alias(c) for c, k in zip(into, late, strict=True)]
    out = x.select(*[F.col(f"`{c}`") for c in names], *total)
    out._written_to = done._written_to  # for release()
    return out
