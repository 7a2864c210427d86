"""The newest reports of a stream, kept as they arrive in any order.

Reports are dealt out to parts by a hash of their ids; a part's state is its newest `most` ids with their times, however
long the stream is, and only ids and times are shuffled. Out come changes: an id that enters a part's newest ones, or
comes again with a later time, and one that leaves them. An id that left never comes back with the same time, as those
that took its place only grow, so the changes can be read in any order: of an id the latest time counts, and of that
whether it left.

Defined results: of reports with one id the one with the latest time counts; equal times are ordered by id, the greatest
first; a report without id or time is in no history; repeated rows change nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import HISTORY

#: Parts whose states are kept side by side.
PARTS = 16


def merged(held: dict, new: Iterable[tuple], most: int) -> dict:
    """The newest `most` of {id: time} and (id, time), an id with its latest time."""
    out = dict(held)
    for key, at in new:
        if key not in out or at > out[key]:
            out[key] = at
    return out if len(out) <= most else dict(heapq.nlargest(most, out.items(), key=lambda e: (e[1], e[0])))


def changes(reports: DataFrame, by: str = "created", key: str = "report_id", most: int = HISTORY, parts: int = PARTS) -> DataFrame:
    """(part, key, at, kept) for a stream of reports: ids that enter (kept) and leave; at is in microseconds."""
    x = reports.select(F.col(key).alias("key"), F.unix_micros(F.col(by).cast("timestamp")).alias("at")).where("key is not null and at is not null")
    kind = dict(x.dtypes)["key"]
    x = x.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def run(part: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = dict(zip(*state.get, strict=True)) if state.exists else {}
        now = was
        for f in frames:
            latest = f.groupby("key")["at"].max()
            now = merged(now, zip(latest.index.tolist(), latest.tolist(), strict=True), most)
        state.update((list(now), list(now.values())))
        rows = [(k, at, True) for k, at in now.items() if was.get(k) != at] + [(k, at, False) for k, at in was.items() if k not in now]
        out = pd.DataFrame(rows, columns=["key", "at", "kept"])
        out.insert(0, "part", part[0])
        yield out

    return x.groupBy("part").applyInPandasWithState(run, f"part int, key {kind}, at long, kept boolean", f"keys array<{kind}>, times array<long>", "append", GroupStateTimeout.NoTimeout)


def keeping(reports: DataFrame, out: str, checkpoint: str, by: str = "created", key: str = "report_id", most: int = HISTORY, parts: int = PARTS, **trigger) -> StreamingQuery:
    """Start writing the changes of a stream of reports to Parquet files in out."""
    return changes(reports, by, key, most, parts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(changed: DataFrame, most: int = HISTORY) -> DataFrame:
    """(key, at) of the newest reports, from all changes so far: a top-k, never a full sort."""
    last = changed.groupBy("key").agg(F.max(F.struct("at", (~F.col("kept")).alias("gone"))).alias("x"))
    return last.where("not x.gone").select("key", "x.at").orderBy(F.desc("at"), F.desc("key")).limit(most)
