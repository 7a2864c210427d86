"""Exact top-k search by inner product with a bit-sliced index.

The index holds vectors in blocks. Of each quantised component a block keeps the SLICES most significant bits above the
block's least value, each bit as one bitmap over the block's rows, beside the exact integers. A query's weights are
rounded to WEIGHT bits and written in signed digits; every digit adds the component's slices at its place, or their
complements, by carry-save adders on whole bitmaps, which leaves a sum in slices. The k-th largest sum is then found
from the most significant slice downward. What was cut off from values and weights bounds the error of a sum from both
sides, so the rows that can reach the k best are those from a limit on; these boundary rows are scored exactly. No
row that could be among the k best is left out, however many they are.

Queries and blocks meet in cells of a grid: a cell gets one group of queries (GROUP at most, about) and streams its
blocks past them, so that a task holds the queries, their best so far, and one batch of blocks.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as query nor as
candidate; nor do rows with a null vec_id. Only vectors of a query's length are its candidates; empty vectors score 0.
Rows with the query's vec_id are its own; each row with a query's id is a query, so repeated rows give repeated
results; ties go to the smaller vec_id. An empty table gives an empty result. Scores are 64-bit: where components are
so large that one might not fit, the search ends with an error that says so. Extra columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block; bits of a component and of a weight that the slices work with.
BLOCK, SLICES, WEIGHT = 1 << 14, 6, 5
#: Queries of a group, about; groups of blocks from which on these grow instead; partitions of the grid at most.
GROUP, COLUMNS, PARTITIONS = 2048, 256, 10_000
PACKED = "block long, dim int, n int, ids binary, exact binary"
INDEXED = f"{PACKED}, low binary, top binary, shift int, kept int, slices binary"


def _packed(batches: Iterator[pa.RecordBatch], scale: float, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, ids, quantised vectors) of up to `rows` vectors of equal length, in the order of a partition."""
    part, count = TaskContext.get().partitionId() << 32, 0
    held: dict[int, list] = defaultdict(list)
    size: dict[int, int] = defaultdict(int)

    def out(d: int) -> tuple[int, np.ndarray, np.ndarray]:
        nonlocal count
        ids, values = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
        size.pop(d)
        count += 1
        return part + count - 1, ids, values

    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
        if len(flat) and np.abs(flat).max() >= 2.0**62:
            raise ValueError("quantised components must be below 2^62 in magnitude")
        flat, starts = flat.astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            values = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
            for k in range(0, len(at), rows):
                held[d].append((ids[at[k : k + rows]], values[k : k + rows]))
                size[d] += len(values[k : k + rows])
                if size[d] >= rows:
                    yield out(d)
    for d in list(held):
        yield out(d)


def _good(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return x.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))


def sliced(values: np.ndarray, most: int = SLICES) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(low, top, shift, slices) of a block: values = low + (cut << shift) + rest, cut <= top, slices (dim, bits, words) of cut."""
    low = values.min(0)
    above = values - low
    bits = int(above.max(initial=0)).bit_length()
    kept, shift = min(bits, most), max(0, bits - most)
    cut = above >> shift
    words = -(-len(values) // 64)
    planes = np.zeros((values.shape[1], kept, words * 64), dtype=np.uint8)
    for b in range(kept):
        planes[:, b, : len(values)] = ((cut >> b) & 1).T
    return low, cut.max(0), shift, np.packbits(planes, axis=2, bitorder="little").view(np.uint64)


def index(vectors: DataFrame, scale: float = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The bit-sliced index of vectors, quantised to floor(scale * x), a row for each block; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, values in _packed(batches, scale, BLOCK):
            low, top, shift, slices = sliced(values)
            row = {"block": block, "dim": values.shape[1], "n": len(ids), "ids": ids.tobytes(), "exact": values.astype(_narrow(values)).tobytes(), "low": low.tobytes(), "top": top.tobytes(), "shift": shift, "kept": slices.shape[1], "slices": slices.tobytes()}
            yield _batch(row)

    return written(_good(vectors, vec_id, embedding).mapInArrow(run, INDEXED), "slices")


def _batch(row: dict) -> pa.RecordBatch:
    kind = {"block": pa.int64(), "dim": pa.int32(), "n": pa.int32(), "shift": pa.int32(), "kept": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([v], type=kind.get(k, pa.binary())) for k, v in row.items()], names=list(row))


def _narrow(values: np.ndarray) -> np.dtype:
    most = int(np.abs(values).max(initial=0))
    return np.dtype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def digits(w: int) -> list[tuple[int, int]]:
    """(place, sign) of the signed digits of w, no two of them adjacent."""
    out, place = [], 0
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((place, d))
            w -= d
        w >>= 1
        place += 1
    return out


def added(places: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The sum of bitmaps by place, as one bitmap for each place: three bitmaps of a place become one and a carry."""
    out, place, carries = [], 0, []
    while places or carries:
        stack = np.concatenate([*carries, *([places.pop(place)] if place in places else [])]) if carries or place in places else None
        carries = []
        while stack is not None and len(stack) > 1:
            m = max(1, len(stack) // 3)
            if len(stack) == 2:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
                break
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            stack = np.concatenate((half ^ c, stack[3 * m :]))
        out.append(stack[0] if stack is not None else None)
        place += 1
    return out


class Block:
    def __init__(self, dim: int, n: int, ids: bytes, exact: bytes, low: bytes, top: bytes, shift: int, kept: int, slices: bytes):
        self.n, self.dim, self.shift, self.kept = n, dim, shift, kept
        self.ids = np.frombuffer(ids, dtype=np.int64)
        width = len(exact) // (n * dim) if dim else 8
        self.exact = np.frombuffer(exact, dtype=np.dtype(f"i{width}")).reshape(n, dim)
        self.low, self.top = np.frombuffer(low, dtype=np.int64), np.frombuffer(top, dtype=np.int64)
        words = -(-n // 64)
        s = np.frombuffer(slices, dtype=np.uint64).reshape(dim * kept, words)
        self.both = np.concatenate((s, ~s))  # complements behind
        self.all = np.full(words, ~np.uint64(0))
        if n % 64:
            self.all[-1] = np.uint64((1 << n % 64) - 1)
        order = np.argsort(self.ids, kind="stable")
        self.order, self.sorted = order, self.ids[order]
        self.largest = int(np.abs(self.exact.astype(np.int64)).max(initial=0))

    def others(self, own: int) -> np.ndarray:
        """The rows whose id is not `own`, as a bitmap."""
        a, b = np.searchsorted(self.sorted, [own, own + 1])
        out = self.all.copy()
        for i in self.order[a:b].tolist():
            out[i // 64] &= ~np.uint64(1 << i % 64)
        return out


def boundary(block: Block, weights: np.ndarray, rows: np.ndarray, k: int, best: int | None) -> np.ndarray:
    """Those of the rows (a bitmap) that can be among the k with the highest scores, or reach `best`, as their numbers."""
    count = int(np.bitwise_count(rows).sum())
    if not count:
        return np.zeros(0, np.int64)
    size = int(np.abs(weights).max(initial=0)).bit_length()
    cut = max(0, size - WEIGHT)
    near = (weights + (1 << cut >> 1)) >> cut
    rest = weights - (near << cut)
    places, extra = defaultdict(list), 0
    for d in np.flatnonzero(near).tolist():
        for place, sign in digits(int(near[d])):
            for b in range(block.kept):
                places[place + b].append(d * block.kept + b + (0 if sign > 0 else block.dim * block.kept))
            extra += 0 if sign > 0 else ((1 << block.kept) - 1) << place
    sums = added({p: block.both[at] for p, at in places.items()})
    # score = base + (sum - extra) * unit + something between least and most
    unit, tail = 1 << (cut + block.shift), (1 << block.shift) - 1
    w, t, e = weights.astype(object), block.top.astype(object), rest.astype(object)
    base = int((w * block.low.astype(object)).sum()) if block.dim else 0
    least = int((np.minimum(w, 0) * tail).sum() + (np.minimum(e, 0) * t * (1 << block.shift)).sum()) if block.dim else 0
    most = int((np.maximum(w, 0) * tail).sum() + (np.maximum(e, 0) * t * (1 << block.shift)).sum()) if block.dim else 0
    kth, equal, need = 0, rows, min(k, count)
    for p in range(len(sums) - 1, -1, -1):
        if sums[p] is None:
            continue
        ones = equal & sums[p]
        c = int(np.bitwise_count(ones).sum())
        if c >= need:
            equal, kth = ones, kth | 1 << p
        else:
            need, equal = need - c, equal & ~sums[p]
    floor = base + (kth - extra) * unit + least if count >= k else None
    if best is not None:
        floor = best if floor is None else max(floor, best)
    if floor is not None:
        limit = extra - (base + most - floor) // unit
        above, equal = np.zeros_like(rows), rows
        if limit > 0:
            if limit >> len(sums):
                return np.zeros(0, np.int64)
            for p in range(len(sums) - 1, -1, -1):
                one = sums[p] if sums[p] is not None else np.zeros_like(rows)
                if limit >> p & 1:
                    equal = equal & one
                else:
                    above, equal = above | (equal & one), equal & ~one
            rows = above | equal
    return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))


def search(indexed: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each row of queries, its own id left out."""
    if k < 1:
        raise ValueError("k must be 1 or more")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, values in _packed(batches, scale, GROUP):
            yield _batch({"block": block, "dim": values.shape[1], "n": len(ids), "ids": ids.tobytes(), "exact": values.tobytes()})

    asked = written(_good(queries, vec_id, embedding).mapInArrow(pack, PACKED), "queries")
    n_queries, n_blocks = asked.agg(F.sum("n")).first()[0] or 0, indexed.count()
    across, down = max(1, min(n_blocks, max(COLUMNS, n_blocks // 64))), max(1, -(-n_queries // GROUP))
    group = lambda of: F.pmod(F.xxhash64("block"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    cell: Column = F.col("r") * across + F.col("c")
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in INDEXED.split(", ")[5:])]
    q = asked.select("*", *none, F.lit(0).alias("kind"), group(down).alias("r"), every(across).alias("c"))
    x = indexed.select("*", F.lit(1).alias("kind"), group(across).alias("c"), every(down).alias("r"))
    both = q.unionByName(x).withColumn("cell", cell.cast("int")).drop("r", "c")
    parts = min(across * down, PARTITIONS)
    dealt = both.repartitionById(parts, F.pmod("cell", F.lit(parts))).sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for block, ids, _, best in held:
                for i, (found, scores) in enumerate(best):
                    m = len(found)
                    if m:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, v, dtype=t)) for v, t in ((block, np.int64), (i, np.int32), (ids[i], np.int64))] + [pa.array(found), pa.array(scores)], names=["block", "i", "query_id", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(i)[r].as_py() for i, c in enumerate(b.schema.names)}
                if row["cell"] != now:
                    yield from out()
                    now, held = row["cell"], []
                if row["kind"] == 0:
                    ids = np.frombuffer(row["ids"], dtype=np.int64)
                    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    held.append((row["block"], ids, np.frombuffer(row["exact"], dtype=np.int64).reshape(len(ids), row["dim"]), [none] * len(ids)))
                    continue
                block = None
                for _, ids, weights, best in held:
                    if weights.shape[1] != row["dim"]:
                        continue
                    block = block or Block(*(row[c] for c in ("dim", "n", "ids", "exact", "low", "top", "shift", "kept", "slices")))
                    if block.dim * block.largest * int(np.abs(weights).max(initial=0)) >= 1 << 63:
                        raise ValueError("a score might not fit 64 bits")
                    for i, own in enumerate(ids.tolist()):
                        found, scores = best[i]
                        at = boundary(block, weights[i], block.others(own), k, int(scores[-1]) if len(scores) == k else None)
                        if len(at):
                            found, scores = np.concatenate((found, block.ids[at])), np.concatenate((scores, block.exact[at].astype(np.int64) @ weights[i]))
                            first = np.lexsort((found, -scores))[:k]
                            best[i] = found[first], scores[first]
        yield from out()

    found = dealt.mapInArrow(run, "block long, i int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "i").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
