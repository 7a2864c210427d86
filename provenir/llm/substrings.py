"""Exact substring deduplication: every byte covered by a string of MIN_LENGTH bytes that starts in two places goes.

A suffix array of the whole collection has no place on one machine, so the suffixes are first brought together
where they can be equal at all:

1. Anchors. Of the grams in each window of MIN_LENGTH bytes the one with the least hash is its anchor; equal windows
   have equal anchors at equal offsets. Anchors whose gram occurs once are done with. The windows of the others fall
   into two halves by the anchor's offset; all windows of a half share a core around the anchor, which is more than
   half a window, and only repeated cores go on.
2. Occurrences whose whole surroundings (everything that the half's windows can touch) are equal are collapsed:
   all their windows are repeated. What remains is one occurrence of each distinct surrounding.
3. For each core the remaining occurrences are sorted by what follows the anchor, which is their part of the suffix
   array, with common prefixes of neighbours. The rows are extended backward, breadth first, over the byte before
   (their part of the Burrows-Wheeler transform): each interval of rows with the same left context splits by that
   byte, the common prefix of the neighbours in each new interval is the least of those between, and the window at
   that offset is repeated if it reaches MIN_LENGTH together with what is to the left. Prefixes are followed up to
   MIN_LENGTH only, and rows alone in their interval drop out.
4. A core with more than HOT distinct surroundings is too large an interval for one task: its range of offsets is cut
   into FAN parts, whose cores are longer and so split the rows by further bytes, and steps 2 and 3 are applied to each
   part; at a single offset core and surroundings are the window itself, so the cutting ends.

Cores and surroundings are compared by two hashes of 64 bits together.

Defined results: a null text is empty; texts shorter than MIN_LENGTH bytes stay whole; repeated rows repeat each
other's text, as do rows that share an id; a null id is kept; extra columns are kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import light
from .common import by_group, release, unused, written
from .ngramjoin import _BACK, _BASE, mixed, powers

U = np.uint64
MIN_LENGTH = 400
CHUNK = 1 << 20
#: Distinct surroundings of a core that one task gets at most, and parts that the range of offsets of others is cut into.
HOT = 4096
FAN = 8
#: Rows with places in documents that are broadcast at most, of about 40 bytes each.
MAX_BROADCAST = 100_000
_CODE = np.random.default_rng(20240602).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def gram(w: int) -> int:
    """Bytes of a gram."""
    return max(min(8, w), w // 8)


def halves(w: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Least and largest offset of the anchor in the windows of each half."""
    offsets = w - gram(w) + 1
    half = max(1, offsets // 2)
    return (0, half - 1), (min(half, offsets - 1), offsets - 1)


def parts_of(lo: int, hi: int) -> list[tuple[int, int]]:
    """A range of offsets cut into FAN parts."""
    step = -(-(hi - lo + 1) // FAN)
    return [(x, min(hi, x + step - 1)) for x in range(lo, hi + 1, step)]


def _chunks(texts: list[bytes]) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


class Sums:
    """Hashes of any stretch of the bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_CODE[data] * powers(_BASE, len(data)))))
        self.back = powers(_BACK, len(data) + 1)

    def piece(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self.sums[e] - self.sums[s]) * self.back[s] + (e - s).astype(np.uint64))

    def keys(self, a: np.ndarray, first: np.ndarray, last: np.ndarray, w: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors at a in texts from first to last: whether a window has one at an offset from lo to hi, and the
        hashes of its core and surroundings."""
        ok = (a - first >= lo) & (a - np.minimum(hi, a - first) + w <= last)
        core, hull = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
        a, first, last = a[ok], first[ok], last[ok]
        core[ok] = self.piece(a - lo, a + w - hi) + U(lo)
        s, e = np.maximum(first, a - hi), np.minimum(last, a + w - lo)
        hull[ok] = self.piece(s, e) ^ mixed((a - s).astype(np.uint64) * U(2) + U(1))
        return ok, core.view(np.int64), hull.view(np.int64)


def anchors(texts: list[bytes], w: int) -> list[tuple[np.ndarray, ...]]:
    """For each text the places of its anchors, the hashes of their grams, and for each half those of the core and of
    the surroundings (both 0 where no window of the half holds the anchor)."""
    none = (np.zeros(0, dtype=np.int64),) * 6
    out = [none] * len(texts)
    g = gram(w)
    for held in _chunks([t if len(t) >= w else b"" for t in texts]):
        own = [i for i in held if len(texts[i]) >= w]
        if not own:
            continue
        data = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
        size = np.array([len(texts[i]) for i in own])
        start = np.cumsum(size) - size
        n = len(data)
        sums = Sums(data)
        span = w - g + 1
        grams = mixed((sums.sums[g:] - sums.sums[: n - g + 1]) * sums.back[: n - g + 1])
        key = (grams & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        rows = -(-len(key) // span)
        block = np.full(rows * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        block[: len(key)] = key
        block = block.reshape(rows, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - w + 1
        least = np.minimum(behind[:m], ahead[span - 1 : span - 1 + m])
        doc = np.repeat(np.arange(len(own)), size)
        inside = doc[:m] == doc[w - 1 :]
        least = least[inside]
        at = (least[np.concatenate(([True], least[1:] != least[:-1]))] & U(0xFFFFFFFF)).astype(np.int64)
        at = np.unique(at)
        d = doc[at]
        keys = [x for lo, hi in halves(w) for x in sums.keys(at, start[d], start[d] + size[d], w, lo, hi)[1:]]
        cut = np.searchsorted(at, np.append(start, n))
        for k, i in enumerate(own):
            x = slice(cut[k], cut[k + 1])
            out[i] = (at[x] - start[k], grams[at[x]].view(np.int64), *(y[x] for y in keys))
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def hits(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, group: np.ndarray, w: int, lo: int, hi: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Which windows of each row, by offset from lo to hi, another row of its group has too (rows, hi - lo + 1).

    With owner, only what rows of two owners have counts.

    left[:, k] is the byte k + 1 before the anchor, right the bytes from the anchor on; n_left and n_right say how many
    of them the document has.
    """
    found = np.zeros((len(group), hi - lo + 1), dtype=bool)
    row = np.lexsort((np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), group))
    cls = group[row].astype(np.int64)
    differ = right[row[1:]] != right[row[:-1]]
    lcp = np.where(differ.any(1), differ.argmax(1), right.shape[1])
    lcp = np.minimum(lcp, np.minimum(n_right[row[1:]], n_right[row[:-1]]))
    lcp = np.concatenate(([-1], np.where(cls[1:] == cls[:-1], lcp, -1)))  # with the row before; -1: another interval
    for j in range(lo, hi + 1):
        keep = n_left[row] >= j
        if j > lo:
            same = (lcp >= 0) & np.concatenate(([False], left[row[1:], j - 1] == left[row[:-1], j - 1])) if len(row) else keep
            if not keep.all() or not (same == (lcp >= 0)).all():
                symbol = np.where(keep, left[row, j - 1].astype(np.int64), 256)
                order = np.lexsort((np.arange(len(row)), symbol, cls))
                least = _least_between(lcp, order)
                row, cls, symbol = row[order], cls[order], symbol[order]
                new = np.concatenate(([True], (cls[1:] != cls[:-1]) | (symbol[1:] != symbol[:-1]))) | (symbol == 256)
                lcp = np.where(new, -1, least)
                cls = np.cumsum(new)
        elif not keep.all():
            order = np.flatnonzero(keep)
            least = _least_between(lcp, order)
            row, cls = row[order], cls[order]
            lcp = np.where(np.concatenate(([True], cls[1:] != cls[:-1])), -1, least)
        linked = lcp >= 0
        alone = ~(linked | np.concatenate((linked[1:], [False])))
        if alone.any():
            row, cls, lcp = row[~alone], cls[~alone], lcp[~alone]
        if not len(row):
            break
        long = lcp >= w - j
        if owner is not None and long.any():
            first = np.flatnonzero(~long)
            least, most = np.minimum.reduceat(owner[row], first), np.maximum.reduceat(owner[row], first)
            found[row[np.repeat(least != most, np.diff(np.append(first, len(row))))], j - lo] = True
        else:
            found[row[long | np.concatenate((long[1:], [False]))], j - lo] = True
    return found


def _least_between(lcp: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For rows brought into a new order: the least lcp between each row and the one now before it.

    Only right for neighbours that keep their old order, as those of one interval do; the others get anything.
    """
    if len(order) < 2:
        return np.full(len(order), -1)
    a, b = order[:-1] + 1, order[1:] + 1  # least of lcp[a:b]
    size = np.maximum(b - a, 1)
    level = np.floor(np.log2(size)).astype(np.int64)
    out = np.full(len(order) - 1, -1)
    table, k = lcp, 0
    while True:
        at = np.flatnonzero((level == k) & (b > a))
        out[at] = np.minimum(table[a[at]], table[b[at] - (1 << k)])
        k += 1
        if k > level.max():
            break
        table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])
    return np.concatenate(([-1], out))


def spans_of(found: np.ndarray, anchor: np.ndarray, w: int, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of repeated windows."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, anchor[row] - (after - 1 + lo), anchor[row] - (first + lo) + w


KEYS = ["places", "grams", "core0", "hull0", "core1", "hull1"]


def repeated(docs: DataFrame, w: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text", scope: str | None = None, by_text: bool = False) -> DataFrame:
    """id_hash, text_hash, start, end: spans of bytes that repeated strings cover; together they are all such bytes.

    With a scope column, strings count as repeated only where two different texts of a scope have them; of equal
    surroundings within one text one is then looked at. by_text: id_hash, text_hash, spans, a row for each of docs that has some.
    """
    spark = docs.sparkSession
    source = docs.where(F.octet_length(text) >= w).select(*hashes(doc_id, text), F.col(text).alias("text"), (F.xxhash64(scope) if scope else F.lit(0).cast("long")).alias("scope"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts = [_bytes(t) for t in x["text"]]
            found = anchors(texts, w)
            if scope:
                found = [(f[0], *(np.where(v == 0, 0, v ^ s) for v in f[1:])) for f, s in zip(found, x["scope"].tolist(), strict=True)]
            yield pd.DataFrame({"id_hash": x["id_hash"], "text_hash": x["text_hash"], "size": [len(t) for t in texts]} | {k: [f[i] for f in found] for i, k in enumerate(KEYS)})

    made = light(source, 500).mapInPandas(find, "id_hash long, text_hash long, size long, places array<int>, " + ", ".join(f"{k} array<long>" for k in KEYS[1:]))
    made = written(made.withColumn("d", F.monotonically_increasing_id()), "anchors")
    who = "text_hash" if scope else None
    several = lambda key, rows: (rows.groupBy(*key).agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a <> b") if scope else rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")).select(*key)
    twice = several(["gram"], made.select(*([who] if scope else []), F.explode("grams").alias("gram")))
    of = ["d", who] if scope else ["d"]
    rows = made.select(*of, F.explode(F.arrays_zip(*KEYS)).alias("x")).select(*of, F.col("x.grams").alias("gram"), F.col("x.places").alias("anchor"), *[F.col(f"x.{k}").alias(k) for k in KEYS[2:]])
    done: list[DataFrame] = []
    if scope:  # within a scope few grams are repeated
        twice = written(twice, "twice")
        done = [twice]
        twice = F.broadcast(twice) if twice.count() <= MAX_BROADCAST else twice
    near = written(rows.join(twice, "gram").drop("gram"), "near")
    texts_of = written(made.select("d", "id_hash", "text_hash", "size"), "ids")
    release(spark, made)
    # one row for each half that a window has an anchor in
    sides = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(f"core{k}").alias("core"), F.col(f"hull{k}").alias("hull")) for k, (lo, hi) in enumerate(halves(w))]))
    places = near.select(*of, "anchor", sides.alias("x")).select(*of, "anchor", "x.*").where("core <> 0 or hull <> 0")
    places = written(places.join(several(["core"], places), "core"), "places")
    release(spark, near)
    spans, level, done = None, 0, [*done, places, texts_of]
    while True:
        covered, fine = collapsed(places, w, scope)
        fine = written(fine, "fine")
        wanted = fine.select("d", "anchor", "lo", "hi", "core", "n", "hot").join(texts_of, "d")
        cut = written(regions(wanted, source, w), "regions")
        usual = by_group(light(cut.where("not hot"), 1000), ["core"], expander(w, bool(scope)), "d long, start long, end long", rows=4000)
        end = F.col("anchor") + w - F.col("lo")
        sized = covered if by_text else covered.join(texts_of.select("d", "size"), "d")
        found = written(sized.select("d", F.greatest(F.lit(0), F.col("anchor") - F.col("hi")).cast("long").alias("start"), (end if by_text else F.least("size", end)).cast("long").alias("end")).unionByName(usual), "spans")
        spans = found if spans is None else spans.unionByName(found)
        done.append(found)
        hot = cut.where("hot")
        if hot.isEmpty():
            release(spark, fine, cut)
            break
        level += 1
        narrow = written(light(hot, 1000).mapInPandas(narrowed(w), "d long, anchor int, text_hash long, n int, lo int, hi int, core long, hull long"), "narrow")
        keep = narrow if scope else narrow.drop("text_hash")
        # an occurrence that stands for several equal ones has been covered and still counts as one that others equal
        again = several(["core"], keep)
        places = written(keep.join(again, "core"), "places")
        done.append(places)
        release(spark, fine, cut, narrow)
    if by_text:
        per = spans.groupBy("d").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(texts_of, "d")
        out = written(per.select("id_hash", "text_hash", F.transform("spans", lambda x: F.struct(x.start.alias("start"), F.least(x.end, "size").alias("end"))).alias("spans")), "spans")
    else:
        out = written(spans.join(texts_of.select("d", "id_hash", "text_hash"), "d").select("id_hash", "text_hash", "start", "end"), "spans")
    release(spark, *done)
    return out


def hashes(doc_id: str, text: str) -> tuple:
    """id_hash, text_hash: what a document is known by."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(doc_id).isNull()).alias("id_hash"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")


def collapsed(places: DataFrame, w: int, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """Places whose surroundings are repeated, and one place of each surroundings where a core has several.

    n: 1, or -1 where the surroundings are known to be covered; hot: too many for one task.
    """
    known = F.col("n") if "n" in places.columns else F.lit(1)
    rows = places.withColumn("n", known)
    count = F.when(F.min("text_hash") != F.max("text_hash"), 2).otherwise(1) if scope else F.count("*")
    distinct = rows.groupBy("core", "hull").agg(count.alias("k"), F.min("n").alias("n"), F.min(F.struct("d", "anchor", "lo", "hi")).alias("one"))
    covered = rows.join(distinct.where("k > 1").select("core", "hull"), ["core", "hull"]).select("d", "anchor", "lo", "hi")
    m = distinct.groupBy("core").agg(F.count("*").alias("m")).where("m > 1")
    fine = distinct.join(m, "core").select("core", (F.col("m") > HOT).alias("hot"), F.when(F.col("k") > 1, -1).otherwise(F.col("n")).cast("int").alias("n"), "one.*")
    return covered, fine


def regions(wanted: DataFrame, source: DataFrame, w: int) -> DataFrame:
    """wanted with n_left and region: the bytes around each anchor that windows with it can touch, once a document."""
    per_doc = written(wanted.groupBy("id_hash", "text_hash").agg(F.collect_list(F.struct("d", "anchor", "lo", "hi", "core", "n", "hot")).alias("at"), F.count("*").alias("k")), "wanted")
    total = per_doc.agg(F.sum("k")).first()[0] or 0
    near = per_doc.drop("k")
    texts = source.select("id_hash", "text_hash", "text").join(F.broadcast(near) if total <= MAX_BROADCAST else near, ["id_hash", "text_hash"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for h, t, places in zip(x["text_hash"], x["text"], x["at"], strict=True):
                b = _bytes(t)
                for p in places:
                    a = p["anchor"]
                    s = max(0, a - p["hi"])
                    out.append((p["core"], p["hot"], p["lo"], p["hi"], p["n"], p["d"], h, a, a - s, b[s : a + w - p["lo"]]))
            if out:
                yield pd.DataFrame(out, columns=["core", "hot", "lo", "hi", "n", "d", "text_hash", "anchor", "n_left", "region"])

    cut = light(texts.dropDuplicates(["id_hash", "text_hash"]) if total > MAX_BROADCAST else texts, 200).mapInPandas(run, "core long, hot boolean, lo int, hi int, n int, d long, text_hash long, anchor int, n_left int, region binary")
    return cut if total > MAX_BROADCAST else cut.dropDuplicates(["d", "anchor", "lo"])


def expander(w: int, scoped: bool) -> Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]:
    """Step 3 for whole groups of regions with a core."""

    def expand(x: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        parts = []
        lo_of, hi_of = x["lo"].to_numpy(), x["hi"].to_numpy()
        for lo, hi in sorted({*zip(lo_of.tolist(), hi_of.tolist(), strict=True)}):
            own = np.flatnonzero((lo_of == lo) & (hi_of == hi))
            before, after = hi, w - lo
            n_left = x["n_left"].to_numpy()[own].astype(np.int64)
            cut = [x["region"].iat[k] for k in own]
            n_right = np.array([len(r) for r in cut]) - n_left
            left = np.frombuffer(b"".join(bytes(r[:k][::-1]).ljust(before, b"\0") for r, k in zip(cut, n_left.tolist(), strict=True)), dtype=np.uint8).reshape(len(own), before)
            right = np.frombuffer(b"".join(bytes(r[k:]).ljust(after, b"\0") for r, k in zip(cut, n_left.tolist(), strict=True)), dtype=np.uint8).reshape(len(own), after)
            found = hits(left, right, n_left, n_right, group[own], w, lo, hi, x["text_hash"].to_numpy()[own] if scoped else None)
            found[x["n"].to_numpy()[own] < 0] = False  # known to be covered
            row, start, end = spans_of(found, x["anchor"].to_numpy()[own], w, lo)
            parts.append(pd.DataFrame({"d": x["d"].to_numpy()[own][row], "start": start, "end": end}))
        return pd.concat(parts, ignore_index=True)

    return expand


def narrowed(w: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Step 4: each region once for each part of its range of offsets, with the hashes of the part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            size = x["region"].map(len).to_numpy()
            last = np.cumsum(size)
            first = last - size
            sums = Sums(np.frombuffer(b"".join(x["region"]), dtype=np.uint8))
            a = first + x["n_left"].to_numpy()
            for lo, hi in sorted({*zip(x["lo"].tolist(), x["hi"].tolist(), strict=True)}):
                at = np.flatnonzero((x["lo"].to_numpy() == lo) & (x["hi"].to_numpy() == hi))
                for p, q in parts_of(lo, hi):
                    ok, core, hull = sums.keys(a[at], first[at], last[at], w, p, q)
                    outer = x["core"].to_numpy()[at][ok].view(np.uint64)
                    out = x[["d", "anchor", "text_hash", "n"]].iloc[at[ok]]
                    yield out.assign(lo=np.int32(p), hi=np.int32(q), core=mixed(core[ok].view(np.uint64) ^ outer).view(np.int64), hull=hull[ok])

    return run


def cut(docs: DataFrame, spans: DataFrame, kept: str, runs: str, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """docs with two more columns: kept (the bytes outside the spans, null where nothing is cut) and runs (maximal runs
    that are cut). As text, bytes of a letter that is cut in two are left out."""
    ours = unused(docs, "id_hash", "text_hash", "spans", "cut")
    per = written(spans.groupBy(F.col("id_hash").alias(ours[0]), F.col("text_hash").alias(ours[1])).agg(F.collect_set(F.struct("start", "end")).alias(ours[2])), "per_document")
    n = per.agg(F.sum(F.size(ours[2]))).first()[0] or 0

    @F.pandas_udf(f"kept {'string' if as_text else 'binary'}, runs long")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        kept, runs = [], []
        for t, s in zip(texts, spans, strict=True):
            if t is None:
                kept.append(None)
                runs.append(0)
                continue
            b = _bytes(t)
            pairs = sorted((p["start"], p["end"]) for p in s)
            out, at, n = [], -1, 0
            for start, end in pairs:
                if start > at:
                    out.append(b[max(at, 0) : start])
                    n += 1
                at = max(at, end)
            out.append(b[at:])
            left = b"".join(out)
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            runs.append(n)
        return pd.DataFrame({"kept": kept, "runs": runs})

    id_hash, text_hash = hashes(doc_id, text)
    keyed = docs.withColumn(ours[0], id_hash).withColumn(ours[1], text_hash)
    joined = keyed.join(F.broadcast(per) if n <= MAX_BROADCAST else per, ours[:2], "left")
    done = light(joined, 500).withColumn(ours[3], keep(F.when(F.col(ours[2]).isNotNull(), F.col(text)), F.col(ours[2])))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(ours[3]).kept.alias(kept), F.col(ours[3]).runs.alias(runs))


def report(docs: DataFrame, w: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = cut(source, repeated(source, w), "kept", "runs")
    kept = F.coalesce("kept", F.encode("text", "UTF-8"))
    size = F.octet_length("text").cast("long")
    return done.select("doc_id", size.alias("n_bytes"), (size - F.octet_length(kept)).alias("n_removed"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, w: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of the text; bytes of a letter that is cut in two are left out."""
    kept, runs = unused(docs, "kept", "runs")
    done = cut(docs, repeated(docs, w, doc_id, text), kept, runs, doc_id, text, as_text=True)
    return done.select(*[F.coalesce(F.col(kept), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
