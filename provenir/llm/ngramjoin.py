"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Every text becomes its set of shingle hashes (63 bits of a randomised polynomial hash, of a digest for long words); texts with equal sets
   collapse to the one with the least id.
2. Shingles have one global order: the COMMON most frequent ones last, by frequency, the others by hash. Two sets of
   Jaccard similarity t or more share a shingle within the first n - ceil(t n) + 1 of each, whatever the order;
   prefix shingles that only one set has are dropped.
3. Documents with identical prefixes and size are one group; groups that share a prefix shingle, whose sizes and places
   in the order fit and whose bitmaps (the parity of the set in 1024 buckets, which bounds the difference of two sets
   from below) do not rule it out are candidates. Only components are asked for, so a few rounds first verify each
   document against one pivot of a shingle of its own and join what is linked; then all candidate pairs of groups that
   are still in different components are expanded to their members and verified. No link between components is left out.
4. Verification recomputes both sets from the whole texts; a document with many partners is split by salt.

Defined results: a null or wordless text has an empty set and is linked with nothing; fewer words than `n` are one
shingle; a null doc_id is kept with a null component; rows that share a doc_id are one node of the graph; repeated
rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import light
from .common import by_group, components, release, unused, written

U = np.uint64
_random = np.random.default_rng(20240601)
_CODE = _random.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _random.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
CHUNK = 1 << 20
#: Words of as many bytes are hashed by a cryptographic digest: modulo a power of two there are long words, as those of
#: Thue and Morse, whose polynomials are equal for every odd base.
LONG_WORD = 64
#: Shingles that are put last in the order at most, of 12 bytes each where they are broadcast, and the shingles that
#: are counted at once.
COMMON = 250_000
BLOCK = 1 << 21
#: A document's bitmap: 2 ** BITS buckets.
BITS = 10
WORDS = (1 << BITS) // 64
#: Shingles of a document's partners that are verified in one group, but one partner at least.
STAR = 500_000
#: Documents that are broadcast at most, of about 200 bytes each with their bitmaps, and of 16 bytes with their
#: component alone; more are joined by shuffle.
MAX_BROADCAST, MAX_IDS = 100_000, 1_000_000
PIVOT_ROUNDS = 2
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(max(n, CHUNK + 4096) - 1, base, dtype=np.uint64))))
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64, not negative) of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_CODE[data] * powers(_BASE, len(data)))))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = mixed((sums[ends] - sums[starts]) * powers(_BACK, len(data))[starts])
    for k in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        words[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes().lower(), digest_size=8).digest(), "little")
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    whole = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        whole += words[k : k + len(whole)] * _PLACE[k]
    whole = (mixed(whole) >> U(1)).astype(np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            few = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[n : n + 1] * U(b - a)
            out.append((mixed(few) >> U(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def chunked_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """sets() of many texts, about CHUNK bytes at once."""
    held, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > CHUNK:
            yield from sets(held, n)
            held, size = [], 0
        held.append(b)
        size += len(b)
    yield from sets(held, n)


def needed(n: int, percent: int) -> int:
    """Shingles of a set of n of which two similar sets share one."""
    return n - (percent * n + 99) // 100 + 1


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that go last in the order, the most frequent last: COMMON at most, counted over all texts.

    Blocks of BLOCK shingles report what they hold twice, so the counts are somewhat low; they only shape the order,
    and the join is right under any order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def report() -> pd.DataFrame:
            s = np.sort(np.concatenate(held))
            held.clear()
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            count = np.diff(np.append(at, len(s)))
            return pd.DataFrame({"tok": s[at[count > 1]], "k": count[count > 1]})

        size = 0
        for x in frames:
            for s in chunked_sets(x["text"].tolist(), n):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield report()
                    size = 0
        if held:
            yield report()

    counted = written(light(docs.select("text"), 500).mapInPandas(run, "tok long, k long").groupBy("tok").agg(F.sum("k").alias("k")), "counts")
    step = F.floor(F.log2("k") * 8).cast("int")
    per_step = sorted(((r.step, r.m) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("m")).collect()), reverse=True)  # 512 rows at most
    cut, total = None, 0
    for s, m in per_step:
        total += m
        if total > COMMON:
            break
        cut = s
    found = np.zeros(0, dtype=np.int64)
    if cut is not None:
        rows = counted.where(step >= cut).toArrow()  # COMMON rows at most
        tok, k = rows["tok"].to_numpy(), rows["k"].to_numpy()
        found = tok[np.lexsort((tok, k))]
    release(docs.sparkSession, counted)
    return found


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n, s1, s2 (a signature of the set), prefix (shingles in the common order) and bits (WORDS longs: the parity
    of the set in each of 64 * WORDS buckets)."""
    common = common_shingles(docs, n)
    order = np.argsort(common)
    held = docs.sparkSession.sparkContext.broadcast((common[order], order.astype(np.int32)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank = held.value
        for x in frames:
            rows = []
            for s in chunked_sets(x["text"].tolist(), n):
                m = mixed(s.astype(np.uint64))
                prefix = s
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    last = known[at] == s
                    prefix = np.concatenate((s[~last], s[last][np.argsort(rank[at[last]])]))
                parity = np.bincount((m >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint8) & 1
                m = m.view(np.int64)
                rows.append((len(s), int(m.sum()), int(np.bitwise_xor.reduce(m)), prefix[: needed(len(s), percent) if len(s) else 0], np.packbits(parity).view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "prefix", "bits"])
            out.insert(0, "id", x["id"].to_numpy())
            yield out.astype({"id": "Int64"})

    return light(docs, 500).mapInPandas(run, "id long, n long, s1 long, s2 long, prefix array<long>, bits array<long>")


def entries_of(made: DataFrame, classes: DataFrame, fits: Callable[..., Column], percent: int) -> DataFrame:
    """tok, pos, id, n, g (the group of documents with this prefix and size), comp: prefix shingles of two sets or more.

    What counts is different sets, so a signature travels with each shingle; where only two rows have a shingle, their
    sizes must fit as well. Sets so small that no other set can be similar have no entries.
    """
    near = made.where((F.col("n") > 0) & F.col("id").isNotNull() & (F.col("n") * 100 >= (F.col("n") + 1) * percent))
    signature = F.shiftleft(F.least("n", F.lit((1 << 23) - 1)), 40).bitwiseOR(F.xxhash64("s1", "s2").bitwiseAND(F.lit((1 << 40) - 1)))
    rows = near.select("id", signature.alias("sig"), F.posexplode("prefix").alias("pos", "tok"))
    found = rows.groupBy("tok").agg(F.count("*").alias("m"), F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b")
    zero = F.lit(0)
    shared = found.where((F.col("m") > 2) | fits(F.shiftright("a", 40), F.shiftright("b", 40), zero, zero)).select("tok")
    few = written(rows.select("tok", "pos", "id").join(shared, "tok"), "repeated")
    release(made.sparkSession)
    rep = classes.select(F.col("rep").alias("id"), "n", "g")
    out = written(few.join(rep, "id").select("tok", F.col("pos").cast("long").alias("pos"), "id", "n", "g"), "entries")  # equal sets have one document here
    release(made.sparkSession, few)
    return out


def far(a: str, b: str, size: Column, percent: int, masks: bool = False) -> Column:
    """Whether the parities in the columns a and b show that the sets are not similar; a lower bound of the difference.

    With masks, the buckets named in a_mask or b_mask are left out.
    """
    differ = reduce(
        lambda x, y: x + y,
        (F.bit_count((F.col(a)[i].bitwiseXOR(F.col(b)[i])) if not masks else (F.col(a)[i].bitwiseXOR(F.col(b)[i])).bitwiseAND(F.bitwise_not(F.col(a + "_mask")[i].bitwiseOR(F.col(b + "_mask")[i])))) for i in range(WORDS)),
    )
    return differ.cast("long") * (100 + percent) > size * (100 - percent)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar. pairs: a, b, n (size of b's set); texts: id, text.

    The partners of one a are dealt out in parts of about STAR shingles.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.sum("n") / STAR).cast("int").alias("parts"))
    own = degree.select("a", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("part"), F.col("a").alias("id"), F.lit(0).alias("side"))
    other = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.greatest("parts", F.lit(1))).cast("int").alias("part"), F.col("b").alias("id"), F.lit(1).alias("side"))
    wanted = written(own.unionByName(other), "wanted")
    near = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    rows = light(texts.join(near, "id").select("a", "part", "side", "id", "text"), 200)

    def run(x: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        out_a, out_b = [], []
        side, ids, a_of = x["side"].to_numpy(), x["id"].to_numpy(), x["a"].to_numpy()
        texts_of = x["text"].tolist()
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own_at = [k for k in range(i, j) if side[k] == 0]
            firsts = list(chunked_sets([texts_of[k] for k in own_at], n))
            others = [k for k in range(i, j) if side[k] == 1]
            for k, s in zip(others, chunked_sets([texts_of[k] for k in others], n), strict=False):
                for f in firsts:
                    both = len(np.intersect1d(f, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(f) + len(s) - both):
                        out_a.append(a_of[k])
                        out_b.append(ids[k])
                        break
        return pd.DataFrame({"a": np.array(out_a, dtype=np.int64), "b": np.array(out_b, dtype=np.int64)})

    out = written(by_group(rows, ["a", "part"], run, "a long, b long", rows=200), "links")
    release(pairs.sparkSession, wanted)
    return out


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; ids are integers."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    made = written(sketches(source, n, percent), "sketches")
    classes = written(made.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min(F.xxhash64("prefix")).alias("g")), "classes")
    fits = lambda x, y, i, j: (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (F.least(x - i, y - j) * (100 + percent) >= (x + y) * percent)
    entries = entries_of(made, classes, fits, percent)
    # bits of each document with an entry; comp: a document that it is known to be connected with
    of_entries = written(entries.select("id").distinct(), "ids")
    m = of_entries.count()
    near = lambda d: F.broadcast(d) if m <= MAX_BROADCAST else d
    short = lambda d: F.broadcast(d) if m <= MAX_IDS else d
    one_set = (F.min("s1") == F.max("s1")) & (F.min("s2") == F.max("s2"))  # rows that share an id but not a text: no bitmap rules them out
    state = made.where("n > 0").join(short(of_entries), "id").groupBy("id").agg(F.min("n").alias("n"), F.first("bits").alias("bits"), one_set.alias("sure"))
    state = written(state.withColumn("comp", F.col("id")), "state")
    texts = written(source.where("id is not null").join(short(of_entries), "id"), "texts")
    every: DataFrame | None = None
    for k in range(PIVOT_ROUNDS + 1):
        now = entries.join(short(state.select("id", "comp")), "id")
        if k < PIVOT_ROUNDS:
            open_toks = now.groupBy("tok").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min_by(F.struct("id", "n", "comp", "pos"), F.xxhash64("id", F.lit(k)) if k else F.col("id")).alias("pivot")).where("c < d").select("tok", "pivot")
            met = now.join(open_toks, "tok").where((F.col("comp") != F.col("pivot.comp")) & fits(F.col("n"), F.col("pivot.n"), F.col("pos"), F.col("pivot.pos"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
            both = met.join(near(state.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"), F.col("sure").alias("sure_a"))), "a").join(near(state.select(F.col("id").alias("b"), "n", F.col("bits").alias("bits_b"), F.col("sure").alias("sure_b"))), "b")
            both = both.where(~(F.col("sure_a") & F.col("sure_b") & far("bits_a", "bits_b", F.col("na") + F.col("n"), percent)))
            pairs = both.groupBy("b", "n").agg(F.min_by("a", F.struct(F.abs(F.col("na") - F.col("n")), "a")).alias("a"))  # one pivot for each document and round
        else:
            several = now.groupBy("tok").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d").select("tok")
            still = written(now.join(several, "tok"), "open")
            pairs = crossing(still, state, fits, percent)
        pairs = written(pairs.select("a", "b", "n"), "pairs")
        if pairs.isEmpty():
            release(spark, pairs)
            continue  # pivots without partners say nothing of the other pairs: only the last round is exhaustive
        new = verified(pairs, texts, n, percent)
        every = new if every is None else every.unionByName(new)
        if k < PIVOT_ROUNDS:
            old, state = state, written(hooked(state, new, short) if k + 1 < PIVOT_ROUNDS else solved(state, every), "state")
            release(spark, old)
        release(spark, pairs)
    ties = ties_of(made, classes)
    every = ties if every is None else every.unionByName(ties)
    members = components(every, "a", "b")
    release(spark, entries, texts, state, of_entries)
    rep_of = classes.join(members, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("c"))
    per_row = made.select("id", "n", "s1", "s2").join(rep_of, ["n", "s1", "s2"], "left")
    return per_row.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))


def ties_of(made: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): documents of several texts, each with the representative of each text's set."""
    sets_of = made.where("n > 0 and id is not null").select("id", "n", "s1", "s2")
    one = F.struct("n", "s1", "s2")
    several = sets_of.groupBy("id").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x <> y").select("id")
    return written(sets_of.join(several, "id").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "ties")


def hooked(state: DataFrame, links: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """state with comp brought nearer to the least document connected: over one link, then over one comp."""
    comp = lambda name: near(state.select(F.col("id").alias(name), F.col("comp").alias(f"of_{name}")))
    both = links.join(comp("a"), "a").join(comp("b"), "b").select("a", "b", F.least("of_a", "of_b").alias("c"))
    least = both.select(F.col("a").alias("id"), "c").unionByName(both.select(F.col("b").alias("id"), "c")).groupBy("id").agg(F.min("c").alias("c"))
    once = written(state.select("id", "comp").join(near(least), "id", "left").select("id", F.coalesce("c", "comp").alias("comp")), "hooked")
    further = near(once.select(F.col("id").alias("comp"), F.col("comp").alias("next")))
    moved = once.join(further, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
    return state.drop("comp").join(near(moved), "id")


def solved(state: DataFrame, links: DataFrame) -> DataFrame:
    """state with comp as the links give it."""
    members = components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("c"))
    return state.join(members, "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")


def crossing(now: DataFrame, state: DataFrame, fits: Callable[..., Column], percent: int) -> DataFrame:
    """(a, b, n): all pairs of documents of different components that may be similar.

    now: entries with comp, of shingles that several components have. Groups of documents with the
    same prefix, size and component meet over a shingle, each that is not of the most frequent component with all
    others; of a group, buckets in which its members differ are left out of the comparison. Group pairs that are left
    are expanded to their members.
    """
    now = now.join(now.groupBy("tok").agg(F.mode("comp").alias("most")), "tok")
    of_group = written(now.select("comp", "g", "n", "id").distinct().join(state.select("id", "bits", "sure"), "id"), "members")
    both = lambda f: F.array(*[f(F.col("bits")[i]) for i in range(WORDS)])
    masks = of_group.groupBy("comp", "g", "n").agg(both(F.bit_and).alias("all"), both(F.bit_or).alias("some"), F.min("sure").alias("sure"))
    masks = masks.select("comp", "g", "n", F.col("all").alias("bits"), F.zip_with("all", "some", lambda x, y: F.when(F.col("sure"), x.bitwiseXOR(y)).otherwise(F.lit(-1).cast("long"))).alias("mask"))
    groups = written(now.groupBy("tok", "most", "comp", "g", "n").agg(F.min("pos").alias("pos")).join(masks, ["comp", "g", "n"]), "groups")
    side = lambda s: groups.select("tok", "most", *[F.col(c).alias(f"{c}_{s}") for c in ("comp", "g", "n", "pos")], F.col("bits").alias(f"bits_{s}"), F.col("mask").alias(f"bits_{s}_mask"))
    left, right = side("a").where("comp_a <> most").drop("most"), side("b")
    meet = (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("most")) | (F.col("comp_a") < F.col("comp_b")))
    on = (left["tok"] == right["tok"]) & meet & fits(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")) & ~far("bits_a", "bits_b", F.col("n_a") + F.col("n_b"), percent, masks=True)
    pairs = left.join(right, on).select("comp_a", "g_a", "n_a", "comp_b", "g_b", "n_b").distinct()
    member = lambda s, i: of_group.select(*[F.col(c).alias(f"{c}_{s}") for c in ("comp", "g", "n")], F.col("id").alias(i), F.col("bits").alias(f"bits_{s}"), F.col("sure").alias(f"sure_{s}"))
    found = pairs.join(member("a", "x"), ["comp_a", "g_a", "n_a"]).join(member("b", "y"), ["comp_b", "g_b", "n_b"]).where(~(F.col("sure_a") & F.col("sure_b") & far("bits_a", "bits_b", F.col("n_a") + F.col("n_b"), percent)))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("n_b")).otherwise(F.col("n_a")).alias("n")).distinct()


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the least id. Rows with a null id stay."""
    (gone,) = unused(docs, "gone")
    out = link_components(docs, n, percent, doc_id, text).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col(doc_id) == F.col(gone), "left_anti")
