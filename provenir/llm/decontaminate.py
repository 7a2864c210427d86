"""Benchmark decontamination with DataFrame functions only.

The test items' windows of `n` words are hashed once and broadcast while they are few (MAX_BROADCAST windows,
counted before); beyond that the same join is left to the planner, and a position takes its own words along, no text. Each document is scanned once: its word
positions are generated, the window at each is hashed, looked up, and a hit is verified word by word.

Defined results: a null or wordless text has no words and no hits; an item of fewer words than `n` is one window
of all its words; null items have no window; a null item_id hits but is not listed; repeated rows give repeated
rows; rows that share doc_id but not text are judged each for itself; extra columns are carried by `decontaminate`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, unused, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and what lies between words.
CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Windows of the test items that are broadcast at most, of about 100 bytes each.
MAX_BROADCAST = 1_000_000


def _rough(text: Column) -> Column:
    """Lower case of all letters. The capital sigma, whose lower case depends on what follows, is replaced first."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def _rough_words(text: Column) -> Column:
    """Words in lower case of all letters, for hashing: as many words at the same places as the exact ones."""
    return F.regexp_extract_all(_rough(text), F.lit(WORD), 0)


def _exact_words(text: Column, rough: Column) -> Column:
    """Words with A-Z alone in lower case: the rough ones but for texts with other capitals, which are split again."""
    other = (F.octet_length(text) > F.length(text)) & (_rough(text) != lower_ascii(text))
    return F.when(other, F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0)).otherwise(rough)


def _window(words: str, pos: Column, k: int) -> Column:
    return F.slice(words, F.greatest(pos, F.lit(1)), k)


def windows(items: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(k, hash, gram, items): the distinct windows of the items, k words long, and the items that hold them."""
    words = items.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(WORD), 0).alias("ws")).where(F.size("ws") > 0)
    k = F.least(F.size("ws"), F.lit(n))
    grams = words.select("item", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.array_join(F.slice("ws", i, k), " "))).alias("gram"))
    rough = F.split(F.lower(F.replace(F.col("gram"), F.lit("Σ"), F.lit("σ"))), " ")
    return grams.groupBy("k", "gram").agg(F.collect_set("item").alias("items")).select("k", F.xxhash64(rough).alias("hash"), "gram", "items")


def hits(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: key columns doc_id and text_hash, n_words, spans (word position from 1, length) and items."""
    grams = written(windows(items, n), "grams")
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # n values at most
    small = grams.count() <= MAX_BROADCAST
    parts = []
    for i, k in enumerate(sizes or [n]):
        words = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t")).withColumn("ws", F.coalesce(_rough_words(F.col("t")), F.array().cast("array<string>")))
        words = words.withColumn("xs", _exact_words(F.col("t"), F.col("ws")))  # once a document, however many hits it has
        size = F.size("ws")
        at = words.select("id", "text_hash", "xs", "ws", F.explode(F.when(size >= k, F.sequence(F.lit(0), size - k + 1)).otherwise(F.array(F.lit(0)))).alias("pos"))
        own = grams.where(F.col("k") == k).select(F.col("hash").alias("h"), "gram", "items")
        exact = F.array_join(_window("xs", F.col("pos"), k), " ")
        on = (F.xxhash64(_window("ws", F.col("pos"), k)) == F.col("h")) & (F.col("pos") > 0)
        if not small:
            last = F.least(F.size("ws"), F.size("xs")) - k + 1
            place = lambda p: F.struct(p.alias("pos"), F.xxhash64(_window("ws", p, k)).alias("wh"), F.when(p > 0, F.array_join(_window("xs", p, k), " ")).alias("own"))  # noqa: B023, E731
            at = words.select("id", "text_hash", F.size("ws").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), place)).alias("x")).select("id", "text_hash", "n", "x.*")
            size, exact, on = F.col("n"), F.col("own"), (F.col("wh") == F.col("h")) & (F.col("pos") > 0)
        found = at.join(F.broadcast(own) if small else own, on, "left").where((F.col("pos") == 0) | F.col("gram").isNotNull())
        found = found.where((F.col("pos") == 0) | (exact == F.col("gram")))
        here = F.col("pos") > 0
        found = found.select("id", "text_hash", F.when(~here & F.lit(i == 0), size).alias("n_words"), F.when(here, F.struct(F.col("pos"), F.lit(k).alias("k"))).alias("span"), F.when(here, F.col("items")).alias("items"))
        parts.append(found)
    every = reduce(DataFrame.unionByName, parts)
    per = every.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.select(F.col("id").alias(doc_id), "text_hash", F.col("n_words").cast("long").alias("n_words"), "spans", "items", "copies")


def _hit_words(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a.end, s.pos + s.k).alias("end"), (a.n + F.greatest(F.lit(0), s.pos + s.k - F.greatest(a.end, s.pos))).cast("long").alias("n"))
    return F.aggregate(spans, zero, step, lambda a: a.n)


def report(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items; a row for each row of docs."""
    found = hits(docs, items, n, doc_id, text)
    n_hit = _hit_words(F.col("spans"))
    out = found.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return out.drop("_copy")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "documents", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit words and what follows each cut out of the text.

    The columns stay as they are, whatever they are called.
    """
    id_, hash_, spans_, cut_ = unused(docs, "id", "hash", "spans", "cut")
    bad = hits(docs, items, n, doc_id, text).where(F.size("spans") > 0).select(F.col(doc_id).alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_))
    on = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(hash_))
    if mode == "documents":
        return docs.join(bad, on, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode {mode!r} is neither documents nor spans")
    piece = F.regexp_extract_all(F.col(text), F.lit(CASED + BETWEEN), 0)
    head = F.regexp_extract(F.col(text), "^" + BETWEEN, 0)
    keep = F.filter(F.transform(piece, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))), lambda x: ~F.exists(spans_, lambda s: (x.i >= s.pos) & (x.i < s.pos + s.k)))
    cut = F.when(F.col(spans_).isNull(), F.col(text)).otherwise(F.concat(head, F.array_join(F.transform(keep, lambda x: x.p), "")))
    return docs.join(bad, on, "left").withColumn(cut_, cut).select(*[F.col(cut_).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
