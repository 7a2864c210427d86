"""The trie of conversations' beginnings: every distinct sequence of first turns with totals over what continues it.

Turns are numbered within their conversation, and a beginning is named by sums over its turns of hashes of (place,
turn): 192 bits that add up along a conversation, so that both steps are running sums over ordered groups
(`operators.ordered`) and a conversation with a third of all turns is spread over many tasks. Grouping by name gives
the nodes.

Totals over subtrees are rolled up in depth bands of fixed height: in a join on (conversation, band) a node reaches
only its ancestors within its own band; the totals of the bands' topmost nodes are then completed from the deepest
band up, a round for each band between such nodes alone, and each completed total goes to the ancestors in the band
above. The height is 8, or the root of the greatest depth where that is more, which bounds both the rounds and the
rows. A node with a single conversation is followed by a single line, whose totals are known; only nodes of two or more
conversations are rolled up. A node's ending conversations are hashed in order, from joined runs of at most ENDS ids,
so a node where very many end is read as a stream of few rows; a hash of one string is sequential by its nature.

Defined results: a null role or text is empty; turns with equal numbers go in the order of their digests (the SHA-256
of role and text); repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are
left out; an empty table gives no node, not even a root; texts of any length only pass as digest and size; extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import release, written

#: Height of a band at least.
BAND = 8
#: Turns of a conversation that are joined in one group, ids of ending conversations that are joined in one string.
PIECE, ENDS = 1 << 16, 1 << 10
#: Children from which a node's own row is broadcast to them, and such nodes at most.
HOT, MAX_BROADCAST = 1024, 100_000
LANES = 6


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos, digest, size of every turn: its place from 1, the SHA-256 of role and text, the text's UTF-8 bytes."""
    said, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length(said).cast("string"), F.concat(said, what)), 256))
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.octet_length(what).cast("long").alias("size")).where("conv is not null")
    done = running(rows, ["conv"], [F.asc_nulls_first("turn"), "digest"], rank="pos")
    return _of(done, done.select("conv", "pos", "digest", "size"))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (turns with conv, depth, digest, size, length; conv, length)."""
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("length"))
    pieces = lengths.select("conv", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / PIECE).cast("int"))).alias("piece"))
    x = turns.withColumn("piece", F.floor((F.col("pos") - 1) / PIECE).cast("int")).join(pieces, ["conv", "piece"])
    return x.select("conv", F.col("pos").alias("depth"), "digest", "size", "length"), lengths


def rebuilt(turns: DataFrame, every: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begun with that of c - c % every: its first h turns (all if fewer), then c's own after its first h.

    h is the CRC-32 of c in decimal modulo `most`. Returns as `plain` does. A conversation is joined piece by piece, and
    only the first turns of few are repeated, so long ones stay spread.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = own.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", h).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = written(convs.select("conv", "n", "base", "h", "taken", "length"), "conversations")
    pieces = convs.where("n > h").select("conv", "taken", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))).alias("piece"))
    tails = turns.where(F.col("pos") > h).withColumn("piece", F.floor((F.col("pos") - 1) / PIECE).cast("int")).join(pieces, ["conv", "piece"])
    tails = tails.select("conv", (F.col("pos") - h + F.col("taken")).alias("depth"), "digest", "size", "length")
    first = turns.where((F.col("pos") < most) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    heads = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv", F.col("pos").alias("depth"), "digest", "size", "length")
    return tails.unionByName(heads), convs.select("conv", "length")


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", *[c.cast("string") for c in (depth, *sums)]), 256), 1, 32))


def _beginnings(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, depth, node, parent, size, ends: a row for each beginning of each conversation, from the root on."""
    lanes, sums = [f"l{i}" for i in range(LANES)], [f"s{i}" for i in range(LANES)]
    halves = []
    for k in range(LANES // 2):
        x = F.xxhash64(F.lit(k), "digest", "depth")
        halves += [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]
    keyed = turns.select("conv", "depth", "size", (F.col("depth") == F.col("length")).alias("ends"), *[c.alias(n) for c, n in zip(halves, lanes, strict=True)])
    done = running(keyed, ["conv"], ["depth"], dict(zip(sums, lanes, strict=True)))
    named = done.select("conv", "depth", _name(F.col("depth"), [F.col(s) for s in sums]).alias("node"), _name(F.col("depth") - 1, [F.col(s) - F.col(c) for s, c in zip(sums, lanes, strict=True)]).alias("parent"), "size", "ends")
    root = _name(F.lit(0), [F.lit(0)] * LANES)
    roots = lengths.select("conv", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"), (F.col("length") == 0).alias("ends"))
    out = written(named.unionByName(roots), "beginnings")
    release(done.sparkSession, done)
    return out


def _rolled_up(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over the subtree of every shared node; shared has each node's own leaves and saved."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    height = max(BAND, math.isqrt(deepest) + 1)
    band = lambda depth: F.floor(F.col(depth) / height).cast("long")
    both = lambda a, b: [F.sum(a).alias(a), F.sum(b).alias(b)]
    lines = rows.select("conv", band("depth").alias("band"), F.col("depth").alias("at"), F.col("node").alias("above"))
    x = shared.select(F.col("conv_id").alias("conv"), band("depth").alias("band"), "depth", "node", "leaves", "saved")
    local = x.join(lines, ["conv", "band"]).where("at <= depth").groupBy("above").agg(*both("leaves", "saved")).withColumnRenamed("above", "node")
    bands = deepest // height
    if not bands:
        return local
    local = written(local, "bands")
    tops = x.where(F.col("depth") % height == 0).where("band > 0").select("conv", (F.col("band") - 1).alias("band"), "node").join(local, "node")
    tops = written(tops.join(lines.where(F.col("at") % height == 0).select("conv", "band", "above"), ["conv", "band"]), "tops")
    complete = later = None
    for b in range(bands - 1, -1, -1):
        now = tops.where(F.col("band") == b)
        if later is not None:
            below = later.groupBy("above").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("above", "node")
            now = now.join(below, "node", "left").select("conv", "band", "node", "above", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        later = written(now.select("conv", "band", "node", "above", "leaves", "saved"), "top")
        complete = later if complete is None else complete.unionByName(later)
    up = complete.select("conv", "band", "leaves", "saved").join(lines, ["conv", "band"]).select(F.col("above").alias("node"), "leaves", "saved")
    return local.unionByName(up).groupBy("node").agg(*both("leaves", "saved"))


def _endings(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where two conversations or more end."""
    runs = rows.where("ends").groupBy("node", F.floor(F.col("conv") / ENDS).alias("run")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = runs.select("node", "run", F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha, count = None, None, 0
        for x in frames:
            out = []
            for key, n, ids in zip(x["node"], x["n"], x["ids"], strict=True):
                if key != node:
                    if count > 1:
                        out.append((node, sha.hexdigest()))
                    node, sha, count = key, hashlib.sha256(), 0
                sha.update(("," + ids if count else ids).encode())
                count += n
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if count > 1:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    return joined.repartition("node").sortWithinPartitions("node", "run").mapInPandas(hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, depth (from 1 without gaps), digest (binary; equal turns have equal ones), size, length; lengths: conv,
    length of every conversation, turnless ones too. A node is the first `depth` turns of `conv_id`, its least
    conversation; n_leaves and saved_tokens, the sum of (n_convs - 1) times the size of the node's last turn, are over
    its subtree; ends_sha256 is over the decimal ids of the conversations that end there, ascending, with commas.
    """
    spark = turns.sparkSession
    rows = _beginnings(turns, lengths)
    alone = F.min(F.when(F.col("ends"), F.col("conv")))
    nodes = rows.groupBy("node", "parent", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"), alone.alias("end"))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("singles")).withColumnRenamed("parent", "node")
    shared = nodes.where("n_convs > 1").join(children, "node", "left")
    childless = F.col("n_children").isNull()
    shared = written(shared.select("node", "depth", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(childless, 1).otherwise(F.col("singles")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")), "shared")
    totals = _rolled_up(shared, rows)
    above = shared.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"), "n_children")
    hot, cold = above.where(F.col("n_children") >= HOT).select(F.col("up").alias("parent"), F.col("up_conv").alias("hot_conv")), above.where(F.col("n_children") < HOT).drop("n_children")
    x = nodes
    if hot.count() <= MAX_BROADCAST:
        # the children of a hot node are joined by their own name, which spreads them; what they find then is not used
        x = x.join(F.broadcast(hot), "parent", "left").withColumn("up", F.when(F.col("hot_conv").isNull(), F.coalesce("parent", "node")).otherwise(F.col("node")))
    else:
        cold, x = above.drop("n_children"), x.select("*", F.lit(None).cast("long").alias("hot_conv"), F.coalesce("parent", "node").alias("up"))
    x = x.join(cold, "up", "left").join(totals, "node", "left").join(shared.select("node", "n_children"), "node", "left").join(_endings(rows), "node", "left")
    single = F.col("n_convs") == 1
    known = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256))
    return x.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("hot_conv", "up_conv", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(single, 1 - F.col("n_ends")).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.when(single, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(single, 0).otherwise(F.col("saved")).cast("long").alias("saved_tokens"), F.coalesce(known, "ends_sha256").alias("ends_sha256"),
    )


def _of(source: DataFrame, derived: DataFrame) -> DataFrame:
    derived._written_to = getattr(source, "_written_to", None)
    return derived
