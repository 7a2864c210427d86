"""Where the rules of code fire: highlights and evidence of a file, and of a project by its files' places in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.rx import WS, java
from ..functions.text import intervals, once, scanned, trimmed
from .explain import disjoint, excerpt
from .files import BANNER, CODE_RULES, HASH_COMMENTS, TYPOGRAPHY, paraphrases

PLACES = "struct<ord:int,id:string,level:string,count:int,at:array<struct<start:int,end:int>>,evidence:array<string>>"
#: Places that are shown of a rule in a file and in a project, pieces of evidence, and of those for typography.
IN_FILE, IN_PROJECT, MOST, MOST_TYPOGRAPHY = 200, 300, 4, 3


def comment_places(t: Column, extension: Column) -> Column:
    """Intervals of the comments, as `files.comments` finds them."""
    hashes, slashes = intervals(t, java(r"(?:^|\s)#(?![!{])[^\n]*", "m")), intervals(t, java(r"\/\/[^\n]*|\/\*[\s\S]*?\*\/"))
    return F.when(F.coalesce(extension.isin(*HASH_COMMENTS), F.lit(False)), hashes).otherwise(slashes)


def code_places(t: Column, extension: Column) -> Column:
    """An array of PLACES: each rule of code that fires in a file, with its places, in the order of the rules."""
    row = lambda i, id_, level, n, at, evidence: F.struct(F.lit(i).alias("ord"), F.lit(id_).alias("id"), F.lit(level).alias("level"), n.cast("int").alias("count"), at.alias("at"), evidence.alias("evidence")).cast(PLACES)
    first = lambda at, n: F.slice(at, 1, n)
    around = lambda at: F.transform(first(at, MOST), lambda h: excerpt(t, h.start, h.end))
    found = []

    def fires(i: int, id_: str, least: int, level: str) -> Callable[[Column], Column]:
        return lambda at: F.when(F.size(at) >= least, row(i, id_, level, F.size(at), at, around(at)))

    for i, (id_, p, flags, least, strength, _) in enumerate(CODE_RULES):
        found.append(once(intervals(t, java(p, flags)), fires(i, id_, least, strength)))
    mark = lambda h: F.substring(t, h.start + 1, h.end - h.start)
    inside = once(comment_places(t, extension), lambda c: F.filter(intervals(t, TYPOGRAPHY), lambda h: F.exists(c, lambda o: (o.start <= h.start) & (h.end <= o.end))))
    near = lambda h: trimmed(F.regexp_replace(F.substring(t, F.greatest(F.lit(0), h.start - 30) + 1, h.end + 30 - F.greatest(F.lit(0), h.start - 30)), f"[{WS}]+", " "))
    found.append(once(inside, lambda at: F.when((F.size(at) >= 3) | (F.size(F.array_distinct(F.transform(at, mark))) >= 2), row(len(CODE_RULES), "code-typography", "moyen", F.size(at), first(at, IN_FILE), F.transform(first(at, 40), near)))))
    found.append(once(first(intervals(F.left(t, F.lit(800)), java(BANNER, "m")), 1), lambda at: F.when(F.size(at) > 0, row(len(CODE_RULES) + 1, "code-banner", "moyen", F.lit(1), at, F.transform(at, lambda h: F.left(trimmed(mark(h)), F.lit(120)))))))
    lines = scanned(F.split(t, "\n", -1), F.lit(0), lambda at, x: at + F.length(x) + 1, lambda at, x: F.struct(at.alias("start"), (at + F.length(x)).alias("end")), "struct<start:int,end:int>")

    def repeats(both: Column) -> Column:
        line = lambda k: F.get(both["lines"], k - 1)
        at = F.transform(both["pairs"], lambda p: line(p[both_names[0]]))
        shown = F.transform(first(both["pairs"], 2), lambda p: excerpt(t, line(p[both_names[0]]).start, line(p[both_names[1]]).end, 0))
        return F.when(both["pairs"].isNotNull(), row(len(CODE_RULES) + 2, "code-paraphrase", "faible", F.size(both["pairs"]), at, shown))

    both_names = ("line", "code")
    found.append(once(F.struct(paraphrases(t, extension).alias("pairs"), lines.alias("lines")), repeats))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def project_places(files: DataFrame, key: str = "project") -> tuple[DataFrame, DataFrame]:
    """((key, highlights), (key, id, evidence, count, in_files)) of projects, places counted from the start of a project's text.

    files: key, path, extension, start, text. Of a rule the first IN_PROJECT places in the order of the files are shown, of
    those that overlap the stronger; evidence is each file's own with its path before it.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    x = files.select(key, "path", F.col("start").alias("from"), F.explode_outer(code_places(t, F.col("extension"))).alias("p")).where("p is not null").select(key, "path", "from", "p.*")
    rank = F.array_position(F.array(*map(F.lit, rules.STRENGTHS)), F.col("level")).cast("int")
    rows = x.select(key, rank.alias("r"), "ord", "id", "level", "from", F.explode_outer("at").alias("h")).select(key, "r", (F.col("h.start") + F.col("from")).alias("start"), (F.col("h.end") + F.col("from")).alias("end"), "ord", "id", "level")
    shown = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "id").orderBy("start"))).where(F.col("k") <= IN_PROJECT)
    kept = disjoint(shown, key, "r", ["start", "ord", "k", "end"]).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "id", "level"))).alias("highlights"))
    told = x.select(key, "id", "ord", "from", "count", F.posexplode_outer(F.transform(F.slice("evidence", 1, 40), lambda e: F.concat(F.col("path"), F.lit(" : "), e))).alias("k", "e"))
    first = told.where("e is not null").withColumn("n", F.row_number().over(Window.partitionBy(key, "id").orderBy("from", "k"))).where(F.col("n") <= MOST)
    evidence = first.groupBy(key, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda s: s.e).alias("evidence"))
    counts = x.groupBy(key, "id", "ord").agg(F.sum("count").alias("count"), F.count("*").alias("in_files"))
    few = F.when(F.col("id") == "code-typography", F.slice(F.array_distinct("evidence"), 1, MOST_TYPOGRAPHY)).otherwise(F.col("evidence"))
    return kept, counts.join(evidence, [key, "id"], "left").select(key, "id", few.alias("evidence"), "count", "in_files")
