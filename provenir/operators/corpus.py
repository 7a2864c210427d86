"""Building a calibration corpus: which fetched texts are fit, numbering, prompts, and the comparison of formulas.

Fetching itself is not done here: fetched pages and reviews come as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import seeded_order
from .likelihood import bucket, lowest_reaching
from .ordered import running

MIN_WORDS, MAX_WORDS, MIN_PARAGRAPH, MIN_PAGE, PER_PARENT, BATCH = 80, 400, 15, 6000, 3, 10
# fixed values: what marks texts by robots, lists and openings that are no prose
BOT_TEXT = r"grille communale de densité|aire d'attraction d|unité urbaine|Corine Land Cover"
NO_ARTICLE = r"^Liste |\(homonymie\)"
OPENINGS = r"^(Coordonnées|Pour les articles homonymes|Publié le )"
WORDS = r"\S+"


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(WORDS))


def article_text(paragraphs: Column) -> Column:
    """The paragraphs of an article that are prose, joined until three quarters of MAX_WORDS are reached."""
    fit = F.filter(paragraphs, lambda p: (word_count(p) >= MIN_PARAGRAPH) & ~p.rlike(OPENINGS))
    add = lambda a, p: F.when(word_count(a) >= MAX_WORDS * 0.75, a).otherwise(F.concat(a, F.when(a != "", "\n\n").otherwise(""), p))
    return F.aggregate(fit, F.lit(""), add)


def fit_articles(pages: DataFrame, title: str = "title", length: str = "length", text: str = "text") -> DataFrame:
    """Pages that are articles, long enough and not written by robots."""
    return pages.where((F.col(length) >= MIN_PAGE) & ~F.col(title).rlike(NO_ARTICLE) & (word_count(F.col(text)) >= MIN_WORDS) & ~F.col(text).rlike(BOT_TEXT))


def fit_reviews(reviews: DataFrame, text: str = "text") -> DataFrame:
    n = word_count(F.trim(F.col(text)))
    return reviews.where((n >= MIN_WORDS / 2) & (n <= MAX_WORDS))


def unseen(found: DataFrame, manifest: DataFrame, title: str = "title", order: str = "ord") -> DataFrame:
    """Found rows whose title the manifest has not, the first of each title. A null title is one title."""
    w = Window.partitionBy(title).orderBy(order)
    return found.join(manifest.select(title).distinct(), title, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_per_parent(rows: DataFrame, parent: str, order: str, most: int = PER_PARENT) -> DataFrame:
    """The first rows of each parent; a feature of the collection."""
    w = Window.partitionBy(parent).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def numbered(new: DataFrame, manifest: DataFrame, order: str = "ord") -> DataFrame:
    """new with id: label, genre and the number that follows the genre's largest so far, of three digits or more."""
    last = manifest.groupBy("label", "genre").agg(F.max(F.element_at(F.split("id", "-"), -1).cast("int")).alias("_last"))
    x = running(new, ["label", "genre"], [order], rank="_k").join(last, ["label", "genre"], "left").withColumn("_n", F.col("_k") + F.coalesce("_last", F.lit(0)))
    padded = F.when(F.length(F.col("_n").cast("string")) < 3, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return x.withColumn("id", F.concat_ws("-", "label", "genre", padded)).drop("_n", "_k", "_last")


def prompts(topics: DataFrame, lengths: tuple[int, ...], styles: tuple[str, ...], order: str = "ord", batch: int = BATCH) -> DataFrame:
    """topics with id, words, style and batch, by their place: lengths change with each prompt, styles with each round.

    Topics are places in a list that people work through: it is numbered in one sequence.
    """
    x = running(topics, [], [order], rank="_i").withColumn("_i", F.col("_i") - 1)
    pick = lambda what, at: F.array(*map(F.lit, what))[F.pmod(at, F.lit(len(what))).cast("int")]
    number = (F.col("_i") + 1).cast("string")
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return x.select(*topics.columns, F.concat(F.lit("p"), padded).alias("prompt_id"), pick(lengths, F.col("_i")).alias("words"), pick(styles, F.floor(F.col("_i") / len(lengths))).alias("style"), (F.floor(F.col("_i") / batch) + 1).cast("int").alias("batch")).drop("_i")


def seeded_titles(titles: list[int], seed: int) -> list[int]:
    """Places in a seeded shuffle, as the prompt lists take them."""
    return seeded_order(titles, float(seed))


def import_answers(answers: DataFrame, asked: DataFrame, vendor: str) -> DataFrame:
    """Answers of an assistant with what was asked, as rows of the manifest. answers: prompt_id, answer."""
    x = answers.join(asked, "prompt_id")
    return x.select(F.concat_ws("-", F.lit("ia"), F.lit(vendor), "prompt_id").alias("id"), F.lit("ia").alias("label"), F.lit(vendor).alias("vendor"), "genre", word_count(F.col("answer")).alias("words"), F.col("topic").alias("title"), "style")


def _plain(human: DataFrame, by: list[str], share: float) -> DataFrame:
    place = F.least(F.col("_all") - 1, F.floor(F.col("_all") * share))
    return lowest_reaching(human.withColumn("_one", F.lit(1)), by, "_one", F.col("_upto") > place)


def plain_thresholds(scores: DataFrame, share: float = 0.95) -> DataFrame:
    """(bucket, offset): the human score at place min(n - 1, floor(share n)) of each length, unweighted."""
    return _plain(scores.where(~F.col("ai")).withColumn("bucket", bucket(F.col("tokens"))), ["bucket"], share)


def compared(scores: DataFrame) -> DataFrame:
    """(formula, bucket, detected, false_alarms): shares of the scores above each formula's plain thresholds.

    scores: formula, ai, tokens, score.
    """
    x = scores.withColumn("bucket", bucket(F.col("tokens")))
    limits = _plain(x.where(~F.col("ai")), ["formula", "bucket"], 0.95)
    hit = F.col("score") > F.col("offset")
    share = lambda ai: F.try_divide(F.count(F.when((F.col("ai") == ai) & hit, 1)), F.count(F.when(F.col("ai") == ai, 1)))
    return x.join(F.broadcast(limits), ["formula", "bucket"], "left").groupBy("formula", "bucket").agg(share(True).alias("detected"), share(False).alias("false_alarms"))  # limits: five rows a formula


def exported(samples: DataFrame) -> DataFrame:
    """(sample_id, row): each sample as a JSON array of its numbers, null where one is missing, in the order of the compact form."""
    row = F.array(*[F.col(c).cast("double") for c in ("sample_group", "ai", "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars")])
    return samples.select("sample_id", F.to_json(row).alias("row"))
