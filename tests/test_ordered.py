"""Ranks and running sums against windows: large groups over many partitions, nulls, ties, empty tables, odd names."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from provenir.operators.ordered import running


def test_equals_windows(spark):
    r = random.Random(4)
    rows = [(None if r.random() < 0.05 else "g" if r.random() < 0.5 else f"h{r.randrange(40)}", i if r.random() < 0.9 else None, None if r.random() < 0.1 else r.randrange(100)) for i in r.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "`a b` string, part long, head int").withColumn("k", F.coalesce("part", F.lit(-1)) * 0 + F.monotonically_increasing_id()).cache()
    got = running(df.repartition(7), ["a b"], ["k"], {"total": "head"}, "rank")
    w = Window.partitionBy("`a b`").orderBy("k")
    want = df.withColumn("total", F.sum(F.coalesce("head", F.lit(0))).over(w)).withColumn("rank", F.row_number().over(w))
    key = lambda x: x["k"]
    assert got.columns == ["a b", "part", "head", "k", "total", "rank"]
    assert sorted(map(tuple, got.collect()), key=lambda t: t[3]) == sorted(map(tuple, want.collect()), key=lambda t: t[3])
    assert key(got.first()) >= 0


def test_one_sequence_and_ties(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), F.lit(1).alias("one"))
    got = running(df, [], [F.desc("x")], {"upto": "one"}, "n").collect()
    assert sorted(t.n for t in got) == list(range(1, 1001)) and all(t.n == t.upto for t in got)
    assert [t.x for t in sorted(got, key=lambda t: t.n)] == sorted((t.x for t in got), reverse=True)


def test_group_over_most_partitions(spark):
    df = spark.range(20_000, numPartitions=9).select(F.when(F.col("id") > 100, F.lit(7)).otherwise(F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 20_011).alias("o"))
    got = running(df, ["g"], ["o"], rank="r")
    w = Window.partitionBy("g").orderBy("o")
    assert got.join(df.withColumn("want", F.row_number().over(w)), ["g", "o"]).where("r != want").count() == 0
    assert got.count() == 20_000


def test_empty(spark):
    assert running(spark.createDataFrame([], "g long, o long"), ["g"], ["o"], rank="r").collect() == []
