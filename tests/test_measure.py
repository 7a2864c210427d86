"""Measuring is stopped between writing and committing, and between the commit and the checkpoint: no text twice, none missing."""

import pytest
from pyspark.sql import functions as F

from provenir.sources.versioned import Table
from provenir.streaming.measure import measuring, progress


def measure(df):
    return df.select("id", F.length("text").cast("long").alias("tokens"))


class Stopped(Exception):
    pass


@pytest.mark.parametrize(("at", "after"), [(1, False), (2, True), (3, False)])
def test_stops_lose_and_repeat_nothing(spark, tmp_path, at, after):
    for i in range(4):
        spark.createDataFrame([(f"t{i * 3 + j}", "x" * j) for j in range(4)] + [(None, "n")], "id string, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    texts = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    sink = Table(spark, f"{tmp_path}/sink", "id string, model string, tokens long, batch long")
    stream = lambda: spark.readStream.schema("id string, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    publish, calls = sink._publish, []

    def fails(version, manifest):
        calls.append(version)
        if len(calls) != at:
            return publish(version, manifest)
        if after:
            publish(version, manifest)
        raise Stopped

    sink._publish = fails
    query = measuring(stream(), measure, sink, "m", f"{tmp_path}/state")
    with pytest.raises(Exception, match="Stopped"):
        query.awaitTermination()
    assert sink.read().count() < 13
    sink._publish = publish
    measuring(stream(), measure, sink, "m", f"{tmp_path}/state").awaitTermination()
    ids = sorted(r.id for r in sink.read().collect())
    assert ids == sorted(f"t{i}" for i in range(13))
    assert tuple(progress(texts, sink, "m").first()) == (13, 0)
    assert sink.done() == {f"{tmp_path}/state|m": 3}
    # another model measures all again, beside; a new run of the first finds nothing to do
    measuring(stream(), measure, sink, "n", f"{tmp_path}/other").awaitTermination()
    measuring(stream(), measure, sink, "m", f"{tmp_path}/third").awaitTermination()
    assert {r.model: r["count"] for r in sink.read().groupBy("model").count().collect()} == {"m": 13, "n": 13}
