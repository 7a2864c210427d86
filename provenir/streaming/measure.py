"""Measuring texts as they arrive, each once for each model, and resuming where a run was stopped.

A batch of the stream is measured without the texts that the sink has for the model, and is committed to the sink, a
versioned table, together with the batch's number. A batch that ends between writing and committing leaves files that no
version knows; one that ends between the commit and the stream's own checkpoint is not committed a second time. So after
any number of restarts every text is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versioned import Table


def unmeasured(texts: DataFrame, sink: DataFrame, model: str, key: str = "id") -> DataFrame:
    """texts that the sink has no measure of by this model, each key once: a null key is none."""
    known = sink.where(F.col("model") == model).select(key)
    return texts.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known, key, "left_anti")


def measuring(stream: DataFrame, measure: Callable[[DataFrame], DataFrame], sink: Table, model: str, checkpoint: str, key: str = "id", **trigger) -> StreamingQuery:
    """Start measuring the stream's texts into the sink, which has the key, `model`, `batch` and what `measure` gives.

    The name of the work is the checkpoint's, so two runs that share it continue each other. A stream read with
    maxFilesPerTrigger commits after each such part, which bounds what a stop makes undone.
    """

    def batch(texts: DataFrame, number: int) -> None:
        new = unmeasured(texts, sink.read(), model, key)
        sink.append(measure(new).withColumn("model", F.lit(model)).withColumn("batch", F.lit(number).cast("long")), batch=(f"{checkpoint}|{model}", number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(texts: DataFrame, sink: Table, model: str, key: str = "id") -> DataFrame:
    """(measured, left): one row, how far the measuring of these texts by this model is."""
    known = sink.read().where(F.col("model") == model).select(key, F.lit(1).alias("_known"))
    x = texts.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left")
    return x.agg(F.count("_known").alias("measured"), (F.count("*") - F.count("_known")).alias("left"))
