"""The same analysis over streams: documents as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import is_small
from ..plans.analyze import analyzed
from ..sources.shared import shared_path


def start(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, tasks: int | None = None, **trigger):
    """Start a query that analyses the Parquet files arriving in a folder and appends reports to out.

    tasks: how many the rows of a batch are dealt to, where its files are too few for all cores.
    """
    docs = spark.readStream.schema(schema).parquet(source)
    docs = docs if tasks is None else docs.repartition(tasks)
    reports = analyzed(docs.select("doc_id", "text")).drop("signals")
    return reports.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def analyzed_stream(spark: SparkSession, source: str, schema: StructType) -> DataFrame:
    """Reports of all files that are there now, made by a streaming query and read back."""
    base = shared_path(spark, "stream")
    where = source if spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(source)).isDirectory() else source.rsplit("/", 1)[0] + "/" + source.rsplit("/", 1)[1].replace(".parquet", "*.parquet")
    tasks = spark.sparkContext.defaultParallelism if is_small(spark.read.schema(schema).parquet(where)) else None
    query = start(spark, where, schema, f"{base}/out", f"{base}/state", tasks)
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time; on a stream, state is dropped after `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
