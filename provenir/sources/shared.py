"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of its own (tests); a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage; the table outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def drop_written(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that are done with, and let Spark remove the shuffle files that nothing refers to any more.

    Spark removes these when the driver's JVM collects garbage, which a long job with a small driver may not do.
    """
    for df in tables:
        drop_written(df)
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df has not, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
