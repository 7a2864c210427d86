"""Tables of reports, answers and calibrations: append, history, upsert, delete, and their JSON forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = 200
REPORT_ID = "^[0-9a-f-]{36}$"


def save(reports: DataFrame, path: str) -> None:
    """Append reports, partitioned by the day they were made."""
    reports.withColumn("day", F.to_date("created")).write.mode("append").partitionBy("day").parquet(path)


def find(spark: SparkSession, path: str, report_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("report_id").rlike(REPORT_ID) & (F.col("report_id") == report_id))


def history(reports: DataFrame, by: str = "created", tie: str = "report_id", most: int = HISTORY) -> DataFrame:
    """The newest reports: a top-k, never a full sort."""
    return reports.orderBy(F.desc(by), F.desc(tie)).limit(most)


def without(reports: DataFrame, gone: DataFrame, key: str = "report_id") -> DataFrame:
    return reports.join(gone.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both tables, of each key the one with the highest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def samples_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Calibration samples from their compact form: a header of columns and rows of numbers."""
    x = spark.read.option("multiLine", True).schema("columns array<string>, rows array<array<double>>").json(path).select(F.posexplode("rows").alias("i", "r"))
    g = lambda k: F.get("r", F.lit(k))
    return x.select(F.col("i").cast("long").alias("sample_id"), g(0).cast("long").alias("sample_group"), (g(1) == 1).alias("ai"), F.lit(1).cast("long").alias("weight"), g(2).cast("long").alias("tokens"), g(3).alias("mean_log_prob"), g(4).alias("mean_entropy"), g(5).alias("criterion"), g(6).alias("binoculars"))


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Saved calibrations of the version that is understood."""
    return spark.read.option("multiLine", True).json(path).where("version = 3")
