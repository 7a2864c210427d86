"""WARC as a content-addressed archive: payload bytes once by digest, exact record headers apart, records by a join.

`write_archive` makes two tables in a folder: payloads (sha256, payload, n_bytes, sha1) holds each distinct payload
once, headers (record_id, page_id, header, sha256) the exact header block of every record. `read_archive` joins
them, checks every payload against its digest and gives back whole records: header, blank line, payload, two line
ends. Of records with equal payloads of MIN_REVISIT bytes or more the one with the largest page_id is the response
and the others are revisits that refer to it; a revisit's stored block is empty in the record, its payload is found
through the digest.

Defined results: a null html is an empty payload; page_id ties on the largest page_id are all responses; a null
page_id sorts before all others; repeated rows give repeated records; extra columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: Smaller payloads are cheaper to keep than to refer to.
MIN_REVISIT = 1000
CRLF = "\r\n"


def _header(*fields: tuple[str, Column]) -> Column:
    parts = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def field(header: Column, name: str) -> Column:
    """The value of a named field of a record's header, null where it has none."""
    return F.nullif(F.regexp_extract(header, rf"(?i)\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _clean(url: Column) -> Column:
    """A url that can't break its header line."""
    return F.regexp_replace(url, r"[\r\n]", " ")


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write the rows of pages (page_id, url, html) as an archive in the folder path."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    second = F.struct("n_bytes", F.xxhash64("payload"))  # another hash and the length of what has one digest
    store = rows.select("sha256", second.alias("second"), "n_bytes", "payload").groupBy("sha256").agg(F.first("payload").alias("payload"), F.min("n_bytes").alias("n_bytes"), F.min("second").alias("least"), F.max("second").alias("most"))
    store = store.select("sha256", F.when(F.col("least") == F.col("most"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary")).alias("payload"), "n_bytes", F.sha1("payload").alias("sha1"))
    store.write.mode("overwrite").parquet(f"{path}/payloads")
    light = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "n_bytes", "sha1")
    copied = rows.where(F.col("n_bytes") >= min_revisit).groupBy("sha256").agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1").select("sha256", "kept")
    all_rows = rows.select("page_id", "url", "sha256").join(light, "sha256").join(copied, "sha256", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", uri(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), ("WARC-Target-URI", _clean(F.col("url"))), ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), ("WARC-Refers-To", F.when(revisit, uri(F.col("kept")))), ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("X-Payload-Length", F.col("n_bytes").cast("string")), ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    )
    all_rows.select("page_id", "sha256", header.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload (whole, of revisits too), record (the bytes of the WARC record); payloads are checked."""
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    stored = stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), "sha256")).cast("binary")).alias("payload"))
    joined = spark.read.parquet(f"{path}/headers").join(stored, "sha256")
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def records(archive: DataFrame) -> DataFrame:
    """The fields of records that read_archive gave: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    h = F.col("header")
    return archive.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.concat(F.lit("sha1:"), F.sha1("payload")).alias("_digest"), field(h, "WARC-Payload-Digest").alias("_said"), field(h, "WARC-Type").alias("record_type"), F.regexp_extract(field(h, "WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).try_cast("long").alias("refers_to")).withColumn("payload_digest", F.when(F.col("_digest") == F.col("_said"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload disagree")).cast("string"))).drop("_digest", "_said")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as an archive in the shared folder, read it back and give its records' fields."""
    spark = pages.sparkSession
    return records(read_archive(spark, write_archive(pages, path or shared_path(spark, "warc"))))
