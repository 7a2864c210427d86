"""Makes this package importable on the executors."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core that a table must have to be read as its files are split.
SMALL = 8 << 20
_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark, once per application; no shared install is needed."""
    top = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(top):  # already inside an archive, on an executor
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                with open(path, "rb") as f:
                    z.writestr(zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(top))), f.read())
    digest = hashlib.sha256(held.getvalue()).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, digest)
    if key in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"provenir-{digest}.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, dealt to all cores if it is small: then it may lie in one block, which one task reads.

    A table of more than SMALL bytes a core stays as it is split.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    """Whether a table as read from files has fewer than SMALL bytes a core, but some."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 0 < size < SMALL * df.sparkSession.sparkContext.defaultParallelism
