"""Intermediate tables in the folder that driver and executors share: written once, read by column, released when their readers are done."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes that go to a Python worker at once, and of a row group of tables with long rows: Spark holds a batch some times over, outside its heap, in each task.
BATCH = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return f"{top or tempfile.mkdtemp(prefix='marlstone-')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends BATCH bytes (a row at least) to Python workers at once, where the session allows more."""
    before = spark.conf.get(_LIMIT, None)
    if before is not None and 0 < _bytes(before) <= BATCH:
        yield
        return
    spark.conf.set(_LIMIT, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(_LIMIT) if before is None else spark.conf.set(_LIMIT, before)


def _bytes(size: str) -> int:
    number = size.rstrip("bkmgtBKMGT")
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[len(number) : len(number) + 1].lower(), 0)


def stored(df: DataFrame, name: str = "table", long_rows: bool = False) -> DataFrame:
    """The table, written to the shared folder and read back: a lost executor recomputes nothing before it.

    Rows go to Python in small batches on the way. ``long_rows`` closes a row group after BATCH bytes, so that no reader or writer holds more than some rows of a megabyte and more.
    """
    path = shared_folder(df.sparkSession, name)
    groups = {"parquet.block.size": BATCH, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if long_rows else {}
    with small_batches(df.sparkSession):
        df.write.options(**groups).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` has written."""
    for df in tables:
        path = getattr(df, "stored_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where they stand in fewer partitions (a few large row groups): for work that costs far more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
