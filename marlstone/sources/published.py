"""Versions of a data set: written aside, then published by one atomic rename; a reader always finds a whole version.

A data set is a folder with one subfolder for each version and a file CURRENT that names the published one. A writer that is killed leaves a
version that nothing names; ``vacuum`` removes such folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it isn't there."""
    if not exists(spark, path):
        return None
    place, fs = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then rename it over the old one in one step."""
    sc = spark.sparkContext
    new, fs = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new)
    stream.write(bytearray(text.encode()))
    stream.close()
    kinds = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(_file_system(spark, path)[0]), kinds)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version."""
    name = read_text(spark, f"{path}/{POINTER}")
    return f"{path}/{name}" if name else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write`` a version into a new folder, then make it the current one; its folder."""
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    replace_text(spark, f"{path}/{POINTER}", name)
    return f"{path}/{name}"


def vacuum(spark: SparkSession, path: str, keep: int = 0) -> int:
    """Delete versions that are not current, but for the ``keep`` newest of them; how many went. Not while someone writes or reads old ones."""
    place, fs = _file_system(spark, path)
    now = read_text(spark, f"{path}/{POINTER}")
    old = [s for s in fs.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("version-") and s.getPath().getName() != now]
    old.sort(key=lambda s: s.getModificationTime(), reverse=True)
    for s in old[keep:]:
        fs.delete(s.getPath(), True)
    return len(old[keep:])


def publish_layout(rows: DataFrame, path: str, *keys: str) -> str:
    """Publish rows as JSON lines, one folder for each value of ``keys``, with a manifest of files and rows of each; the version's folder.

    The manifest is read from what was written, so that it tells what is there.
    """
    spark = rows.sparkSession

    def write(folder: str) -> None:
        rows.write.partitionBy(*keys).json(f"{folder}/data")
        kinds = ", ".join(f"{k} string" for k in keys)
        lines = spark.read.schema(f"value string, {kinds}").text(f"{folder}/data").select(*keys, F.col("_metadata.file_path").alias("_file"))
        counts = lines.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("_file").alias("files"))
        counts.coalesce(1).write.json(f"{folder}/manifest")

    return publish(spark, path, write)


def read_layout(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the published version; no rows where none is published."""
    folder = current(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).json(f"{folder}/data")


def read_manifest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(keys.., rows, files) of the published version."""
    schema = ", ".join([*(f"{k} string" for k in keys), "rows long, files long"])
    folder = current(spark, path)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).json(f"{folder}/manifest")


