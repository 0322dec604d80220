"""What the operators share: cut lineage, skew-proof joins, Arrow text blocks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more than 1/HOT of all rows is hot; so there are HOT hot groups at most.
HOT = 1000
#: Groups that are broadcast whole, after a count: some MB at most.
FEW = 40_000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor recomputes nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` has written, once all that reads them is written itself."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path is not None:
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, ``size`` its number of rows), spread evenly.

    FEW groups or fewer, counted first, are broadcast. Of more, those of more than 1/HOT of all rows number HOT at most whatever the input, so
    they are broadcast; the others shuffle, and none of them is large.
    ``rows`` and ``groups`` are read twice: pass tables that are cheap to read.
    """
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    extra = [c for c in groups.columns if c not in keys]
    out = rows.columns + extra
    if count <= FEW:
        return rows.join(F.broadcast(groups), keys, how).select(*out)
    hot = groups.where(F.col(size) * HOT > total)
    cold = groups.where(F.col(size) * HOT <= total)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    found = marked.where("_hot").select(*out)
    rest = marked.where("_hot is null").select(*rows.columns).join(cold, keys, how).select(*out)
    return found.unionByName(rest)


def learns(doc_id: str, parts: int, held: int) -> Column:
    """False for held-out documents: those whose crc32 of the id's text leaves ``held``."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts) != held


def clean_texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large_binary (UTF-8 bytes), null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary()).fill_null(b"")


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """(first row, end row, bytes, document starts and ends in them) in blocks of about ``limit`` bytes, documents whole."""
    col = clean_texts(batch, column)
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Fixed odd multipliers of the hash functions.
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of P and of its inverse, grown when a longer block comes."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, P))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, P_INV))])
        return cls.up, cls.down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash reads the hash of any span in constant time."""
    up, _ = Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), the same wherever they stand."""
    _, down = Powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of bytes that are no white space; none crosses a document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    blank = space[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = blank[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:] | blank[1:]
    starts = np.flatnonzero(first & ~blank)
    ends = np.flatnonzero(last & ~blank) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1
