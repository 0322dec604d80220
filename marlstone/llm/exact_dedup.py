"""Exact dedup by two-pass Bloom filtering (native: DataFrame functions only).

Pass 1 hashes every text into cells of a filter and keeps the cells that two rows or
more have hit. Pass 2 tests every row: a row with a cell hit once has a text of its own
and passes straight through, without a shuffle. Only the others shuffle, as (id, SHA-256),
and are grouped exactly, so a false positive of the filter costs a row's shuffle, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

#: Cells a row, and the most cells; a filter takes max_cells / 8 bytes at most (128 MB), whatever the input.
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 30
#: Beginning of the names of columns that stand beside a caller's own for a while.
MARK = "_marlstone_"


def _cells(h: Column, n: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(n - 1)) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(n - 1)) + 1]


def repeated_cells(hashes: DataFrame, h: str, n: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the cells that two rows or more hit; n / 8 bytes at most."""
    cell = hashes.select(F.explode(F.array(*_cells(F.col(h), n))).alias("cell"))
    hit = cell.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return hit.groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")
    )


def maybe_repeated(rows: DataFrame, h: str, n: int, bitmaps: DataFrame, out: str = "repeated") -> DataFrame:
    """``rows`` with the flag ``out``: false if no other row can have the same hash."""
    for k, cell in enumerate(_cells(F.col(h), n)):
        key, bits, own, at, byte, hit = (f"{MARK}{x}{k}" for x in ("key", "bits", "own", "at", "byte", "hit"))
        found = bitmaps.select(F.col("bucket").alias(key), F.col("bits").alias(bits))
        rows = rows.withColumn(own, cell).join(F.broadcast(found), F.expr(f"bitmap_bucket_number({own})") == F.col(key), "left")
        rows = rows.withColumn(at, F.expr(f"bitmap_bit_position({own})"))
        rows = rows.withColumn(byte, F.expr(f"substring({bits}, cast({at} div 8 as int) + 1, 1)"))
        bit = F.expr(f"shiftright(cast(conv(hex({byte}), 16, 10) as int), cast({at} % 8 as int)) & 1")
        rows = rows.withColumn(hit, F.coalesce(bit == 1, F.lit(False))).drop(key, bits, own, at, byte)
    return rows.withColumn(out, F.col(f"{MARK}hit0") & F.col(f"{MARK}hit1")).drop(f"{MARK}hit0", f"{MARK}hit1")


def filter_size(rows: int) -> int:
    """Cells for so many rows: a power of two from 2^15 to MAX_CELLS."""
    n = 1 << 15
    while n < min(MAX_CELLS, CELLS_PER_ROW * rows):
        n *= 2
    return n


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with
    the largest id stays (the least with keep="min"); rows that repeat that id all count as kept; a null id is less than any
    other (keep_id is null only where all ids of the group are). An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    marked = mark_repeated(rows, "h")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    through = marked.where(~F.col("repeated")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    some = cut(marked.where("repeated").select("id", sha))
    groups = cut(some.groupBy("text_sha256").agg((F.min if keep == "min" else F.max)("id").alias("keep_id"), F.count("*").alias("group_size")))
    exact = join_groups(some, groups, ["text_sha256"], "group_size").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return through.unionByName(exact).withColumnRenamed("id", id_col)


def mark_repeated(rows: DataFrame, h: str, count: int | None = None, out: str = "repeated") -> DataFrame:
    """``rows`` with the flag ``out``: false if no other row has the hash ``h``. Both passes over the rows, without their shuffle. ``count`` is about their number."""
    n = filter_size(rows.count() if count is None else count)
    return maybe_repeated(rows, h, n, cut(repeated_cells(rows, h, n)), out)


def split_by_keys(rows: DataFrame, keys: DataFrame, names: list[str], count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` parted by a Bloom filter of ``keys`` (columns ``names``, of the same types; ``count`` is about their number): those surely not among them, and the rest. No shuffle."""
    own = keys.select(F.xxhash64(*names).alias("h"))
    n = filter_size(own.count() if count is None else count)
    bitmaps = cut(repeated_cells(own.unionByName(own), "h", n))  # the filter holds cells hit twice, so each key counts twice
    h, flag = f"{MARK}h", f"{MARK}maybe"
    marked = maybe_repeated(rows.withColumn(h, F.xxhash64(*names)), h, n, bitmaps, flag)
    return marked.where(~F.col(flag)).select(*rows.columns), marked.where(flag).select(*rows.columns)


def drop_keys(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without those whose columns ``names`` are a row of ``keys`` (null equals null); only rows that may be among them shuffle."""
    keys = cut(keys.select(*names))
    out, maybe = split_by_keys(rows, keys, names)
    gone = keys.select(*[F.col(k).alias(f"{MARK}{k}") for k in names])
    same = [F.col(k).eqNullSafe(F.col(f"{MARK}{k}")) for k in names]
    return out.unionByName(maybe.join(gone, same, "left_anti"))


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs``, all their columns, without the rows (id_col, text_sha256) of ``dropped``: rows that share an id are told apart by their text."""
    sha = f"{MARK}sha"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn(sha, F.sha2(text, 256))
    return drop_keys(rows, dropped.select(F.col(id_col), F.col("text_sha256").alias(sha)), [id_col, sha]).select(*docs.columns)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that exact_dedup keeps: at least one of every text, and all rows that repeat the kept id with that text."""
    return drop_rows(docs, exact_dedup(docs, id_col, text_col).where(~F.col("kept")), id_col, text_col)
