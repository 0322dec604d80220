"""Nearest vectors by cosine with pivots: blocks that the triangle inequality rules out never meet a query.

Vectors of length 1 are dealt to their nearest of some pivots and stand in blocks by their angle to it. A query first meets the one block that lies nearest to it;
the angle r of its k-th best there bounds all better ones: their angle to a pivot is within r of the query's own. So only blocks whose
range of angles touches that window are joined with the query, on the pivot; each block and bundle of queries is one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import release, stored

#: Vectors of a block and queries that meet it at once; vectors to a pivot, and most pivots of vectors of one length.
BLOCK, BUNDLE, EACH, PIVOTS = 512, 2048, 256, 1024
#: Slack of an angle: far over the error of an arc cosine near 0.
SLACK = 1e-7
#: Digits to which scores are told apart.
DIGITS = 9
ZERO = -1


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of little-endian float64 values."""
    raw = b"".join(column.to_pylist())
    n = len(column)
    return np.frombuffer(raw).reshape(n, -1 if width is None else width) if n else np.zeros((0, width or 0))


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, dim, x): vectors of length 1 as bytes; null and non-finite ones and null ids are left out, zeros stay zeros."""

    def work(batches):
        for batch in batches:
            v = batch.column(1)
            size = v.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)
                good = np.isfinite(x).all(1)
                at, x = at[good], x[good]
                x = x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "dim", "x"])

    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return some.mapInArrow(work, "id long, dim int, x binary")


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


class _Pivots:
    """Some vectors of each length: a bounded number on the driver and in every task."""

    def __init__(self, rows: DataFrame):
        counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
        order = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("x"), "id"))
        limit = rows.withColumn("_r", order).where(F.col("_r") <= PIVOTS)
        self.by = {}
        for dim, n in counts.items():
            want = max(1, min(PIVOTS, n // EACH))
            found = limit.where((F.col("dim") == dim) & (F.col("_r") <= want)).select("x").toArrow()
            x = np.unique(_matrix(found["x"], dim), axis=0) if dim else np.zeros((1, 0))
            x = x[(x != 0).any(1)] if dim else x
            self.by[dim] = x

    def nearest(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, angle to it); ZERO for zero vectors and where there is no pivot."""
        p = self.by.get(dim, np.zeros((0, dim)))
        zero = ~(x != 0).any(1)
        if not len(p):
            return np.full(len(x), ZERO), np.zeros(len(x))
        a = _angles(x, p)
        at = a.argmin(1)
        return np.where(zero, ZERO, at), np.where(zero, 0.0, a[np.arange(len(x)), at])


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column(1).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(batch.column(2).take(pa.array(at)), int(dim))


BLOCKS = "block long, dim int, pivot int, low double, high double, n int, ids binary, xs binary"


def pack_blocks(rows: DataFrame, pivots: _Pivots) -> DataFrame:
    """Rows of BLOCKS, BLOCK vectors or fewer of one pivot each, in order of their angle."""

    def deal(batches):
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                pivot, angle = pivots.nearest(dim, x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(pivot.astype(np.int32)), pa.array(angle), batch.column(2).take(pa.array(at))], ["id", "dim", "pivot", "angle", "x"])

    def pack(batches):
        made = 0
        for batch in batches:
            dim, pivot, angle, ids = (batch.column(k).to_numpy() for k in (1, 2, 3, 0))
            key = dim.astype(np.int64) * (PIVOTS + 2) + pivot
            cuts = np.flatnonzero(np.diff(key, prepend=-2))
            for a, end in zip(cuts, [*cuts[1:], len(key)]):
                for i in range(a, end, BLOCK):
                    j = min(i + BLOCK, end)
                    own = np.argsort(ids[i:j], kind="stable") + i
                    x = batch.column(4).take(pa.array(own)).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(TaskContext.get().partitionId() << 32) + made]), pa.array([dim[i]], pa.int32()), pa.array([pivot[i]], pa.int32()), pa.array([angle[i:j].min()]), pa.array([angle[i:j].max()]), pa.array([j - i], pa.int32()), pa.array([ids[own].tobytes()], pa.binary()), pa.array([b"".join(x)], pa.binary())],
                        [c.split()[0] for c in BLOCKS.split(", ")],
                    )
                    made += 1

    dealt = rows.mapInArrow(deal, "id long, dim int, pivot int, angle double, x binary")
    # by id too, so that equal vectors may fall apart
    return dealt.repartitionByRange("dim", "pivot", "angle", "id").sortWithinPartitions("dim", "pivot", "angle", "id").mapInArrow(pack, BLOCKS)


def _meet(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each pair (block, query_id, bundle, x) the k best of the block."""

    def best(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = block["dim"][0].as_py()
        ids = np.frombuffer(block["ids"][0].as_py(), np.int64)
        x, q, own = np.frombuffer(block["xs"][0].as_py()).reshape(len(ids), dim), _matrix(queries["x"], dim), queries["query_id"].to_numpy()
        s = np.round(q @ x.T, DIGITS)
        s[own[:, None] == ids[None, :]] = -np.inf
        m = min(k, s.shape[1])
        kth = np.partition(s, s.shape[1] - m, axis=1)[:, -m][:, None]
        above, equal = s > kth, s == kth
        # ids are in order, so the first of equal scores stay
        row, col = np.nonzero((above | (equal & (np.cumsum(equal, axis=1) <= m - above.sum(1, keepdims=True)))) & np.isfinite(s))
        return pa.table({"query_id": own[row], "id": ids[col], "score": s[row, col]})

    wanted = pairs.select("block", "bundle").distinct().join(blocks.select("block", "dim", "ids", "xs"), "block")
    pairs, wanted = pairs.toDF(*pairs.columns), wanted.toDF(*wanted.columns)  # columns of their own, so that both sides can meet
    return pairs.groupBy("block", "bundle").cogroup(wanted.groupBy("block", "bundle")).applyInArrow(best, "query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score) of all blocks' best, (query_id, blocks) that each query met)."""
    rows, asked = stored(unit_vectors(vectors, id_col, vec_col), "vectors"), stored(unit_vectors(queries, id_col, vec_col), "queries")
    pivots = _Pivots(rows)
    blocks = stored(pack_blocks(rows, pivots), "blocks")
    reach = {(r.dim, r.pivot): (r.low, r.high) for r in blocks.groupBy("dim", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # PIVOTS and one more for each length
    bundles = max(1, -(-asked.count() // BUNDLE))
    asked = asked.withColumn("bundle", F.pmod(F.xxhash64("id"), F.lit(bundles)).cast("int"))

    def near(batches):
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                pivot, angle = pivots.nearest(dim, x)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1, 2, 3)), pa.array(pivot.astype(np.int32)), pa.array(angle)], ["query_id", "dim", "x", "bundle", "pivot", "angle"])

    query = "query_id long, dim int, x binary, bundle int, pivot int"
    spans = blocks.select("block", "dim", "pivot", "low", "high", "n")
    first = asked.select("id", "dim", "x", "bundle").mapInArrow(near, f"{query}, angle double").join(spans, ["dim", "pivot"])
    away = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high"), F.lit(0.0))
    w = Window.partitionBy("query_id", "bundle").orderBy(away, F.desc("n"), "block")
    one = first.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("block", "bundle", "query_id", "x")
    begun = stored(_meet(one, blocks, k), "first")
    least = begun.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))

    def reached(batches):
        for batch in batches:
            least = batch.column(4).to_numpy(zero_copy_only=False)
            for dim, at, x in _by_dim(batch):
                p = pivots.by.get(dim, np.zeros((0, dim)))
                zero = ~(x != 0).any(1)
                r = np.where(zero | np.isnan(least[at]), np.pi, np.arccos(np.clip(least[at] - 2 * 10.0**-DIGITS, -1, 1)) + SLACK)
                a = _angles(x, p) if len(p) else np.zeros((len(x), 0))
                out = []
                for j in range(ZERO, a.shape[1]):
                    span = reach.get((dim, j))
                    if span is None:
                        continue
                    if j == ZERO:  # score 0 with every query
                        some = np.flatnonzero(zero | np.isnan(least[at]) | (least[at] <= 10.0**-DIGITS))
                        low, high = np.zeros(len(some)), np.zeros(len(some))
                    else:
                        low, high = a[:, j] - r, a[:, j] + r
                        low, high = np.where(zero, 0.0, low), np.where(zero, np.pi, high)
                        some = np.flatnonzero((high >= span[0]) & (low <= span[1]))
                        low, high = low[some], high[some]
                    out.append((some, np.full(len(some), j, np.int32), low, high))
                if out:
                    some, pivot, low, high = (np.concatenate(c) for c in zip(*out))
                    take = pa.array(at[some])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 1, 2, 3)), pa.array(pivot), pa.array(low), pa.array(high)], ["query_id", "dim", "x", "bundle", "pivot", "from", "to"])

    rest = asked.select(F.col("id").alias("query_id"), "dim", "x", "bundle").join(least, "query_id", "left")
    windows = rest.mapInArrow(reached, f"{query}, from double, to double")
    touched = windows.join(spans, ["dim", "pivot"]).where("high >= from and low <= to").select("block", "bundle", "query_id", "x")
    met = stored(touched.join(one.select("block", "query_id"), ["block", "query_id"], "left_anti"), "pairs")
    found = stored(begun.unionByName(_meet(met, blocks, k)), "found")
    counted = stored(met.groupBy("query_id").agg((F.count("*") + 1).alias("blocks")), "counted")
    release(rows, begun, met)
    return found, counted


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): cosine of each query with all vectors but itself, the k best; ties (to nine digits) go to the smaller id.

    Vectors of another length than the query's, null ids, null vectors and such with null or non-finite components take no part; zero vectors have cosine 0.
    """
    found, _ = nearest(vectors, queries, k, id_col, vec_col)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
