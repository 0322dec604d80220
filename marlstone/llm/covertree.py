"""Exact top-k inner products by dual-tree search over cover trees.

The upper tree is drawn from a bounded sample; every vector, query or data, goes down it to a leaf, so queries and data share one
index. A leaf's rows lie in blocks of bounded size. For a query node (centre c, radius r) and a data node
(centre d, radius s) no score exceeds c.d + r|d| + s|c| + rs: the search goes down pairs of nodes, the highest bound first, and prunes a pair
whose bound is below the worst kth score of the query node's rows. It does so over the upper tree, which gives the pairs of blocks
that meet, and again in each task over the trees of the two blocks.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Vectors the upper tree is drawn from, rows of its leaves in that sample, and the rows of a block and of a query group, about.
SAMPLE = 4096
LEAF_SAMPLE = 64
BLOCK = 8192
GROUP = 2048
#: Rows of a leaf of the trees inside a task; ratio of the radii of neighbouring levels; most children of a node (a node that needs more is a leaf, whatever its size).
NODE = 256
BASE = 1.5
FAN = 64


def quantize(embedding, scale: int = 256):
    """Components as floor(scale * x), x as double; null if the array, a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


class Tree:
    """A cover tree over rows of ``points``. Node k has a centre (a point), a level, the radius that covers its rows, children and, in a leaf, its rows.

    Children of a node of level i + 1 lie within BASE^(i + 1) of its centre, are more than BASE^i apart, and have their rows within
    BASE^i. Levels at which a node has itself as its only child are passed over.
    """

    def __init__(self, points: np.ndarray, size: int = NODE):
        self.centre: list[np.ndarray] = []
        self.level: list[int] = []
        self.radius: list[float] = []
        self.kids: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        far = self._far(points, points[0])
        self._grow(points, np.arange(len(points)), points[0], far, math.ceil(math.log(max(far.max(), 1e-9), BASE)), size)
        self.centres = np.array(self.centre)
        self.norms = np.sqrt((self.centres**2).sum(1))

    @staticmethod
    def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - centre) ** 2).sum(1))

    def _grow(self, points, rows, centre, far, level, size) -> int:
        node, top = len(self.centre), float(far.max())
        for values, x in ((self.centre, centre), (self.level, level), (self.radius, top), (self.kids, []), (self.rows, rows)):
            values.append(x)
        if len(rows) <= size or top == 0:
            return node
        level = min(level, math.ceil(math.log(top, BASE))) - 1  # below this all rows would stay with the centre
        self.level[node] = level + 1
        reach, own = BASE**level, points[rows]
        centres, near, least = [centre], np.zeros(len(rows), np.int64), far.copy()
        while least.max() > reach:
            if len(centres) == FAN:
                return node
            k = int(least.argmax())
            d = self._far(own, own[k])
            near[d < least] = len(centres)
            least = np.minimum(least, d)
            centres.append(own[k])
        self.rows[node] = None
        for k, c in enumerate(centres):
            at = np.flatnonzero(near == k)
            if len(at):
                self.kids[node].append(self._grow(points, rows[at], c, least[at], level, size))
        return node

    def leaves(self) -> list[int]:
        return [k for k, kids in enumerate(self.kids) if not kids]

    def descend(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance to its centre) of any points: from the root to the nearest child each time."""
        leaf, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            leaf[at] = node
            kids = self.kids[node]
            if kids and len(at):
                c = self.centres[kids]
                near = (-2 * points[at] @ c.T + (c**2).sum(1)).argmin(1)
                todo += [(kid, at[near == k]) for k, kid in enumerate(kids)]
        return leaf, np.sqrt(((points - self.centres[leaf]) ** 2).sum(1))

    def spread(self, radius: dict[int, float]) -> None:
        """Take the leaves' radii from ``radius`` (none: no rows, -1) and cover inner nodes by their children's."""
        for k in reversed(range(len(self.centre))):
            if self.kids[k]:
                own = [self.radius[c] + float(np.sqrt(((self.centres[c] - self.centres[k]) ** 2).sum())) for c in self.kids[k] if self.radius[c] >= 0]
                self.radius[k] = max(own, default=-1.0)
            else:
                self.radius[k] = radius.get(k, -1.0)


def bound(q: Tree, a: int, d: Tree, b: int) -> float:
    """No row below query node ``a`` has a score over this with a row below data node ``b``."""
    r, s = q.radius[a], d.radius[b]
    high = float(q.centres[a] @ d.centres[b]) + r * d.norms[b] + s * q.norms[a] + r * s
    return high + 1e-9 * abs(high) + 1e-3


def dual(q: Tree, d: Tree, worst, visit) -> None:
    """Visit the pairs of leaves that are not pruned, by highest bound: ``worst(node)`` is the worst kth score so far of a query node's rows."""
    heap, n = [(-bound(q, 0, d, 0), 0, 0, 0)], 0
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if q.radius[a] < 0 or d.radius[b] < 0 or -high < worst(a):
            continue
        if not q.kids[a] and not d.kids[b]:
            visit(a, b)
            continue
        if q.kids[a] and (not d.kids[b] or q.radius[a] >= d.radius[b]):
            pairs = [(k, b) for k in q.kids[a]]
        else:
            pairs = [(a, k) for k in d.kids[b]]
        for x, y in pairs:
            n += 1
            heapq.heappush(heap, (-bound(q, x, d, y), n, x, y))


def _best(s: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m best of each row, ties to the left."""
    kth = np.partition(s, s.shape[1] - m, axis=1)[:, -m][:, None]
    above, equal = s > kth, s == kth
    take = above | (equal & (np.cumsum(equal, axis=1) <= m - above.sum(1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(s), m)


def search_block(q_ids, q, d_ids, d, k: int, known: np.ndarray | None = None, exact=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """k best (row of d, score) of a block for each query, -1 where there are fewer; ties to the earlier row. ``known`` is each query's known kth score."""
    none = np.iinfo(np.int64).min
    at, scores = np.full((len(q), k), -1), np.full((len(q), k), none, np.int64)
    known = np.full(len(q), -np.inf) if known is None else known
    tq, td = Tree(q.astype(np.float64)), Tree(d.astype(np.float64))
    q, d = q.astype(exact), d.astype(exact)

    def below(node):
        kids = tq.kids[node]
        return np.concatenate([below(c) for c in kids]) if kids else tq.rows[node]

    inside = [below(node) for node in range(len(tq.kids))]

    def worst(node):
        rows = inside[node]
        kth = np.where(scores[rows, k - 1] == none, -np.inf, scores[rows, k - 1].astype(np.float64))
        return np.maximum(kth, known[rows]).min()

    def visit(a, b):
        rows, own = tq.rows[a], np.sort(td.rows[b])
        s = (q[rows] @ d[own].T).astype(np.int64)  # whole numbers below 2^53 are exact
        s[q_ids[rows][:, None] == d_ids[own][None, :]] = none
        pick = _best(s, min(k, s.shape[1]))
        new, value = own[pick], np.take_along_axis(s, pick, 1)
        new = np.where(value == none, -1, new)
        new, value = np.concatenate([at[rows], new], 1), np.concatenate([scores[rows], value], 1)
        order = np.lexsort((new, ~value), axis=1)[:, :k]
        at[rows], scores[rows] = np.take_along_axis(new, order, 1), np.take_along_axis(value, order, 1)

    dual(tq, td, worst, visit)
    return at, scores


def _matrix(column, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, id, score of the k highest integer inner products of each query (ids divisible by ``every``) with all other rows.

    Ties go to the smaller id; fewer rows if there are fewer candidates. Null ids, and vectors that are null, empty or hold null or non-finite components, take
    no part. A query meets the vectors of its own length; each length is searched by itself. Rows that repeat an id with the same vector count once;
    with different vectors they are candidates each, and a query id has the best of its vectors' scores with each candidate. No row with the query's own id is
    its candidate. Scores past 2^63 raise. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantize(F.col(vec_col)).alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = cut(rows.withColumn("row", F.xxhash64("id", "v")))
    names = "query_id long, rank int, vec_id long, score long"
    high = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("high")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), high).where("q > 0").orderBy("dim").collect()
    found = [_top_k(rows.where(F.size("v") == s.dim), s, k, every, block, group) for s in sizes]
    release(rows)
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], names)


def _top_k(rows: DataFrame, stats, k: int, every: int, block: int, group: int) -> DataFrame:
    """top_k of rows (id, v, row) of one length ``stats.dim``; ``stats.high`` is the greatest size of a component."""
    spark, dim = rows.sparkSession, stats.dim
    most = int(stats.high) ** 2 * dim
    if most >= 1 << 63:
        raise ValueError(f"scores up to {most} are more than a long holds")
    exact = np.float64 if most < 1 << 53 else np.int64
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE).select("v").toArrow()["v"]
    tree = Tree(_matrix(sample, dim).astype(np.float64), LEAF_SAMPLE)

    def descend(batches):
        for batch in batches:
            leaf, far = tree.descend(_matrix(batch.column(1), dim).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far)], ["id", "v", "row", "leaf", "far"])

    placed = cut(rows.select("id", "v", "row").mapInArrow(descend, "id long, v array<long>, row long, leaf long, far double"))
    is_query = F.col("id") % every == 0
    leaves = placed.groupBy("leaf").agg(F.max("far").alias("s"), F.count("*").alias("n"), F.max(F.when(is_query, F.col("far"))).alias("r"), F.count(F.when(is_query, 1)).alias("q")).collect()
    # both sides share the tree and have radii of their own; the leaves of a sample of SAMPLE are SAMPLE at most
    queries, data = (Tree.__new__(Tree) for _ in range(2))
    for side, name in ((queries, "r"), (data, "s")):
        side.__dict__.update(tree.__dict__, radius=list(tree.radius))
        side.spread({x.leaf: getattr(x, name) for x in leaves if getattr(x, name) is not None})
    parts = spark.createDataFrame([(x.leaf, -(-x.n // block), max(1, -(-x.q // group))) for x in leaves], "leaf long, blocks long, groups long")
    h = F.xxhash64("id")
    met = placed.join(F.broadcast(parts), "leaf")
    data_rows = met.select("id", "v", "row", F.col("leaf").alias("d_leaf"), F.pmod(h, "blocks").alias("b"))
    query_rows = cut(met.where(is_query).select("id", "v", "row", F.col("leaf").alias("q_leaf"), F.pmod(h, "groups").alias("g")))
    blocks = parts.select(F.col("leaf").alias("d_leaf"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    schema = "query_id long, q_row long, vec_id long, d_row long, score long"
    keys = ["q_leaf", "g", "d_leaf", "b"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("query_id", "q_row", "vec_id", "d_row", "score")})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, tag = (right[x].to_numpy() for x in ("id", "row"))
        one = np.lexsort((tag, ids))
        new = np.ones(len(one), bool)
        new[1:] = (ids[one][1:] != ids[one][:-1]) | (tag[one][1:] != tag[one][:-1])
        one = one[new]  # equal rows count once; what is left is in order of ids, so that ties go to the earlier row
        q_ids, q_tag = (left[x].to_numpy() for x in ("id", "row"))
        at, scores = search_block(q_ids, _matrix(left["v"], dim), ids[one], _matrix(right["v"], dim)[one], k, left["kth"].to_numpy(zero_copy_only=False).astype(np.float64), exact)
        q, _ = np.nonzero(at >= 0)
        hit = one[at[at >= 0]]
        return pa.table({"query_id": q_ids[q], "q_row": q_tag[q], "vec_id": ids[hit], "d_row": tag[hit], "score": scores[at >= 0]})

    def run(pairs: DataFrame, left: DataFrame) -> DataFrame:
        """The blocks' best of each query; pairs: (q_leaf, g, d_leaf, b)."""
        a, b = left.join(pairs, ["q_leaf", "g"]), data_rows.join(pairs, ["d_leaf", "b"])
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(work, schema)

    groups = parts.select(F.col("leaf").alias("q_leaf"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
    # each group's most promising leaf first, one block of it; the kth scores found there then prune
    filled = [x.leaf for x in leaves]
    best = [(x.leaf, max(filled, key=lambda b: bound(queries, x.leaf, data, b))) for x in leaves if x.q]
    start = groups.join(F.broadcast(spark.createDataFrame(best, "q_leaf long, d_leaf long")), "q_leaf").withColumn("b", F.lit(0).cast("long"))
    first = cut(run(start, query_rows.withColumn("kth", F.lit(float("-inf")))))
    kth = first.groupBy("query_id", "q_row").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    kth = kth.select(F.col("query_id").alias("id"), F.col("q_row").alias("row"), F.when(F.col("n") >= k, F.col("low").cast("double")).alias("kth"))
    again = cut(query_rows.join(kth, ["id", "row"], "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))
    worst = {x.q_leaf: x.worst for x in again.groupBy("q_leaf").agg(F.min("kth").alias("worst")).collect()}

    def worst_of(node: int) -> float:
        kids = tree.kids[node]
        return min((worst_of(c) for c in kids), default=math.inf) if kids else worst.get(node, math.inf)

    low = [worst_of(node) for node in range(len(tree.kids))]
    pairs: list[tuple[int, int]] = []
    dual(queries, data, lambda node: low[node], lambda a, b: pairs.append((a, b)))
    both = spark.createDataFrame(pairs, "q_leaf long, d_leaf long").join(blocks, "d_leaf").join(groups, "q_leaf").join(start, keys, "left_anti")
    found = first.unionByName(run(both, again))
    found = found.groupBy("query_id", "vec_id", "d_row").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "d_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
