"""Near-dedup by MinHash: universal hash minima with banding, signature verification, connected components.

Documents with the same shingle set form a class, and only a class's first document goes on. Bands of its minima are its keys; keys that no
other class has are left out by a filter. A bucket (the classes of a key) first links all to its leader; what that leaves in
separate components is met pair by pair in small buckets and block by block in large ones, so no link is lost and no bucket is expanded into
all its pairs. Two low bits of each minimum are the signature that pairs are verified by; those that agree enough are confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import LOWER, cut, join_groups, mix, prefix_sums, release, span_hash, text_blocks, words
from .components import components
from .exact_dedup import drop_keys, mark_repeated, split_by_keys

#: A pair at the threshold .8 shares no band with probability (1 - .8^5)^32 = 3e-6.
ROWS, BANDS = 5, 32
#: Classes of a bucket whose pairs are all listed, rows of a block of larger ones.
SMALL, BLOCK = 8, 512
#: Shingles of a block, about: a block's sets take 2 MB for each of its two sides, or what its longest document takes.
BLOCK_SHINGLES = 250_000
#: Chance that a pair at the threshold fails the signature test (a bound on links lost there, far below that of the bands).
MISS = 1e-9

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, ROWS * BANDS, dtype=np.uint64)
SIG = [f"s{k}" for k in range(ROWS * BANDS // 32)]
_PAIRS_OF_BITS = 0x5555555555555555


def shingles(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted within a document, where each document's begin and end) of a block of texts.

    Words are lower-cased (A-Z) runs of bytes that are no ASCII white space. With fewer words than ``size`` the whole sequence is the one shingle.
    """
    docs = len(bounds) - 1
    data = LOWER[data]
    ws, we, wd = words(data, bounds)
    if not len(ws):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    h = span_hash(prefix_sums(data), ws, we)
    count = np.bincount(wd, minlength=docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = len(h)
    out, owner = [], []
    if n >= size:
        x = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            x = mix(x * np.uint64(3) + h[k : n - size + 1 + k])
        inside = wd[: n - size + 1] == wd[size - 1 :]
        out.append(x[inside])
        owner.append(wd[: n - size + 1][inside])
    for d in np.flatnonzero((count > 0) & (count < size)):
        x = np.full(1, count[d], np.uint64)
        for k in range(first[d], first[d] + count[d]):
            x = mix(x * np.uint64(5) + h[k])
        out.append(x)
        owner.append(np.array([d]))
    x, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    return x, np.searchsorted(owner, np.arange(docs + 1))


def minima(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(documents, ROWS * BANDS) minima of (a x + b) mod 2^64, upper half; all ones for an empty set."""
    docs = len(cuts) - 1
    out = np.full((docs, ROWS * BANDS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(some):
        starts = cuts[some]
        x = x[: cuts[-1]]
        y = np.empty_like(x)
        for j in range(ROWS * BANDS):
            np.multiply(x, _A[j], out=y)
            np.add(y, _B[j], out=y)
            out[some, j] = (np.minimum.reduceat(y, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys: a hash of each band's minima and its number."""
    part = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), 1))
    for j in range(ROWS):
        h = mix(h * np.uint64(31) + part[:, :, j])
    return h


def packed_bits(m: np.ndarray) -> np.ndarray:
    """(documents, len(SIG)): two low bits of each minimum."""
    part = (m & np.uint32(3)).astype(np.uint64).reshape(len(m), len(SIG), 32)
    return (part << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)


def digest(x: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x ^ np.uint64(salt)))]) for salt in (0x51ED, 0xC0FFEE)]
    return [(s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums]


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n, k1, k2, keys, s0..): set size, 128-bit digest of the set, band keys as bytes, signature (null for an empty set)."""
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                x, cuts = shingles(data, bounds, size)
                m, n = minima(x, cuts), np.diff(cuts)
                raw, width, none = band_keys(m).tobytes(), 8 * BANDS, n == 0
                keys = [None if none[i] else raw[i * width : (i + 1) * width] for i in range(b - a)]
                sig = packed_bits(m).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), *map(pa.array, digest(x, cuts)), pa.array(keys, pa.binary()), *[pa.array(sig[:, k], mask=none) for k in range(len(SIG))]],
                    ["id", "text_hash", "n", "k1", "k2", "keys", *SIG],
                )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), text_hash(text).alias("text_hash"))
    return rows.mapInArrow(work, f"id {kind}, text_hash long, n long, k1 long, k2 long, keys binary, {', '.join(f'{c} long' for c in SIG)}")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, x): node is (id, first half of the set's digest), x the sorted distinct shingle hashes, of (id, text)."""
    kind = dict(texts.dtypes)["id"]

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                x, cuts = shingles(data, bounds, size)
                k1 = pa.array(digest(x, cuts)[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), k1, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.view(np.int64)))], ["id", "k1", "x"])

    return texts.select("id", "text").mapInArrow(work, f"id {kind}, k1 long, x array<long>").select(F.struct("id", "k1").alias("node"), "x")


def least_agreeing(threshold: float) -> int:
    """The least number of equal signature places: a pair at the threshold has fewer with probability MISS at most."""
    n, p = ROWS * BANDS, threshold + (1 - threshold) / 4
    tail = 0.0
    for k in range(n + 1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > MISS:
            return k
    return n


def _verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of nodes (a, b) whose signatures and set sizes allow the threshold."""
    left = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"a{c}") for c in SIG])
    right = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"b{c}") for c in SIG])
    x = [F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")) for c in SIG]
    differ = sum((F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(_PAIRS_OF_BITS))) for v in x), F.lit(0))
    met = pairs.join(left, "a").join(right, "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return met.where(fits & (differ <= ROWS * BANDS - least_agreeing(percent / 100))).select("a", "b")


def _sets(nodes: DataFrame, texts: DataFrame, size: int, count: int) -> DataFrame:
    """The sets of nodes; only texts of documents that a Bloom filter takes for them are read twice. ``count`` is the number of documents."""
    return cut(shingle_sets(split_by_keys(texts, nodes.select("node.id").distinct(), ["id"], count)[1], size))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets. A set goes to its pairs as a, and then with them to those of b."""
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    met = met.select("a", "b", both.alias("i"), (F.size("xa") + F.size("xb")).cast("long").alias("s"))
    return cut(met.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b").distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _bands(reps: DataFrame, count: int) -> DataFrame:
    """(node, n, band, key) of the band keys that two nodes may share; ``count`` is about the number of nodes."""
    buckets, bits = filters.shape(count * BANDS)
    kind = dict(reps.select("node.id").dtypes)["id"]

    def pack(batches):
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            yield filters.pack(*np.unique(np.frombuffer(raw, np.uint64), return_counts=True), buckets)

    seen = filters.build(reps.select("keys").mapInArrow(pack, filters.PACKED), buckets, bits)[0]
    sent = reps.sparkSession.sparkContext.broadcast(seen)

    def work(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
            hit = np.flatnonzero(filters.test(sent.value, keys))
            own = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in range(3)], pa.array((hit % BANDS).astype(np.int32)), pa.array(keys[hit].view(np.int64))], ["id", "k1", "n", "band", "key"])

    out = reps.select("node.id", "node.k1", "n", "keys").mapInArrow(work, f"id {kind}, k1 long, n long, band int, key long")
    return out.select(F.struct("id", "k1").alias("node"), "n", "band", "key")


def _left_small(shared: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of small buckets in different components, but for those with the bucket's leader."""
    some = shared.where(F.col("m").between(3, SMALL)).where(F.col("node") != F.col("lead")).select("key", "node")
    some = some.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    pairs = some.alias("l").join(some.alias("r"), "key").where("l.node < r.node and l.component <> r.component")
    return pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _met_by_node(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a node): a node's rows (one for each of BANDS keys at most) meet it together."""
    own = [c for c in rows.columns if c != "node"]
    each = rows.groupBy("node").agg(F.collect_list(F.struct(*own)).alias("_in")).join(table, "node", how)
    extra = [c for c in table.columns if c != "node"]
    return each.select("node", *extra, F.explode("_in").alias("_r")).select("node", *extra, *[F.col(f"_r.{c}").alias(c) for c in own])


def _close(shared: DataFrame, named: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame | None, Callable | None]:
    """Members of large buckets in different components whose signatures agree with one on the other side, in blocks; None if there are none.

    Every link that is left has an end outside the component of the bucket's leader; these others meet all members in blocks of bounded rows and
    shingles, each pair of blocks a group of its own, whatever the bucket's size. Blocks first compare signatures; only rows that agree with one of the other
    side get their sets and meet again (the function returned confirms them). A block gives one link for each other and component, which is all that the components need.
    """
    large = shared.where(F.col("m") > SMALL).select("node", "key", "band", "lead", F.col("n").alias("size"))
    rows = cut(_met_by_node(large, named, "left").withColumn("component", F.coalesce("component", "node")))
    mark = F.xxhash64("component")
    buckets = rows.groupBy("key").agg(F.count("*").alias("m"), F.max(F.when(F.col("node") == F.col("lead"), F.col("component"))).alias("main"), F.min(mark).alias("x"), F.max(mark).alias("y"))
    buckets = cut(buckets.where("x <> y").drop("x", "y"))
    marked = join_groups(rows.drop("lead"), buckets, ["key"], "m").withColumn("other", F.col("component") != F.col("main")).drop("m", "main")
    marked = cut(marked)
    release(rows, buckets)
    parts = lambda count, total: F.greatest(F.ceil(count / BLOCK), F.ceil(total / BLOCK_SHINGLES)).cast("int")
    o, some = F.col("other").cast("long"), F.when(F.col("other"), F.col("size")).otherwise(0)
    todo = cut(marked.groupBy("key").agg(F.count("*").alias("m"), parts(F.count("*"), F.sum("size")).alias("na"), parts(F.sum(o), F.sum(some)).alias("no")))
    short = F.concat(*[F.substring("keys", 8 * k + 1, 4) for k in range(BANDS)])
    met = _met_by_node(join_groups(marked, todo, ["key"], "m"), reps.select("node", short.alias("short"), *SIG), "inner")
    h = F.xxhash64("node", F.lit(3))
    place = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    every = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda j: place(0, F.pmod(h, "na"), j))
    other = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: place(1, i, F.pmod(h, "no")))
    each = met.withColumn("_p", F.explode(F.when(F.col("other"), F.concat(every, other)).otherwise(every))).withColumns({"row": F.xxhash64("node"), "comp": F.xxhash64("component")})
    each = each.select("key", "_p.i", "_p.j", "_p.side", "band", "row", "comp", F.col("size").alias("n"), "short", "node.id", "node.k1", *SIG)
    least = least_agreeing(percent / 100)
    kind = dict(reps.select("node.id").dtypes)["id"]
    names = ["key", "i", "j", "side", "band", "comp", "n", "short", "id", "k1", *SIG]
    keep = f"key long, i long, j long, side int, band int, comp long, n long, short binary, id {kind}, k1 long, {', '.join(f'{c} long' for c in SIG)}"

    def sides(table: pa.Table) -> tuple[dict, dict]:
        """The two sides of a block as columns, with the rows' places in the table."""
        side = table["side"].to_numpy()
        out = []
        for k in (0, 1):
            at = np.flatnonzero(side == k)
            own = table.take(pa.array(at))
            sig = np.stack([own[c].to_numpy() for c in SIG], 1).view(np.uint64)
            short = np.frombuffer(b"".join(own["short"].to_pylist()), np.uint32).reshape(-1, BANDS)
            out.append({"at": at, "sig": sig, "short": short, "n": own["n"].to_numpy(), "comp": own["comp"].to_numpy(), "rows": own})
        return tuple(out)

    def agreeing(left: dict, right: dict, band: int):
        """For each row of the right side the rows of the left that its signature allows. A pair meets in each band that it shares; only the first looks at it."""
        s, n, comps = left["sig"], left["n"], left["comp"]
        for k, (sig, c, m, own) in enumerate(zip(right["sig"], right["comp"], right["n"], right["short"])):
            x = s ^ sig
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_PAIRS_OF_BITS)).sum(1)
            ok = np.flatnonzero((differ <= ROWS * BANDS - least) & (comps != c) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            ok = ok[(left["short"][ok] == own).argmax(1) == band]
            if len(ok):
                yield k, ok

    def near(table: pa.Table) -> pa.Table:
        left, right = sides(table)
        hit = np.zeros(table.num_rows, bool)
        for k, ok in agreeing(left, right, table["band"][0].as_py()):
            hit[right["at"][k]] = True
            hit[left["at"][ok]] = True
        return table.filter(pa.array(hit)).select(names)

    def confirm(table: pa.Table) -> pa.Table:
        left, right = sides(table)
        out, n, comps = [], left["n"], left["comp"]
        sets, others = left["rows"]["x"], right["rows"]["x"]
        for k, ok in agreeing(left, right, table["band"][0].as_py()):
            x, met = others[k].values.to_numpy(), set()
            for q in ok.tolist():
                if comps[q] not in met:
                    both = len(np.intersect1d(x, sets[q].values.to_numpy(), assume_unique=True))
                    if 100 * both >= percent * (len(x) + n[q] - both):
                        met.add(comps[q])
                        out.append((q, k))
        a, b = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
        ends = (left["rows"].take(a), right["rows"].take(b))
        return pa.table([ends[0]["id"], ends[0]["k1"], ends[1]["id"], ends[1]["k1"]], names=["id", "k1", "id2", "k2"])

    close = cut(each.groupBy("key", "i", "j").applyInArrow(near, keep).withColumn("node", F.struct("id", "k1")))
    release(marked, todo)
    if close.isEmpty():
        return None, None

    def confirmed(sets: DataFrame) -> DataFrame:
        found = close.join(sets, "node").drop("node").groupBy("key", "i", "j").applyInArrow(confirm, f"id {kind}, k1 long, id2 {kind}, k2 long")
        out = cut(found.select(F.struct("id", "k1").alias("a"), F.struct(F.col("id2").alias("id"), F.col("k2").alias("k1")).alias("b")).distinct())
        release(close)
        return out

    return close, confirmed


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id reachable over links), kept (id is component_id), text_hash, first (the row that stays).

    Documents are linked if the Jaccard similarity of their sets of distinct ``size``-word shingles is ``percent`` / 100 or more.
    A null, empty or blank text has an empty set, is linked with nothing and stays. Ids are of any type that has an order. Rows that repeat an id are
    documents each; of rows that lead a group with the same id, ``first`` marks those of one text only. Rows with a null id are left out of links and
    stay alone, with a null component. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(signatures(docs, size, id_col, text_col))
    count = rows.count()
    node = F.struct("id", "k1")
    full = rows.where("n > 0 and id is not null")
    own = rows.where("n = 0 or id is null").select("id", "text_hash", "n", F.col("id").alias("component"), F.lit(True).alias("first"))
    marked = mark_repeated(full.withColumn("h", F.xxhash64("k1", "k2", "n")), "h", count).drop("h")
    once, some = marked.where("not repeated"), marked.where("repeated")
    alike = [F.first(c).alias(c) for c in ("keys", *SIG)]
    classes = cut(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.count("*").alias("members"), *alike).withColumn("node", node))
    kept = ["node", "n", "keys", *SIG]
    reps = cut(once.withColumn("node", node).select(*kept).unionByName(classes.select(*kept)))
    bands = cut(_bands(reps, count))
    buckets = cut(bands.groupBy("key").agg(F.count("*").alias("m"), F.min_by("node", F.xxhash64("node")).alias("lead")).where("m > 1"))
    shared = cut(join_groups(bands, buckets, ["key"], "m"))
    release(bands, buckets)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    star = shared.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    star = cut(_verified(star, reps, percent))
    sets = _sets(_ends(star), texts, size, count)
    links = _confirm(star, sets, percent)
    release(star, sets)
    comp = cut(components(links))
    named = comp.select(F.col("id").alias("node"), "component")
    small = cut(_verified(_left_small(shared, named), reps, percent))
    close, confirmed = _close(shared, named, reps, percent)
    left = [] if small.isEmpty() else [_ends(small)]
    left += [] if close is None else [close.select("node")]
    if left:
        sets = _sets(functools.reduce(DataFrame.unionByName, left), texts, size, count)
        more = _confirm(small, sets, percent)
        more = more if close is None else cut(more.unionByName(confirmed(sets)))
        release(sets)
        if not more.isEmpty():
            comp = cut(components(links.unionByName(more)))
            named = comp.select(F.col("id").alias("node"), "component")
    release(shared, reps, small)
    group = classes.select("k1", "k2", "n", "members", "node").join(named, "node", "left").select("k1", "k2", "n", "members", F.coalesce("component", "node").alias("component"), F.col("node").alias("rep"))
    group = cut(group)
    of_class = join_groups(some.select("id", "text_hash", "n", "k1", "k2"), group, ["k1", "k2", "n"], "members").withColumn("node", F.when(F.struct("id", "k1") == F.col("rep"), F.col("rep")))
    alone = once.select("id", "text_hash", "n", node.alias("node")).join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = of_class.select("id", "text_hash", "n", "component", "node").unionByName(alone.select("id", "text_hash", "n", "component", "node"))
    found = found.select("id", "text_hash", "n", F.col("component.id").alias("component"), F.coalesce(F.col("node") == F.col("component"), F.lit(False)).alias("first"))
    out = found.unionByName(own)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), "text_hash", "first")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that stay: of each group of linked documents the one with the least id."""
    mark = "_marlstone_hash"
    gone = near_dedup(docs, size, percent, id_col, text_col).where("not first").select(F.col(id_col), F.col("text_hash").alias(mark))
    rows = docs.withColumn(mark, text_hash(F.col(text_col).cast("string")))
    return drop_keys(rows, gone, [id_col, mark]).select(*docs.columns)
