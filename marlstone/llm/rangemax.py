"""Ranked search by best-first document intervals over posting lists with range-maximum tables.

A task packs the postings of the queries' terms for some thousand documents into a block, documents ordered so that like ones stand together
(by their most frequent query term, then by length). In a block every posting list has a sparse table of its greatest impacts. For a query, the
sum of the lists' range maxima bounds the score of every document of an interval. Intervals wait by their bounds; one that is taken out is split
at the document where its strongest term has most, that document is scored exactly, and both sides get their own bounds. Intervals
whose bound is under the worst of the k best so far are dropped. The best go on from block to block inside a task; the tasks' best meet in a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, clean_texts, cut, prefix_sums, release, span_hash, text_blocks, words
from .filters import spread, squeeze

#: Documents of a block; bytes of query texts that go through the corpus together; cells of a table of ranks; most intervals split at once.
DOCS, QUERY_BYTES, RANKS, WIDTH = 8192, 4 << 20, 1 << 24, 1024
#: Bytes that stand between terms.
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False
NULL_ID = np.iinfo(np.int64).max

BLOCK = "docs long, words long, codes array<int>, df array<int>, ids binary, postings binary"


def term_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every term of a block of texts."""
    starts, ends, doc = words(data, bounds, BETWEEN)
    return span_hash(prefix_sums(LOWER[data]), starts, ends), doc


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def pack_blocks(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows of BLOCK: some thousand documents (ids, lengths) with their postings of ``terms`` (sorted hashes) by term and document, and the counts for the corpus' statistics."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def block(ids, n, doc, code, tf):
        # like documents stand together: by the term that they have most often, then by length
        lead = np.zeros(len(ids), np.int64)
        last = np.lexsort((-code, tf, doc))
        lead[doc[last]] = code[last]
        order = np.lexsort((ids, n, lead))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = place[doc]
        by = np.lexsort((doc, code))
        own, df = np.unique(code, return_counts=True)
        return {
            "docs": int((n > 0).sum()),
            "words": int(n.sum()),
            "codes": own.astype(np.int32).tolist(),
            "df": df.astype(np.int32).tolist(),
            "ids": squeeze(ids[order].view(np.uint64), n[order].astype(np.uint64)),
            "postings": squeeze(code[by].astype(np.uint32), doc[by].astype(np.uint32), tf[by].astype(np.uint32)),
        }

    def work(batches):
        terms = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS):
                part = batch.slice(first, DOCS)
                ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                n, found = np.zeros(len(ids), np.int64), []
                for a, _, data, bounds in text_blocks(part, "text"):
                    h, doc = term_hashes(data, bounds)
                    n[a : a + len(bounds) - 1] += np.bincount(doc, minlength=len(bounds) - 1)
                    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                    hit = terms[at] == h
                    key, tf = np.unique((doc[hit] + a) * len(terms) + at[hit], return_counts=True)
                    found.append((key, tf))
                key, tf = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_pylist([block(ids, n, key // len(terms), key % len(terms), tf)], schema=SCHEMA)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, BLOCK)


SCHEMA = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("codes", pa.list_(pa.int32())), ("df", pa.list_(pa.int32())), ("ids", pa.binary()), ("postings", pa.binary())])


class Block:
    """Posting lists with a sparse table of the places of their greatest impacts."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        self.ids, self.code, self.doc, self.impact = ids, code, doc, impact
        longest = int(np.bincount(code).max()) if len(code) else 1
        level = np.arange(len(code), dtype=np.int32)
        levels = [level]
        for j in range(longest.bit_length() - 1):
            step = 1 << j
            nxt = level.copy()
            if len(level) > step:
                a, b = level[:-step], level[step:]
                nxt[:-step] = np.where(impact[b] > impact[a], b, a)
            levels.append(nxt)
            level = nxt
        self.table = np.stack(levels)
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1
        self.key = code.astype(np.int64) * (len(ids) + 1) + doc

    def rank(self, terms: np.ndarray):
        """A function (documents) -> place of the first posting at or behind each, for each term: terms x documents."""
        width = len(self.ids) + 1
        if len(terms) * width > RANKS:
            return lambda x: np.searchsorted(self.key, terms[:, None] * width + x[None, :])
        bounds = np.searchsorted(self.key, terms * width), np.searchsorted(self.key, (terms + 1) * width)
        has = np.zeros((len(terms), width), np.int32)
        for t, (a, b) in enumerate(zip(*bounds)):
            has[t, self.doc[a:b] + 1] = 1
        np.cumsum(has, axis=1, out=has)
        has += bounds[0][:, None].astype(np.int32)
        return lambda x: has[:, x]

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest impact of the postings [a, b), its place) elementwise; 0 for none."""
        size = b - a
        some = size > 0
        j = self.log[np.maximum(size, 0)]
        one = self.table[j, np.where(some, a, 0)]
        two = self.table[j, np.where(some, b - (1 << j), 0)]
        u, v = self.impact[one], self.impact[two]
        return np.where(some, np.maximum(u, v), 0), np.where(v > u, two, one)

    def search(self, terms: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best (scores, ids) of ``best`` and this block, and how many documents were scored. ``best`` is in order."""
        rank, scored, wide = None, 0, 4
        scores, ids = best
        lo, hi = np.zeros(1, np.int64), np.array([len(self.ids)], np.int64)
        width = len(self.ids) + 1
        top, at = self.maxima(np.searchsorted(self.key, terms * width), np.searchsorted(self.key, (terms + 1) * width))
        bound, split = np.array([top.sum()]), self.doc[at[top.argmax()]][None].astype(np.int64)
        while len(bound):
            least = scores[k - 1] if len(scores) >= k else 1
            keep = bound >= max(least, 1)
            lo, hi, bound, split = lo[keep], hi[keep], bound[keep], split[keep]
            if not len(bound):
                break
            rank = rank or self.rank(terms)
            if len(bound) > wide:
                order = np.argpartition(-bound, wide)
                now, later = order[:wide], order[wide:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            wide = min(WIDTH, wide * 2)
            x = split[now]
            a, b = rank(x), rank(x + 1)
            value = np.where(b > a, self.impact[np.minimum(a, len(self.impact) - 1)], 0).sum(0)
            scored += len(x)
            scores, ids = np.concatenate([scores, value]), np.concatenate([ids, self.ids[x]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            left, right = np.concatenate([lo[now], x + 1]), np.concatenate([x, hi[now]])
            open_ = right > left
            left, right = left[open_], right[open_]
            top, at = self.maxima(rank(left), rank(right))
            lead = at[top.argmax(0), np.arange(len(left))]
            lo, hi = np.concatenate([lo[later], left]), np.concatenate([hi[later], right])
            bound, split = np.concatenate([bound[later], top.sum(0)]), np.concatenate([split[later], self.doc[lead].astype(np.int64)])
        some = scores > 0
        return (scores[some], ids[some]), scored


def rank_blocks(blocks: DataFrame, queries: list[np.ndarray], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """(query int, id, score, scored) of each task's k best; scored is how many documents the task scored for the query."""
    sent = blocks.sparkSession.sparkContext.broadcast((queries, weights))

    def work(batches):
        queries, weights = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        scored = np.zeros(len(queries), np.int64)
        for batch in batches:
            for raw_ids, raw in zip(batch.column(0), batch.column(1)):
                ids, n = spread(raw_ids.as_py(), [np.uint64, np.uint64])
                code, doc, tf = (x.astype(np.int64) for x in spread(raw.as_py(), [np.uint32] * 3))
                if not len(code):
                    continue
                m = 10 + (90 * n.astype(np.int64) * docs) // length
                impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                block = Block(ids.view(np.int64), code, doc, impact)
                for q, terms in enumerate(queries):
                    if len(terms):
                        best[q], more = block.search(terms, k, best[q])
                        scored[q] += more
        size = [len(s) for s, _ in best]
        if sum(size):
            ids = np.concatenate([i for _, i in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), size), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(np.concatenate([s for s, _ in best])), pa.array(np.repeat(scored, size))],
                ["query", "id", "score", "scored"],
            )

    return blocks.select("ids", "postings").mapInArrow(work, "query int, id long, score long, scored long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): each item's k highest-scoring documents with a score above 0; equal scores by ascending id, rows without an id last.

    The score is the sum over the item's distinct terms (runs of ASCII letters and digits and of all other characters, A-Z lower-cased) of integer
    impacts w * (10^9 tf div (1000 tf + 8 m)). A document that is null or has no terms counts nowhere; items without terms have no rows.
    Rows that repeat are documents, or items, of their own. Other columns are not looked at. An empty table on either side gives no rows.
    Items go through the corpus in groups of about QUERY_BYTES of text, each group in two passes: packing postings, and search.
    Terms are told by 64 bits of hash.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, out = max(1, -(-size // QUERY_BYTES)), None
    for g in range(groups):
        part = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).toArrow().combine_chunks()
        hashes = [np.zeros(0, np.uint64)] * part.num_rows
        for batch in part.to_batches():
            for a, b, data, bounds in text_blocks(batch, "text"):
                h, item = term_hashes(data, bounds)
                for i in range(b - a):
                    hashes[a + i] = np.unique(h[item == i])
        terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        if not len(terms):
            continue
        blocks = cut(pack_blocks(docs, terms, id_col, text_col))
        n, length = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        if not n:
            release(blocks)
            continue
        counts = blocks.select(F.explode(F.arrays_zip("codes", "df")).alias("x")).groupBy("x.codes").agg(F.sum("x.df").alias("df")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        for code, df in zip(counts["codes"].to_pylist(), counts["df"].to_pylist()):
            weights[code] = weight(n, df)
        has = np.isin(np.arange(len(terms)), counts["codes"].to_numpy())
        queries = [(at := np.searchsorted(terms, h))[has[at]] for h in hashes]
        found = rank_blocks(blocks, queries, weights, n, length, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        release(blocks)
        names = spark.createDataFrame(pa.table({"query": pa.array(range(part.num_rows), pa.int32()), "item": part["item"]}))
        rows = best.join(F.broadcast(names), "query").select(F.col("item").cast(kind).alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    return out
