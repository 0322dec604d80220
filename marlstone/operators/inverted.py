"""An inverted index in files, and ranked search over it that skips blocks of documents by their highest possible scores.

Documents stand in shards of some thousand, cut by their number and by their tokens. A shard is made in one task without a shuffle and is one row: its terms (64 bits of hash, sorted), and for each
its documents (places in the shard) and counts. A search finds its terms in a shard by bisection; only numbers of terms ever move. In a shard, like documents stand together (by their most frequent token, then by length), in blocks; a
query's bound for a block is the sum of its terms' greatest impacts there. Blocks are scored whole, in order of their bounds, until no
block can hold one of the k best; the shards' best meet in a window. Scores of several signals with their weights are summed before the blocks are ranked, so a
fusion is pruned as one search is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import release, small_batches, spread, stored

K1, B = 1.5, 0.75
#: Documents of a shard and of a block; queries whose terms a pass over the index takes along.
SHARD, BLOCK, QUERIES = 8192, 16, 4096
#: Tokens of a shard, unless one document has more: what a task holds is bounded by them, not by how long documents are.
TOKENS = 1 << 18
#: Scores are compared to so many digits.
DIGITS = 9
#: From so many queries on, a shard is scored for many of them at once: for so many postings, or pairs of a query and a document, in a step.
MANY, STEP = 32, 1 << 19


@dataclass
class Index:
    """shards: shard, ids, lengths (int32), terms (uint64, sorted), pair (bool), n (int32, documents of each term), places and counts (int32, term by term), norms (float64, null until ``weigh``); terms: term, pair, df, shards."""

    shards: DataFrame
    terms: DataFrame
    count: int
    length: int
    grams: int

    @property
    def docs(self) -> DataFrame:
        return self.shards

    def release(self) -> None:
        release(self.shards, self.terms)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def hashed(words: list[str]) -> np.ndarray:
    """64 bits for each word."""
    from pandas.util import hash_array

    return hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64 bits for each pair of neighbours, by the hashes of both."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + ((right << np.uint64(23)) | (right >> np.uint64(41))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _invert(shard: int, ids: pa.Array, tokens: pa.Array, grams: int) -> pa.RecordBatch:
    """The shard's row, for rows of ids and token lists."""
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    # the most frequent token of each document, the first in the dictionary of equal ones
    key, count = np.unique(doc * max(1, len(words)) + code, return_counts=True)
    own, term = key // max(1, len(words)), key % max(1, len(words))
    last = np.lexsort((-term, count, own))
    lead = np.full(len(size), -1)
    lead[own[last]] = term[last]
    place = np.empty(len(size), np.int64)
    order = np.lexsort((size, lead))
    place[order] = np.arange(len(size))
    ids, size, doc = ids.take(pa.array(order)), size[order], place[doc]
    own = hashed(words.to_pylist())
    names, keys, docs = [own], [code], [doc]
    if grams > 1:
        same = np.diff(doc) == 0
        pair, inverse = np.unique(paired(own[code[:-1][same]], own[code[1:][same]]), return_inverse=True)
        names.append(pair)
        keys.append(inverse.astype(np.int64) + len(words))
        docs.append(doc[1:][same])
    names = np.concatenate(names)
    by = np.argsort(names, kind="stable")
    at = np.empty(len(names), np.int64)
    at[by] = np.arange(len(names))
    key, count = np.unique(at[np.concatenate(keys)] * max(1, len(size)) + np.concatenate(docs), return_counts=True)
    n = np.bincount(key // max(1, len(size)), minlength=len(names))
    cells = [names[by], by >= len(words), n.astype(np.int32), (key % max(1, len(size))).astype(np.int32), count.astype(np.int32)]
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (size.astype(np.int32), *cells)]
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([ids.to_pylist()], pa.list_(ids.type)), *blobs, pa.nulls(1, pa.binary())], COLUMNS)


COLUMNS = ["shard", "ids", "lengths", "terms", "pair", "n", "places", "counts", "norms"]


def build(docs: DataFrame, tokens: Column, id_col: str = "id", grams: int = 1, norms: bool = False) -> Index:
    """Index the documents' ``tokens`` (an array of strings), and pairs of neighbours too if ``grams`` is 2; ``norms`` adds the lengths of the TF-IDF vectors.

    Each text is read once. Rows without an id take no part; a null array is an empty text; ids that repeat are documents of their own.
    """
    rows = spread(docs).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), docs_tokens(tokens))  # spread first, then made
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[pa.RecordBatch] = []

        def shards(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            while held:
                whole = pa.Table.from_batches(held).combine_chunks()
                ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy())
                rows = min(SHARD, max(1, int(np.searchsorted(ends, TOKENS, side="right"))))
                if rows >= whole.num_rows and not last:
                    held = whole.to_batches()
                    break
                part = whole.slice(0, rows).to_batches()
                held = whole.slice(rows).to_batches()
                one = part[0] if len(part) == 1 else pa.Table.from_batches(part).combine_chunks().to_batches()[0]
                yield _invert((TaskContext.get().partitionId() << 24) + made, one.column(0), one.column(1), grams)
                made += 1

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from shards(False)
        yield from shards(True)

    blobs = ", ".join(f"{c} binary" for c in COLUMNS[2:])
    shards = stored(rows.mapInArrow(work, f"shard long, ids array<{kind}>, {blobs}"), "index", True)
    met = _listed(shards).groupBy("term", "pair").agg(F.sum("n").alias("df"), F.count("*").alias("shards"))
    terms = stored(met, "terms")
    sizes = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n
    index = Index(shards, terms, sizes, lists_length(shards), grams)
    return weigh(index) if norms else index


def docs_tokens(tokens: Column) -> Column:
    return tokens.cast("array<string>").alias("tokens")


def _listed(shards: DataFrame) -> DataFrame:
    """(shard, term, pair, n) of each shard's terms."""

    def work(batches):
        for batch in batches:
            for shard, terms, pair, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                term = np.frombuffer(terms, np.int64)
                arrays = [np.full(len(term), shard), term, np.frombuffer(pair, bool), np.frombuffer(n, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["shard", "term", "pair", "n"])

    return shards.select("shard", "terms", "pair", "n").mapInArrow(work, "shard long, term long, pair boolean, n int")


def lists_length(shards: DataFrame) -> int:
    """Tokens of all documents."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).sum())])], ["n"])

    return shards.select("lengths").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _weighed(index: Index, finish, schema: str) -> DataFrame:
    """``finish`` (the shard's row as a table, weight tf * (ln((1 + N) / (1 + df)) + 1) and place of each posting, its term, each document's norm) on every shard.

    A term of one shard has its count there; the counts of the others come to the shard by number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    count, out = index.count, to_arrow_schema(StructType.fromDDL(schema))
    wide = index.terms.where("shards > 1").select("term", "pair", "df")
    dealt = _listed(index.shards).join(wide, ["term", "pair"]).select("shard", "term", "pair", "df")

    def work(one: pa.Table, more: pa.Table) -> pa.Table:
        if not one.num_rows:
            return out.empty_table()
        term, pair, n, place, tf = (np.frombuffer(one[c][0].as_py(), t) for c, t in zip(COLUMNS[3:8], (np.uint64, bool, np.int32, np.int32, np.int32)))
        df = n.astype(np.int64)
        for kind in (False, True):  # a word and a pair may share a number
            own = np.flatnonzero(pair == kind)
            some = more.filter(pc.equal(more["pair"], kind))
            df[own[np.searchsorted(term[own], some["term"].to_numpy().view(np.uint64))]] = some["df"].to_numpy()
        w = tf * np.repeat(np.log((1 + count) / (1 + df)) + 1, n)
        size = len(one["lengths"][0].as_py()) // 4
        norm = np.sqrt(np.bincount(place, weights=w * w, minlength=size))
        return finish(one, w, place, np.repeat(term, n), norm).cast(out)

    return index.shards.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(work, schema)


def weigh(index: Index) -> Index:
    """The index with ``norms``: the length of each document's vector of tf * (ln((1 + N) / (1 + df)) + 1)."""
    blobs = ", ".join(f"{c} binary" for c in COLUMNS[2:])
    schema = f"shard long, ids {dict(index.shards.dtypes)['ids']}, {blobs}"

    def finish(one, w, place, term, norm):
        return one.select(COLUMNS[:8]).append_column("norms", pa.array([norm.tobytes()], pa.binary()))

    shards = stored(_weighed(index, finish, schema), "weighed", True)
    release(index.shards)
    return Index(shards, index.terms, index.count, index.length, index.grams)


def vectors(index: Index) -> DataFrame:
    """(id, terms, weights): each document's TF-IDF vector of length 1, terms as ``hashed`` and ``paired`` number them, in their order; documents without tokens have no row."""
    kind = dict(index.shards.dtypes)["ids"][len("array<") : -1]

    def finish(one, w, place, term, norm):
        by = np.argsort(place, kind="stable")
        size = np.bincount(place, minlength=len(norm))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (term[by].view(np.int64), (w / norm[place])[by])]
        return pa.table({"id": one["ids"].combine_chunks().flatten(), "terms": lists[0], "weights": lists[1]}).filter(pa.array(size > 0))

    return _weighed(index, finish, f"id {kind}, terms array<long>, weights array<double>")


class Shard:
    """A shard's documents and the posting lists of the terms of a group of queries, with the greatest impact of each list in each block."""

    def __init__(self, size: int, lists: dict[int, tuple[np.ndarray, np.ndarray]], impacts: dict[str, dict[int, np.ndarray]], rank: np.ndarray | None = None):
        """rank: the order of the documents' ids, by which ties are told; their places if it is None."""
        self.size, self.places, self.impacts = size, {t: p for t, (p, _) in lists.items()}, impacts
        self.rank = np.arange(size) if rank is None else rank
        self.blocks = -(-size // BLOCK)
        edges = np.arange(self.blocks + 1) * BLOCK
        self.cuts = {t: np.searchsorted(p, edges) for t, p in self.places.items()}
        self.tops: dict[tuple[str, int], np.ndarray] = {}

    def top(self, signal: str, term: int) -> np.ndarray:
        """Greatest impact in each block, 0 for none."""
        found = self.tops.get((signal, term))
        if found is None:
            found = np.zeros(self.blocks)
            cuts = self.cuts[term]
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            found[some] = np.maximum.reduceat(self.impacts[signal][term], cuts[some])
            self.tops[signal, term] = found
        return found

    def all(self, parts: list[tuple[str, int, float]]) -> tuple[np.ndarray, np.ndarray]:
        """(places of the documents that have a term, their scores)."""
        place = np.concatenate([self.places[t] for _, t, _ in parts])
        value = np.concatenate([w * self.impacts[s][t] for s, t, w in parts])
        score = np.bincount(place, weights=value, minlength=self.size)
        has = np.zeros(self.size, bool)
        has[place] = True
        at = np.flatnonzero(has)
        return at, score[at]

    def best(self, parts: list[tuple[str, int, float]], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, postings read) of the k highest scores; equal ones (to DIGITS) in order of id."""
        bound, some = np.zeros(self.blocks), np.zeros(self.blocks, bool)
        for s, t, w in parts:
            bound += w * self.top(s, t)
            some |= self.cuts[t][1:] > self.cuts[t][:-1]
        order = np.argsort(-bound, kind="stable")
        order = order[some[order]]
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step, read = 0, 2, 0
        while at < len(order):
            if len(places) == k and np.round(bound[order[at]], DIGITS) < np.round(scores[-1], DIGITS) - 2 * 10.0**-DIGITS:
                break
            now = np.sort(order[at : at + step])
            at, step = at + step, step * 2
            place, value = [], []
            for s, t, w in parts:
                cuts = self.cuts[t]
                rows = _ranges(cuts[now], cuts[now + 1] - cuts[now])
                place.append(self.places[t][rows])
                value.append(w * self.impacts[s][t][rows])
            place = np.concatenate(place)
            read += len(place)
            own, inverse = np.unique(place, return_inverse=True)
            score = np.bincount(inverse, weights=np.concatenate(value), minlength=len(own))
            places, scores = np.concatenate([places, own]), np.concatenate([scores, score])
            best = np.lexsort((self.rank[places], -np.round(scores, DIGITS)))[:k]
            places, scores = places[best], scores[best]
        return places, scores, read


class Flat:
    """A shard's documents and the posting lists of the terms of a group of queries, end to end, to be scored whole for many queries."""

    def __init__(self, size: int, at: np.ndarray, begin: np.ndarray, n: np.ndarray, places: np.ndarray, impacts: list[np.ndarray]):
        """at: the list of each of the group's terms, -1 for none; impacts: one array for each signal."""
        self.size, self.at, self.begin, self.n, self.all = size, at, begin, n, len(places)
        self.places, self.impacts = np.tile(places, len(impacts)), np.concatenate(impacts)

    def steps(self, parts: "_Parts", queries: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first query, the one after the last, their scores of all documents, postings of each), some queries at a time; documents without a term have 0."""
        lists = self.at[parts.term]
        some = np.flatnonzero(lists >= 0)
        q, begin, n, w = parts.query[some], self.begin[lists[some]] + parts.signal[some] * self.all, self.n[lists[some]], parts.weight[some]
        total = np.bincount(q, weights=n, minlength=queries).astype(np.int64)
        ends, a, rows = np.cumsum(total), 0, max(1, STEP // max(1, self.size))
        while a < queries:
            b = max(a + 1, min(queries, a + rows, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, side="right"))))
            own = slice(*np.searchsorted(q, (a, b)))
            if own.start < own.stop:
                at = _ranges(begin[own], n[own])
                key = np.repeat((q[own] - a) * self.size, n[own]) + self.places[at]
                score = np.bincount(key, weights=np.repeat(w[own], n[own]) * self.impacts[at], minlength=(b - a) * self.size)
                yield a, b, score.reshape(b - a, self.size), total[a:b]
            a = b


@dataclass
class _Parts:
    """What terms count in which queries, in order of the queries: all weights are over 0."""

    query: np.ndarray
    signal: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def _even(parts: dict[str, list], weights: list[tuple[str, np.ndarray | None]]) -> tuple[_Parts, list[int]]:
    """The terms of all queries whose terms all count more than 0 in a signal and less in none; the other queries."""
    rows, odd = [], []
    for q in range(len(next(iter(parts.values()), []))):
        own = [(q, i, t, w * (1.0 if c is None else float(c[q]))) for i, (s, c) in enumerate(weights) for t, w in parts[s][q]]
        some = [x for x in own if x[3] > 0]
        if {x[2] for x in some} == {x[2] for x in own} and all(x[3] >= 0 for x in own):
            rows += some
        else:
            odd.append(q)
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return _Parts(*(np.array(c, t) for c, t in zip(cols, (np.int64, np.int64, np.int64, float)))), odd


@dataclass
class _Group:
    """Some queries, their terms and the weights of the terms in each signal."""

    queries: list
    terms: np.ndarray  # numbers of the terms, as the shards have them
    pair: np.ndarray
    df: np.ndarray
    parts: dict[str, list[list[tuple[int, float]]]]  # signal -> for each query (term, weight)


def _groups(index: Index, queries: DataFrame, tokens: Column, signals: tuple[str, ...]) -> Iterator[_Group]:
    """The queries, QUERIES or so at a time, on the driver: their number there is bounded, whatever the table's."""
    groups = max(1, -(-queries.count() // QUERIES))
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        asked: dict[tuple, int] = {}  # query, word or pair, different words of the query -> times
        for q, words in zip(*part.select("query_id", docs_tokens(tokens)).toArrow().to_pydict().values()):
            for t in [(w,) for w in words or ()] + (list(zip(words, words[1:])) if words and index.grams > 1 else []):
                at = q, t, len(set(words))
                asked[at] = asked.get(at, 0) + 1
        words = sorted({w for _, t, _ in asked for w in t})
        code = dict(zip(words, hashed(words).tolist()))
        pairs = sorted({t for _, t, _ in asked if len(t) > 1})
        both = paired(*(np.array([code[t[k]] for t in pairs], np.uint64) for k in (0, 1))).tolist()
        number = {(w,): c for w, c in code.items()} | dict(zip(pairs, both))
        wanted = sorted({(c, len(t) > 1) for t, c in number.items()})
        if not wanted:
            continue
        sent = pa.table({"term": pa.array(np.array([c for c, _ in wanted], np.uint64).view(np.int64)), "pair": pa.array([p for _, p in wanted])})
        sent = index.terms.sparkSession.createDataFrame(sent)
        found = index.terms.join(F.broadcast(sent) if len(wanted) <= 1_000_000 else sent, ["term", "pair"]).select("term", "pair", "df").toArrow()
        rows = sorted(zip(found["term"].to_numpy().view(np.uint64).tolist(), found["pair"].to_pylist(), found["df"].to_pylist()))
        if not rows:
            continue
        known = {(c, p): i for i, (c, p, _) in enumerate(rows)}
        df = np.array([n for _, _, n in rows], float)
        met = {at: times for at, times in asked.items() if (number[at[1]], len(at[1]) > 1) in known}
        names = sorted({q for q, _, _ in met})
        own: list[list] = [[] for _ in names]
        at = {q: i for i, q in enumerate(names)}
        for (q, t, distinct), qtf in sorted(met.items(), key=lambda x: (x[0][0], x[0][1])):
            own[at[q]].append((known[number[t], len(t) > 1], qtf, distinct, len(t) > 1))
        parts: dict[str, list] = {}
        for s in signals:
            if s == "bm25":
                raw = np.log(index.count - df + 0.5) - np.log(df + 0.5)
                idf = np.where(raw < 0, 0.25 * mean_idf(index), raw)
                parts[s] = [[(t, qtf * idf[t]) for t, qtf, _, pair in rows if not pair] for rows in own]
            elif s == "overlap":
                parts[s] = [[(t, 1.0 / distinct) for t, _, distinct, pair in rows if not pair] for rows in own]
            elif s == "tfidf":
                idf = np.log((1 + index.count) / (1 + df)) + 1
                size = [max(1e-300, float(np.sqrt(sum((qtf * idf[t]) ** 2 for t, qtf, _, _ in rows)))) for rows in own]
                parts[s] = [[(t, qtf * idf[t] * idf[t] / z) for t, qtf, _, _ in rows] for rows, z in zip(own, size)]
            else:
                raise ValueError(f"unknown signal {s}")
        yield _Group(names, np.array([c for c, _, _ in rows], np.uint64), np.array([p for _, p, _ in rows]), df, parts)


def mean_idf(index: Index) -> float:
    """Mean of ln(N - df + .5) - ln(df + .5) over all terms of one token."""
    raw = F.log(F.lit(index.count) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return index.terms.where("not pair").agg(F.avg(raw)).first()[0] or 0.0


def _impact(signal: str, tf: np.ndarray, length: np.ndarray, norm: np.ndarray, average: float) -> np.ndarray:
    """What postings count in a signal, by their counts and their documents' lengths and norms."""
    if signal == "bm25":
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    return np.ones(len(tf)) if signal == "overlap" else tf / norm


def _met(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, kinds: np.ndarray) -> Iterator[tuple]:
    """(shard, ids, lengths, norms, n, ends, places, counts, asked, lists) of each shard that has some of the terms: lists are the numbers of those of ``asked``."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row] for c in batch.schema.names}
            term, pair, n, places, counts = (np.frombuffer(one[c].as_buffer(), t) for c, t in zip(COLUMNS[3:8], (np.uint64, bool, np.int32, np.int32, np.int32)))
            length = np.frombuffer(one["lengths"].as_buffer(), np.int32)
            norm = np.frombuffer(one["norms"].as_buffer(), np.float64) if one["norms"].is_valid else np.ones(len(length))
            found = [], []
            for kind in (False, True):
                own, asked = np.flatnonzero(pair == kind), np.flatnonzero(kinds == kind)
                if not len(own) or not len(asked):
                    continue
                at = np.minimum(np.searchsorted(term[own], wanted[asked]), len(own) - 1)
                has = term[own[at]] == wanted[asked]
                found[0].append(asked[has])
                found[1].append(own[at[has]])
            if sum(map(len, found[0])):
                yield one["shard"].as_py(), one["ids"].values, length, norm, n, np.cumsum(n, dtype=np.int64), places, counts, np.concatenate(found[0]), np.concatenate(found[1])


def _over_shards(index: Index, group: _Group, work, schema: str) -> DataFrame:
    """``work`` (shard number, ids, Shard) on every shard that has a term of the group."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted, kinds, signals = group.terms, group.pair, tuple(group.parts)
    average, out = index.length / max(1, index.count), to_arrow_schema(StructType.fromDDL(schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, length, norm, n, ends, places, counts, asked, own in _met(batches, wanted, kinds):
            lists, impacts = {}, {s: {} for s in signals}
            for t, k in zip(asked.tolist(), own.tolist()):
                place, tf = places[ends[k] - n[k] : ends[k]], counts[ends[k] - n[k] : ends[k]]
                lists[t] = (place, tf)
                for s in signals:
                    impacts[s][t] = _impact(s, tf, length[place], norm[place], average)
            rank = np.empty(len(length), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(length))
            yield from work(shard, ids, Shard(len(length), lists, impacts, rank)).cast(out).to_batches()

    return index.shards.mapInArrow(meet, schema)


def _over_flat(index: Index, group: _Group, signals: tuple[str, ...], begin, schema: str) -> DataFrame:
    """A task's rows: ``begin`` gives two functions, one for each of its shards (ids, Flat), and one for the table at its end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted, kinds = group.terms, group.pair
    average, out = index.length / max(1, index.count), to_arrow_schema(StructType.fromDDL(schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, end = begin()
        for _, ids, length, norm, n, ends, places, counts, asked, own in _met(batches, wanted, kinds):
            rows = _ranges(ends[own] - n[own], n[own])
            place, tf = places[rows].astype(np.int64), counts[rows]
            at = np.full(len(wanted), -1)
            at[asked] = np.arange(len(asked))
            size = n[own].astype(np.int64)
            impacts = [_impact(s, tf, length[place], norm[place], average) for s in signals]
            work(ids, Flat(len(length), at, np.cumsum(size) - size, size, place, impacts))
        last = end()
        if last is not None and last.num_rows:
            yield from last.cast(out).to_batches(1 << 16)

    return index.shards.mapInArrow(meet, schema)


def search(index: Index, queries: DataFrame, tokens: Column, k: int | None, signal: str = "bm25", tier: Column | None = None) -> DataFrame:
    """(query_id, id, score, read, postings): the k best documents of each query; all that share a term with it where k is None.

    ``tier``, an expression over ``id``, keeps the k best of each of its values. read and postings: what the document's shard read for
    the query, and what it has. queries: query_id and what ``tokens`` reads; query ids that repeat are one query.
    """
    return _union([_search(index, g, [(signal, None)], k, tier) for g in _groups(index, queries, tokens, (signal,))], index, queries)


def _union(tables: list[DataFrame], index: Index, queries: DataFrame) -> DataFrame:
    if not tables:
        return queries.sparkSession.createDataFrame([], _schema(index, queries))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _schema(index: Index, queries: DataFrame) -> str:
    kind = dict(index.shards.dtypes)["ids"][len("array<") : -1]
    return f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double, read long, postings long"


def _search(index: Index, group: _Group, weights: list[tuple[str, np.ndarray | None]], k: int | None, tier: Column | None = None, offset: np.ndarray | None = None) -> DataFrame:
    """One pass over the index for a group. weights: what each signal counts in each query; offset: what every document of a query gets besides."""
    spark = index.shards.sparkSession
    kind = dict(index.shards.dtypes)["ids"][len("array<") : -1]
    named = spark.createDataFrame(pa.table({"q": pa.array(range(len(group.queries)), pa.int32()), "query_id": pa.array(group.queries)}))
    parts = group.parts
    keep = None if tier is not None else k
    each = list(range(len(group.queries)))
    many = None
    if keep is not None and len(each) >= MANY:
        even, each = _even(parts, weights)
        many = _over_flat(index, group, tuple(s for s, _ in weights), _best_of(even, len(group.queries), keep, offset), f"q int, id {kind}, score double, read long, postings long")

    def work(shard: int, ids: pa.Array, own: Shard) -> pa.Table:
        which, place, score, read, total = [], [], [], [], []
        for q in each:
            some = [(s, t, w * (1.0 if c is None else float(c[q]))) for s, c in weights for t, w in parts[s][q] if t in own.places]
            some = [x for x in some if x[2] != 0] or some
            if not some:
                continue
            everything = sum(len(own.places[t]) for _, t, _ in some)
            if keep is None or any(w < 0 for _, _, w in some):
                at, value = own.all(some)
                seen = everything
                if keep is not None:
                    first = np.lexsort((own.rank[at], -np.round(value, DIGITS)))[:keep]
                    at, value = at[first], value[first]
            else:
                at, value, seen = own.best(some, keep)
            which.append(np.full(len(at), q, np.int32))
            place.append(at)
            score.append(value if offset is None else value + offset[q])
            read.append(np.full(len(at), seen))
            total.append(np.full(len(at), everything))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        return pa.table({"q": cat(which, np.int32), "id": ids.take(pa.array(cat(place, np.int64))), "score": cat(score, float), "read": cat(read, np.int64), "postings": cat(total, np.int64)})

    rows = many if many is not None and not each else _over_shards(index, group, work, f"q int, id {kind}, score double, read long, postings long")
    if many is not None and each:
        rows = rows.unionByName(many)
    if k is not None:
        keys = ["q"]
        if tier is not None:
            rows, keys = rows.withColumn("tier", tier), ["q", "tier"]
        order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", DIGITS)), "id")
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return rows.join(F.broadcast(named), "q").select("query_id", "id", "score", "read", "postings")


def _best_of(parts: _Parts, queries: int, k: int, offset: np.ndarray | None):
    """For ``_over_flat``: a task's k best documents of each query."""

    def begin():
        held: list[pa.Table] = []
        floor = np.full(queries, -np.inf)

        def cut() -> None:
            rows = pa.concat_tables(held).combine_chunks()
            q, score = rows["q"].to_numpy(), np.round(rows["score"].to_numpy(), DIGITS)
            rank = np.empty(len(q), np.int64)
            rank[pc.sort_indices(rows["id"]).to_numpy()] = np.arange(len(q))
            order = np.lexsort((rank, -score, q))
            own = q[order]
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            order, last = order[nth < k], order[nth == k - 1]
            floor[q[last]] = score[last]
            held[:] = [rows.take(pa.array(order))]

        def work(ids: pa.Array, shard: Flat) -> None:
            which, place, score, total = [], [], [], []
            for a, b, found, postings in shard.steps(parts, queries):
                low = floor[a:b] - (0.0 if offset is None else offset[a:b])
                if shard.size > k:
                    low = np.maximum(low, np.partition(found, shard.size - k, axis=1)[:, shard.size - k])
                q, at = np.nonzero((found > 0) & (found >= (low - 2 * 10.0**-DIGITS)[:, None]))
                which.append(q + a)
                place.append(at)
                score.append(found[q, at])
                total.append(postings[q])
            if not which:
                return
            q, score, total = np.concatenate(which), np.concatenate(score), np.concatenate(total)
            score = score if offset is None else score + offset[q]
            held.append(pa.table({"q": q.astype(np.int32), "id": ids.take(pa.array(np.concatenate(place))), "score": score, "read": total, "postings": total}))
            cut()

        return work, lambda: held[0] if held else None

    return begin


def _span_of(parts: dict[str, tuple[_Parts, list[int]]], queries: int):
    """For ``_over_flat``: a task's ``spans``; no row for the queries that ``parts`` leaves to them."""

    def begin():
        high, low, docs = ({s: np.full(queries, x) for s in parts} for x in (-np.inf, np.inf, 0))

        def work(ids: pa.Array, shard: Flat) -> None:
            for s, (own, _) in parts.items():
                for a, b, found, _ in shard.steps(own, queries):
                    has = found > 0
                    high[s][a:b] = np.maximum(high[s][a:b], np.where(has, found, -np.inf).max(1))
                    low[s][a:b] = np.minimum(low[s][a:b], np.where(has, found, np.inf).min(1))
                    docs[s][a:b] += has.sum(1)

        def end() -> pa.Table:
            tables = []
            for s in parts:
                q = np.flatnonzero(docs[s])
                tables.append(pa.table({"q": q.astype(np.int32), "signal": pa.array([s] * len(q), pa.string()), "high": high[s][q], "low": low[s][q], "docs": docs[s][q]}))
            return pa.concat_tables(tables)

        return work, end

    return begin


def spans(index: Index, group: _Group) -> DataFrame:
    """(q, signal, high, low, some): greatest score of each query and signal, the least (0 where a document has no term of the query), and the least among those that have one."""
    parts = group.parts
    total, schema = index.count, "q int, signal string, high double, low double, docs long"
    left, many = {s: range(len(group.queries)) for s in parts}, None
    if len(group.queries) >= MANY:
        even = {s: _even({s: parts[s]}, [(s, None)]) for s in parts}
        for i, (own, _) in enumerate(even.values()):
            own.signal[:] = i
        left = {s: odd for s, (_, odd) in even.items()}
        many = _over_flat(index, group, tuple(parts), _span_of(even, len(group.queries)), schema)

    def work(shard: int, ids: pa.Array, own: Shard) -> pa.Table:
        out = {"q": [], "signal": [], "high": [], "low": [], "docs": []}
        for s, queries in parts.items():
            for q in left[s]:
                terms = queries[q]
                some = [(s, t, w) for t, w in terms if t in own.places]
                if not some:
                    continue
                at, value = own.all(some)
                for c, v in zip(out, (q, s, float(value.max()), float(value.min()), len(at))):
                    out[c].append(v)
        return pa.table({"q": pa.array(out["q"], pa.int32()), "signal": pa.array(out["signal"], pa.string()), "high": pa.array(out["high"], pa.float64()), "low": pa.array(out["low"], pa.float64()), "docs": pa.array(out["docs"], pa.int64())})

    found = many
    if any(map(len, left.values())):
        rows = _over_shards(index, group, work, schema)
        found = rows if many is None else many.unionByName(rows)
    low = F.when(F.sum("docs") < total, F.least(F.lit(0.0), F.min("low"))).otherwise(F.min("low"))
    return found.groupBy("q", "signal").agg(F.max("high").alias("high"), low.alias("low"))


def ranges(index: Index, queries: DataFrame, tokens: Column, signals: tuple[str, ...]) -> DataFrame:
    """(query_id, signal, high, low) of each query that shares a term with a document."""
    spark, out = queries.sparkSession, None
    for group in _groups(index, queries, tokens, signals):
        named = spark.createDataFrame(pa.table({"q": pa.array(range(len(group.queries)), pa.int32()), "query_id": pa.array(group.queries)}))
        rows = spans(index, group).join(F.broadcast(named), "q").select("query_id", "signal", "high", "low")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, signal string, high double, low double") if out is None else out


def fused(index: Index, queries: DataFrame, tokens: Column, k: int | None, weights: dict[str, float], tier: Column | None = None) -> DataFrame:
    """(query_id, id, score, read, postings): the k best (of each ``tier``) by the weighted mean of the signals, each between its least and greatest score in the query.

    A first pass over the terms' postings finds each signal's range; the second one ranks by one weighted sum, pruned as a single signal is. A signal that
    ranges over less than 1e-9 counts 1 if it is positive. Documents that share no term with a query have no row.
    """
    tables = []
    for group in _groups(index, queries, tokens, tuple(weights)):
        scale, offset = _scales(index, group, weights)
        tables.append(_search(index, group, [(s, scale[s]) for s in weights], k, tier, offset))
    return _union(tables, index, queries)


def _scales(index: Index, group: _Group, weights: dict[str, float]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What each signal counts in each query of the group, and what every document of a query gets besides."""
    total, shape = sum(weights.values()), (len(group.queries),)
    scale, offset = {s: np.zeros(shape) for s in weights}, np.zeros(shape)
    with small_batches(index.shards.sparkSession):
        found = spans(index, group).collect()  # a row for each query of the group and signal
    for r in found:
        w = weights[r.signal] / total
        if r.high - r.low >= 1e-9:
            scale[r.signal][r.q] = w / (r.high - r.low)
            offset[r.q] -= w * r.low / (r.high - r.low)
        elif r.high > 0:
            offset[r.q] += w
    return scale, offset


def fused_vectors(index: Index, queries: DataFrame, tokens: Column, weights: dict[str, float], names: list) -> DataFrame:
    """(id, scores): one row for each document that shares a term with a query, its ``fused`` scores as float64 bytes, one for each query id of ``names``; NaN where no term is shared.

    For QUERIES queries at most: what reads all scores of a document gets one row, not one for each query.
    """
    kind = dict(index.shards.dtypes)["ids"][len("array<") : -1]
    schema, at = f"id {kind}, scores binary", {n: i for i, n in enumerate(names)}
    groups = list(_groups(index, queries, tokens, tuple(weights)))
    if len(groups) > 1:
        raise ValueError(f"more than {QUERIES} queries")
    if not groups:
        return queries.sparkSession.createDataFrame([], schema)
    group = groups[0]
    scale, offset = _scales(index, group, weights)
    parts, column = group.parts, [at[q] for q in group.queries]

    def work(shard: int, ids: pa.Array, own: Shard) -> pa.Table:
        value = np.full((own.size, len(at)), np.nan)
        for q, c in enumerate(column):
            some = [(s, t, w * float(scale[s][q])) for s in parts for t, w in parts[s][q] if t in own.places]
            if some:
                place, score = own.all(some)
                value[place, c] = score + offset[q]
        has = np.flatnonzero(~np.isnan(value).all(1))
        return pa.table({"id": ids.take(pa.array(has)), "scores": pa.array([value[i].tobytes() for i in has], pa.binary())})

    return _over_shards(index, group, work, schema)


def reading(found: DataFrame) -> DataFrame:
    """(read, postings, share) of a search's rows: postings that were scored, of those that the shards with a hit have."""
    one = found.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))
    return one.agg(F.sum("read").alias("read"), F.sum("postings").alias("postings")).withColumn("share", F.col("read") / F.col("postings"))
