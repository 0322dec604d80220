"""Collocations by prefix-free parsing: phrases are counted in a dictionary of distinct chunks, not in the texts.

A chunk begins where a hash of two neighbouring words says so, thus at the same words in every copy of a passage, and runs on over its end by so many words
that each phrase which begins in it is whole; a phrase counts in the chunk where it begins, so overlaps count once. Chunks group to a
dictionary with their frequencies by language, and the words of a distinct chunk are read once, weighed by its frequency.

Long phrases are counted only where both of their parts that are a word shorter are frequent: hashes of phrases are counted bucket by bucket, the frequent
ones set bits of a filter of bounded size, and the next length tests its parts there. Where the filter fills, more phrases are counted; none is missed. The
texts of what passes are counted exactly at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters
from .common import LOWER, P, cut, join_groups, mix, prefix_sums, release, span_hash, text_blocks, words

#: One word in PERIOD begins a chunk, about; a chunk has MOST words at most.
PERIOD, MOST = 24, 256
#: Bits of a filter's bucket; hashes and phrases that a task gathers before it passes them on.
BUCKET_BITS, GATHER = 1 << 15, 1 << 21
#: Ends of pieces, and all that stands between words.
BREAK = np.zeros(256, bool)
BREAK[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True
UNKNOWN = "und"


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings data[begin : begin + size], which may overlap."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _last_of_piece(new: np.ndarray) -> np.ndarray:
    """For each word the first word behind its piece; ``new`` marks the first words of pieces."""
    ends = np.append(np.flatnonzero(new)[1:], len(new))
    return ends[np.cumsum(new) - 1]


def chunks(data: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, words that begin in each, document of each) of a block of texts. Words of a piece are joined by blanks, pieces by line ends."""
    low = LOWER[data]
    starts, ends, doc = words(low, bounds, GAP)
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.cumsum(BREAK[low])[starts]
    other = np.diff(doc, prepend=-1) != 0
    new = other | (np.diff(breaks, prepend=-1) != 0)
    h = span_hash(prefix_sums(low), starts, ends)
    begin = other.copy()
    begin[1:] |= mix(h[:-1] * P + h[1:]) % np.uint64(PERIOD) == 0
    first = np.flatnonzero(begin)
    begin |= (np.arange(len(h)) - first[np.cumsum(begin) - 1]) % MOST == 0
    # one byte behind each word: a blank inside a piece, a line end after it
    size = ends - starts + 1
    place = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=place[1:])
    text = np.append(low, np.uint8(0))[np.repeat(starts - place[:-1], size) + np.arange(place[-1])]
    text[place[1:] - 1] = np.where(np.append(new[1:], True), 10, 32)
    i = np.flatnonzero(begin)
    e = np.append(i[1:], len(h))
    stop = np.maximum(e, np.minimum(_last_of_piece(new)[e - 1], e + longest - 1))
    return _slices(text, place[i], place[stop] - 1 - place[i]), e - i, doc[i]


def dictionary(docs: DataFrame, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, own, chunk, freq): the distinct chunks of all texts, how many words begin in each, and how often each occurs in a language."""

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                chunk, own, doc = chunks(data, bounds, longest)
                if len(chunk):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(own.astype(np.int32)), chunk], ["lang", "own", "chunk"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "lang string, own int, chunk binary").groupBy("lang", "own", "chunk").agg(F.count("*").alias("freq"))


class _Words:
    """The words of a batch of dictionary rows."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        names = batch.column(0).dictionary_encode()
        codes = names.indices.to_numpy()
        hashes = np.array([span_hash(prefix_sums(x), np.array([0]), np.array([len(x)]))[0] for x in (np.frombuffer(s.encode(), np.uint8) for s in names.dictionary.to_pylist())], np.uint64)
        _, _, self.data, bounds = next(text_blocks(batch, "chunk", 1 << 40))
        self.starts, self.ends, self.row = words(self.data, bounds, GAP)
        n = len(self.starts)
        place = np.arange(n) - np.searchsorted(self.row, self.row)  # of the word in its chunk
        self.counts = place < batch.column(1).to_numpy()[self.row]
        self.freq = batch.column(3).to_numpy()[self.row]
        new = place == 0
        if n:
            new |= np.where(self.starts > 0, self.data[np.maximum(self.starts - 1, 0)] == 10, True)
        self.room = _last_of_piece(new) - np.arange(n) if n else np.zeros(0, np.int64)
        self.h = span_hash(prefix_sums(self.data), self.starts, self.ends) ^ hashes[codes][self.row] if n else np.zeros(0, np.uint64)

    def grams(self, k: int, known: np.ndarray | None):
        """(hash of the phrase of k words at each word, whether it counts and its shorter parts may be frequent)."""
        g = mix(self.h + np.uint64(1))
        ok = self.counts & (self.room >= k)
        for j in range(1, k):
            if j == k - 1 and known is not None:
                may = filters.test(known, g) if len(g) else np.zeros(0, bool)
                ok = ok & may
                ok[:-1] &= may[1:]
            nxt = np.zeros_like(g)
            nxt[:-j] = mix(g[:-j] * P + self.h[j:])
            g = nxt
        return g, ok


def _counted(rows: DataFrame, k: int, known, buckets: int) -> DataFrame:
    """Packed counts of the hashes of phrases of k words."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def work(batches):
        held, size = [], 0

        def merged():
            h = np.concatenate([x for x, _ in held])
            own, code = np.unique(h, return_inverse=True)
            return own, np.bincount(code, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            w = _Words(batch)
            g, ok = w.grams(k, sent.value)
            if ok.any():
                held.append((g[ok], w.freq[ok]))
                size += int(ok.sum())
            if size > GATHER:
                held = [merged()]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield filters.pack(*held[0], buckets)
                    held, size = [], 0
        if held:
            yield filters.pack(*merged(), buckets)

    return rows.mapInArrow(work, filters.PACKED)


TEXTS = "lang string, bucket long, phrases binary, size long, counts binary"


def _pack_texts(rows: pa.Table, buckets: int) -> pa.RecordBatch:
    """One row for each language and bucket of phrases: their texts, a line each, and their counts, compressed."""
    rows = rows.combine_chunks()
    lang = rows["lang"].combine_chunks().dictionary_encode()
    texts = rows["phrase"].combine_chunks().cast(pa.binary())
    _, _, data, bounds = next(text_blocks(pa.RecordBatch.from_arrays([texts], ["phrase"]), "phrase", 1 << 40))
    bucket, _ = filters.place(span_hash(prefix_sums(data), bounds[:-1], bounds[1:]), buckets)
    key = lang.indices.to_numpy().astype(np.int64) * buckets + bucket
    order = np.argsort(key, kind="stable")
    key, lines, counts = key[order], texts.take(pa.array(order)).to_pylist(), rows["n"].to_numpy()[order].astype(np.uint64)
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    whole = [b"\n".join(lines[i:j]) for i, j in zip(cuts, [*cuts[1:], len(key)])]
    packed = [filters.squeeze(counts[i:j]) for i, j in zip(cuts, [*cuts[1:], len(key)])]
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(key[cuts] // buckets)),
            pa.array(key[cuts] % buckets),
            pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in whole], pa.binary()),
            pa.array([len(x) for x in whole], pa.int64()),
            pa.array(packed, pa.binary()),
        ],
        ["lang", "bucket", "phrases", "size", "counts"],
    )


def _texts(rows: DataFrame, longest: int, known: np.ndarray) -> DataFrame:
    """Rows of TEXTS: the phrases that pass the filter with their counts, summed in each task and packed by bucket."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    buckets = len(known)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            w = _Words(batch)
            for k in range(1, longest + 1):
                g, ok = w.grams(k, None)
                at = np.flatnonzero(ok)
                at = at[filters.test(sent.value, g[at])]
                if not len(at):
                    continue
                _, first, code = np.unique(g[at], return_index=True, return_inverse=True)
                i = at[first]
                phrase = _slices(w.data, w.starts[i], w.ends[i + k - 1] - w.starts[i]).cast(pa.string())
                n = np.bincount(code, weights=w.freq[at]).astype(np.int64)
                held.append(pa.table({"lang": batch.column(0).take(pa.array(w.row[i])), "phrase": phrase, "n": n}))
                size += len(i)
            if size > GATHER:
                held = [_summed(held)]
                size = held[0].num_rows
                if size > GATHER // 2:
                    yield _pack_texts(held[0], buckets)
                    held, size = [], 0
        if held:
            yield _pack_texts(_summed(held), buckets)

    return rows.mapInArrow(work, TEXTS)


def _unpacked(packed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of packed texts: exact sums of ``least`` and more."""

    def meet(table: pa.Table) -> pa.Table:
        parts = []
        for texts, size, counts in zip(table["phrases"].to_pylist(), table["size"].to_pylist(), table["counts"].to_pylist()):
            lines = pa.decompress(texts, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
            parts.append(pa.table({"phrase": pa.array(lines, pa.binary()), "f": filters.spread(counts, [np.uint64])[0].astype(np.int64)}))
        sums = pa.concat_tables(parts).group_by("phrase").aggregate([("f", "sum")])
        sums = sums.filter(pc.greater_equal(sums["f_sum"], least))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * sums.num_rows, pa.string()), "phrase": sums["phrase"].cast(pa.string()), "f": sums["f_sum"]})

    return packed.groupBy("lang", "bucket").applyInArrow(meet, "lang string, phrase string, f long")


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def frequent(rows: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """(lang, phrase, f): all phrases of 1 to ``longest`` words with f >= ``least`` in a dictionary; f is exact."""
    total = rows.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    buckets, _ = filters.shape(total)
    bits = max(8, min(BUCKET_BITS, filters.MAX_BITS // buckets))
    known = np.zeros((buckets, bits // 8), np.uint8)
    for k in range(1, longest + 1):
        # a count above 255 is kept as 255, so ``least`` beyond it makes the filter pass more
        new = filters.build(_counted(rows, k, known if k > 1 else None, buckets), buckets, bits, (min(least, 255),))[0]
        if not new.any():
            break
        known |= new
    return _unpacked(_texts(rows, longest, known), least)


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, inside: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words with a = f(phrase) >= ``least``.

    A-Z count as lower case. Phrases don't cross ``.,;:!?`` and line ends; words are what stands between blanks and tabs. The score of a
    cut after k words is floor(1000 a n / (l r)) with l and r the counts of its parts and n the language's words; the lowest counts, the first of equal ones.
    A phrase inside a longer one with at least ``inside`` percent of its count is left out. Ranks by score, then a, descending, then phrase by its bytes.
    A null text is empty, a null language is ``und`` (together with a language of that name); repeated rows count each; other columns are not
    looked at, whatever their names. An empty table gives no rows. Products are decimals of 38 digits.
    """
    rows = cut(dictionary(docs, longest, text_col, lang_col))
    totals = rows.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    found = cut(frequent(rows, least, longest).withColumn("w", F.split("phrase", " ")))
    long = found.where(F.size("w") >= 2)
    join = lambda i, k: F.array_join(F.slice("w", i, k), " ")
    cuts = cut(
        long.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    )
    whole = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    parts = cuts
    for side, name in (("first", "l"), ("rest", "r")):
        sizes = cuts.groupBy("lang", side).agg(F.count("*").alias("_size"))
        parts = cut(join_groups(parts, cut(sizes.join(whole(side, name), ["lang", side])), ["lang", side], "_size").drop("_size"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = (F.lit(1000) * big("a")).cast("decimal(19,0)") * big("n"), big("l") * big("r")
    scored = parts.join(totals, "lang").withColumns({"_over": over, "_under": under}).withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    spans = [(i, k) for k in range(2, longest) for i in range(1, longest - k + 2)]
    inner = F.filter(F.array(*[F.when((F.size("w") > k) & (F.size("w") >= i + k - 1), join(F.lit(i), F.lit(k))) for i, k in spans]), lambda x: x.isNotNull())
    held = found.where(F.size("w") >= 3).select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")) if spans else None
    if held is not None:
        held = held.groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
        best = best.join(held, ["lang", "phrase"], "left").where(F.col("_f").isNull() | (100 * F.col("_f") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = cut(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    release(rows, found, cuts)
    return out
