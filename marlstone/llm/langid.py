"""Language identification by interpolated Kneser-Ney character models, one per language.

Four-grams of lower-case letters (all else is one blank) are counted per language over all training documents, and all are kept: the model
grows with the distinct four-grams of the corpus (far slower than the corpus). Discounts are estimated for each order and language from its counts of counts.
The probabilities stand in sorted arrays of n-gram keys; a text belongs to the language with the lowest
cross-entropy per character, and is rejected if that is above nearly all that the language's own documents have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, text_blocks

ORDER = 4
BITS = np.uint64(16)
#: Discount of an order in which no count is 1 or none is 2; otherwise n1 / (n1 + 2 n2) within these bounds.
DISCOUNT, LEAST_DISCOUNT, MOST_DISCOUNT = 0.75, 0.1, 0.95
#: The share of a language's own training documents that may be rejected; and nats on top, since the model has seen these documents.
REJECTED = 0.005
SLACK = 0.25
UNSEEN = "und"
BLANK = 32
#: Symbols of letters past the first plane.
ABOVE, SHARED = 0xD800, 0xF900 - 0xD800


class _Letters:
    """Code point to symbol: lower-case letters stand for themselves, those past 16 bits share the codes from 0xD800 to 0xF8FF, which no letter has; all else is a blank."""

    table = np.full(0x110000, 0, np.uint16)

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table[BLANK] == 0:
            cls.table[:] = BLANK
            for c in range(0x110000):
                if (0xD800 <= c < 0xE000) or not (ch := chr(c)).isalpha():
                    continue
                low = ch.lower()
                cls.table[c] = ABOVE + ord(low[0]) % SHARED if ord(low[0]) > 0xFFFF else ord(low[0])
        return cls.table


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four-gram keys, document, letters in each document); a document begins after three blanks, runs of blanks count as one."""
    if not len(data):
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), np.zeros(len(bounds) - 1, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    doc = np.searchsorted(bounds, lead, side="right") - 1
    if len(points) != len(doc):  # bytes that are no UTF-8: each document by itself
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    sym = _Letters.get()[points].astype(np.uint64)
    letters = np.bincount(doc[sym != BLANK], minlength=len(bounds) - 1)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != BLANK) | (sym[:-1] != BLANK) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep], doc[keep]
    key = sym.copy()
    for k in range(1, ORDER):
        before = np.full(len(sym), BLANK, np.uint64)
        before[k:] = np.where(doc[k:] == doc[:-k], sym[:-k], np.uint64(BLANK))
        key |= before << (BITS * np.uint64(k))
    return key, doc, letters


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language: counted in each task first, then summed."""

    def work(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, data, bounds in text_blocks(batch, "text", 4 << 20):
                key, doc, _ = grams(data, bounds)
                names, number = np.unique(langs[a:b], return_inverse=True)
                for k, name in enumerate(names):
                    g, n = np.unique(key[number[doc] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Table:
    """Sorted keys with a row of figures for each language; absent keys give a row of zeros."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])

    def find(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))


def discount(counts: np.ndarray) -> float:
    """The absolute discount of an order, from how many n-grams came once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(MOST_DISCOUNT, max(LEAST_DISCOUNT, once / (once + 2 * twice))) if once and twice else DISCOUNT


class Model:
    """Kneser-Ney of orders 4 to 1 for each language, from four-gram counts."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        n = len(langs)
        self.levels: list[_Table] = []  # of order 4, 3, 2, 1: discounted count shares
        self.backs: list[_Table] = []  # of their contexts: mass given to the next lower order
        level = counts
        symbols = [len(np.unique(g & np.uint64(0xFFFF))) + 1 for g, _ in counts]
        self.floor = 1.0 / np.array(symbols, np.float64)
        for order in range(ORDER, 0, -1):
            keys = np.unique(np.concatenate([g for g, _ in level]))
            context = np.unique(keys >> BITS)
            share, back = np.zeros((len(keys), n)), np.zeros((len(context), n))
            for k, (g, c) in enumerate(level):
                cut = discount(c)
                at = np.searchsorted(context, g >> BITS)
                total = np.bincount(at, weights=c, minlength=len(context))
                kinds = np.bincount(at, minlength=len(context))
                back[:, k] = np.where(total > 0, cut * kinds / np.maximum(total, 1e-9), 0)
                share[np.searchsorted(keys, g), k] = np.maximum(c - cut, 0) / total[at]
            self.levels.append(_Table(keys, share))
            self.backs.append(_Table(context, back))
            if order > 1:  # continuation counts: how many characters come before the shorter gram
                mask = np.uint64((1 << (16 * (order - 1))) - 1)
                level = [tuple(np.unique(g & mask, return_counts=True)) for g, _ in level]
        self.top = _Table(self.levels[0].keys, self._logs(self.levels[0].keys).astype(np.float32))
        # the cross-entropy that a language's own training text has, and the most that a text of it may have
        self.level = np.array([-(c * self.logs(g)[:, k]).sum() / c.sum() for k, (g, c) in enumerate(counts)])
        self.most = self.level + 1.0

    def _logs(self, key: np.ndarray) -> np.ndarray:
        """Natural log of the interpolated probability in each language."""
        p = np.tile(self.floor, (len(key), 1))
        for order in range(1, ORDER + 1):
            part = key & np.uint64((1 << (16 * order)) - 1) if order < ORDER else key
            level, back = self.levels[ORDER - order], self.backs[ORDER - order]
            share = level.rows[level.find(part)]
            mass = back.rows[back.find(part >> BITS)]
            p = share + np.where(mass > 0, mass, 1.0) * p
        return np.log(p)

    def logs(self, key: np.ndarray) -> np.ndarray:
        at = self.top.find(key)
        out = self.top.rows[at]
        new = at == len(self.top.keys)
        if new.any():
            out = out.astype(np.float64)
            out[new] = self._logs(key[new])
        return out

    def entropies(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character in nats: document x language, letters)."""
        docs = len(bounds) - 1
        key, doc, letters = grams(data, bounds)
        total = np.zeros((docs, len(self.langs)))
        size = np.maximum(np.bincount(doc, minlength=docs), 1)
        if len(key):
            short, code = np.unique(key, return_inverse=True)  # one look-up for each distinct gram of the block
            value = self.logs(short)
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(doc, weights=value[code, k], minlength=docs)
        return -total / size[:, None], letters


#: Bins of a nat in which entropies are counted.
BINS = 4096


def _quantiles(rows: DataFrame, share: float) -> dict[str, float]:
    """The exact percentile of ``entropy`` in each ``lang``, between the two nearest ranks: bins are counted first, then only the values of the ranks' own bins are read."""
    binned = rows.withColumn("bin", F.floor(F.col("entropy") * BINS))
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in binned.groupBy("lang", "bin").count().collect():
        counts.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    places, wanted = {}, F.lit(False)
    for lang, bins in counts.items():
        bins.sort()
        ends = np.cumsum([n for _, n in bins])
        at = (int(ends[-1]) - 1) * share
        low, high = (int(np.searchsorted(ends, rank, side="right")) for rank in (int(at), min(int(at) + 1, int(ends[-1]) - 1)))
        places[lang] = (at, int(ends[low]) - bins[low][1])
        wanted = wanted | ((F.col("lang") == lang) & F.col("bin").isin(bins[low][0], bins[high][0]))
    values: dict[str, list[tuple[float, int]]] = {}
    for r in binned.where(wanted).groupBy("lang", "entropy").count().collect():
        values.setdefault(r["lang"], []).append((r["entropy"], r["count"]))
    out = {}
    for lang, (at, before) in places.items():
        known = sorted(values[lang])
        ends = before + np.cumsum([n for _, n in known])
        low, high = (known[min(int(np.searchsorted(ends, rank, side="right")), len(known) - 1)][0] for rank in (int(at), int(at) + 1))
        out[lang] = low + (high - low) * (at - int(at))
    return out


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """A model of all four-grams of all rows with a language, its rejection calibrated on all of them. None without rows.

    The counts come to the driver, which makes the arrays: 12 bytes a language and four-gram there, and 8 and 4 a language for each n-gram in the model.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = count_grams(known, "id", "text").toArrow()
    langs = sorted(set(pc.unique(got["lang"]).to_pylist()))
    if not langs:
        return None
    tables = []
    for lang in langs:
        own = got.filter(pc.equal(got["lang"], lang))
        gram = own["gram"].to_numpy().view(np.uint64)
        order = np.argsort(gram)
        tables.append((gram[order], own["n"].to_numpy()[order]))
    model = Model(langs, tables)
    own = cut(identify(known, model, "id", "text").where("id = lang_pred").select(F.col("id").alias("lang"), "entropy"))
    for lang, most in _quantiles(own, 1 - REJECTED).items():
        model.most[langs.index(lang)] = most + SLACK
    release(own)
    return model


#: Sharpness of the score: exp of the cross-entropies' difference times this.
SHARP = 8.0


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1), entropy (nats per character), rejected.

    lang_pred is a learned language; ``und`` with score 0 if the text is null or has no letters, or if nothing was learned. ``rejected``
    marks texts whose best cross-entropy is above the level calibrated for that language. Texts of any length are read whole. One pass, no shuffle.
    Ties go to the first language by name. Rows that repeat get the same answer. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        model = sent.value
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                n = b - a
                if model is None:
                    name, score, best, off = [UNSEEN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
                else:
                    h, letters = model.entropies(data, bounds)
                    pick = h.argmin(1)
                    best = h.min(1)
                    score = 1 / np.exp(-SHARP * (h - best[:, None])).sum(1)
                    none = letters == 0
                    name = [UNSEEN if z else model.langs[p] for z, p in zip(none, pick)]
                    score, best = np.where(none, 0.0, score), np.where(none, 0.0, best)
                    off = none | (best > model.most[pick])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(name, pa.string()), pa.array(score), pa.array(best), pa.array(off)], ["id", "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)
