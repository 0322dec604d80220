"""Quality classifier: attention-based multiple-instance learning over passages.

Every passage (a line, cut at 400 bytes) is encoded as a vector of character shares, word statistics and hashed pairs of character
classes; gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), weighs the passages of a document, and a logistic layer
scores the weighted vector. All parameters are learned from document labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, LOWER, prefix_sums, span_hash, text_blocks, words
from .toxicity import sample_labelled

#: Labelled documents that training reads, at most, half of each label where there are so many.
MAX_TRAIN = 4000
PASSAGE = 400
BINS = 24
HIDDEN = 12
THRESHOLD = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:", b"!?", b"|/\\_", b"*#$%&@+=~^<>", b"'\"()[]{}-"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASS = len(_CLASSES) + 2
#: Per passage: class shares, BINS pairs of neighbouring classes, seven word and length figures.
WIDTH = _N_CLASS + BINS + 7


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, document) of the passages of a block; an empty document has one passage of zeros."""
    n = len(data)
    docs = len(bounds) - 1
    empty = np.flatnonzero(bounds[1:] == bounds[:-1])
    if n == 0:
        return np.zeros((docs, WIDTH), np.float32), np.arange(docs)
    first = np.zeros(n, bool)
    first[1:] = data[:-1] == 10
    first[bounds[:-1][bounds[:-1] < n]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    more = (size - 1) // PASSAGE  # long lines are cut in even parts
    if more.any():
        k = np.arange((more + 1).sum()) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        start = np.repeat(start, more + 1) + k * np.repeat(-(-size // (more + 1)), more + 1)
        start = start[start < n]
    size = np.diff(np.append(start, n)).astype(np.float64)
    m = len(start)
    number = np.repeat(np.arange(m), size.astype(np.int64))
    cls = _CLASS[data]
    out = np.zeros((m, WIDTH), np.float32)
    out[:, :_N_CLASS] = np.bincount(number * _N_CLASS + cls, minlength=m * _N_CLASS).reshape(m, -1) / size[:, None]
    pair = (cls[:-1] * 37 + cls[1:] * 11) % BINS
    inside = np.ones(n - 1, bool)  # no pair of a document with the next one
    inside[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)] - 1] = False
    out[:, _N_CLASS : _N_CLASS + BINS] = np.bincount((number[:-1] * BINS + pair)[inside], minlength=m * BINS).reshape(m, -1) / size[:, None]
    ws, we, wd = words(data, bounds)
    if len(ws):
        h = span_hash(prefix_sums(LOWER[data]), ws, we)
        at = number[ws]
        count = np.bincount(at, minlength=m)
        some = np.maximum(count, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
        skip = np.zeros(len(h), bool)
        skip[2:] = (h[2:] == h[:-2]) & (wd[2:] == wd[:-2])
        last = cls[we - 1]
        x = _N_CLASS + BINS
        out[:, x] = np.bincount(at, weights=same, minlength=m) / some
        out[:, x + 1] = np.bincount(at, weights=skip, minlength=m) / some
        out[:, x + 2] = np.bincount(at, weights=(we - ws), minlength=m) / some / 10
        out[:, x + 3] = np.bincount(at, weights=(last >= 5) & (last <= 7), minlength=m) / some
        out[:, x + 4] = np.bincount(at, weights=(we - ws) == 1, minlength=m) / some
        out[:, x + 5] = np.log1p(count) / 5
    out[:, WIDTH - 1] = np.log1p(size) / 6
    doc = np.searchsorted(bounds, start, side="right") - 1
    if len(empty):
        out = np.concatenate([out, np.zeros((len(empty), WIDTH), np.float32)])
        doc = np.concatenate([doc, empty])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def _forward(m: dict, x: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    t = np.tanh(x @ m["V"] + m["v"])
    g = 1 / (1 + np.exp(-(x @ m["U"] + m["u"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
    a = e / np.add.reduceat(e, starts)[doc]
    z = np.add.reduceat(a[:, None] * x, starts, axis=0)
    return t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, rounds: int = 160, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> dict:
    """Adam on the weighted log loss of the gated attention model; all bags in each round."""
    rng = np.random.default_rng(seed)
    n = len(bags)
    x = np.concatenate(bags) if n else np.zeros((1, WIDTH), np.float32)
    mean, std = x.mean(0), x.std(0) + 1e-3
    m = {"V": rng.normal(0, 0.2, (WIDTH, HIDDEN)), "v": np.zeros(HIDDEN), "U": rng.normal(0, 0.2, (WIDTH, HIDDEN)), "u": np.zeros(HIDDEN), "w": rng.normal(0, 0.2, HIDDEN), "c": np.zeros(WIDTH), "b": np.zeros(1)}
    share = labels.mean() if n else 0.5
    if n and 0 < share < 1:
        x = (x - mean) / std
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        doc = np.repeat(np.arange(n), sizes)
        y = labels.astype(float)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n
        first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
        for r in range(1, rounds + 1):
            t, g, a, z, p = _forward(m, x, starts, doc)
            d = weight * (p - y)
            dz = d[:, None] * m["c"]
            da = (dz[doc] * x).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts)[doc])
            dh = de[:, None] * m["w"]
            dt, dg = dh * g * (1 - t * t), dh * t * g * (1 - g)
            grad = {"V": x.T @ dt, "v": dt.sum(0), "U": x.T @ dg, "u": dg.sum(0), "w": (t * g).T @ de, "c": z.T @ d, "b": d.sum(keepdims=True)}
            for k in m:
                gk = grad[k] + decay * m[k]
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.99 * second[k] + 0.01 * gk * gk
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
    elif n:
        m["b"][:] = 4.0 if share == 1 else -4.0
    return m | {"mean": mean, "std": std}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TRAIN) -> dict:
    """Train on a bounded sample (``limit``) of the labelled documents given; a task encodes each text to passages."""

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                x, doc = encode(data, bounds)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()), batch.column(1).slice(a, b - a)], ["x", "label"])

    rows = sample_labelled(docs, labels, label, id_col, text_col, limit).mapInArrow(work, "x binary, label int").toArrow().to_pylist()
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], np.int64))


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score, predicted, passages, attention (the largest weight), focus (the number of that passage, the first of equals).

    Null and empty texts are one passage of zeros. One pass, no shuffle; a document of any length is scored whole, on all its
    passages. Rows that repeat get the same score. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                x, doc = encode(data, bounds)
                starts = np.searchsorted(doc, np.arange(b - a))
                _, _, weight, _, p = _forward(model, (x - model["mean"]) / model["std"], starts, doc)
                top = np.maximum.reduceat(weight, starts)
                where = np.flatnonzero(weight == top[doc])
                focus = where[np.searchsorted(doc[where], np.arange(b - a))] - starts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.diff(np.append(starts, len(doc))).astype(np.int32)), pa.array(top), pa.array(focus.astype(np.int32))],
                    ["id", "score", "predicted", "passages", "attention", "focus"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, score double, predicted int, passages int, attention double, focus int").withColumnRenamed("id", id_col)
