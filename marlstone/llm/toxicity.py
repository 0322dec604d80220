"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Sentence scores q are combined by noisy-or, 1 - prod(1 - q), and learned from document labels alone; the same function is trained and served.
A sentence without any weighed feature has q = 0, so that length alone makes no text toxic. The trained scores then locate the offending sentences. Features of a sentence are its words and
their beginnings (4 to 6 bytes), hashed, so that inflected forms share weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, mix, prefix_sums, release, span_hash, text_blocks, words

#: Labelled documents that training reads, at most, taken by a hash of the id, half of them toxic where there are so many;
#: characters of sentence text it holds per document are not limited.
MAX_TRAIN = 6000
STARTS = (4, 5, 6)
THRESHOLD = 0.7
#: What the toxic documents weigh in training, of all: less than half, so that a score of THRESHOLD is seldom a clean document's.
TOXIC_SHARE = 0.25
#: Least evidence (log likelihood ratio, in nats) that a feature's presence goes with the label.
EVIDENCE = 8.0

#: Bytes that end a sentence, and bytes between words (ASCII punctuation and white space).
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True
_GAP = np.zeros(256, bool)
_GAP[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def featurize(data: np.ndarray, bounds: np.ndarray):
    """(feature hash, sentence, document of each sentence, start and end of each sentence) of a block of texts.

    Sentences end after . ! ? and line feeds and at a document's end; sentence numbers count over the block.
    """
    data = LOWER[data]
    n = len(data)
    starts, ends, doc = words(data, bounds, _GAP)
    first = np.zeros(n + 1, bool)
    first[1:][_END[data]] = True
    first[bounds] = True
    number = np.cumsum(first[:n]) - 1
    s_start = np.flatnonzero(first[:n])
    s_end = np.append(s_start[1:], n)
    s_doc = np.searchsorted(bounds, s_start, side="right") - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), s_doc, s_start, s_end
    sums = prefix_sums(data)
    sent = number[starts]
    hashes, owners = [span_hash(sums, starts, ends)], [sent]
    for k in STARTS:
        long = ends - starts > k
        hashes.append(span_hash(sums, starts[long], starts[long] + k) ^ mix(np.full(1, k, np.uint64)))
        owners.append(sent[long])
    return np.concatenate(hashes), np.concatenate(owners), s_doc, s_start, s_end


def _noisy_or(score: np.ndarray, bias: float, sent_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sigmoids of sentence scores, and the log of each document's chance that no sentence is toxic: q is how far the sigmoid is above that of the bias."""
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    none = np.log1p(-np.minimum(p, 1 - 1e-12)) - np.log1p(-1 / (1 + np.exp(-bias)))
    return p, np.minimum(0, np.bincount(sent_doc, weights=none, minlength=n))


def train(keep: np.ndarray, features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150, rate: float = 0.25, decay: float = 2e-4, share: float = TOXIC_SHARE) -> dict:
    """keep: sorted hashes of the features to weigh; features: (hashes, sentence numbers) of each document. Returns keys, weights and the bias."""
    n = len(labels)
    if n == 0 or not labels.any() or not len(keep):
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -8.0}
    cols, sents, docs, at = [], [], [], 0
    for d, (h, s) in enumerate(features):
        c = np.minimum(np.searchsorted(keep, h), len(keep) - 1)
        hit = keep[c] == h
        own, code = np.unique(s[hit], return_inverse=True)
        pair = np.unique(np.stack([code + at, c[hit]], 1), axis=0)  # a feature counts once in a sentence
        sents.append(pair[:, 0])
        cols.append(pair[:, 1])
        docs.append(np.full(len(own), d))
        at += len(own)
    sent_doc, sent, col = np.concatenate(docs), np.concatenate(sents), np.concatenate(cols)
    w, b = np.ones(len(keep)), -6.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    y = labels.astype(float)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / max(1e-9, 1 - y.mean())) / n
    for t in range(1, rounds + 1):
        score = b + np.bincount(sent, weights=w[col], minlength=at)
        p, log_none = _noisy_or(score, b, sent_doc, n)
        any_ = np.clip(-np.expm1(log_none), 1e-6, 1 - 1e-12)
        # d(-log likelihood)/d score of a sentence: p for a clean document, -p (1 - P) / P for a toxic one
        pull = (weight * np.where(y > 0, -np.exp(log_none) / any_, 1.0))[sent_doc]
        gw = np.bincount(col, weights=(pull * p)[sent], minlength=len(w)) + decay * w
        gb = (pull * (p - 1 / (1 + np.exp(-b)))).sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        w = np.maximum(w, 0)  # a word may make a sentence toxic; none makes it clean
        b = min(b, -5.0)
    return {"keys": keep[w > 0], "weights": w[w > 0], "bias": float(b)}


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """text and label of ``limit`` labelled documents at most, half of each label where possible, by a hash of the id.

    The labels are cut to the sample before the texts are joined. Null labels are left out.
    """
    one = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    one = one.groupBy("_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("_id"), F.lit(17))
    some = [one.where(F.col("label") == k).orderBy(order, "_id").limit(limit // 2) for k in (0, 1)]
    few = some[0].unionByName(some[1])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(few, "_id").select("text", "label")


def select_features(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of all features of (text, label) whose presence is evidence of label 1, EVIDENCE nats at least. Documents are counted in the cluster; only these hashes come back, bounded by the sample."""

    def work(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, bounds in text_blocks(batch, "text"):
                h, s, s_doc, _, _ = featurize(data, bounds)
                doc = s_doc[s] if len(s) else s
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                key, code = np.unique(h[keep], return_inverse=True)
                pos = np.bincount(code, weights=labels[a:b][doc[keep]], minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(np.bincount(code, minlength=len(key)).astype(np.int64))], ["h", "pos", "tot"])

    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic:
        return np.zeros(0, np.uint64)
    sums = sample.mapInArrow(work, "h long, pos long, tot long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("tot").alias("tot"))
    pos, neg = F.col("pos"), F.col("tot") - F.col("pos")
    nats = lambda x, share: F.when(x > 0, x * F.log(x / (F.col("tot") * share))).otherwise(0.0)
    evidence = nats(pos, toxic / n) + nats(neg, max(1e-9, 1 - toxic / n))
    best = sums.where((pos >= 2) & (pos * n > F.col("tot") * toxic) & (evidence >= EVIDENCE))
    return np.sort(best.select("h").toArrow()["h"].to_numpy().view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_TRAIN) -> dict:
    """Train on a bounded sample of the labelled documents given (``limit``): features are chosen first, then a task trains on each text's chosen features and returns the weights."""
    sample = cut(sample_labelled(docs, labels, label, id_col, text_col, limit))
    keep = select_features(sample)

    def work(batches):
        for batch in batches:
            labels = batch.column(1)
            for a, b, data, bounds in text_blocks(batch, "text"):
                h, s, s_doc, _, _ = featurize(data, bounds)
                hit = np.isin(h, keep)
                h, s = h[hit], s[hit]
                doc = s_doc[s] if len(s) else s
                order = np.argsort(doc, kind="stable")
                h, s, cuts = h[order], s[order], np.searchsorted(doc[order], np.arange(b - a + 1))
                rows = [(h[i:j].tobytes(), s[i:j].astype(np.uint32).tobytes()) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), labels.slice(a, b - a)], ["h", "s", "label"])

    def learn(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        features = [(np.frombuffer(r["h"], np.uint64), np.frombuffer(r["s"], np.uint32).astype(np.int64)) for r in rows]
        m = train(keep, features, np.array([r["label"] for r in rows], np.int64))
        yield pa.RecordBatch.from_pylist([{"keys": m["keys"].tobytes(), "weights": m["weights"].tobytes(), "bias": m["bias"]}])

    order = sample.mapInArrow(work, "h binary, s binary, label int").repartition(1).sortWithinPartitions("h", "s")  # the same sums whatever task comes first
    row = order.mapInArrow(learn, "keys binary, weights binary, bias double").first()
    release(sample)
    if row is None:
        return train(keep, [], np.zeros(0, np.int64))
    return {"keys": np.frombuffer(row["keys"], np.uint64), "weights": np.frombuffer(row.weights, np.float64), "bias": row.bias}


def score_block(model: dict, data: np.ndarray, bounds: np.ndarray):
    """Document scores, and the sentences (document, probability, start, end) of a block."""
    h, s, s_doc, s_start, s_end = featurize(data, bounds)
    total = np.full(len(s_doc), model["bias"])
    keys = model["keys"]
    if len(keys) and len(h):
        h32 = (h >> np.uint64(48)).astype(np.int64)
        maybe = model["gate"][h32]
        h, s = h[maybe], s[maybe]
        c = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[c] == h
        pair = np.unique(s[hit] * len(keys) + c[hit])
        total = total + np.bincount(pair // len(keys), weights=model["weights"][pair % len(keys)], minlength=len(total))
    p, log_none = _noisy_or(total, model["bias"], s_doc, len(bounds) - 1)
    return np.clip(-np.expm1(log_none), 0, 1), s_doc, p, s_start, s_end


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sentences: bool = True) -> DataFrame:
    """One row per input row: id, score, predicted, offending (start, end, score of sentences at or over 1/2; null unless asked for).

    Positions are bytes of the UTF-8 text, the end exclusive. Null and empty texts have score 0. One pass, no shuffle;
    a document of any length is scored whole. Rows that repeat get the same score. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    gate = np.zeros(1 << 16, bool)
    gate[(model["keys"] >> np.uint64(48)).astype(np.int64)] = True
    model = model | {"gate": gate}

    def work(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, "text"):
                score, s_doc, p, s_start, s_end = score_block(model, data, bounds)
                found: list = [None] * (b - a)
                if sentences:
                    found = [[] for _ in range(b - a)]
                    for k in np.flatnonzero(p >= 0.5):
                        d = s_doc[k]
                        found[d].append({"start": int(s_start[k] - bounds[d]), "end": int(s_end[k] - bounds[d]), "score": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, span)], ["id", "score", "predicted", "offending"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, score double, predicted int, offending array<struct<start long, end long, score double>>"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, whose score is below the threshold. One pass, no shuffle."""
    gate = np.zeros(1 << 16, bool)
    gate[(model["keys"] >> np.uint64(48)).astype(np.int64)] = True
    model = model | {"gate": gate}

    def work(batches):
        for batch in batches:
            for a, b, data, bounds in text_blocks(batch, text_col):
                score = score_block(model, data, bounds)[0]
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))

    return docs.mapInArrow(work, docs.schema)
