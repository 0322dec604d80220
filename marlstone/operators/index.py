"""Index statistics as tables: postings, TF-IDF, BM25, keyword weights, lookups.

``by`` names the columns that part the corpus into indexes, each with its own statistics; none is one index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import release, small_batches, spread, stored


def postings(docs: DataFrame, tokens: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, term, tf): term counts of each document."""
    rows = spread(docs).select(*by, F.col(id_col).alias("id"), F.explode(tokens).alias("term"))
    return rows.groupBy(*by, "id", "term").agg(F.count("*").alias("tf"))


def _with_total(df: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Attach statistics of each index; with a single index it is one row, broadcast."""
    return df.join(totals, list(by)) if by else df.crossJoin(F.broadcast(totals))


def document_counts(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("N"))


def keyword_dictionary(docs: DataFrame, terms: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., term, keyword_id, df, idf): idf = max(0, ln(N / (1 + df)) + 1)."""
    df = spread(docs).select(*by, F.explode(F.array_distinct(terms)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log(F.col("N") / (1 + F.col("df"))) + 1)
    return _with_total(df, document_counts(docs, by), by).select(*by, "term", T.keyword_id("term").alias("keyword_id"), "df", idf.alias("idf"))


def keyword_weights(docs: DataFrame, terms: Column, id_col: str = "id", by: tuple[str, ...] = (), top: int = 12, only: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(by.., id, term, idf, weight, rank): (1 + ln tf) idf, the ``top`` of each document by (weight, idf, term) descending. ``only`` (id) names the documents that are asked for; all count for the idf. ``words`` is the dictionary, where it is made already."""
    words = (keyword_dictionary(docs, terms, id_col, by) if words is None else words).where("idf > 0").select(*by, "term", "idf")
    asked = docs if only is None else docs.join(only.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    rows = postings(asked, terms, id_col, by).join(words, [*by, "term"]).withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    order = Window.partitionBy(*by, "id").orderBy(F.desc(F.round("weight", 9)), F.desc(F.round("idf", 9)), F.desc("term"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*by, "id", "term", "idf", "weight", "rank")


def tfidf_idf(tf: DataFrame, docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., term, idf) of postings: ln((1 + N) / (1 + df)) + 1."""
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    return _with_total(df, document_counts(docs, by), by).select(*by, "term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_norms(tf: DataFrame, idf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, norm): length of each document's vector of tf idf."""
    w = F.col("tf") * F.col("idf")
    return tf.join(idf, [*by, "term"]).groupBy(*by, "id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def tfidf(docs: DataFrame, grams: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, term, idf, weight): tf (ln((1 + N) / (1 + df)) + 1), each document's weights of length 1."""
    tf = postings(docs, grams, id_col, by)
    idf = tfidf_idf(tf, docs, by)
    raw = tf.join(idf, [*by, "term"]).join(tfidf_norms(tf, idf, by), [*by, "id"])
    return raw.select(*by, "id", "term", "idf", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def bm25_terms(docs: DataFrame, tokens: Column, id_col: str = "id", by: tuple[str, ...] = (), tf: DataFrame | None = None) -> DataFrame:
    """(by.., term, df, idf): ln(N - df + .5) - ln(df + .5); negative values become a quarter of the index's mean. ``tf`` are the postings, where they are made already."""
    tf = postings(docs, tokens, id_col, by) if tf is None else tf
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    raw = _with_total(df, document_counts(docs, by), by).withColumn("raw", F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*by).agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw"))
    return _with_total(raw, mean, by).select(*by, "term", "df", idf.alias("idf"))


def bm25_lengths(docs: DataFrame, tokens: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., id, dl, avgdl): tokens of each document and the index's mean."""
    rows = docs.select(*by, F.col(id_col).alias("id"), F.size(tokens).cast("long").alias("dl"))
    return _with_total(rows, rows.groupBy(*by).agg(F.avg("dl").alias("avgdl")), by)


def corpus_signature(docs: DataFrame, id_col: str, text_col: str, by: tuple[str, ...]) -> DataFrame:
    """(by.., chunks, signature): changes if a row of the index does. Rows are hashed where they stand; sums of the hashes need no order."""
    h = F.sha1(F.concat(F.col(id_col).cast("string"), F.lit("\0"), T.text(text_col), F.lit("\0")))
    parts = [F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 9, 17)]
    sums = docs.groupBy(*by).agg(F.count("*").alias("chunks"), *parts)
    return sums.select(*by, "chunks", F.sha1(F.concat_ws(":", "s1", "s9", "s17")).alias("signature"))


def index_report(docs: DataFrame, by: tuple[str, ...], vectors: str = "none") -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("chunks"), F.lit(vectors).alias("vectors"))


def context_keys(dedupe_key: Column, doc_id: Column, text: Column, title: Column, question: Column) -> dict[str, Column]:
    """The keys that a logged context and its corpus row may share; blank where there is nothing to share. Texts are normalised, and stand as digests."""
    digest = lambda x: F.when(x != "", F.md5(x))
    return {
        "dedupe": F.trim(dedupe_key),
        "text": digest(text),
        "doc_text": F.when(text != "", F.md5(F.concat(doc_id.cast("string"), F.lit("::"), text))),
        "title": title,
        "question": question,
    }


def lookups(corpus: DataFrame) -> DataFrame:
    """(key_kind, key, id): the keys by which a logged context finds its corpus row (id, dedupe_key, doc_id, text, title, question)."""
    keys = context_keys(F.col("dedupe_key"), F.col("doc_id"), T.norm_ascii("text"), T.norm_ascii("title"), T.norm_ascii("question"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key_kind"), v.alias("key")) for k, v in keys.items()])
    return corpus.select("id", F.explode(pairs).alias("p")).where("p.key <> ''").select("p.key_kind", "p.key", "id").distinct()


#: Postings of a row of the matrix by terms, and those multiplied at once; documents whose sums meet in a task.
POSTINGS, STEP, SLICE = 1 << 18, 1 << 16, 1 << 14


def lsa_vectors(docs: DataFrame, tokens: Column, id_col: str = "id", rank: int = 64) -> DataFrame:
    """(id, vector): the documents' coordinates in the first ``rank`` singular directions of the TF-IDF matrix of the whole vocabulary, of length 1.

    Weights are tf (ln((1 + N) / (1 + df)) + 1), rows of length 1. With A = U S V' the coordinates A V are U S, so only eigenvectors of A A' are looked for, and nothing of the
    vocabulary's size is on the driver or sent to a task: the matrix stays distributed by terms. The driver holds three numbers for each document and direction, so the number of documents
    bounds it. Signs are arbitrary. Documents without tokens, and those whose coordinates are 0, have no row.
    """
    from . import inverted as V

    kind, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    index = V.build(docs, tokens, id_col)
    rows = stored(V.vectors(index).withColumn("at", F.monotonically_increasing_id()), "rows")
    size = index.terms.count()
    index.release()
    parts = rows.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).orderBy("p").collect()
    n = sum(r.n for r in parts)
    if not n:
        release(rows)
        return spark.createDataFrame([], f"id {kind}, vector array<double>")
    first = dict(zip([r.p for r in parts], np.cumsum([0, *[r.n for r in parts]]).tolist()))
    numbered = rows.withColumn("row", F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.shiftright("at", 33)) + F.col("at").bitwiseAND((1 << 33) - 1))
    buckets = max(spark.sparkContext.defaultParallelism, -(-sum(r.terms for r in parts) // POSTINGS))
    columns = stored(_columns(numbered.select("row", "terms", "weights"), buckets), "columns", True)
    values, u = _leading(lambda x: _product(columns, n, x), n, max(1, min(rank, n - 1, size - 1)))
    release(columns)
    sent = spark.sparkContext.broadcast(u * np.sqrt(values))
    del u

    def project(batches):
        import pandas as pd

        for pdf in batches:
            x = sent.value[pdf.row.to_numpy()]
            length = np.sqrt((x * x).sum(1))
            some = length > 1e-9
            yield pd.DataFrame({"id": pdf.id[some], "vector": list(x[some] / length[some, None])})

    out = stored(numbered.select("id", "row").mapInPandas(project, f"id {kind}, vector array<double>"), "lsa")
    release(rows)
    sent.destroy()
    return out


def _columns(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ends, docs, weights, terms, by): the postings of some terms each, term by term; ``by`` is their order by document."""
    import pyarrow as pa

    def deal(batches):
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            term, weight = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            doc = np.repeat(batch.column(0).to_numpy().astype(np.int32), size)
            own = (term.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32())} | {c: pa.array([x[at].tobytes()], pa.binary()) for c, x in (("term", term), ("doc", doc), ("weight", weight))})

    def join(table: pa.Table) -> pa.Table:
        term, doc, weight = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("term", np.int64), ("doc", np.int32), ("weight", float)))
        order = np.lexsort((doc, term))
        term, doc, weight = term[order], doc[order], weight[order]
        own = np.cumsum(np.diff(term, prepend=term[:1]) != 0).astype(np.int32)
        cells = {"ends": np.bincount(own).cumsum(), "docs": doc, "weights": weight, "terms": own, "by": np.argsort(doc, kind="stable").astype(np.int32)}
        return pa.table({"bucket": table["bucket"][:1]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in cells.items()})

    dealt = rows.mapInArrow(deal, "bucket int, term binary, doc binary, weight binary")
    return dealt.groupBy("bucket").applyInArrow(join, "bucket int, ends binary, docs binary, weights binary, terms binary, by binary")


def _sums(x: np.ndarray, take: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of weight * x[take] for each run of them."""
    out, a = np.empty((len(ends), x.shape[1])), 0
    while a < len(ends):
        begin = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + STEP, side="right")))
        own = slice(begin, int(ends[b - 1]))
        out[a:b] = np.add.reduceat(x[take[own]] * weight[own, None], np.concatenate([[begin], ends[a : b - 1]]) - begin, axis=0)
        a = b
    return out


def _product(columns: DataFrame, n: int, x: np.ndarray) -> np.ndarray:
    """A A' x: each task multiplies by its terms' columns and their transpose, and the tasks' sums meet by some documents at a time."""
    import pyarrow as pa

    sent, width = columns.sparkSession.sparkContext.broadcast(x), x.shape[1]

    def work(batches):
        x, y = sent.value, np.zeros((n, width))
        for batch in batches:
            for r in range(batch.num_rows):
                ends, docs, weights, terms, by = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ends", np.int64), ("docs", np.int32), ("weights", float), ("terms", np.int32), ("by", np.int32)))
                z = _sums(x, docs, weights, ends)
                own = docs[by]
                last = np.flatnonzero(np.diff(own, append=-1))
                y[own[last]] += _sums(z, terms[by], weights[by], last + 1)
        for a in range(0, n, SLICE):
            yield pa.RecordBatch.from_pydict({"a": [a], "y": [y[a : a + SLICE].tobytes()]})

    def total(table: pa.Table) -> pa.Table:
        y = sum(np.frombuffer(b.as_buffer()) for b in table["y"])
        return pa.table({"a": table["a"][:1], "y": pa.array([y.tobytes()], pa.binary())})

    out = np.zeros((n, width))
    with small_batches(columns.sparkSession):
        found = columns.mapInArrow(work, "a long, y binary").groupBy("a").applyInArrow(total, "a long, y binary").toArrow()
    for a, y in zip(found["a"].to_pylist(), found["y"]):
        out[a : a + SLICE] = np.frombuffer(y.as_buffer()).reshape(-1, width)
    sent.destroy()
    return out


def _leading(product, n: int, k: int, block: int = 16, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix without negative ones, and their vectors: block Lanczos with all vectors kept orthogonal, begun again from the best when 3 k are held."""
    most = 3 * k + 2 * block
    if n <= most + block:
        m = product(np.eye(n))
        values, y = np.linalg.eigh((m + m.T) / 2)
        return _positive(values[::-1][:k], y[:, ::-1][:, :k])
    rng = np.random.default_rng(7)
    v, h, m = np.zeros((n, most), order="F"), np.zeros((most, most)), block
    v[:, :m] = np.linalg.qr(rng.standard_normal((n, block)))[0]
    last = slice(0, block)
    for _ in range(rounds):
        w, own = product(v[:, last]), v[:, :m]
        part = own.T @ w
        h[:m, last], h[last, :m] = part, part.T
        w -= own @ part
        w -= own @ (own.T @ w)
        q, r = np.linalg.qr(w)
        values, y = np.linalg.eigh((h[:m, :m] + h[:m, :m].T) / 2)
        values, y = values[::-1], y[:, ::-1]
        if m >= k and np.sqrt(((r @ y[last, :k]) ** 2).sum(0)).max() <= 1e-10 * values[0]:
            return _positive(values[:k], own @ y[:, :k])
        weak = np.abs(np.diag(r)) <= 1e-13 * values[0]
        if weak.any():  # the space is used up in these directions: others at random
            q[:, weak] = rng.standard_normal((n, weak.sum()))
            for _ in range(2):
                q -= own @ (own.T @ q)
                q = np.linalg.qr(q)[0]
        if m + block > most:
            m = k + block
            v[:, :m] = own @ y[:, :m]
            h[:] = 0
            h[np.arange(m), np.arange(m)] = values[:m]
        v[:, m : m + block] = q
        last, m = slice(m, m + block), m + block
    raise RuntimeError("the singular directions have not been found")


def _positive(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = values > 1e-14 * max(values[0], 0.0)
    return values[some], vectors[:, some]
