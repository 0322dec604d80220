"""I, R, E: index statistics, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import inverted as V
from ..operators import scan as C
from ..operators import search as S
from ..sources.tables import release, spread, stored
from .common import Plans, d_alnum, d_ascii, d_keyword_id, d_terms

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
STOP = T.STOPWORDS

TERMS = lambda: T.keyword_terms("text")
TOKENS = lambda: T.alnum_tokens("text", 2)
D_TERMS = d_terms("text", STOP)
D_TOKENS = f"list_filter({d_alnum('text')}, lambda t: length(t) >= 2)"

D_KW = f"""ktf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({D_TERMS}) AS term FROM documents) GROUP BY ALL),
    kidf AS (SELECT term, count(*) AS df, greatest(0.0, ln((SELECT count(*) FROM documents) / (1 + count(*))) + 1) AS idf FROM ktf GROUP BY term),
    kw AS (SELECT id, term, idf, (1 + ln(tf)) * idf AS weight, row_number() OVER (PARTITION BY id ORDER BY round((1 + ln(tf)) * idf, 9) DESC, round(idf, 9) DESC, term DESC) AS rank
        FROM ktf JOIN kidf USING (term) WHERE idf > 0 QUALIFY rank <= 12)"""
D_KEY = d_keyword_id("term")

P.add(
    "i1_keyword_dictionary",
    lambda docs: I.keyword_dictionary(docs, TERMS(), "doc_id").select("term", "keyword_id", "df", F.round("idf", 6).alias("idf")),
    "documents",
    sql=f"WITH {D_KW} SELECT term, {D_KEY} AS keyword_id, df, round(idf, 6) AS idf FROM kidf",
)
P.add(
    "i2_keyword_weights",
    lambda docs: I.keyword_weights(docs, TERMS(), "doc_id").select("id", "term", F.round("weight", 6).alias("weight"), "rank"),
    "documents",
    sql=f"WITH {D_KW} SELECT id, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM kw",
)


def tfidf_rows(docs):
    """Each document's vector over its tokens and pairs of neighbours."""
    index = V.build(docs, TOKENS(), "doc_id", grams=2)
    return kept(V.vectors(index), index)


D_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
D_TFIDF = f"""gtf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({D_GRAMS}) AS term FROM (SELECT doc_id AS id, {D_TOKENS} AS t FROM documents)) GROUP BY ALL),
    gidf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM gtf GROUP BY term),
    g AS (SELECT id, term, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight FROM gtf JOIN gidf USING (term))"""
P.add(
    "i3_tfidf_vectors",
    lambda docs: tfidf_rows(docs).select("id", F.size("terms").cast("long").alias("terms"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("weights"), 6).alias("top")),
    "documents",
    sql=f"WITH {D_TFIDF} SELECT id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM g GROUP BY id",
)

D_BM = f"""tok AS (SELECT doc_id AS id, {D_TOKENS} AS t FROM documents), len_ AS (SELECT id, len(t) AS dl, avg(len(t)) OVER () AS avgdl FROM tok),
    tf_ AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL),
    raw_ AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf_ GROUP BY term),
    idf_ AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw_)"""
P.add(
    "i4_bm25_stats",
    lambda docs: I.bm25_terms(docs, TOKENS(), "doc_id").select("term", "df", F.round("idf", 6).alias("idf")),
    "documents",
    sql=f"WITH {D_BM} SELECT term, df, round(idf, 6) AS idf FROM idf_",
)
P.add("i5_lsa_vectors", lambda docs: I.lsa_vectors(docs, TOKENS(), "doc_id").select("id", F.size("vector").alias("dim"), F.round(F.abs(F.element_at("vector", 1)), 4).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm")), "documents")


_SUMS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {k}, 8) AS BIGINT)) AS VARCHAR)" for k in (1, 9, 17))
P.add(
    "i6_corpus_signature",
    lambda docs: I.corpus_signature(docs, "doc_id", "text", ("source",)),
    "documents",
    sql=f"SELECT source, count(*) AS chunks, sha1(concat_ws(':', {_SUMS})) AS signature FROM (SELECT source, sha1(doc_id || chr(0) || text || chr(0)) AS h FROM documents) GROUP BY source",
)
P.add("i7_index_report", lambda c: I.index_report(c, ("domain",), "lsa"), "corpus_v", sql="SELECT domain, count(*) AS chunks, 'lsa' AS vectors FROM corpus_v GROUP BY domain")
D_KEYS = f"""SELECT 'dedupe' AS key_kind, trim(dedupe_key) AS key, id FROM corpus_v UNION ALL SELECT 'text', md5(t), id FROM (SELECT id, {d_ascii('text')} AS t FROM corpus_v) WHERE t <> ''
    UNION ALL SELECT 'doc_text', md5(doc_id || '::' || t), id FROM (SELECT id, doc_id, {d_ascii('text')} AS t FROM corpus_v) WHERE t <> ''
    UNION ALL SELECT 'title', {d_ascii('title')}, id FROM corpus_v UNION ALL SELECT 'question', {d_ascii('question')}, id FROM corpus_v"""
P.add(
    "i8_lookup_indexes",
    I.lookups,
    "corpus_v",
    sql=f"SELECT DISTINCT key_kind, key, id FROM ({D_KEYS}) WHERE key <> ''",
)

Q_TOKENS = lambda: T.alnum_tokens("query", 2)
D_QTOK = f"qtok AS (SELECT query_id, list_filter({d_alnum('query')}, lambda t: length(t) >= 2) AS t FROM queries_v)"
#: (query_id, id, score) of every document that shares a token with a query.
D_SCORE = f"""{D_BM}, {D_QTOK}, qtf AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM qtok) GROUP BY ALL),
    bm AS (SELECT query_id, tf_.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qtf JOIN tf_ USING (term) JOIN idf_ USING (term) JOIN len_ USING (id) GROUP BY ALL)"""
D_HITS = D_SCORE + ", hits AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 20)"


def kept(rows, *indexes):
    """A search's few rows, written, and the index released."""
    out = stored(rows, "hits")
    for index in indexes:
        index.release()
    return out


def hits(queries, docs, k=20, index=None):
    """The candidates that rerankers work on: the k best of BM25. ``index``, of the same tokens (and their pairs), is left where it is given."""
    own = V.build(docs, TOKENS(), "doc_id") if index is None else index
    rows = V.search(own, queries, Q_TOKENS(), k).select("query_id", "id", "score")
    return S.top(kept(rows, *([own] if index is None else [])), k)


P.add(
    "r3_bm25_search",
    lambda q, docs: hits(q, docs, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"WITH {D_HITS} SELECT query_id, id, rank, round(score, 6) AS score FROM hits WHERE rank <= 10",
)


def tfidf_hits(queries, docs, k):
    index = V.build(docs, TOKENS(), "doc_id", grams=2, norms=True)
    return S.top(kept(V.search(index, queries, Q_TOKENS(), k, "tfidf").select("query_id", "id", "score"), index), k)


P.add(
    "r1_tfidf_search",
    lambda q, docs: tfidf_hits(q, docs, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"""WITH {D_TFIDF}, {D_QTOK}, q0 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({D_GRAMS}) AS term FROM qtok) GROUP BY ALL),
        q1 AS (SELECT query_id, term, qtf * idf / sqrt(sum(qtf * idf * qtf * idf) OVER (PARTITION BY query_id)) AS qw FROM q0 JOIN gidf USING (term)),
        s AS (SELECT query_id, id, sum(qw * weight) AS score FROM q1 JOIN g USING (term) GROUP BY ALL)
        SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""",
)
D_OVER = f"""{D_QTOK}, ov AS (SELECT query_id, id, count(*) / any_value(n) AS score FROM (SELECT query_id, len(list_distinct(t)) AS n, unnest(list_distinct(t)) AS term FROM qtok)
    JOIN (SELECT doc_id AS id, unnest(list_distinct({D_TOKENS})) AS term FROM documents) USING (term) GROUP BY ALL)"""


def overlap_hits(q, docs, k):
    index = V.build(docs, TOKENS(), "doc_id")
    return S.top(kept(V.search(index, q, Q_TOKENS(), k, "overlap").select("query_id", "id", "score"), index), k)


P.add(
    "r2_overlap_search",
    lambda q, docs: overlap_hits(q, docs, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"WITH {D_OVER} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM ov QUALIFY rank <= 10",
)
P.add(
    "r4_vector_search",
    lambda e: S.vector_search(e, e.where("vec_id % 50 = 0"), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "embeddings",
    sql="""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_cosine_similarity(q.e, d.e) AS score
        FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
)


def unit_hits(q, docs, k):
    """The k best of BM25 with ``unit``, the score between the query's least and greatest."""
    index = V.build(docs, TOKENS(), "doc_id")
    rows = V.search(index, q, Q_TOKENS(), k).join(V.ranges(index, q, Q_TOKENS(), ("bm25",)), "query_id")
    span = F.col("high") - F.col("low")
    unit = F.when(span < 1e-9, F.when(F.col("high") > 0, 1.0).otherwise(0.0)).otherwise((F.col("score") - F.col("low")) / span)
    return kept(rows.select("query_id", "id", unit.alias("unit")), index)


def d_unit(name: str) -> str:
    """CTE u_name: min-max of a signal's scores in each query, absent documents counting 0."""
    low = "CASE WHEN count(*) OVER w < (SELECT count(*) FROM documents) THEN least(0.0, min(score) OVER w) ELSE min(score) OVER w END"
    return f"""u_{name} AS (SELECT query_id, id, score, CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END AS unit
        FROM (SELECT *, max(score) OVER w AS hi, {low} AS lo FROM {name} WINDOW w AS (PARTITION BY query_id)))"""


P.add(
    "r5_minmax_normalize",
    lambda q, docs: unit_hits(q, docs, 20).select("query_id", "id", F.round("unit", 6).alias("unit")),
    "queries_v",
    "documents",
    sql=f"WITH {D_SCORE}, {d_unit('bm')} SELECT query_id, id, round(unit, 6) AS unit FROM u_bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 20",
)


#: The text signals of one index; the vectors' share goes to them.
SIGNALS = {name: S.FUSION[name] for name in ("tfidf", "overlap", "bm25")}


def fused(q, docs, k, weights=SIGNALS, tier=None, index=None):
    """The k best of the fused signals. ``index`` is left where it is given."""
    own = V.build(docs, TOKENS(), "doc_id", grams=2 if "tfidf" in weights else 1, norms="tfidf" in weights) if index is None else index
    return kept(V.fused(own, q, Q_TOKENS(), k, weights, tier).select("query_id", "id", "score"), *([own] if index is None else []))


D_FUSED = f"""{D_SCORE}, {D_TFIDF}, q0 AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({D_GRAMS}) AS term FROM qtok) GROUP BY ALL),
    q1 AS (SELECT query_id, term, qtf * idf / sqrt(sum(qtf * idf * qtf * idf) OVER (PARTITION BY query_id)) AS qw FROM q0 JOIN gidf USING (term)),
    ti AS (SELECT query_id, id, sum(qw * weight) AS score FROM q1 JOIN g USING (term) GROUP BY ALL), {D_OVER[len(D_QTOK) + 2:]},
    {d_unit('bm')}, {d_unit('ti')}, {d_unit('ov')},
    fused AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, unit * 0.28 / 0.64 AS part FROM u_ti UNION ALL SELECT query_id, id, unit * 0.18 / 0.64 FROM u_ov
        UNION ALL SELECT query_id, id, unit * 0.18 / 0.64 FROM u_bm) GROUP BY ALL)"""
P.add(
    "r6_hybrid_fusion",
    lambda q, docs: S.top(fused(q, docs, 10), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"WITH {D_FUSED} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, round(score, 6) AS score FROM fused QUALIFY rank <= 10",
)
Q_TERMS = lambda: T.keyword_terms("query")
D_QTERMS = d_terms("query", STOP)
P.add(
    "r7_keyword_rerank",
    lambda q, docs: S.keyword_rerank(q, Q_TERMS(), I.keyword_weights(docs, TERMS(), "doc_id"), I.keyword_dictionary(docs, TERMS(), "doc_id")).select("query_id", "id", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"""WITH {D_KW}, q AS (SELECT query_id, term, sum(greatest(0.05, coalesce(idf, 0))) OVER (PARTITION BY query_id) AS norm FROM (SELECT query_id, unnest(list_distinct({D_QTERMS})) AS term FROM queries_v) LEFT JOIN kidf USING (term))
        SELECT query_id, id, round(sum(weight) / any_value(norm), 6) AS score FROM q JOIN kw USING (term) GROUP BY query_id, id""",
)


def candidates(q, docs, corpus, k=20):
    """Hits with the texts of query and chunk, normalised."""
    rows = hits(q, docs, k).withColumn("id", F.concat(F.lit("d"), F.col("id")))
    rows = rows.join(q.select("query_id", F.col("query").alias("q_raw"), F.col("query_type").alias("asked"), F.col("domain").alias("q_domain")), "query_id").join(corpus, "id")
    return rows.withColumns({"query": T.norm_ascii("q_raw"), "body": T.norm_ascii("text"), "title_n": T.norm_ascii("title"), "entity_n": T.norm_ascii("entity_name"), "question_n": T.norm_ascii("question")}).withColumns({"q_tokens": F.regexp_extract_all("query", F.lit("[a-z0-9]+"), F.lit(0)), "q_words": F.split("query", " ")})


D_CAND = f"""{D_HITS}, cand AS (SELECT h.query_id, c.id, h.score, h.rank, q.query AS q_raw, q.query_type AS asked, q.domain AS q_domain, c.* EXCLUDE (id), {d_ascii('q.query')} AS query, {d_ascii('c.text')} AS body,
    {d_ascii('c.title')} AS title_n, {d_ascii('c.entity_name')} AS entity_n, {d_ascii('c.question')} AS question_n, {d_alnum('q.query')} AS q_tokens, string_split({d_ascii('q.query')}, ' ') AS q_words FROM hits h JOIN queries_v q USING (query_id) JOIN corpus_v c ON c.id = 'd' || h.id)"""
_CAND = ("queries_v", "documents", "corpus_v")
_first = "q_words[1:6]"


def d_some(x: str) -> str:
    return f"len(list_filter({_first}, lambda t: contains({x}, t))) > 0"


def d_hits(tokens: str, x: str) -> str:
    return f"len(list_filter({tokens}, lambda t: contains({x}, t)))"


D_FIELD = f"""(CASE WHEN {d_some('title_n')} THEN 0.08 ELSE 0.0 END + CASE WHEN {d_some('chunk_type')} THEN 0.08 ELSE 0.0 END + CASE WHEN {d_some('entity_n')} THEN 0.10 ELSE 0.0 END
    + least(0.16, 0.03 * {d_hits("list_filter(q_words, lambda t: length(t) >= 5)", 'body')}))"""


def _field():
    return S.field_boost(F.col("q_words"), F.col("title_n"), F.col("chunk_type"), F.col("entity_n"), F.col("body"))


P.add("r8_field_boost", lambda q, d, c: candidates(q, d, c).select("query_id", "id", F.round(_field(), 6).alias("boost")), *_CAND, sql=f"WITH {D_CAND} SELECT query_id, id, round(CAST({D_FIELD} AS DOUBLE), 6) AS boost FROM cand")
#: The query's own prefixes; the entity is a few words of the text, so that names occur in queries.
PREFIXES = ("the ", "der ", "la ", "el ")
_ENT = "CASE " + " ".join(f"WHEN starts_with(entity_n, '{p}') THEN trim(substr(entity_n, {len(p) + 1}))" for p in PREFIXES) + " ELSE entity_n END"
_etoks = "list_filter(string_split(entity_n, ' '), lambda t: length(t) >= 3)"
D_ENTITY = f"""CASE WHEN entity_n = '' THEN 0.0 WHEN contains(query, entity_n) THEN 0.3 WHEN {_ENT} <> '' AND contains(query, {_ENT}) THEN 0.2 WHEN len({_etoks}) = 0 THEN 0.0
    WHEN {d_hits(_etoks, 'query')} = len({_etoks}) THEN 0.18 WHEN {d_hits(_etoks, 'query')} >= greatest(2, len({_etoks}) - 1) THEN 0.12 ELSE 0.0 END"""
P.add(
    "r9_entity_boost",
    lambda q, d, c: candidates(q, d, c).withColumn("entity_n", F.regexp_replace(F.substring("body", 1, 14), " +$", "")).select("query_id", "id", F.round(S.entity_boost(F.col("query"), F.col("entity_n"), PREFIXES), 6).alias("boost")),
    *_CAND,
    sql=f"WITH {D_CAND}, c2 AS (SELECT * REPLACE (rtrim(substr(body, 1, 14)) AS entity_n) FROM cand) SELECT query_id, id, round(CAST({D_ENTITY} AS DOUBLE), 6) AS boost FROM c2",
)
#: Marks that occur in these tables' queries.
TYPE_MARKS = {"history": ("the ", "of "), "overview": (" in ", " to "), "fact": ("and",), "generic": ("license",)}
INTENT_MARKS = {"history": (0.08, ("the ",)), "overview": (0.10, (" in ",))}
TOPIC_MARKS = {"en": (0.04, ("and",))}
_has = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def d_type(marks: dict) -> str:
    return "CASE WHEN " + " OR ".join(f"(chunk_type = '{n}' AND {_has('query', ws)})" for n, ws in marks.items()) + " THEN 0.12 WHEN chunk_type IN ('overview', 'fact') THEN 0.03 ELSE 0.0 END"


D_TYPE = d_type(TYPE_MARKS)
P.add("r10_type_boost", lambda q, d, c: candidates(q, d, c).select("query_id", "id", S.type_boost(F.col("query"), F.col("chunk_type"), TYPE_MARKS).alias("boost")), *_CAND, sql=f"WITH {D_CAND} SELECT query_id, id, CAST({D_TYPE} AS DOUBLE) AS boost FROM cand")


def _terms(rows):
    """Search terms and bigrams of the text, normalised, as the metadata's terms."""
    rows = rows.withColumn("_w", F.slice(F.array_distinct(T.keyword_terms("text")), 1, 28))
    pairs = F.when(F.size("_w") >= 2, F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("terms", F.concat("_w", pairs)).drop("_w")


def _metadata():
    return S.metadata_boost(F.col("query"), F.col("terms"), F.array("chunk_type"), F.array("domain"), INTENT_MARKS, TOPIC_MARKS)


_parts = "list_filter(string_split(t, ' '), lambda x: length(x) >= 3)"
_held = f"((contains(t, ' ') AND contains(query, t)) OR (len({_parts}) > 0 AND len(list_filter({_parts}[1:4], lambda x: NOT contains(query, x))) = 0))"
D_META = f"""least(0.18, 0.06 * len(list_filter(terms, lambda t: length(t) >= 3 AND {_held}))) + least(0.10, 0.025 * len(list_filter(terms, lambda t: length(t) >= 3 AND NOT {_held} AND len(list_filter({_parts}, lambda x: contains(query, x))) > 0)))
    + {' + '.join(f"CASE WHEN {c} = '{n}' AND {_has('query', ws)} THEN {v} ELSE 0.0 END" for c, table in (('chunk_type', INTENT_MARKS), ('domain', TOPIC_MARKS)) for n, (v, ws) in table.items())}"""
D_TERMED = f"""c1 AS (SELECT *, {d_terms('text', STOP)} AS w0 FROM cand), c3 AS (SELECT * EXCLUDE (w0), list_filter(w0, lambda x, i: list_position(w0, x) = i)[1:28] AS w FROM c1),
        c2 AS (SELECT *, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS terms FROM c3)"""
P.add(
    "r11_metadata_boost",
    lambda q, d, c: _terms(candidates(q, d, c)).select("query_id", "id", F.round(_metadata(), 6).alias("boost")),
    *_CAND,
    sql=f"WITH {D_CAND}, {D_TERMED} SELECT query_id, id, round(CAST({D_META} AS DOUBLE), 6) AS boost FROM c2",
)
P.add("r12_priority_boost", lambda c: c.select("id", S.priority_boost(F.col("priority")).alias("boost")), "corpus_v", sql="SELECT id, greatest(0, least(100, priority)) / 1000 AS boost FROM corpus_v")

CONTRAST = [
    {"query_any": ["the", "of"], "query_none": ["by"], "text_any": ["that", "this"], "text_none": ["from"], "type": None, "delta": 0.08},
    {"query_any": ["with", "and"], "text_any": ["for"], "type": "history", "delta": -0.06},
    {"query_any": ["in"], "text_none": ["license"], "type": "overview", "delta": 0.04},
]


def d_any(x: str, words: list[str]) -> str:
    return _has(x, words)


def d_contrast() -> str:
    out = []
    for r in CONTRAST:
        hold = [d_any("query", r["query_any"])]
        hold += [f"NOT {d_any('query', r['query_none'])}"] if r.get("query_none") else []
        hold += [d_any("body", r["text_any"])] if r.get("text_any") else []
        hold += [f"NOT {d_any('body', r['text_none'])}"] if r.get("text_none") else []
        hold += [f"chunk_type = '{r['type']}'"] if r["type"] else []
        out.append(f"CASE WHEN {' AND '.join(hold)} THEN {r['delta']} ELSE 0.0 END")
    return " + ".join(out)


def _contrast(rows):
    return S.contrast_boost(rows.drop("text").withColumnRenamed("body", "text"), CONTRAST)


P.add("r13_contrast_boost", lambda q, d, c: _contrast(candidates(q, d, c)).select("query_id", "id", F.round("contrast", 6).alias("boost")), *_CAND, sql=f"WITH {D_CAND} SELECT query_id, id, round(CAST({d_contrast()} AS DOUBLE), 6) AS boost FROM cand")
_qd = "list_distinct(list_filter(q_words, lambda t: t <> ''))"
D_SEED_SCORE = f"""(len(list_intersect({_qd}, string_split(both_, ' '))) / greatest(1, len({_qd})) + CASE WHEN query <> '' AND contains(both_, query) THEN 0.25 ELSE 0.0 END
    + 0.06 * {d_hits("list_filter(q_words, lambda t: length(t) >= 4)", 'both_')} + CASE WHEN source_kind = 'seed' THEN 0.1 ELSE 0.05 END)"""


def _seed_score():
    return S.lexical_seed_score(F.col("query"), F.col("q_words"), F.concat_ws(" ", "title_n", "body"), F.when(F.col("source_kind") == "seed", 0.1).otherwise(0.05))


P.add(
    "r14_lexical_seed_score",
    lambda q, d, c: candidates(q, d, c).select("query_id", "id", F.round(_seed_score(), 6).alias("score")),
    *_CAND,
    sql=f"WITH {D_CAND}, c2 AS (SELECT *, title_n || ' ' || body AS both_ FROM cand) SELECT query_id, id, round({D_SEED_SCORE}, 6) AS score FROM c2",
)


def _pool(q, docs, corpus):
    rows = fused(q, docs, 20).withColumn("id", F.concat(F.lit("d"), F.col("id")))  # max(4 * 5, 12)
    return rows.join(corpus.select("id", "dedupe_key", F.lit("").alias("parent"), F.col("entity_name").alias("entity"), "chunk_type"), "id")


P.add("r15_diversified_topk", lambda q, d, c: S.diversified(_pool(q, d, c), 5).select("query_id", "id", "rank", F.round("score", 6).alias("score")), *_CAND)


#: Queries whose scores of a chunk travel as one row of 8 bytes each.
TOGETHER = 512


def chunk_search(q, docs, corpus, scope=None, k=5, vectors=None):
    """Fusion of the text signals (and of ``vectors``: query_id, id, score, where there are any) over the chunks in scope, all boosts on every chunk that shares a term, greedy pick.

    The text signals of a chunk come as one row with the scores of all queries, and the chunk's text is read once for all of them; only the best of each query leave a task.
    """
    inside = corpus if scope is None else corpus.where(scope)
    docs = docs.join(inside.select("doc_id"), "doc_id", "left_semi")
    plain = lambda x: F.regexp_extract_all(T.norm(x), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    bare, full = V.build(docs, TOKENS(), "doc_id", 2, True), V.build(docs, plain("text"), "doc_id", 2, True)
    own = {"tfidf": S.FUSION["tfidf_ascii"], "overlap": S.FUSION["overlap"], "bm25": S.FUSION["bm25"]}
    total = sum(own.values()) + S.FUSION["tfidf"] + (0.0 if vectors is None else S.FUSION["vector"])
    weights = {"bare": sum(own.values()) / total, "full": S.FUSION["tfidf"] / total}
    words = stored(I.keyword_dictionary(docs, TERMS(), "doc_id").select("term", "idf"), "words")
    keywords = stored(I.keyword_weights(docs, TERMS(), "doc_id", words=words).select("id", "term", "weight"), "keywords")
    chunks = _terms(spread(inside)).select(
        "id", T.norm_ascii("text").alias("body"), T.norm_ascii("title").alias("title"), T.norm_ascii("entity_name").alias("entity"), "chunk_type", "domain",
        S.priority_boost(F.col("priority")).cast("double").alias("base"), "terms",
    )
    if vectors is not None:
        given = S.minmax(vectors, ("query_id",)).select("id", "query_id", (F.col("unit") * (S.FUSION["vector"] / total)).alias("score"))
    q = q.where("query_id is not null").dropDuplicates(["query_id"])
    groups, pool = max(1, -(-q.count() // TOGETHER)), None
    for g in range(groups):
        part = q if groups == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        part = part.select("query_id", "query", T.norm_ascii("query").alias("norm"), F.array_distinct(Q_TERMS()).alias("asked"))
        names = [r.query_id for r in part.select("query_id").orderBy("query_id").collect()]
        asked = part.select("query_id", F.explode("asked").alias("term"))
        norms = asked.join(words, "term", "left").groupBy("query_id").agg(F.sum(F.greatest(F.lit(0.05), F.coalesce("idf", F.lit(0.0)))).alias("norm"))
        named = lambda rows: rows.withColumn("id", F.concat(F.lit("d"), F.col("id")))
        rows = chunks.join(named(V.fused_vectors(bare, part, Q_TOKENS(), own, names)).withColumnRenamed("scores", "bare"), "id", "left")
        rows = rows.join(named(V.fused_vectors(full, part, plain("query"), {"tfidf": S.FUSION["tfidf"]}, names)).withColumnRenamed("scores", "full"), "id", "left")
        own_words = keywords.join(asked.select("term").distinct(), "term", "left_semi").groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("keywords"))
        rows = rows.join(named(own_words), "id", "left")
        if vectors is None:
            rows = rows.withColumn("given", F.lit(None).cast("array<struct<query_id: string, score: double>>"))
        else:
            rows = rows.join(named(given.join(part.select("query_id"), "query_id").groupBy("id").agg(F.collect_list(F.struct("query_id", "score")).alias("given"))), "id", "left")
        met = C.boosted(rows, part.select("query_id", F.col("norm").alias("query"), "asked"), names, weights, dict(map(tuple, norms.collect())), max(4 * k, 12), PREFIXES, TYPE_MARKS, INTENT_MARKS, TOPIC_MARKS, CONTRAST)
        pool = met if pool is None else pool.unionByName(met)
    pool = kept(pool, bare, full)
    release(words, keywords)
    rows = pool.join(inside.select("id", "dedupe_key", F.lit("").alias("parent"), F.col("entity_name").alias("entity"), "chunk_type"), "id")
    return S.diversified(rows, k)


P.add("r16_chunk_search", lambda q, d, c: chunk_search(q, d, c, F.col("domain") == "en").select("query_id", "id", "rank", F.round("score", 6).alias("score")), *_CAND)
P.add(
    "r17_scope_tiers",
    lambda c: c.select("domain", F.col("entity_name").alias("doc"), F.when(F.substring("entity_name", 4, 9).cast("int") < 7, 1).when(F.substring("entity_name", 4, 9).cast("int") < 14, 2).otherwise(3).alias("tier")).groupBy("domain", "tier", "doc").agg(F.count("*").alias("chunks")),
    "corpus_v",
    sql="""SELECT domain, CASE WHEN CAST(substr(entity_name, 4, 9) AS INT) < 7 THEN 1 WHEN CAST(substr(entity_name, 4, 9) AS INT) < 14 THEN 2 ELSE 3 END AS tier, entity_name AS doc, count(*) AS chunks FROM corpus_v GROUP BY ALL""",
)
P.add(
    "r18_tiered_search",
    lambda q, docs: S.tiered(fused(q, docs, 5, {"bm25": 1.0}, F.col("id") % 3).select("query_id", "id", "score", (F.col("id") % 3 + 1).alias("tier"))).select("query_id", "tier", "id", "rank", F.round("score", 6).alias("score")),
    "queries_v",
    "documents",
    sql=f"""WITH {D_SCORE}, {d_unit('bm')}, t AS (SELECT query_id, id, unit AS score, id % 3 + 1 AS tier, CAST(row_number() OVER (PARTITION BY query_id, id % 3 ORDER BY round(unit, 9) DESC, id) AS INTEGER) AS rank FROM u_bm QUALIFY rank <= 5),
        b AS (SELECT query_id, tier, max(score) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM t GROUP BY ALL),
        l AS (SELECT query_id, min(CASE WHEN top >= 0.72 OR (top >= 0.56 AND second >= 0.46) THEN tier END) AS last FROM b GROUP BY query_id)
        SELECT query_id, tier, id, rank, round(score, 6) AS score FROM t JOIN l USING (query_id) WHERE last IS NULL OR tier <= last""",
)


def _merged(q, docs, corpus, k=8):
    rows = candidates(q, docs, corpus)
    one = rows.select("query_id", "id", F.col("dedupe_key").alias("key"), (F.col("score") / 100).alias("score"))
    two = rows.select("query_id", "id", F.col("dedupe_key").alias("key"), _seed_score().alias("score"))
    return S.merge_dedupe([one, two], k)


D_MERGED = f"""{D_CAND}, c2 AS (SELECT *, title_n || ' ' || body AS both_ FROM cand), un AS (SELECT query_id, id, dedupe_key AS key, score / 100 AS score FROM c2 UNION ALL SELECT query_id, id, dedupe_key, {D_SEED_SCORE} FROM c2),
    b1 AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY round(score, 9) DESC, id) = 1),
    merged AS (SELECT query_id, id, key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM b1 QUALIFY rank <= 8)"""


def pooled(q, docs, corpus, k, index=None):
    """Seed search over all seeds of the query's domain and fused search over all chunks, the k best of each, merged."""
    both = F.concat_ws(" ", T.norm_ascii("title"), T.norm_ascii("text"))
    seeds = C.seed_search(corpus.where("source_kind = 'seed'"), q, both, F.lit(0.1), k)
    chunks = fused(q, docs, k, index=index).select("query_id", F.concat(F.lit("d"), F.col("id")).alias("id"), "score")
    rows = seeds.unionByName(chunks).join(corpus.select("id", F.col("dedupe_key").alias("key")), "id")
    return S.merge_dedupe([rows.select("query_id", "id", "key", "score")], k)


def d_pooled(k: int) -> str:
    """CTEs up to pool: the k best of pooled."""
    own = D_SEED_SCORE.replace("CASE WHEN source_kind = 'seed' THEN 0.1 ELSE 0.05 END", "0.1")
    return f"""sq AS (SELECT query_id, domain, {d_ascii('query')} AS query, string_split({d_ascii('query')}, ' ') AS q_words FROM queries_v), sb AS (SELECT id, domain, {d_ascii('title')} || ' ' || {d_ascii('text')} AS both_ FROM corpus_v WHERE source_kind = 'seed'),
    ss AS (SELECT query_id, id, CAST({own} AS DOUBLE) AS score FROM sq JOIN sb USING (domain)), s1 AS (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {k}),
    f1 AS (SELECT query_id, 'd' || id AS id, score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fused.id) <= {k}),
    pu AS (SELECT u.*, coalesce(nullif(c.dedupe_key, ''), u.id) AS key FROM (SELECT * FROM s1 UNION ALL SELECT * FROM f1) u JOIN corpus_v c USING (id)),
    p1 AS (SELECT * FROM pu QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY round(score, 9) DESC, id) = 1),
    pool AS (SELECT query_id, id, key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM p1 QUALIFY rank <= {k})"""


P.add("r19_merge_dedupe", lambda q, d, c: _merged(q, d, c).select("query_id", "id", "rank", F.round("score", 6).alias("score")), *_CAND, sql=f"WITH {D_MERGED} SELECT query_id, id, rank, round(score, 6) AS score FROM merged")
P.add("r20_strong_evidence", lambda q, d: S.strong(fused(q, d, 1), 0.6).select("query_id", F.round("top", 6).alias("top")), "queries_v", "documents", sql=f"WITH {D_FUSED} SELECT query_id, round(max(score), 6) AS top FROM fused GROUP BY query_id HAVING max(score) >= 0.6")
def facets(q, docs):
    """The keywords of the ten best; only those documents are weighed."""
    found = hits(q, docs, 10)
    return S.keyword_facets(found, I.keyword_weights(docs, TERMS(), "doc_id", only=found))


P.add(
    "r21_keyword_facets",
    lambda q, d: facets(q, d).select("query_id", "term", "keyword_id", "hits", F.round("weight", 6).alias("weight"), "rank"),
    "queries_v",
    "documents",
    sql=f"""WITH {D_HITS}, {D_KW}, f AS (SELECT query_id, term, count(*) AS hits, max(weight) AS weight FROM hits JOIN kw USING (id) WHERE hits.rank <= 10 GROUP BY ALL)
        SELECT query_id, term, {D_KEY} AS keyword_id, hits, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, round(weight, 9) DESC, term) AS INTEGER) AS rank FROM f QUALIFY rank <= 24""",
)
P.add(
    "r22_context_pack",
    lambda q, d, c: S.context_pack(candidates(q, d, c).select("query_id", "id", "score", "title", "text")).select("query_id", F.md5("prompt").alias("prompt"), F.length("prompt").cast("long").alias("size")),
    *_CAND,
    sql=f"""WITH {D_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM cand QUALIFY k <= 3),
        p AS (SELECT query_id, string_agg('[' || k || '] ' || title || chr(10) || substr(text, 1, CASE WHEN k = 1 THEN 520 ELSE 300 END), chr(10) ORDER BY k) AS prompt FROM r GROUP BY query_id)
        SELECT query_id, md5(prompt) AS prompt, length(prompt) AS size FROM p""",
)

RANKED = D_HITS + ", rel AS (SELECT DISTINCT query_id, CAST(substr(corpus_id, 2) AS BIGINT) AS id FROM qrels_v), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL), h AS (SELECT rel.query_id, rank FROM rel JOIN hits USING (query_id, id))"
D_METRICS = f"""{RANKED}, m AS (SELECT n.query_id, k, any_value(n) AS n, coalesce(sum(CASE WHEN rank <= k THEN 1 ELSE 0 END), 0) / any_value(n) AS recall, coalesce(1 / min(CASE WHEN rank <= k THEN rank END), 0.0) AS mrr,
    coalesce(sum(CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0 END), 0) / list_sum(list_transform(range(1, least(k, any_value(n)) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
    FROM n CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN h ON h.query_id = n.query_id GROUP BY n.query_id, k)"""


def metrics(q, docs, qrels):
    rel = qrels.select("query_id", F.substring("corpus_id", 2, 20).cast("long").alias("id"))
    return E.rank_metrics(hits(q, docs), rel)


for _name, _m in (("e1_recall_at_k", "recall"), ("e2_mrr_at_k", "mrr"), ("e3_ndcg_at_k", "ndcg")):
    P.add(
        _name,
        lambda q, d, r, m=_m: metrics(q, d, r).select("query_id", F.col("k").cast("int").alias("k"), F.round(m, 6).alias(m)),
        "queries_v",
        "documents",
        "qrels_v",
        sql=f"WITH {D_METRICS} SELECT query_id, CAST(k AS INTEGER) AS k, round(CAST({_m} AS DOUBLE), 6) AS {_m} FROM m",
    )
P.add(
    "e4_metric_breakdown",
    lambda q, d, r: E.breakdown(metrics(q, d, r), q).select("level", "value", F.col("k").cast("int").alias("k"), "queries", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "ndcg")]),
    "queries_v",
    "documents",
    "qrels_v",
    sql=f"""WITH {D_METRICS}, j AS (SELECT m.*, q.origin, q.query_type, q.domain FROM m JOIN queries_v q USING (query_id)), x AS (SELECT 'all' AS level, '' AS value, * FROM j UNION ALL SELECT 'origin', origin, * FROM j
        UNION ALL SELECT 'query_type', query_type, * FROM j UNION ALL SELECT 'domain', domain, * FROM j)
        SELECT level, value, CAST(k AS INTEGER) AS k, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM x GROUP BY level, value, k""",
)


def flagship(q, docs, qrels):
    """BM25 top ten with the relevance of each hit."""
    top = hits(q, docs, 10)
    rel = qrels.select("query_id", F.substring("corpus_id", 2, 20).cast("long").alias("id"), F.lit(True).alias("relevant")).distinct()
    return top.join(rel, ["query_id", "id"], "left").select("query_id", "id", "rank", F.round("score", 6).alias("score"), F.coalesce("relevant", F.lit(False)).alias("relevant"))
