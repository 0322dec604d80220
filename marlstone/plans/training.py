"""D, E5-E10, R23-R29: retriever training data, answer checks, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import classify as Q
from ..operators import entities as N
from ..operators import evaluate as E
from ..operators import inverted as V
from ..operators import pages as G
from ..operators import retriever_data as D
from ..operators import scan as A
from ..operators import search as S
from ..operators.classify import Rule
from ..sources.tables import release, stored
from .common import Plans, d_alnum, d_ascii, d_bucket, d_norm, d_words, d_ws
from .corpus import D_LINES
from .preference import D_CAND as D_XCAND
from .preference import D_DEDUPE, D_LAST, D_PAIRS, d_reward, deduped, pairs, with_reward
from .sessions import STEPS, d_label, d_rule
from .retrieval import D_CAND, D_FUSED, D_HITS, D_KEYS, D_MERGED, D_SEED_SCORE, TOKENS, _merged, _seed_score, candidates, d_pooled, fused, hits, pooled

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
_CAND = ("queries_v", "documents", "corpus_v")
COMMON = ("the", "of", "and", "to", "in", "is", "a")
_join = lambda c: F.array_join(c, "|")
_toks = lambda x: T.alnum_tokens(x, 2)
d_toks = lambda x: f"list_filter({d_alnum(x)}, lambda t: length(t) >= 2)"

P.add(
    "d1_corpus_union",
    lambda c: D.corpus_union(c.where("source_kind = 'seed'").select("id", "domain", "text", "source_kind"), c.where("source_kind = 'local'").select("id", "domain", "text", "title", "source_kind")).select("id", "domain", "title", "source_kind"),
    "corpus_v",
    sql="SELECT id, domain, CASE WHEN source_kind = 'local' THEN title END AS title, source_kind FROM corpus_v WHERE trim(text) <> ''",
)


def usable(t, r, f):
    from ..operators.preference import latest

    return D.usable_turns(t, r, latest(f, "turn_id", "updated_at", "seq"))


_has = lambda *xs: f"list_has_any(coalesce(v.verdicts, []), [{', '.join(repr(x) for x in xs)}])"
D_FACTS = f"""vd AS (SELECT turn_id, list(DISTINCT verdict) AS verdicts FROM reviews_v WHERE review_kind = 'answer' GROUP BY turn_id),
    ft AS (SELECT t.*, coalesce(f.rating, 0) AS rating, {_has('correct')} AS correct, {_has('partial', 'missing')} AS half, {_has('incorrect', 'excessive')} AS bad FROM facts_v t LEFT JOIN ({D_LAST}) f USING (turn_id) LEFT JOIN vd v USING (turn_id))"""
D_USABLE = f"""{D_FACTS}, us AS (SELECT turn_id, CASE WHEN {d_ws('question')} = '' THEN 'empty_question' WHEN top_score IS NULL THEN 'no_contexts' WHEN route IN ({', '.join(repr(x) for x in D.BAD_ROUTES)}) THEN 'bad_route:' || route
    WHEN bad THEN 'review_rejected' WHEN rating IN (1, 2) THEN 'feedback_rejected'
    WHEN CASE WHEN rating >= 4 THEN 2 WHEN rating = 3 THEN 1 ELSE 0 END + CASE WHEN correct THEN 2 WHEN half THEN 1 ELSE 0 END + CASE WHEN top_score >= 0.75 THEN 2 WHEN top_score >= 0.55 THEN 1 ELSE 0 END
        + CASE WHEN domain IN ('', 'general_docs') THEN 0 ELSE 1 END < 2 THEN 'low_confidence' ELSE 'ok' END AS reason FROM ft)"""
_TRF = ("facts_v", "reviews_v", "feedback_v")
P.add("d2_usable_turns", usable, *_TRF, sql=f"WITH {D_USABLE} SELECT turn_id, reason = 'ok' AS usable, reason FROM us")


def quality(t, r, f):
    from ..operators.preference import latest

    rows = t.join(latest(f, "turn_id", "updated_at", "seq").select("turn_id", "rating"), "turn_id", "left").join(D.verdicts_of(r), "turn_id", "left")
    return D.query_quality(rows.withColumn("origin", F.when(F.col("domain") == "general_docs", "seed_qa").otherwise("history")))


P.add(
    "d3_query_quality",
    lambda t, r, f: quality(t, r, f).select("turn_id", F.round("quality", 4).alias("quality")),
    *_TRF,
    sql=f"""WITH {D_FACTS} SELECT turn_id, CASE WHEN domain = 'general_docs' THEN 1.0e0 ELSE round(CAST(least(1.0, 0.45 + CASE WHEN rating >= 4 THEN 0.20 WHEN rating = 3 THEN 0.08 ELSE 0 END + CASE WHEN correct THEN 0.22 WHEN half THEN 0.10 ELSE 0 END
        + CASE WHEN top_score >= 1.0 THEN 0.13 WHEN top_score >= 0.7 THEN 0.08 WHEN top_score >= 0.5 THEN 0.04 ELSE 0 END) AS DOUBLE), 4) END AS quality FROM ft""",
)
P.add(
    "d4_context_resolve",
    lambda x, c: D.resolve_contexts(x, c).select("context_id", "id", "score"),
    "contexts_v",
    "corpus_v",
    sql=f"""WITH k AS ({D_KEYS}), kn AS (SELECT context_id, source_id AS id FROM contexts_v WHERE source_id IN (SELECT id FROM corpus_v)),
        x AS (SELECT *, {d_ascii('title')} AS t, {d_ascii('question')} AS q, {d_ascii('answer')} AS a, {d_ascii('text')} AS b FROM contexts_v WHERE context_id NOT IN (SELECT context_id FROM kn)),
        c AS (SELECT *, {d_ascii('title')} AS ct, {d_ascii('question')} AS cq, {d_ascii('text')} AS cb FROM corpus_v),
        ak AS (SELECT context_id, 'dedupe' AS key_kind, dedupe_key AS key FROM x UNION ALL SELECT context_id, 'text', md5(b) FROM x WHERE b <> '' UNION ALL SELECT context_id, 'text', md5(a) FROM x WHERE a <> ''
            UNION ALL SELECT context_id, 'doc_text', md5(doc_id || '::' || b) FROM x WHERE b <> '' AND doc_id IS NOT NULL UNION ALL SELECT context_id, 'title', t FROM x UNION ALL SELECT context_id, 'question', q FROM x),
        f AS (SELECT DISTINCT context_id, id FROM ak JOIN k USING (key_kind, key) WHERE key <> ''),
        s AS (SELECT f.context_id, f.id, round(CAST(CASE WHEN x.doc_id = c.doc_id THEN 1.0 ELSE 0 END + CASE WHEN x.kind = c.source_kind THEN 0.6 ELSE 0 END + CASE WHEN t <> '' AND t = ct THEN 0.9 ELSE 0 END + CASE WHEN q <> '' AND q = cq THEN 1.2 ELSE 0 END
            + CASE WHEN a <> '' AND a = cb THEN 1.0 ELSE 0 END + CASE WHEN b <> '' AND b = cb THEN 0.8 ELSE 0 END AS DOUBLE), 6) AS score FROM f JOIN x USING (context_id) JOIN c ON c.id = f.id)
        SELECT context_id, id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY score DESC, id DESC) = 1 UNION ALL SELECT context_id, id, NULL FROM kn""",
)


def positives(q, d, index=None):
    return D.history_positives(hits(q, d, 8, index).drop("rank")).withColumn("id", F.concat(F.lit("d"), F.col("id")))


D_POS = f"""{D_HITS}, h8 AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS t FROM hits WHERE rank <= 8),
    pos AS (SELECT query_id, 'd' || id AS id, rank FROM h8 WHERE (rank = 1 OR score >= greatest(0.32, 0.68 * t)) AND rank <= 2)"""
P.add("d5_history_positives", positives, "queries_v", "documents", sql=f"WITH {D_POS} SELECT query_id, id, rank FROM pos")
_own = f"list_filter(q_tokens, lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(c) for c in COMMON)}))"
P.add(
    "d6_positive_match",
    lambda q, d, c: D.positive_match(candidates(q, d, c), F.col("q_tokens"), COMMON).select("query_id", "id"),
    *_CAND,
    sql=f"WITH {D_CAND} SELECT query_id, id FROM cand WHERE len({_own}) = 0 OR len(list_filter({_own}, lambda t: contains(title_n || ' ' || entity_n || ' ' || body || ' ' || question_n, t))) > 0",
)


def expanded(q, d, c):
    asked = q.select("query_id", "query_type", T.alnum_tokens("query").alias("tokens"))
    return D.positive_expand(positives(q, d), asked, c.withColumn("summary", F.substring("text", 1, 100)), COMMON)


_types = lambda t, c: "CASE " + " ".join(f"WHEN {t} = '{n}' THEN {c} IN ({', '.join(repr(x) for x in xs)})" for n, xs in D.ACCEPTED.items() if n != "generic") + f" ELSE {c} IN ({', '.join(repr(x) for x in D.ACCEPTED['generic'])}) END"
P.add(
    "d7_positive_expand",
    expanded,
    *_CAND,
    sql=f"""WITH {D_POS}, b AS (SELECT query_id, domain, {d_ascii('entity_name')} AS e FROM pos JOIN corpus_v USING (id)),
        c AS (SELECT *, {d_ascii('entity_name')} AS entity_n, {d_ascii('title')} AS title_n, {d_ascii('text')} AS body, {d_ascii('question')} AS question_n, {d_ascii('substr(text, 1, 100)')} AS summary FROM corpus_v),
        m AS (SELECT q.query_id, q.query_type, c.*, {d_alnum('q.query')} AS q_tokens, {_types('q.query_type', 'c.chunk_type')} AS fits FROM (SELECT DISTINCT query_id, e FROM b WHERE e <> '') x JOIN c ON c.entity_n = x.e JOIN queries_v q USING (query_id)
            WHERE (query_id, c.domain) IN (SELECT query_id, domain FROM b) AND (query_id, c.id) NOT IN (SELECT query_id, id FROM pos)),
        k AS (SELECT query_id, id, round(CAST(CASE WHEN source_kind = 'seed' THEN 0.25 ELSE 0 END + CASE WHEN fits THEN 0.30 ELSE 0 END + CASE WHEN query_type <> 'generic' AND chunk_type = query_type THEN 0.35 ELSE 0 END + CASE WHEN body <> '' AND body <> summary THEN 0.05 ELSE 0 END AS DOUBLE), 6) AS score
            FROM m WHERE (chunk_type = '' OR fits) AND (len({_own}) = 0 OR len(list_filter({_own}, lambda t: contains(title_n || ' ' || entity_n || ' ' || body || ' ' || question_n, t))) > 0))
        SELECT query_id, id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) <= 3""",
)


def seed_qa(t):
    return t.select(F.col("turn_id").alias("origin_id"), "question", F.array(F.substring("question", 1, 40), F.substring("answer", 1, 50)).alias("variants"))


P.add(
    "d8_seed_queries",
    lambda t: D.seed_queries(seed_qa(t)),
    "turns",
    sql=f"""WITH v AS (SELECT turn_id AS origin_id, question, 0 AS pos, {d_ws('question')} AS query FROM turns UNION ALL SELECT turn_id, question, 1, {d_ws('substr(question, 1, 40)')} FROM turns UNION ALL SELECT turn_id, question, 2, {d_ws('substr(answer, 1, 50)')} FROM turns)
        SELECT origin_id, query, pos FROM v WHERE length(query) >= 6 AND (pos = 0 OR NOT contains({d_norm('question')}, {d_norm('query')})) QUALIFY row_number() OVER (PARTITION BY origin_id ORDER BY pos) <= 3""",
)


def history_queries(t, r, f, d):
    """Usable turns whose question finds documents: their best positives."""
    ok = usable(t, r, f).where("usable").select("turn_id")
    q = t.join(ok, "turn_id").select(F.col("turn_id").alias("query_id"), F.col("question").alias("query"))
    return positives(q, d)


_D_HQ = D_POS.replace("SELECT query_id, list_filter", "SELECT turn_id AS query_id, list_filter").replace(d_alnum("query"), d_alnum("question")).replace("FROM queries_v)", "FROM turns WHERE turn_id IN (SELECT turn_id FROM us WHERE reason = 'ok'))")
P.add("d9_history_queries", history_queries, *_TRF, "documents", sql=f"WITH {D_USABLE}, {_D_HQ} SELECT query_id, id, rank FROM pos")
P.add(
    "d10_candidate_pool",
    lambda q, d, c: pooled(q, d, c, 8).select("query_id", "id", "key", "rank", F.round("score", 6).alias("score")),
    *_CAND,
    sql=f"WITH {D_FUSED}, {d_pooled(8)} SELECT query_id, id, key, rank, round(score, 6) AS score FROM pool",
)


_long = lambda x: F.filter(F.split(T.norm_ascii(x), " "), lambda t: F.length(t) >= 3)
_whole = lambda: F.concat_ws(" ", "title", "entity_name", "text", "question")


def lexical(q, d, c, pos=None):
    return D.lexical_negatives(q, _long("query"), c, _long(_whole()), positives(q, d) if pos is None else pos)


_D3 = lambda x: f"list_distinct(list_filter(string_split({d_ascii(x)}, ' '), lambda t: length(t) >= 3))"
D_LEX = f"""{D_POS}, lq AS (SELECT query_id, domain AS q_domain, query_type AS asked, {_D3('query')} AS t FROM queries_v), ld AS (SELECT id, unnest({_D3("title || ' ' || entity_name || ' ' || text || ' ' || question")}) AS term FROM corpus_v),
    ls AS (SELECT query_id, q_domain, asked, id, count(*) / any_value(n) AS overlap FROM (SELECT *, len(t) AS n, unnest(t) AS term FROM lq) JOIN ld USING (term) GROUP BY ALL),
    np AS (SELECT query_id, c.*, {d_ascii('entity_name')} AS e FROM pos JOIN corpus_v c USING (id)),
    lx0 AS (SELECT ls.query_id, ls.id, round(CAST(overlap + CASE WHEN c.domain = q_domain THEN 0.18 ELSE 0 END + CASE WHEN c.chunk_type = asked THEN 0.16 ELSE 0 END
        - CASE WHEN {d_ascii('c.entity_name')} <> '' AND (ls.query_id, {d_ascii('c.entity_name')}) IN (SELECT query_id, e FROM np) THEN 0.22 ELSE 0 END + CASE WHEN (ls.query_id, c.domain) IN (SELECT query_id, domain FROM np) THEN 0.05 ELSE 0 END AS DOUBLE), 9) AS score,
        CASE WHEN c.chunk_type = asked THEN 'same_type' WHEN c.domain = q_domain THEN 'same_domain' ELSE 'lexical' END AS source
        FROM ls JOIN corpus_v c USING (id) WHERE (ls.query_id, ls.id) NOT IN (SELECT query_id, id FROM np) AND (ls.query_id, c.dedupe_key) NOT IN (SELECT query_id, dedupe_key FROM np)),
    lex AS (SELECT * FROM lx0 WHERE score >= 0.18)"""
P.add("d11_lexical_negatives", lambda q, d, c: lexical(q, d, c).select("query_id", "id", "source", F.round("score", 6).alias("score")), *_CAND, sql=f"WITH {D_LEX} SELECT query_id, id, source, round(score, 6) AS score FROM lex")
#: Retrieved candidates of a query: six for each negative wanted.
POOL = 48
NEGATIVES = 8


def judged(q, d, c):
    """Positives and hard negatives, each made once; BM25 and the fusion search the same index of the documents.

    Retrieved negatives come before lexical ones, so only queries that lack some of the former are searched for the latter.
    """
    index = V.build(d, TOKENS(), "doc_id", grams=2, norms=True)
    pos = stored(positives(q, d, index), "positives")
    got = stored(pooled(q, d, c, POOL, index).select("query_id", "id", "score"), "pool")
    index.release()
    found = stored(D.retrieved_negatives(got, q, c, pos), "retrieved")
    release(got)
    neg = stored(D.hard_negatives(found, lexical(D.short_of(q, found, NEGATIVES), d, c, pos), NEGATIVES), "negatives")
    release(found)
    return pos, neg


def negatives(q, d, c):
    return judged(q, d, c)[1]


_lex_after = D_LEX[len(D_HITS) + 2 :]  # D_FUSED has the first steps of D_HITS
D_NEG = f"""{D_FUSED}, hits AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 20), {_lex_after}, {d_pooled(POOL)},
    rn AS (SELECT p.query_id, p.id, p.score FROM pool p JOIN corpus_v c USING (id) JOIN queries_v q USING (query_id) WHERE (p.query_id, p.id) NOT IN (SELECT query_id, id FROM np) AND (p.query_id, c.dedupe_key) NOT IN (SELECT query_id, dedupe_key FROM np)
        AND NOT ((p.query_id, {d_ascii('c.entity_name')}) IN (SELECT query_id, e FROM np WHERE e <> '') AND {_types('q.query_type', 'c.chunk_type')})),
    n0 AS (SELECT query_id, id, 'retrieval' AS source, score, 0 AS s FROM rn UNION ALL SELECT query_id, id, source, score, 1 FROM lex),
    n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY s) = 1),
    neg AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, round(score, 9) DESC, CASE WHEN s = 0 THEN id END, id DESC) AS INTEGER) AS rank FROM n1 QUALIFY rank <= 8)"""
P.add("d12_hard_negatives", lambda q, d, c: negatives(q, d, c).select("query_id", "id", "source", "rank", F.round("score", 6).alias("score")), *_CAND, sql=f"WITH {D_NEG} SELECT query_id, id, source, rank, round(CAST(score AS DOUBLE), 6) AS score FROM neg")
P.add("d13_id_split", lambda q: q.select("query_id", D.id_split(F.col("query_id")).alias("split")), "queries_v", sql=f"SELECT query_id, CASE WHEN {d_bucket('query_id')} % 10000 < 1500 THEN 'val' ELSE 'train' END AS split FROM queries_v")
P.add("d14_qrels", lambda q, d: D.qrels(positives(q, d)), "queries_v", "documents", sql=f"WITH {D_POS} SELECT DISTINCT query_id, id, 1 AS label FROM pos")
D_PAIRED = f"""{D_NEG}, pr0 AS (SELECT query_id, id, 1 AS label FROM pos WHERE query_id IN (SELECT query_id FROM neg) UNION ALL SELECT query_id, id, 0 FROM neg),
    pr AS (SELECT DISTINCT 'pair-' || substr(sha1(query_id || chr(0) || id || chr(0) || label || chr(0)), 1, 16) AS pair_id, query_id, id, label FROM pr0)"""
P.add("d15_reranker_pairs", lambda q, d, c: D.reranker_pairs(*judged(q, d, c)), *_CAND, sql=f"WITH {D_PAIRED} SELECT * FROM pr")
P.add("d16_triplets", lambda q, d, c: D.triplets(*judged(q, d, c)), *_CAND, sql=f"WITH {D_NEG} SELECT 'tri-' || substr(sha1(p.query_id || chr(0) || p.id || chr(0) || n.id || chr(0)), 1, 16) AS triplet_id, p.query_id, p.id AS positive_id, n.id AS negative_id FROM pos p JOIN neg n USING (query_id)")
P.add(
    "d17_dataset_summary",
    lambda q, d, c: D.counts_by(negatives(q, d, c).join(q, "query_id"), ["source", "origin", "query_type", "domain"]),
    *_CAND,
    sql=f"""WITH {D_NEG}, j AS (SELECT neg.source, q.* FROM neg JOIN queries_v q USING (query_id)) SELECT 'all' AS dim, '' AS value, count(*) AS n FROM j UNION ALL {' UNION ALL '.join(f"SELECT '{x}', {x}, count(*) FROM j GROUP BY {x}" for x in ('source', 'origin', 'query_type', 'domain'))}""",
)
D_HARD = """(SELECT query_id, CASE WHEN count(CASE WHEN score > 0 THEN 1 END) = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, ln(1 + avg(CASE WHEN score > 0 THEN score END)) / ln(4))) END AS hard FROM neg GROUP BY query_id)"""
_weight = lambda hard: f"round(CAST(greatest(0.15, least(1.25, quality * (0.75 + 0.5 * round({hard}, 6)) * CASE WHEN origin = 'seed_qa' THEN 1 ELSE 0.92 END)) AS DOUBLE), 6)"
D_WEIGHT = f"{_weight('hard')} AS weight"
P.add(
    "d18_difficulty_weight",
    lambda q, d, c: negatives(q, d, c)
    .groupBy("query_id")
    .agg(D.difficulty(F.collect_list("score")).alias("hard"))
    .join(q, "query_id")
    .select("query_id", F.round("hard", 6).alias("difficulty"), F.round(D.weight(F.col("quality"), F.col("hard"), F.col("origin")), 6).alias("weight")),
    *_CAND,
    sql=f"WITH {D_NEG} SELECT query_id, round(CAST(hard AS DOUBLE), 6) AS difficulty, {D_WEIGHT} FROM {D_HARD} JOIN queries_v USING (query_id)",
)
P.add(
    "d19_beir_export",
    lambda q, d, c: q.select(F.col("query_id").alias("_id"), F.lit("query").alias("part"), F.md5("query").alias("text"))
    .unionByName(c.select(F.col("id").alias("_id"), F.lit("corpus").alias("part"), F.md5(F.concat_ws("\n", "title", "text")).alias("text")))
    .unionByName(D.qrels(positives(q, d)).select(F.concat_ws("\t", "query_id", "id").alias("_id"), F.lit("qrels").alias("part"), F.lit("1").alias("text"))),
    *_CAND,
    sql=f"WITH {D_POS} SELECT query_id AS _id, 'query' AS part, md5(query) AS text FROM queries_v UNION ALL SELECT id, 'corpus', md5(title || chr(10) || text) FROM corpus_v UNION ALL SELECT DISTINCT query_id || chr(9) || id, 'qrels', '1' FROM pos",
)


def bi(q, c, pos, neg):
    return D.bi_encoder(q, pos, neg, c)


P.add(
    "d20_bi_encoder_export",
    lambda q, d, c: bi(q, c, *judged(q, d, c)).select("query_id", F.md5(F.array_join("positives", "\n")).alias("positives"), F.md5(F.array_join("negatives", "\n")).alias("negatives"), F.round("weight", 6).alias("weight")),
    *_CAND,
    sql=f"""WITH {D_NEG}, p AS (SELECT query_id, md5(string_agg(text, chr(10) ORDER BY id)) AS positives FROM (SELECT DISTINCT query_id, id FROM pos) JOIN corpus_v USING (id) GROUP BY query_id),
        n AS (SELECT query_id, md5(string_agg(text, chr(10) ORDER BY id)) AS negatives FROM neg JOIN corpus_v USING (id) GROUP BY query_id) SELECT query_id, positives, negatives, {D_WEIGHT} FROM queries_v JOIN p USING (query_id) JOIN n USING (query_id) JOIN {D_HARD} USING (query_id)""",
)


def cross(q, c, pos, neg):
    return D.cross_encoder(D.reranker_pairs(pos, neg), neg, q, c)


_hard_of = "CASE WHEN n.score > 0 THEN greatest(0.0, least(1.0, ln(1 + n.score) / ln(4))) ELSE 0.5 END"
D_CROSS = f"""{D_PAIRED}, ce AS (SELECT pr.pair_id, pr.query_id, pr.label, c.text, q.quality, {_weight(_hard_of)} AS weight FROM pr JOIN queries_v q USING (query_id) LEFT JOIN neg n ON pr.label = 0 AND n.query_id = pr.query_id AND n.id = pr.id LEFT JOIN corpus_v c ON c.id = pr.id)"""
P.add(
    "d21_cross_encoder_export",
    lambda q, d, c: cross(q, c, *judged(q, d, c)).select("pair_id", "label", F.md5("text").alias("text"), F.round("weight", 6).alias("weight")),
    *_CAND,
    sql=f"WITH {D_CROSS} SELECT pair_id, label, md5(coalesce(text, '')) AS text, round(weight, 6) AS weight FROM ce",
)


def curriculum(q, d, c):
    """Rows of both exports that are sure enough, of queries to train on."""
    of = q.select("query_id", "quality", D.id_split(F.col("query_id")).alias("split"))
    both = judged(q, d, c)
    rows = bi(q, c, *both).select("query_id", F.lit("bi_encoder").alias("part"), F.col("query_id").alias("row_id"), "weight").unionByName(cross(q, c, *both).select("query_id", F.lit("cross_encoder").alias("part"), F.col("pair_id").alias("row_id"), "weight"))
    return D.curriculum(rows.join(of, "query_id"))


P.add(
    "d22_curriculum_slice",
    lambda q, d, c: curriculum(q, d, c).select("part", "row_id", F.round("weight", 6).alias("weight")),
    *_CAND,
    sql=f"""WITH {D_CROSS}, hard AS {D_HARD}, sure AS (SELECT * FROM queries_v WHERE {d_bucket('query_id')} % 10000 >= 1500 AND quality >= 0.9)
        SELECT 'bi_encoder' AS part, query_id AS row_id, {_weight('hard')} AS weight FROM sure JOIN hard USING (query_id) WHERE query_id IN (SELECT query_id FROM pos) UNION ALL SELECT 'cross_encoder', pair_id, round(weight, 6) FROM ce WHERE query_id IN (SELECT query_id FROM sure)""",
)

# E: an answer against the messages before it


D_CTX = "cx AS (SELECT conv_id, turn, role, text AS answer, coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM conversations), ctx AS (SELECT * FROM cx WHERE role = 'assistant')"
_IMP = lambda x: rf"list_distinct(list_filter(regexp_extract_all({d_norm(x)}, '[\p{{L}}\p{{N}}_@./:+-]+'), lambda t: contains(t, '@') OR contains(t, 'http') OR regexp_matches(t, '[0-9]') OR length(t) >= 6))"
P.add(
    "e5_grounding_guard",
    E.grounded_in_conversation,
    "conversations",
    sql=f"""WITH {D_CTX}, i AS (SELECT conv_id, turn, {_IMP('answer')} AS o, {_IMP('context')} AS k FROM ctx)
        SELECT conv_id, turn, len(list_filter(o, lambda t: (contains(t, '@') OR contains(t, 'http') OR regexp_matches(t, '[0-9]')) AND NOT list_contains(k, t))) = 0 AND len(list_filter(o, lambda t: NOT list_contains(k, t))) <= greatest(4, len(o) // 3) AS grounded FROM i""",
)


def checked(t):
    """Turns with token columns, made once."""
    return t.withColumns({"q": T.norm_ascii("question"), "a": T.norm_ascii("answer")}).withColumns({"qt": F.regexp_extract_all("q", F.lit("[a-z0-9]{3,}"), F.lit(0)), "at": F.regexp_extract_all("a", F.lit("[a-z0-9]{3,}"), F.lit(0))})


D_CHECKED = f"ck AS (SELECT *, regexp_extract_all(q, '[a-z0-9]{{3,}}') AS qt, regexp_extract_all(a, '[a-z0-9]{{3,}}') AS ant FROM (SELECT *, {d_ascii('question')} AS q, {d_ascii('answer')} AS a FROM turns))"
d_cover = lambda t, x: f"len(list_filter(list_distinct({t}), lambda t: contains({x}, t))) / greatest(1, len(list_distinct({t})))"
D_FOCUS = "len(list_filter(ant, lambda t: list_contains(qt, t))) / greatest(1, len(ant))"
P.add(
    "e6_coverage",
    lambda t: checked(t).select("turn_id", F.round(E.coverage(F.col("qt"), F.col("a")), 6).alias("query_coverage"), F.round(E.coverage(F.col("at"), F.col("q")), 6).alias("context_coverage")),
    "turns",
    sql=f"WITH {D_CHECKED} SELECT turn_id, round({d_cover('qt', 'a')}, 6) AS query_coverage, round({d_cover('ant', 'q')}, 6) AS context_coverage FROM ck",
)
P.add("e7_focus", lambda t: checked(t).select("turn_id", F.round(E.focus(F.col("at"), F.col("qt")), 6).alias("focus")), "turns", sql=f"WITH {D_CHECKED} SELECT turn_id, round({D_FOCUS}, 6) AS focus FROM ck")
_X = ("turns", "reviews_v", "review_variants_v", "feedback_v", "contrib_v")
_KEPT = r"^(how|steps?)\b"


def _guarded(x: str, y: str) -> str:
    """DuckDB: whether the important tokens ``x`` of an answer are held by those of its context ``y``."""
    return f"(len(list_filter({x}, lambda t: (contains(t, '@') OR contains(t, 'http') OR regexp_matches(t, '[0-9]')) AND NOT list_contains({y}, t))) = 0 AND len(list_filter({x}, lambda t: NOT list_contains({y}, t))) <= greatest(4, len({x}) // 3))"


def ranked_answers(*v):
    """The answer to keep for each turn, of its candidates; the turn's own answer is their context."""
    rows = deduped(*v).join(v[0].select("turn_id", "question", F.col("answer").alias("given")), "turn_id")
    rows = with_reward(rows, "question", "text", "reward").withColumns({"q": T.norm_ascii("question"), "a": T.norm_ascii("text"), "g": T.norm_ascii("given")})
    rows = rows.withColumns({"qt": F.regexp_extract_all("q", F.lit("[a-z0-9]{3,}"), F.lit(0)), "at": F.regexp_extract_all("a", F.lit("[a-z0-9]{3,}"), F.lit(0))})
    rows = rows.withColumn("source", F.when(T.ws("given") == F.col("text"), "original").when(F.col("source") == "feedback", "fallback").otherwise("rule"))
    rows = rows.withColumns({"intent": F.when(F.col("q").rlike(_KEPT), "howto").when(F.length("q") < 60, "factoid").otherwise("list"), "guarded": E.grounded(F.col("text"), F.col("given"))})
    steps = rows.withColumn("x", F.col("a")).withColumn("steps", Q.score(F.col("x"), STEPS))
    parts = (F.col("guarded"), E.coverage(F.col("at"), F.col("g")), E.coverage(F.col("qt"), F.col("a")), E.focus(F.col("at"), F.col("qt")), F.length("text"), F.col("intent"), F.col("steps"), F.col("reward"), F.col("source"))
    scored = steps.withColumns({"total": F.round(E.answer_score(*parts), 9), "pos": F.col("rank"), "norm": F.col("a"), "focus": E.focus(F.col("at"), F.col("qt")), "length": F.length("text")})
    return E.verified_answer(scored, "turn_id").select("turn_id", "answer", "how", F.round("top", 6).alias("top"))


_STEPS = " + ".join(f"CASE WHEN {d_rule(r)} THEN {r.delta} ELSE 0 END" for r in STEPS)
P.add(
    "e8_candidate_rank",
    ranked_answers,
    *_X,
    sql=f"""WITH {D_DEDUPE}, a0 AS (SELECT d.turn_id, d.text, d.rank AS pos, d.source AS came, t.answer AS given, {d_ascii('t.question')} AS q, {d_ascii('d.text')} AS a, {d_ascii('t.answer')} AS g, {_IMP('d.text')} AS o, {_IMP('t.answer')} AS k FROM ded d JOIN turns t USING (turn_id)),
        a1 AS (SELECT *, a AS x, regexp_extract_all(q, '[a-z0-9]{{3,}}') AS qt, regexp_extract_all(a, '[a-z0-9]{{3,}}') AS ant, CASE WHEN {d_ws('given')} = text THEN 'original' WHEN came = 'feedback' THEN 'fallback' ELSE 'rule' END AS source,
            CASE WHEN regexp_matches(q, '{_KEPT}') THEN 'howto' WHEN length(q) < 60 THEN 'factoid' ELSE 'list' END AS intent, {_guarded('o', 'k')} AS guarded, length(text) AS n FROM a0),
        a2 AS (SELECT *, {d_cover('ant', 'g')} AS support, CAST({_STEPS} AS DOUBLE) AS steps FROM a1),
        a3 AS (SELECT *, round(CAST(0.35 * CASE WHEN guarded THEN greatest(support, 0.85) ELSE support END + 0.22 * {d_cover('qt', 'a')} + 0.18 * {D_FOCUS} + 0.13 * CASE WHEN intent IN ('factoid', 'contact', 'howto') THEN least(1.0, 220.0e0 / greatest(220, n)) ELSE 1 END
            + 0.12 * ({d_reward('q', 'a', 'n')} - 0.5) + CASE source WHEN 'rule' THEN 0.18 ELSE 0.02 END + CASE WHEN intent = 'howto' THEN least(0.35, 0.12 * steps) ELSE 0 END AS DOUBLE), 9) AS total FROM a2),
        b AS (SELECT turn_id, arg_min(text, (-total, pos)) AS best, arg_min(source, (-total, pos)) AS came, max(total) AS top, coalesce(max(CASE WHEN source = 'original' THEN total END), 0) AS base,
            max(CASE WHEN source = 'original' THEN text END) AS own, coalesce(bool_or(CASE WHEN source = 'original' THEN guarded END), false) AS held FROM a3 GROUP BY turn_id),
        fo AS (SELECT *, {D_FOCUS} AS foc FROM a3), ru AS (SELECT * FROM fo WHERE source = 'rule' QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY pos) = 1), og AS (SELECT * FROM fo WHERE source = 'original' QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY pos) = 1),
        wy AS (SELECT og.turn_id, og.text AS otext, ru.text AS rtext, CASE WHEN ru.a = og.a THEN 'keep' WHEN og.intent = 'list' OR (og.intent IN ('factoid', 'contact', 'howto') AND (NOT og.guarded OR (og.intent = 'howto' AND ru.steps >= og.steps + 0.4)
            OR ru.foc >= og.foc + 0.03 OR ru.n * 2 <= greatest(1, og.n))) THEN 'rule' END AS way FROM og JOIN ru USING (turn_id))
        SELECT b.turn_id, CASE WHEN way = 'keep' THEN otext WHEN way = 'rule' THEN rtext WHEN came <> 'original' AND (top >= base + 0.08 OR (NOT held AND top >= 0.3)) THEN best ELSE own END AS answer, coalesce(way, 'ranked') AS how, round(top, 6) AS top FROM b LEFT JOIN wy USING (turn_id)""",
)


def replacement(*v):
    """Whether the chosen text should replace the turn's answer, which is its context."""
    rows = pairs(*v).join(v[0].select("turn_id", "question", F.col("answer").alias("given")), "turn_id")
    rows = with_reward(with_reward(rows, "question", "chosen", "rc"), "question", "rejected", "rr").withColumns({"q": T.norm_ascii("question"), "c": T.norm_ascii("chosen"), "r": T.norm_ascii("rejected")})
    rows = rows.withColumns({f"{n}t": F.regexp_extract_all(n, F.lit("[a-z0-9]{3,}"), F.lit(0)) for n in ("q", "c", "r")})
    gain = lambda f, g: F.round(f - g, 9)
    focus = gain(E.focus(F.col("ct"), F.col("qt")), E.focus(F.col("rt"), F.col("qt")))
    cover = gain(E.coverage(F.col("qt"), F.col("c")), E.coverage(F.col("qt"), F.col("r")))
    out = E.replaces(E.grounded(F.col("chosen"), F.col("given")), F.col("c") == F.col("r"), focus, cover, F.length("chosen"), F.length("rejected"), gain(F.col("rc"), F.col("rr")))
    return rows.select("turn_id", out.alias("replace"))


_focus_of = lambda t: f"(len(list_filter({t}, lambda t: list_contains(qt, t))) / greatest(1, len({t})))"
P.add(
    "e9_replacement_check",
    replacement,
    *_X,
    sql=f"""WITH {D_PAIRS}, a0 AS (SELECT p.*, {d_ascii('et.question')} AS q, {d_ascii('chosen')} AS c, {d_ascii('rejected')} AS r, {_IMP('chosen')} AS o, {_IMP('et.answer')} AS k FROM pairs p JOIN et USING (turn_id)),
        a1 AS (SELECT *, regexp_extract_all(q, '[a-z0-9]{{3,}}') AS qt, regexp_extract_all(c, '[a-z0-9]{{3,}}') AS ct, regexp_extract_all(r, '[a-z0-9]{{3,}}') AS rt FROM a0),
        a2 AS (SELECT *, round(CAST({_focus_of('ct')} - {_focus_of('rt')} AS DOUBLE), 9) AS df, round(CAST({d_cover('qt', 'c')} - {d_cover('qt', 'r')} AS DOUBLE), 9) AS dc, round({d_reward('q', 'c', 'length(chosen)')} - {d_reward('q', 'r', 'length(rejected)')}, 9) AS dr FROM a1)
        SELECT turn_id, {_guarded('o', 'k')} AND c <> r AND length(chosen) > 0 AND (df >= 0.03 OR dc >= 0.15 OR length(chosen) + 80 < length(rejected) OR (dr >= 0.12 AND df + dc >= -0.08)) AS replace FROM a2""",
)
P.add(
    "e10_skip_generation",
    lambda q, d, c: _merged(q, d, c, 1).join(q.select("query_id", "query_type"), "query_id").join(c.select("id", "text"), "id").groupBy("query_type").agg(F.count("*").alias("queries"), F.round(F.avg(((F.length("text") <= 1400) & (F.col("score") >= 0.6)).cast("double")), 6).alias("share")),
    *_CAND,
    sql=f"WITH {D_MERGED} SELECT q.query_type, count(*) AS queries, round(avg(CASE WHEN length(c.text) <= 1400 AND score >= 0.6 THEN 1.0 ELSE 0.0 END), 6) AS share FROM merged m JOIN queries_v q USING (query_id) JOIN corpus_v c ON c.id = m.id WHERE m.rank = 1 GROUP BY q.query_type",
)

# R: matching and entities
P.add(
    "r23_variant_match",
    lambda t, r, v: N.variant_match(t, r, v).select("turn_id", "review_turn", F.round("score", 6).alias("score")),
    "turns",
    "reviews_v",
    "review_variants_v",
    sql=f"""WITH q AS (SELECT turn_id, q, list_distinct(string_split(q, ' ')) AS qt FROM (SELECT turn_id, {d_ascii('question')} AS q FROM turns) WHERE q <> ''),
        v AS (SELECT DISTINCT turn_id AS review_turn, {d_ascii('variant')} AS v FROM review_variants_v WHERE turn_id IN (SELECT turn_id FROM reviews_v WHERE active AND review_kind = 'answer') AND {d_ascii('variant')} <> ''),
        s AS (SELECT q.turn_id, review_turn, max(CASE WHEN q = v THEN 10.0 ELSE len(list_intersect(qt, list_distinct(string_split(v, ' ')))) / len(qt) + CASE WHEN contains(q, v) OR contains(v, q) THEN 0.5 ELSE 0 END END) AS score FROM q, v GROUP BY ALL)
        SELECT turn_id, review_turn, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY round(score, 9) DESC, review_turn) = 1""",
)
#: Words of units and heads, phrases that end a name, and words that name nothing, for the parts' names.
UNITS, HEADS, STOPS, PLAINWORDS = ("green", "blue"), ("large", "small"), ("steel", "tin"), ("economy", "standard")
_toks2 = lambda x: f"list_filter(string_split({x}, ' '), lambda t: length(t) >= 2 AND t NOT IN ({', '.join(repr(w) for w in PLAINWORDS)}))"
_grams = lambda t: f"list_distinct(flatten([list_transform(range(1, greatest(len({t}) - k + 2, 1)), lambda i: array_to_string({t}[i:i + k - 1], ' ')) for k in [2, 3, 4]]))"
_frag = lambda lead: rf"trim(regexp_extract(regexp_extract(q, '{lead}([a-z0-9][a-z0-9\s&.-]*)', 1), '^(.*?)(?:\b(?:{'|'.join(STOPS)})\b|$)', 1))"
_lead1, _lead2 = rf"\b(?:{'|'.join(HEADS)})\s+(?:{'|'.join(UNITS)})\s+", rf"\b(?:{'|'.join(UNITS)})\s+"
P.add(
    "r24_entity_match",
    lambda p: N.entity_match(p.select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_name", "p_type").alias("question")), p.select(F.col("p_name").alias("name")).distinct(), UNITS, HEADS, STOPS, PLAINWORDS).select("question_id", "name", F.round("score", 6).alias("score")),
    "part",
    sql=rf"""WITH q0 AS (SELECT p_partkey AS question_id, {d_ascii("p_name || ' ' || p_type")} AS q FROM part), q1 AS (SELECT *, coalesce(nullif({_frag(_lead1)}, ''), {_frag(_lead2)}) AS f FROM q0),
        q2 AS (SELECT *, {_toks2("CASE WHEN f <> '' THEN f ELSE q END")} AS qt FROM q1), q AS (SELECT *, list_distinct(qt) AS qs, {_grams('qt')} AS qp, list_distinct({_toks2('q')}) AS qw FROM q2),
        n0 AS (SELECT DISTINCT p_name AS name, {d_ascii('p_name')} AS nn FROM part), n1 AS (SELECT *, trim(regexp_replace(nn, '^(?:{'|'.join(UNITS)})\s+', '')) AS short FROM n0), n2 AS (SELECT *, {_toks2('short')} AS nt FROM n1),
        n AS (SELECT *, list_distinct(nt) AS ns, {_grams('nt')} AS np, list_distinct({_toks2('nn')}) AS nw FROM n2),
        pr AS (SELECT DISTINCT question_id, name FROM (SELECT question_id, unnest(qw) AS t FROM q) JOIN (SELECT name, unnest(nw) AS t FROM n) USING (t)),
        r AS (SELECT *, len(list_intersect(qs, ns)) AS hits, len(list_intersect(qp, np)) AS ph, len(qs) > 0 AND len(list_filter(qs, lambda t: NOT list_contains(ns, t))) = 0 AS inside FROM pr JOIN q USING (question_id) JOIN n USING (name)),
        s AS (SELECT question_id, name, round(CAST(CASE WHEN contains(q, nn) THEN 4 + length(nn) / 100 ELSE 0 END + CASE WHEN short <> '' AND contains(q, short) THEN 3 + length(short) / 100 ELSE 0 END + CASE WHEN f <> '' AND contains(short, f) THEN 3.5 + length(f) / 100 ELSE 0 END
            + CASE WHEN len(ns) > 0 THEN hits / len(ns) + 0.6 * hits + CASE WHEN inside THEN 2.2 ELSE 0 END ELSE 0 END + 1.4 * ph AS DOUBLE), 9) AS score, len(ns) > 0 AND (hits >= greatest(1, least(2, len(qs))) OR ph >= 1 OR inside) AS ok FROM r)
        SELECT question_id, name, round(score, 6) AS score FROM s WHERE score > 0 AND (score >= 3 OR ok) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, name) = 1""",
)
P.add(
    "r25_entity_profiles",
    lambda d: N.entity_profiles(G.lines(d), F.lower("text").startswith("the "), F.col("text").contains("@")).select("doc_id", F.md5("entity").alias("entity"), "lines", "contacts", "first_pos"),
    "documents",
    sql=f"""WITH {D_LINES}, e AS (SELECT doc_id, pos, text, last_value(CASE WHEN starts_with(lower(text), 'the ') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS entity FROM lines)
        SELECT doc_id, md5(entity) AS entity, count(*) AS lines, CAST(sum(CAST(contains(text, '@') AS INT)) AS BIGINT) AS contacts, min(pos) AS first_pos FROM e WHERE entity IS NOT NULL GROUP BY doc_id, entity""",
)
P.add("r26_entity_list", lambda d: N.entity_list(d, "The [a-z]+", "lang"), "documents", sql="SELECT lang, entity, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(text, 'The [a-z]+'))) AS entity FROM documents) GROUP BY ALL")
PLACES = [("north", "th"), ("south", "st")]
P.add(
    "r27_contact_lines",
    lambda d: N.contact_lines(G.lines(d), PLACES).select("doc_id", "field", "place", F.md5("text").alias("text")),
    "documents",
    sql=rf"""WITH {D_LINES}, f AS (SELECT DISTINCT doc_id, CASE WHEN contains(text, '@') THEN 'email' WHEN contains(text, 'http') THEN 'web' WHEN regexp_matches(text, '\+?[0-9][0-9 ().-]{{6,}}[0-9]') THEN 'phone' END AS field,
        CASE WHEN contains({d_norm('text')}, 'th') THEN 'north' WHEN contains({d_norm('text')}, 'st') THEN 'south' ELSE '' END AS place, text FROM lines) SELECT doc_id, field, place, md5(text) AS text FROM f WHERE field IS NOT NULL""",
)
P.add(
    "r28_field_proximity",
    lambda d: N.field_proximity(G.lines(d), T.norm("text").contains("was"), F.col("text").contains("was the")).select("doc_id", "pos", "found_pos"),
    "documents",
    sql=f"""WITH {D_LINES}, h AS (SELECT *, CASE WHEN contains(text, 'was the') THEN pos END AS hit FROM lines), n AS (SELECT *, coalesce(hit, lead(hit, 1) OVER w, lead(hit, 2) OVER w, lead(hit, 3) OVER w) AS found_pos FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        SELECT doc_id, pos, found_pos FROM n WHERE contains({d_norm('text')}, 'was') AND found_pos IS NOT NULL""",
)
#: Topics, marks and steps that occur in these tables.
QA_TOPICS, QA_ADJUST, QA_STEPS = [Rule("from", ("from",)), Rule("with", ("with",)), Rule("that", ("that",))], {"from": (("and", "the"), 2.0), "with": (("the",), -1.0)}, ("that",)


def qa_rows(t):
    rows = t.select(F.col("turn_id").alias("qa_id"), "question", "answer").withColumn("x", F.concat_ws(" ", T.norm_ascii("question"), T.norm_ascii("answer")))
    words = F.slice(F.array_distinct(F.filter(F.split("x", " "), lambda w: F.length(w) >= 6)), 1, 3)
    return rows.select("qa_id", "question", "answer", Q.first_label(F.col("x"), QA_TOPICS, "").alias("topic"), words.alias("keywords"), Q.score(T.norm_ascii("answer"), STEPS).alias("specificity"))


def qa_queries(q):
    x = T.norm_ascii("query")
    return q.select("query_id", "query", Q.first_label(x, QA_TOPICS, "").alias("topic"), x.contains("in").alias("howto"))


_added = " + ".join(f"CASE WHEN a.topic = '{t}' AND ({' OR '.join(f'contains(q.x, {m!r})' for m in marks)}) THEN {v} ELSE 0 END" for t, (marks, v) in QA_ADJUST.items())
P.add(
    "r29_qa_match",
    lambda q, t: A.qa_match(qa_queries(q), qa_rows(t), QA_ADJUST, QA_STEPS).select("query_id", "qa_id", F.round("score", 6).alias("score")),
    "queries_v",
    "turns",
    sql=f"""WITH q0 AS (SELECT query_id, {d_ascii('query')} AS x FROM queries_v), q AS (SELECT *, {d_label(QA_TOPICS)} AS topic, contains(x, 'in') AS howto, list_filter(string_split(x, ' '), lambda w: length(w) >= 4) AS w FROM q0),
        a0 AS (SELECT turn_id AS qa_id, {d_ascii('question')} || ' ' || {d_ascii('answer')} AS x, {d_ascii('answer')} AS y FROM turns), a1 AS (SELECT *, list_filter(string_split(x, ' '), lambda w: length(w) >= 6) AS k FROM a0),
        a AS (SELECT *, {d_label(QA_TOPICS)} AS topic, list_filter(k, lambda w, i: list_position(k, w) = i)[1:3] AS kw, {' + '.join(f"CASE WHEN {d_rule(r, 'y')} THEN {r.delta} ELSE 0 END" for r in STEPS)} AS spec FROM a1),
        s AS (SELECT query_id, qa_id, CAST(CASE WHEN a.topic <> '' AND a.topic = q.topic THEN 3 ELSE 0 END + 1.5 * len(list_filter(kw, lambda k: contains(q.x, k))) + 0.25 * len(list_filter(q.w, lambda w: contains(a.x, w))) + {_added}
            + CASE WHEN howto THEN 0.9 * spec + CASE WHEN a.topic IN ({', '.join(repr(t) for t in QA_STEPS)}) THEN 0.25 ELSE 0 END ELSE 0 END AS DOUBLE) AS score FROM q CROSS JOIN a)
        SELECT query_id, qa_id, round(score, 6) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, qa_id) = 1""",
)
