"""U: text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .common import Plans, d_alnum, d_ascii, d_keyword_id, d_norm, d_slug, d_terms, d_words, d_ws

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle

P.add(
    "u1_norm_text",
    lambda docs: docs.select("doc_id", F.md5(T.norm("text")).alias("norm"), F.md5(T.norm_ascii("text")).alias("ascii"), F.substring(T.slug("text"), 1, 60).alias("slug"), F.md5(T.ws("text")).alias("ws")),
    "documents",
    sql=f"SELECT doc_id, md5({d_norm('text')}) AS norm, md5({d_ascii('text')}) AS ascii, substr({d_slug('text')}, 1, 60) AS slug, md5({d_ws('text')}) AS ws FROM documents",
)

P.add(
    "u2_keyword_terms",
    lambda docs: docs.select("doc_id", T.keyword_terms("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("terms")),
    "documents",
    sql=f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS terms FROM (SELECT doc_id, {d_terms('text', T.STOPWORDS)} AS t FROM documents)",
)


def _terms(docs):
    return docs.select(F.explode(T.keyword_terms("text")).alias("term")).distinct()


_D_TERMS = f"(SELECT DISTINCT unnest({d_terms('text', T.STOPWORDS)}) AS term FROM documents)"
P.add(
    "u3_keyword_id",
    lambda docs: _terms(docs).select("term", T.keyword_id("term").alias("keyword_id")),
    "documents",
    sql=f"SELECT term, {d_keyword_id('term')} AS keyword_id FROM {_D_TERMS}",
)

P.add(
    "u4_alnum_tokens",
    lambda c: c.select(
        "conv_id",
        "turn",
        F.array_join(T.alnum_tokens("text"), " ").alias("tokens"),
        F.array_join(T.alnum_tokens("text", 2, ("the", "of", "and")), " ").alias("reward_tokens"),
        F.array_join(T.alnum_tokens("text", 3, ("what", "which", "who")), " ").alias("content_tokens"),
    ),
    "conversations",
    sql=f"""SELECT conv_id, turn, array_to_string(t, ' ') AS tokens, array_to_string(list_filter(t, lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and')), ' ') AS reward_tokens,
        array_to_string(list_filter(t, lambda x: length(x) >= 3 AND x NOT IN ('what', 'which', 'who')), ' ') AS content_tokens FROM (SELECT *, {d_alnum('text')} AS t FROM conversations)""",
)

D_IMPORTANT = rf"list_filter(regexp_extract_all({d_norm('X')}, '[\p{{L}}\p{{N}}_@./:+-]+'), lambda t: contains(t, '@') OR contains(t, 'http') OR regexp_matches(t, '[0-9]') OR length(t) >= 6)"
P.add(
    "u5_important_tokens",
    lambda c: c.select("conv_id", "turn", F.array_join(F.sort_array(T.important_tokens("text")), " ").alias("tokens")),
    "conversations",
    sql=f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct({D_IMPORTANT.replace('X', 'text')})), ' ') AS tokens FROM conversations",
)

P.add(
    "u6_unique_strings",
    lambda docs: docs.select("doc_id", F.array_join(T.unique_strings(F.slice(T.words("text"), 1, 40), 12), " ").alias("first")),
    "documents",
    sql=f"""SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, k), lambda z, i: z[2] <> '' AND list_position(k, z[2]) = i)[1:12], lambda z: z[1]), ' ') AS first
        FROM (SELECT doc_id, w, list_transform(w, lambda x: {d_ascii('x')}) AS k FROM (SELECT doc_id, {d_words('text')}[1:40] AS w FROM documents))""",
)

P.add(
    "u7_word_ngrams",
    lambda b: b.select("item_id", F.explode(T.ngrams(T.alnum_tokens("text"), 2, 4)).alias("phrase")).groupBy("item_id", "phrase").agg(F.count("*").alias("n")),
    "benchmark",
    sql=f"""WITH t AS (SELECT item_id, {d_alnum('text')} AS t FROM benchmark), g AS (SELECT item_id, unnest(flatten([
        list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')), list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')),
        list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))])) AS phrase FROM t) SELECT item_id, phrase, count(*) AS n FROM g GROUP BY ALL""",
)

P.add(
    "u8_hint_match",
    lambda c: c.withColumn("t", T.norm_ascii("text")).select(
        "conv_id", "turn", T.hint_match(F.col("t"), "th", "contains").alias("has"), T.hint_match(F.col("t"), "the", "word").alias("word"), T.hint_match(F.col("t"), "of the", "word").alias("phrase"), T.hint_match(F.col("t"), "the", "equals").alias("same")
    ),
    "conversations",
    sql=f"""SELECT conv_id, turn, contains(t, 'th') AS has, regexp_matches(' ' || t || ' ', '[^a-z0-9]the[^a-z0-9]') AS word, contains(t, 'of the') AS phrase, t = 'the' AS same
        FROM (SELECT *, {d_ascii('text')} AS t FROM conversations)""",
)

P.add(
    "u9_stable_id",
    lambda c: c.select("conv_id", "turn", T.stable_id("m", F.col("conv_id"), F.col("role"), F.col("text")).alias("id")),
    "conversations",
    sql="SELECT conv_id, turn, 'm-' || substr(sha1(conv_id || chr(0) || role || chr(0) || text || chr(0)), 1, 16) AS id FROM conversations",
)


def _overlap(b, docs):
    """Shared distinct tokens by an equi-join on the token, never query by text."""
    q = b.select("item_id", F.array_distinct(T.alnum_tokens("text", 3)).alias("q")).withColumn("n", F.size("q"))
    d = docs.select("doc_id", F.explode(F.array_distinct(T.alnum_tokens("text", 3))).alias("t"))
    hits = q.select("item_id", "n", F.explode("q").alias("t")).join(d, "t").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("overlap"))
    return hits.where("overlap >= 0.5").select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"))


P.add(
    "u10_token_overlap",
    _overlap,
    "benchmark",
    "documents",
    sql=f"""WITH q AS (SELECT item_id, list_distinct(list_filter({d_alnum('text')}, lambda t: length(t) >= 3)) AS q FROM benchmark),
        d AS (SELECT doc_id, unnest(list_distinct(list_filter({d_alnum('text')}, lambda t: length(t) >= 3))) AS t FROM documents),
        h AS (SELECT item_id, doc_id, count(*) / any_value(n) AS overlap FROM (SELECT item_id, len(q) AS n, unnest(q) AS t FROM q) JOIN d USING (t) GROUP BY ALL)
        SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM h WHERE overlap >= 0.5""",
)
