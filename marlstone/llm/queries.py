"""The operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, exact_dedup, langid, minhash, mixing, phrases, pii, quality, rangemax, suffix, tokencount, toxicity
from .common import learns

#: The vocabulary of the BPE queries; another file is another parameter.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The model of the token counts.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _load(spark, sf_dir, "documents"), _load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(learns("doc_id", 4, 2)))
    out = quality.score_documents(docs, model)
    return out.select("doc_id", (~learns("doc_id", 4, 2)).alias("held_out"), "score", "predicted", "passages", "attention", "focus")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_load(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_load(spark, sf_dir, "documents"), redacted=False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    model = langid.fit(docs.where(learns("doc_id", 4, 2)))
    return langid.identify(docs, model).select("doc_id", (~learns("doc_id", 4, 2)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_weights(_load(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("prob", 6).alias("prob"), "sampled")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_texts(_load(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _load(spark, sf_dir, "documents"), _load(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(learns("doc_id", 3, 1)))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (~learns("doc_id", 3, 1)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_load(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_load(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_load(spark, sf_dir, "documents"), size=2, percent=80)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangemax.search(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"), k=10)


def op12_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_load(spark, sf_dir, "documents"), PIECES)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_load(spark, sf_dir, "documents"), least=100, longest=5, inside=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_quality, op2_topk, op3_pii, op4_language, op5_mixing, op6_bpe, op7_toxicity, op8_exact_dedup, op9_suffix, op10_minhash, op11_lexical, op12_tokencount, op13_collocations)}


def _mixing_sql(rounds: int = mixing.ROUNDS) -> str:
    """The raking of mixing.rake, unrolled: a step for each margin of each round."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    steps = [
        f"docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN length(coalesce(text, '')) < 1000 THEN 'brief' "
        f"WHEN length(coalesce(text, '')) < 4000 THEN 'article' ELSE 'long' END AS topic, CAST({words} AS BIGINT) AS tokens FROM documents)",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS w FROM docs GROUP BY ALL)",
    ]
    for name, power in mixing.TEMPER.items():
        steps.append(
            f"t_{name} AS MATERIALIZED (SELECT {name}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS target FROM (SELECT {name}, CAST(sum(tokens) AS DOUBLE) AS t FROM w0 GROUP BY ALL) WHERE t > 0)"
        )
    at = 0
    for _ in range(rounds):
        for name in mixing.TEMPER:
            steps.append(
                f"w{at + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * coalesce(CASE WHEN s.s > 0 THEN t.target / s.s ELSE 1 END, 1) AS w FROM w{at} c "
                f"JOIN (SELECT {name}, sum(w) AS s FROM w{at} GROUP BY ALL) s USING ({name}) LEFT JOIN t_{name} t USING ({name}))"
            )
            at += 1
    steps.append(f"ratio AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS r FROM w{at})")
    steps.append("prob AS (SELECT source, lang, topic, CASE WHEN max(r) OVER () > 0 THEN r / max(r) OVER () ELSE 0 END AS p FROM ratio)")
    p = "CASE WHEN d.tokens > 0 THEN p ELSE 0 END"
    u = "CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0e0"
    return f"WITH {', '.join(steps)} SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round({p}, 6) AS prob, {u} < {p} AS sampled FROM docs d JOIN prob USING (source, lang, topic)"


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLE = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op5_mixing": _mixing_sql(),
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_lexical": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms_sql("coalesce(text, '')")} AS t FROM documents),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
        g AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(g.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN g GROUP BY term),
        m AS (SELECT r, doc_id, 10 + (90 * len(t) * g.n) // g.l AS m FROM d CROSS JOIN g),
        q AS (SELECT DISTINCT item_id, unnest({_terms_sql("coalesce(text, '')")}) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10""",
    "op13_collocations": rf"""
        WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
            unnest(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
        x AS (SELECT *, unnest(range(1, size)) AS k FROM c),
        y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f) AS score FROM x JOIN t USING (lang)
            JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')),
        b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a AS f, unnest(flatten(list_transform(range(2, size), lambda k: list_transform(range(1, size - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))))) AS phrase FROM c)
            GROUP BY ALL)
        SELECT b.lang, row_number() OVER o AS rank, b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * a
        WINDOW o AS (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) QUALIFY row_number() OVER o <= 2000""",
}
