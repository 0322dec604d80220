"""What the registered queries share: tables, derived views and pieces of DuckDB SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Derived views; plain SQL with the same rows in Spark and DuckDB.
VIEWS = {
    "turns": """SELECT a.conv_id, a.turn, concat(a.conv_id, ':', a.turn) AS turn_id, a.ut AS user_turn, coalesce(u.text, '') AS question, a.text AS answer
        FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS ut FROM conversations) a
        LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.ut WHERE a.role = 'assistant'""",
    "feedback_v": """SELECT turn_id, concat('u', conv_id % 17) AS student_id, question, answer, r.seq, CAST((conv_id * 7 + turn + r.seq) % 7 AS INT) AS rating,
        CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('suggest ', substr(question, 1, 40)) ELSE '' END AS answer_suggestion,
        concat('2026-01-0', r.seq, 'T00:00:00Z') AS updated_at FROM turns CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2) r
        WHERE (conv_id + turn) % 2 = 0 AND (r.seq = 1 OR conv_id % 3 = 0)""",
    "facts_v": """SELECT turn_id, question, CASE (conv_id + turn) % 9 WHEN 0 THEN 'meta' WHEN 1 THEN 'partial_scope' WHEN 2 THEN 'admin_review_override' ELSE 'document_answer' END AS route,
        CASE conv_id % 5 WHEN 0 THEN 'general_docs' WHEN 1 THEN '' ELSE 'sales' END AS domain, CASE WHEN length(answer) >= 20 THEN CAST(length(answer) % 120 AS DOUBLE) / 100.0e0 END AS top_score FROM turns""",
    "contexts_v": """SELECT concat('x', doc_id) AS context_id, CASE WHEN doc_id % 4 = 0 THEN id ELSE '' END AS source_id, source_kind AS kind, CASE WHEN doc_id % 7 = 0 THEN '' ELSE title END AS title,
        question, CASE WHEN doc_id % 5 = 0 THEN text ELSE '' END AS answer, CASE WHEN doc_id % 2 = 0 THEN dedupe_key ELSE '' END AS dedupe_key, CASE WHEN doc_id % 3 <> 1 THEN doc_id END AS doc_id,
        CASE WHEN doc_id % 3 <> 2 THEN text ELSE '' END AS text FROM corpus_v""",
    "session_turns_v": """SELECT conv_id, turn, (conv_id + turn) % 5 <> 0 AS answered, CASE (conv_id + turn) % 3 WHEN 0 THEN 'gamma' WHEN 1 THEN 'eps' ELSE '' END AS domain,
        concat('doc', conv_id % 7) AS doc, split_part(answer, ' ', 1) AS entity, substr(question, 1, 12) AS unit, CASE WHEN contains(lower(question), ' how ') THEN 'howto' ELSE 'factoid' END AS qtype,
        concat('d', conv_id * 3 + turn) AS first_id, concat('t', length(question) % 4) AS topic, CASE WHEN turn % 4 = 3 THEN 'web' ELSE 'docs' END AS channel, contains(lower(question), 'that') AS use_history,
        question, lower(question) AS question_n, CASE WHEN (conv_id + turn) % 10 = 0 THEN '' ELSE answer END AS answer FROM turns""",
    "reviews_v": """SELECT turn_id, question AS user_question, answer AS assistant_answer, r.seq,
        CASE (conv_id + turn + r.seq) % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'missing' WHEN 3 THEN 'excessive' WHEN 4 THEN 'partial' ELSE 'unknown' END AS verdict,
        CASE WHEN conv_id % 11 = 0 THEN 'policy' ELSE 'answer' END AS review_kind,
        CASE WHEN (conv_id + turn + r.seq) % 6 IN (1, 2, 4) THEN concat('ok ', substr(answer, 1, 60)) ELSE '' END AS approved_answer,
        conv_id % 7 <> 0 AS active, concat('2026-02-0', r.seq, 'T00:00:00Z') AS updated_at
        FROM turns CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2) r WHERE conv_id % 3 <> 1 AND (r.seq = 1 OR conv_id % 4 = 0)""",
    "review_variants_v": """SELECT turn_id, user_question AS variant FROM reviews_v WHERE user_question <> ''
        UNION SELECT turn_id, concat(user_question, ' again') FROM reviews_v WHERE user_question <> ''""",
    "contrib_v": """SELECT concat('c:', turn_id) AS contribution_id, turn_id, question AS original_question, answer AS bot_answer,
        concat('fact ', substr(answer, 1, 50)) AS user_contribution,
        CASE conv_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' ELSE 'bogus' END AS status FROM turns WHERE turn % 4 = 1""",
    "corpus_v": """SELECT concat('d', doc_id) AS id, doc_id, lang AS domain, source AS entity_name, substr(text, 1, 60) AS title, text,
        CASE WHEN n_chars < 500 THEN 'fact' WHEN n_chars < 2000 THEN 'overview' WHEN n_chars < 5000 THEN 'history' ELSE 'generic' END AS chunk_type,
        CAST(doc_id % 101 AS INT) AS priority, sha1(text) AS dedupe_key, CASE WHEN doc_id % 2 = 0 THEN 'seed' ELSE 'local' END AS source_kind,
        CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 50) ELSE '' END AS question FROM documents""",
    "queries_v": """SELECT concat('q', item_id) AS query_id, item_id, substr(text, 1, 80) AS query, 'en' AS domain,
        CASE WHEN item_id % 2 = 0 THEN 'seed_qa' ELSE 'history' END AS origin,
        CASE item_id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'history' ELSE 'generic' END AS query_type,
        CASE WHEN item_id % 2 = 0 THEN 1.0e0 ELSE 0.45e0 + 0.05e0 * (item_id % 10) END AS quality FROM benchmark""",
    "qrels_v": """SELECT concat('q', b.item_id) AS query_id, concat('d', d.doc_id) AS corpus_id, 1 AS label
        FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))""",
}


def needs(sql: str) -> list[str]:
    """Views that a statement reads, those they read first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for other in [*needs(VIEWS[name]), name]:
                if other not in out:
                    out.append(other)
    return out


def twin(sql: str) -> str:
    """DuckDB SQL with the views it reads as common table expressions."""
    names = needs(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    return f"WITH RECURSIVE {ctes}, {body[15:]}" if body.upper().startswith("WITH RECURSIVE ") else f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qrels_v without a nested loop: the words 2 to 4 of a passage's first 60 characters are whole words of every text that holds these; pairs that share them are verified.

    Passages with fewer whole words meet the documents by substring; they are counted first, and there are none in ordinary prose.
    """
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.substring("text", 1, 60).alias("head"))
    items = items.withColumn("w", F.split(F.trim("head"), r"\s+")).withColumn("key", F.when(F.size("w") >= 5, F.array_join(F.slice("w", 2, 3), " ")))
    words = F.split(F.trim("text"), r"\s+")
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    keyed = items.where("key is not null").select("item_id", "head", "key")
    own = texts.withColumn("w", words).select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(keyed, "key").join(texts, "doc_id").where(F.contains("text", "head"))
    short = items.where("key is null").select("item_id", "head")
    pairs = own.select("item_id", "doc_id")
    if not short.isEmpty():
        pairs = pairs.unionByName(texts.join(short, F.contains("text", "head")).select("item_id", "doc_id"))
    return pairs.select(F.concat(F.lit("q"), "item_id").alias("query_id"), F.concat(F.lit("d"), "doc_id").alias("corpus_id"), F.lit(1).alias("label"))


#: Views that Spark builds another way than DuckDB, with the same rows.
BUILT = {"qrels_v": _qrels}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived view."""
    if name in BUILT:
        return BUILT[name](spark, sf_dir)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            view(spark, sf_dir, t).createOrReplaceTempView(t)
    for v in VIEWS:
        if v != name and re.search(rf"\b{v}\b", sql):
            view(spark, sf_dir, v).createOrReplaceTempView(v)
    return spark.sql(sql)


class Plans:
    """Collects a module's queries and twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, build: Callable, *tables: str, sql: str | None = None) -> None:
        """Register ``build(*tables as DataFrames)``; ``sql`` is its DuckDB twin."""
        self.queries[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, t) for t in tables])
        if sql is not None:
            self.oracle[name] = twin(sql)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for round trips: in the shared checkpoint folder, or a temporary one where none is set and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    top = top or tempfile.mkdtemp(prefix="marlstone-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


# Pieces of DuckDB SQL, as text.
CLASS = r"[^\p{L}\p{N}_@./:+-]+"


def d_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{CLASS}', ' ', 'g'))"


def d_ascii(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower(nfc_normalize({x}))), 'đ', 'd'), '{CLASS}', ' ', 'g'))"


def d_trimmed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def d_slug(x: str) -> str:
    return f"coalesce(nullif({d_trimmed(d_ascii(x))}, ''), 'item')"


def d_ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0B]+', ' ', 'g'))"


def d_words(x: str) -> str:
    return f"list_filter(string_split({d_ws(x)}, ' '), lambda w: w <> '')"


def d_terms(x: str, stop: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in stop)
    return (
        f"list_filter(list_transform(string_split({d_ascii(x)}, ' '), lambda t: regexp_replace(t, '^[./:+-]+|[./:+-]+$', '', 'g')), lambda t: length(t) >= 3 AND t NOT IN ({listed}) "
        rf"AND NOT regexp_full_match(t, '[0-9]+') AND length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) >= greatest(2, length(t) - 2))"
    )


def d_alnum(x: str) -> str:
    return f"regexp_extract_all({d_ascii(x)}, '[a-z0-9]+')"


def d_keyword_id(term: str) -> str:
    safe = f"regexp_replace(regexp_replace(lower({term}), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"'kw-' || substr(coalesce(nullif({safe}, ''), 'default'), 1, 24) || '-' || substr(sha1({term}), 1, 10)"


def d_first(xs: str, limit: int, key: str = "") -> str:
    """Distinct elements in order of first occurrence."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)[1:{limit}]"


def d_bucket(x: str) -> str:
    return f"CAST('0x' || substr(sha1({x}), 1, 8) AS BIGINT)"
