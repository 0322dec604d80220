"""Retrieval for batches of queries: equi-joins on terms, fusion, boosts, top-k. Queries never meet the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import index as I
from .vectors import vector_search  # noqa: F401

K1, B = 1.5, 0.75
#: Weights of the signals in the fusion.
FUSION = {"tfidf": 0.28, "tfidf_ascii": 0.16, "overlap": 0.18, "bm25": 0.18, "vector": 0.20}


def top(rows: DataFrame, k: int, score: str = "score", id_col: str = "id", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each group with their rank; ties (to nine digits) go to the smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, q_tokens: Column, docs: DataFrame, d_tokens: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., query_id, id, score); a repeated query token counts again. The corpus is tokenised once; only postings of query terms meet lengths and weights."""
    tf = I.postings(docs, d_tokens, id_col, by)
    lengths = tf.groupBy(*by, "id").agg(F.sum("tf").alias("dl"))
    counts = I.document_counts(docs, by).join(tf.groupBy(*by).agg(F.sum("tf").alias("_all")), list(by)) if by else I.document_counts(docs).crossJoin(F.broadcast(tf.agg(F.sum("tf").alias("_all"))))
    means = counts.select(*by, (F.col("_all") / F.col("N")).alias("avgdl"))
    own = tf.join(query_terms(queries, q_tokens), "term").join(I.bm25_terms(docs, d_tokens, id_col, by, tf).select(*by, "term", "idf"), [*by, "term"])
    hits = own.join(lengths, [*by, "id"])
    hits = hits.join(means, list(by)) if by else hits.crossJoin(F.broadcast(means))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(*by, "query_id", "id").agg(F.sum(part).alias("score"))


def tfidf(queries: DataFrame, q_grams: Column, docs: DataFrame, d_grams: Column, id_col: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., query_id, id, score): cosine of the TF-IDF vectors; query terms outside the index are left out. Only postings of query terms are weighed; a document's length is one sum."""
    tf = I.postings(docs, d_grams, id_col, by)
    idf = I.tfidf_idf(tf, docs, by)
    q = query_terms(queries, q_grams).join(idf, "term").withColumn("w", F.col("qtf") * F.col("idf"))
    q = q.withColumn("qw", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, "query_id"))))
    sums = tf.join(q.select(*by, "query_id", "term", "idf", "qw"), [*by, "term"]).groupBy(*by, "query_id", "id").agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("dot"))
    return sums.join(I.tfidf_norms(tf, idf, by), [*by, "id"]).select(*by, "query_id", "id", (F.col("dot") / F.col("norm")).alias("score"))


def overlap(queries: DataFrame, q_tokens: Column, docs: DataFrame, d_tokens: Column, id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, keep.., score): share of the distinct query tokens that the text has."""
    q = queries.select("query_id", F.array_distinct(q_tokens).alias("q")).withColumn("n", F.size("q"))
    d = docs.select(*keep, F.col(id_col).alias("id"), F.explode(F.array_distinct(d_tokens)).alias("term"))
    hits = q.select("query_id", "n", F.explode("q").alias("term")).join(d, "term")
    return hits.groupBy("query_id", "id", *keep).agg((F.count("*") / F.first("n")).alias("score"))


def minmax(rows: DataFrame, keys: tuple[str, ...], totals: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``unit``, the score between the group's least and greatest. A range under 1e-9 gives 1 where the greatest is over 0, else 0.

    totals: (by.., N) documents of each index; where fewer matched, the others' score 0 is the least.
    """
    w = Window.partitionBy(*keys)
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    out = rows.withColumns({"_low": low, "_high": high, "_n": n})
    if totals is not None:
        out = out.join(totals, list(by)) if by else out.crossJoin(F.broadcast(totals))
        out = out.withColumn("_low", F.when(F.col("_n") < F.col("N"), F.least(F.col("_low"), F.lit(0.0))).otherwise(F.col("_low"))).drop("N")
    span = F.col("_high") - F.col("_low")
    unit = F.when(span < 1e-9, F.when(F.col("_high") > 0, 1.0).otherwise(0.0)).otherwise((F.col("score") - F.col("_low")) / span)
    return out.withColumn("unit", unit).drop("_low", "_high", "_n")


def fuse(signals: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score): weighted mean of the signals' ``unit`` scores, weights rescaled over the signals given; an absent row counts 0."""
    weights = weights or FUSION
    total = sum(weights[s] for s in signals)
    parts = None
    for name, rows in signals.items():
        part = rows.select("query_id", "id", (F.col("unit") * (weights[name] / total)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def keyword_rerank(queries: DataFrame, q_terms: Column, weights: DataFrame, words: DataFrame, least: float = 0.05) -> DataFrame:
    """(query_id, id, score): keyword weights of the query's terms over the sum of their max(``least``, idf); terms outside the index count ``least``."""
    q = queries.select("query_id", F.explode(F.array_distinct(q_terms)).alias("term")).join(words.select("term", "idf"), "term", "left")
    q = q.withColumn("norm", F.sum(F.greatest(F.lit(least), F.coalesce("idf", F.lit(0.0)))).over(Window.partitionBy("query_id"))).drop("idf")
    return q.join(weights.select("id", "term", "weight"), "term").groupBy("query_id", "id").agg((F.sum("weight") / F.first("norm")).alias("score"))


def _hits(tokens: Column, x: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: x.contains(t)))


def field_boost(q_words: Column, title: Column, section: Column, entity: Column, body: Column) -> Column:
    """.08 for the title, .08 for the section, .10 for the entity if one of the first six words occurs; .03 for each word of five characters in the text (again if repeated), .16 at most."""
    first = F.slice(q_words, 1, 6)
    some = lambda x: F.exists(first, lambda t: x.contains(t))
    long = F.filter(q_words, lambda t: F.length(t) >= 5)
    return (
        F.when(some(title), 0.08).otherwise(0.0)
        + F.when(some(section), 0.08).otherwise(0.0)
        + F.when(some(entity), 0.10).otherwise(0.0)
        + F.least(F.lit(0.16), 0.03 * _hits(long, body))
    )


#: Words that an entity's short name leaves out.
PREFIXES = ("phong ", "khoa ", "ban ", "truong ")


def entity_boost(query: Column, entity: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """.30 whole name, .20 name without a leading prefix, .18 all its tokens of three characters, .12 all but one (two at least)."""
    rest = entity
    for prefix in reversed(prefixes):
        rest = F.when(entity.startswith(prefix), F.trim(F.substring(entity, len(prefix) + 1, 1 << 20))).otherwise(rest)
    tokens = F.filter(F.split(entity, " "), lambda t: F.length(t) >= 3)
    found = _hits(tokens, query)
    return (
        F.when(entity == "", 0.0)
        .when(query.contains(entity), 0.30)
        .when((rest != "") & query.contains(rest), 0.20)
        .when(F.size(tokens) == 0, 0.0)
        .when(found == F.size(tokens), 0.18)
        .when(found >= F.greatest(F.lit(2), F.size(tokens) - 1), 0.12)
        .otherwise(0.0)
    )


#: Marks in a query that ask for a type of chunk.
TYPE_MARKS = {
    "contact": ("email", "mail", "website", "web", "dien thoai", "sdt", "lien he"),
    "location": ("dia chi", "o dau", "co so", "ha noi", "nam dinh", "minh khai", "linh nam"),
    "role": ("la ai", "hieu truong", "pho hieu truong", "truong khoa", "truong phong", "chu tich"),
    "howto": ("cach", "nhu the nao", "dang nhap", "dang ky", "tra cuu", "xem ", "huong dan"),
    "teaching": ("day mon", "mon gi", "mon nao", "giang day", "hoc phan", "day hoc"),
    "training": ("dao tao gi", "nganh nao", "nganh gi", "chuong trinh dao tao", "ma nganh", "tin chi"),
    "history": ("lich su", "thanh lap", "tien than", "giai doan"),
    "overview": ("tong quan", "gioi thieu", "truong co"),
    "function": ("lam gi", "chuc nang", "nhiem vu"),
    "duty": ("lam gi", "nhiem vu", "phu trach"),
    "function_duty": ("lam gi", "chuc nang", "nhiem vu"),
}


def type_boost(query: Column, chunk_type: Column, marks: dict[str, tuple[str, ...]] = TYPE_MARKS) -> Column:
    """.12 if the query asks for this type by one of its marks, else .03 for overviews and facts."""
    asked = F.lit(False)
    for name, words in marks.items():
        asked = asked | ((chunk_type == name) & T.any_hint(query, list(words)))
    return F.when(asked, 0.12).when(chunk_type.isin("overview", "fact"), 0.03).otherwise(0.0)


#: What an intent tag and a topic tag add when the query has one of their marks.
INTENT_MARKS = {
    "contact": (0.08, ("email", "mail", "website", "web", "dien thoai", "sdt", "lien he")),
    "location": (0.08, ("dia chi", "o dau", "co so", "ha noi", "nam dinh")),
    "howto": (0.08, ("cach", "nhu the nao", "huong dan", "dang ky", "tra cuu", "xem ")),
    "teaching_lookup": (0.10, ("day mon", "mon gi", "mon nao", "giang day", "hoc phan", "day hoc")),
    "training_lookup": (0.10, ("dao tao gi", "nganh nao", "nganh gi", "chuong trinh dao tao", "ma nganh")),
    "person_lookup": (0.08, ("la ai", "truong khoa", "truong phong", "hieu truong")),
}
TOPIC_MARKS = {"faculty": (0.04, ("khoa",)), "department": (0.04, ("phong",))}


def metadata_boost(query: Column, terms: Column, intents: Column, topics: Column, intent_marks: dict = INTENT_MARKS, topic_marks: dict = TOPIC_MARKS) -> Column:
    """.06 for each term that the query holds (.18 at most), .025 for each that it holds in part (.10 at most), and the marks of the tags.

    A phrase is held as a whole, or by its first four tokens of three characters; terms under three characters don't count. ``terms`` are normalised.
    """
    parts = lambda t: F.filter(F.split(t, " "), lambda x: F.length(x) >= 3)
    long = F.filter(terms, lambda t: F.length(t) >= 3)
    held = lambda t: (t.contains(" ") & query.contains(t)) | ((F.size(parts(t)) > 0) & F.forall(F.slice(parts(t), 1, 4), lambda x: query.contains(x)))
    exact = F.size(F.filter(long, held))
    part = F.size(F.filter(long, lambda t: ~held(t) & F.exists(parts(t), lambda x: query.contains(x))))
    out = F.least(F.lit(0.18), 0.06 * exact) + F.least(F.lit(0.10), 0.025 * part)
    for tags, table in ((intents, intent_marks), (topics, topic_marks)):
        for name, (value, words) in table.items():
            out = out + F.when(F.array_contains(tags, name) & T.any_hint(query, list(words)), value).otherwise(0.0)
    return out


def priority_boost(priority: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), priority)) / 1000


def _rule(query: tuple, delta: float, text: tuple = (), text_none: tuple = (), query_none: tuple = (), type: str | None = None) -> dict:
    return {"query_any": query, "query_none": query_none, "text_any": text, "text_none": text_none, "type": type, "delta": delta}


#: What sets like things apart, ranks of a head, two sites, teaching, training and the founding.
_HEAD, _DEPUTY, _A, _B = ("hieu truong",), ("pho hieu truong",), ("ha noi",), ("nam dinh",)
_TEACH, _COURSES = ("day mon", "mon gi", "mon nao", "giang day", "hoc phan", "day hoc"), ("cac hoc phan", "hoc phan ve")
_TRAIN, _FOUNDED, _BEFORE = ("dao tao gi", "nganh nao", "nganh gi", "chuong trinh dao tao", "ma nganh"), ("thanh lap",), ("tien than",)
CONTRAST = (
    _rule(_DEPUTY, 0.22, _DEPUTY),
    _rule(_DEPUTY, -0.10, _HEAD, _DEPUTY),
    _rule(_HEAD, 0.24, _HEAD, _DEPUTY, _DEPUTY),
    _rule(_HEAD, -0.12, _DEPUTY, (), _DEPUTY),
    _rule(_A, 0.22, _A),
    _rule(_A, -0.08, _B, _A),
    _rule(_B, 0.22, _B),
    _rule(_B, -0.08, _A, _B),
    _rule(_TEACH, 0.12, type="teaching"),
    _rule(_TEACH, 0.30, _COURSES),
    _rule(_TEACH, 0.14, ("toan hoc", "logic hoc", "vat ly", "hoa hoc")),
    _rule(_TEACH, -0.35, ("dia chi", "email", "website", "linh nam", "tran hung dao")),
    _rule(_TEACH, -0.18, ("nghien cuu",), _COURSES),
    _rule(_TRAIN, 0.10, type="training"),
    _rule(_TRAIN, 0.22, ("nganh dao tao", "dao tao khdl", "ma nganh", "chuong trinh cu nhan")),
    _rule(_TRAIN, 0.10, ("khoa hoc du lieu",)),
    _rule(_TRAIN, -0.18, ("dieu chinh chuong trinh", "quy che hoat dong")),
    _rule(_FOUNDED, 0.12, ("duoc thanh lap",)),
    _rule(_FOUNDED, 0.10, ("quyet dinh",)),
    _rule(_FOUNDED, 0.08, type="overview"),
    _rule(_FOUNDED, -0.05, _BEFORE, (), _BEFORE),
    _rule(_FOUNDED, -0.06, ("truong trung cap",), (), _BEFORE),
)


def named(full: str, *short: str) -> dict:
    """Keyword arguments of ``type_boost`` and ``contrast_boost`` for one institution: its short names ask for an overview, and a text that tells of the founding of its ``full`` name gets .22 more. All are normal forms."""
    marks = TYPE_MARKS | {"overview": (*TYPE_MARKS["overview"], *short)}
    return {"marks": marks, "rules": (*CONTRAST, _rule(_FOUNDED, 0.22, (f"{full} duoc thanh lap",)))}


def contrast_boost(pairs: DataFrame, rules: tuple[dict, ...] = CONTRAST) -> DataFrame:
    """``pairs`` (query and text normalised, chunk_type) with ``contrast``, the sum of the deltas of all rules that hold.

    A rule: query_any, query_none, text_any, text_none (substrings), type (or None), delta. The rules are a short fixed table, compiled into one expression.
    """
    out = F.lit(0.0)
    for r in rules:
        hold = T.any_hint(F.col("query"), list(r["query_any"]))
        for field, words, want in (("query", r.get("query_none"), False), ("text", r.get("text_any"), True), ("text", r.get("text_none"), False)):
            if words:
                some = T.any_hint(F.col(field), list(words))
                hold = hold & (some if want else ~some)
        if r.get("type"):
            hold = hold & (F.col("chunk_type") == r["type"])
        out = out + F.when(hold, F.lit(float(r["delta"]))).otherwise(0.0)
    return pairs.withColumn("contrast", out)


def lexical_seed_score(query: Column, q_words: Column, body: Column, base: Column) -> Column:
    """Share of the distinct query words that are words of the text + .25 if the query is in the text + .06 for each query word of four characters in it (again if repeated) + base. Texts are normalised."""
    distinct = F.array_distinct(F.filter(q_words, lambda t: t != ""))
    share = F.size(F.array_intersect(distinct, F.split(body, " "))) / F.greatest(F.lit(1), F.size(distinct))
    long = F.filter(q_words, lambda t: F.length(t) >= 4)
    return share + F.when((query != "") & body.contains(query), 0.25).otherwise(0.0) + 0.06 * _hits(long, body) + base


def diversified(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank, score): greedy pick from the best max(4k, 12) of each query; every pick lowers its like:
    .35 same dedupe key, .08 same parent, .04 same entity, .02 same type. Groups are bounded by the pool.
    """
    import pandas as pd

    pool = top(rows, max(4 * k, 12)).select("query_id", "id", F.col("score").cast("double").alias("score"), "dedupe_key", "parent", "entity", "chunk_type")
    loss = {"dedupe_key": 0.35, "parent": 0.08, "entity": 0.04, "chunk_type": 0.02}

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = pdf.to_dict("records"), []
        while left and len(out) < k:
            best = min(left, key=lambda r: (-round(r["score"], 9), r["id"]))
            left.remove(best)
            out.append((best["query_id"], best["id"], len(out) + 1, best["score"]))
            for r in left:
                r["score"] -= sum(x for c, x in loss.items() if r[c] and r[c] == best[c])
        return pd.DataFrame(out, columns=["query_id", "id", "rank", "score"])

    return pool.groupBy("query_id").applyInPandas(pick, "query_id string, id string, rank int, score double")


def tiered(rows: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, tier, id, score) of the tiers up to the first with evidence: its best at .72, or .56 with a second at .46."""
    ranked = top(rows, k, keys=("query_id", "tier"))
    by = ranked.groupBy("query_id", "tier").agg(F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    enough = (F.col("top") >= 0.72) | ((F.col("top") >= 0.56) & (F.coalesce("second", F.lit(0.0)) >= 0.46))
    last = by.groupBy("query_id").agg(F.min(F.when(enough, F.col("tier"))).alias("last"))
    return ranked.join(last, "query_id").where(F.col("last").isNull() | (F.col("tier") <= F.col("last"))).drop("last")


def merge_dedupe(lists: list[DataFrame], k: int) -> DataFrame:
    """Union of result lists (query_id, id, key, score): the best row of each key, then the k best."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    best = top(rows.withColumn("key", F.coalesce(F.nullif(F.col("key"), F.lit("")), F.col("id"))), 1, keys=("query_id", "key")).drop("rank")
    return top(best, k)


def strong(rows: DataFrame, least: float = 0.32) -> DataFrame:
    """Queries whose best score is ``least`` or more."""
    return rows.groupBy("query_id").agg(F.max("score").alias("top")).where(F.col("top") >= least)


def keyword_facets(hits: DataFrame, weights: DataFrame, limit: int = 24) -> DataFrame:
    """(query_id, term, keyword_id, hits, weight, rank) of the keywords of each result set."""
    rows = hits.select("query_id", "id").join(weights.select("id", "term", "weight"), "id")
    sums = rows.groupBy("query_id", "term").agg(F.count("*").alias("hits"), F.max("weight").alias("weight"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc(F.round("weight", 9)), "term")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("keyword_id", T.keyword_id("term"))


def context_pack(hits: DataFrame, k: int = 3, long: int = 520, short: int = 300) -> DataFrame:
    """(query_id, prompt) from hits (query_id, id, score, title, text): the k best, the first cut at ``long`` characters and the others at ``short``."""
    ranked = top(hits, k)
    body = F.when(F.col("rank") == 1, F.substring("text", 1, long)).otherwise(F.substring("text", 1, short))
    line = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit("\n"), body)
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n").alias("prompt"))
