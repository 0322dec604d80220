"""Retriever training data: positives, hard negatives, qrels, pairs, triplets, exports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import inverted as V
from .search import top


def corpus_union(seed: DataFrame, local: DataFrame) -> DataFrame:
    """Both sources in one schema, blank texts dropped."""
    return seed.unionByName(local, allowMissingColumns=True).where(F.trim(F.coalesce("text", F.lit(""))) != "")


#: Routes whose answers teach nothing, verdicts that reject a turn or support it, and the domain that counts as none.
BAD_ROUTES = ("admin_review_override", "clarification", "control", "meta", "out_of_scope", "partial_scope", "policy_block", "sensitive_block")
REJECTED, CORRECT, HALF = ("incorrect", "excessive"), "correct", ("partial", "missing")
NO_DOMAIN = "general_docs"
#: Chunk types that answer a type of query.
ACCEPTED = {
    "contact": ("contact", "location"),
    "location": ("location", "contact", "overview"),
    "role": ("role", "record"),
    "howto": ("howto",),
    "history": ("history", "overview"),
    "function": ("function", "duty", "overview"),
    "generic": ("overview", "fact", "contact", "location", "role", "history", "function", "duty", "howto", "record"),
}


def verdicts_of(reviews: DataFrame) -> DataFrame:
    """(turn_id, verdicts) of answer reviews."""
    answers = reviews.where("coalesce(nullif(review_kind, ''), 'answer') = 'answer'")
    return answers.groupBy("turn_id").agg(F.collect_set(F.trim("verdict")).alias("verdicts"))


def _any(verdicts: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(verdicts, F.array(*[F.lit(n) for n in names])), F.lit(False))


def usable_turns(turns: DataFrame, reviews: DataFrame, ratings: DataFrame, least: int = 2) -> DataFrame:
    """(turn_id, usable, reason) of turns (turn_id, question, route, domain, top_score), where top_score is the best score of the turn's contexts, null if it has none.

    Confidence is 2 for a rating of 4 or more (1 for 3), 2 for a correct verdict (1 for a half right one), 2 for a top score of .75 (1 for .55) and 1 for a domain; ``least`` is needed.
    """
    rows = turns.join(verdicts_of(reviews), "turn_id", "left").join(ratings.select("turn_id", "rating"), "turn_id", "left")
    rating, top = F.coalesce("rating", F.lit(0)), F.col("top_score")
    right, half = _any(F.col("verdicts"), (CORRECT,)), _any(F.col("verdicts"), HALF)
    sure = F.when(rating >= 4, 2).when(rating == 3, 1).otherwise(0) + F.when(right, 2).when(half, 1).otherwise(0) + F.when(top >= 0.75, 2).when(top >= 0.55, 1).otherwise(0)
    sure = sure + F.when(~F.coalesce("domain", F.lit("")).isin("", NO_DOMAIN), 1).otherwise(0)
    reason = (
        F.when(T.ws("question") == "", "empty_question")
        .when(top.isNull(), "no_contexts")
        .when(F.col("route").isin(*BAD_ROUTES), F.concat(F.lit("bad_route:"), "route"))
        .when(_any(F.col("verdicts"), REJECTED), "review_rejected")
        .when((rating != 0) & (rating <= 2), "feedback_rejected")
        .when(sure < least, "low_confidence")
        .otherwise("ok")
    )
    return rows.select("turn_id", (reason == "ok").alias("usable"), reason.alias("reason"))


def query_quality(rows: DataFrame) -> DataFrame:
    """(turn_id, quality) of (turn_id, origin, rating, verdicts, top_score): 1 for seed questions; else .45 + .20 for a rating of 4 or more (.08 for 3)
    + .22 for a correct verdict (.10 for a half right one) + .13, .08 or .04 for a top score of 1, .7 or .5; four digits."""
    rating, top = F.coalesce("rating", F.lit(0)), F.coalesce("top_score", F.lit(0.0))
    q = 0.45 + F.when(rating >= 4, 0.20).when(rating == 3, 0.08).otherwise(0.0)
    q = q + F.when(_any(F.col("verdicts"), (CORRECT,)), 0.22).when(_any(F.col("verdicts"), HALF), 0.10).otherwise(0.0)
    q = q + F.when(top >= 1.0, 0.13).when(top >= 0.7, 0.08).when(top >= 0.5, 0.04).otherwise(0.0)
    return rows.select("turn_id", F.when(F.col("origin") == "seed_qa", 1.0).otherwise(F.round(F.least(F.lit(1.0), q), 4)).alias("quality"))


#: What a shared field counts when the corpus row of a logged context is chosen.
MATCH = {"doc_id": 1.0, "kind": 0.6, "title": 0.9, "question": 1.2, "answer": 1.0, "text": 0.8}


def _matches(values: dict[str, Column], weights: dict[str, float]) -> list[Column]:
    """(n, key, score) for each set of fields that a context and a corpus row may share: some of title, question and text, or the dedupe key, with or without kind and document. Null where a field is."""
    found = [k for n in (1, 2, 3) for k in combinations(("title", "question", "text"), n)] + [("dedupe",)]
    sets = [k + m for k in found for n in (0, 1, 2) for m in combinations(("kind", "doc_id"), n)]
    out = []
    for i, names in enumerate(sets):
        score = round(sum(weights.get(c, 0.0) for c in names), 6)
        if score > 0:
            some = F.md5(F.concat(*[F.concat(F.length(values[c]).cast("string"), F.lit(":"), values[c]) for c in names]))
            out.append(F.struct(F.lit(i).alias("n"), some.alias("key"), F.lit(score).alias("score")))
    return out


def resolve_contexts(contexts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(context_id, id, score): the corpus row of a logged context (context_id, source_id, kind, title, question, answer, dedupe_key, doc_id, text).

    A source_id that the corpus has is the answer (score null). Otherwise rows are found by question, title, dedupe key, text, or the answer as text, and scored by MATCH; the best
    with a positive score stays, ties to the greater id. Each set of fields has one row with the greatest id, and the best set that a context shares with any row gives its
    score, so contexts and rows with the same title or text never meet in pairs.
    """
    known = contexts.join(corpus.select(F.col("id").alias("source_id"), "id"), "source_id").select("context_id", "id", F.lit(None).cast("double").alias("score"))
    rest = contexts.join(known.select("context_id"), "context_id", "left_anti")
    digest = lambda x: F.when(T.norm_ascii(x) != "", F.md5(T.norm_ascii(x)))
    plain = lambda x: F.when(F.trim(x) != "", F.trim(x))
    shared = {"title": digest("title"), "question": digest("question"), "dedupe": plain(F.col("dedupe_key")), "doc_id": F.col("doc_id").cast("string")}
    own = corpus.select("id", *[v.alias(c) for c, v in {**shared, "text": digest("text"), "kind": F.nullif(F.col("source_kind"), F.lit(""))}.items()])
    asked = rest.select("context_id", *[v.alias(c) for c, v in {**shared, "text": digest("text"), "answer": digest("answer"), "kind": F.nullif(F.col("kind"), F.lit(""))}.items()])
    weights = {c: MATCH[c] for c in ("title", "question", "kind", "doc_id")}
    cols = {c: F.col(c) for c in ("title", "question", "text", "dedupe", "kind", "doc_id")}
    both = F.coalesce(F.col("text") == F.col("answer"), F.lit(False))
    each = []  # a row's text may be the context's text, its answer, or both
    for when, value, worth in ((both, "text", MATCH["text"] + MATCH["answer"]), (~both, "text", MATCH["text"]), (~both, "answer", MATCH["answer"])):
        part = asked.where(when).select("context_id", F.explode(F.array(*_matches({**cols, "text": F.col(value)}, {**weights, "text": worth}))).alias("m"))
        each.append(part.select("context_id", "m.n", "m.key", "m.score").where("key is not null"))
    sides = each[0].unionByName(each[1]).unionByName(each[2])
    ones = own.select("id", F.explode(F.array(*_matches(cols, {**weights, "text": MATCH["text"]}))).alias("m")).select("id", "m.n", "m.key").where("key is not null")
    met = sides.join(ones.groupBy("n", "key").agg(F.max("id").alias("id")), ["n", "key"])
    best = met.groupBy("context_id").agg(F.max(F.struct("score", "id")).alias("b"))
    return best.select("context_id", "b.id", "b.score").unionByName(known)


def history_positives(contexts: DataFrame, n: int = 2, floor: float = 0.32, share: float = 0.68) -> DataFrame:
    """(query_id, id, rank): of a query's eight best contexts the first, and others at max(floor, share of the first); ``n`` at most."""
    eight = top(contexts, 8)
    first = F.first_value("score").over(Window.partitionBy("query_id").orderBy("rank"))
    kept = eight.withColumn("_t", first).where((F.col("rank") == 1) | (F.col("score") >= F.greatest(F.lit(floor), F.col("_t") * share)))
    return kept.where(F.col("rank") <= n).select("query_id", "id", "rank")


def positive_match(rows: DataFrame, tokens: Column, common: tuple[str, ...]) -> DataFrame:
    """Rows where a query token of three characters that is not common is a substring of title, entity, text or question; all if there is no such token. Text columns are normalised."""
    listed = F.array(*[F.lit(t) for t in common])
    own = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(listed, t))
    both = F.concat_ws(" ", "title_n", "entity_n", "body", "question_n")
    return rows.withColumn("_own", own).withColumn("_all", both).where((F.size("_own") == 0) | F.exists("_own", lambda t: F.col("_all").contains(t))).drop("_own", "_all")


def _accepts(query_type: Column, chunk_type: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether a chunk type answers a query type; unknown query types are generic."""
    out = chunk_type.isin(*table["generic"])
    for name, types in table.items():
        if name != "generic":
            out = F.when(query_type == name, chunk_type.isin(*types)).otherwise(out)
    return out


def positive_expand(positives: DataFrame, queries: DataFrame, corpus: DataFrame, common: tuple[str, ...], accepted: dict[str, tuple[str, ...]] = ACCEPTED, n: int = 3) -> DataFrame:
    """(query_id, id): up to ``n`` other chunks of the positives' entities and domains, of an accepted type or none, that match the query (``positive_match``).

    .25 for seed chunks, .30 for an accepted type, .35 for the very type asked for, .05 for a text that is not just its summary; ties to the greater id. queries: query_id, query_type, tokens.
    """
    base = positives.join(corpus.select("id", "domain", T.norm_ascii("entity_name").alias("entity_n")), "id")
    entities = base.where("entity_n <> ''").select("query_id", "entity_n").distinct()
    domains = base.where("domain <> ''").select("query_id", "domain").distinct()
    own = corpus.withColumns({"entity_n": T.norm_ascii("entity_name"), "title_n": T.norm_ascii("title"), "body": T.norm_ascii("text"), "question_n": T.norm_ascii("question")})
    own = own.select("id", "domain", "entity_n", "title_n", "body", "question_n", "chunk_type", "source_kind", F.length("body").alias("_len"), T.norm_ascii("summary").alias("_summary"))
    more = entities.join(own, "entity_n").join(domains, ["query_id", "domain"], "left_semi").join(positives.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = more.join(queries.select("query_id", F.col("query_type").alias("asked"), "tokens"), "query_id").withColumn("fits", _accepts(F.col("asked"), F.col("chunk_type"), accepted))
    more = positive_match(more.where((F.col("chunk_type") == "") | F.col("fits")), F.col("tokens"), common)
    score = F.when(F.col("source_kind") == "seed", 0.25).otherwise(0.0) + F.when(F.col("fits"), 0.30).otherwise(0.0)
    score = score + F.when((F.col("asked") != "generic") & (F.col("chunk_type") == F.col("asked")), 0.35).otherwise(0.0) + F.when((F.col("body") != "") & (F.col("body") != F.col("_summary")), 0.05).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 6)), F.desc("id"))
    return more.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("query_id", "id")


def seed_queries(qa: DataFrame, n: int = 3) -> DataFrame:
    """(origin_id, query, pos): a QA's question and variants of six characters or more that are not contained in the question; ``n`` at most. qa: origin_id, question, variants."""
    rows = qa.select("origin_id", "question", F.posexplode(F.concat(F.array("question"), "variants")).alias("pos", "query"))
    rows = rows.withColumn("query", T.ws("query")).where((F.length("query") >= 6) & ((F.col("pos") == 0) | ~T.norm("question").contains(T.norm("query"))))
    w = Window.partitionBy("origin_id").orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("origin_id", "query", "pos")


def lexical_negatives(queries: DataFrame, q_tokens: Column, corpus: DataFrame, c_tokens: Column, positives: DataFrame, least: float = 0.18) -> DataFrame:
    """(query_id, id, score, source): chunks that share tokens with a query: overlap + .18 same domain + .16 its type - .22 a positive's entity + .05 a positive's domain; no positives, no copies of them.

    ``source`` is the last of lexical, same_domain, same_type that holds. Overlaps come from an index of the chunks, shard by shard, so no word makes
    pairs of queries and chunks; every chunk with a shared token is judged, as a domain alone reaches ``least``. Without queries no chunk is read.
    """
    corpus = corpus.where(F.lit(not queries.isEmpty()))
    q = queries.select("query_id", F.col("domain").alias("q_domain"), F.col("query_type").alias("asked"))
    index = V.build(corpus, c_tokens)
    share = V.search(index, queries, q_tokens, None, "overlap").select("query_id", "id", F.col("score").alias("overlap"))
    named = positives.join(corpus.select("id", "domain", T.norm_ascii("entity_name").alias("entity_n"), "dedupe_key"), "id")
    sets = named.groupBy("query_id").agg(F.collect_set("domain").alias("p_domains"), F.collect_set("entity_n").alias("p_entities"), F.collect_set("dedupe_key").alias("p_keys"), F.collect_set("id").alias("p_ids"))
    rows = share.join(corpus.select("id", "domain", "chunk_type", T.norm_ascii("entity_name").alias("entity_n"), "dedupe_key"), "id")
    rows = rows.join(q.join(sets, "query_id", "left"), "query_id")  # a query has two positives or so
    in_ = lambda name, value: F.coalesce(F.array_contains(name, F.col(value)), F.lit(False))
    rows = rows.where(~in_("p_ids", "id") & ~in_("p_keys", "dedupe_key"))
    domain, kind = F.col("domain") == F.col("q_domain"), F.col("chunk_type") == F.col("asked")
    score = F.col("overlap") + F.when(domain, 0.18).otherwise(0.0) + F.when(kind, 0.16).otherwise(0.0) - F.when((F.col("entity_n") != "") & in_("p_entities", "entity_n"), 0.22).otherwise(0.0) + F.when(in_("p_domains", "domain"), 0.05).otherwise(0.0)
    source = F.when(kind, "same_type").when(domain, "same_domain").otherwise("lexical")
    return rows.withColumns({"score": F.round(score, 9), "source": source}).where(F.col("score") >= least).select("query_id", "id", "score", "source")


def retrieved_negatives(retrieved: DataFrame, queries: DataFrame, corpus: DataFrame, positives: DataFrame, accepted: dict[str, tuple[str, ...]] = ACCEPTED) -> DataFrame:
    """Retrieved (query_id, id, score) that are no positives, no copies of one, and no chunk of a positive's entity with a type that answers the query."""
    named = positives.join(corpus.select("id", T.norm_ascii("entity_name").alias("entity_n"), "dedupe_key"), "id")
    rows = retrieved.join(corpus.select("id", "chunk_type", T.norm_ascii("entity_name").alias("entity_n"), "dedupe_key"), "id").join(queries.select("query_id", "query_type"), "query_id")
    rows = rows.join(positives.select("query_id", "id"), ["query_id", "id"], "left_anti").join(named.where("dedupe_key <> ''").select("query_id", "dedupe_key"), ["query_id", "dedupe_key"], "left_anti")
    same = named.where("entity_n <> ''").select("query_id", "entity_n").distinct().withColumn("_same", F.lit(True))
    rows = rows.join(same, ["query_id", "entity_n"], "left").where(~(F.coalesce("_same", F.lit(False)) & _accepts(F.col("query_type"), F.col("chunk_type"), accepted)))
    return rows.select("query_id", "id", "score")


def short_of(queries: DataFrame, retrieved: DataFrame, n: int) -> DataFrame:
    """Queries with fewer than ``n`` retrieved negatives: all others take none from elsewhere."""
    full = retrieved.groupBy("query_id").agg(F.countDistinct("id").alias("_n")).where(F.col("_n") >= n)
    return queries.join(full.select("query_id"), "query_id", "left_anti")


def hard_negatives(retrieved: DataFrame, lexical: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, id, source, score, rank): retrieved negatives first, then lexical ones, each by score (ties among the former to the smaller id, among the latter to the greater), one for each id."""
    rows = retrieved.select("query_id", "id", "score", F.lit("retrieval").alias("source"), F.lit(0).alias("_s")).unionByName(lexical.select("query_id", "id", "score", "source", F.lit(1).alias("_s")))
    one = Window.partitionBy("query_id", "id").orderBy("_s")
    order = Window.partitionBy("query_id").orderBy("_s", F.desc(F.round("score", 9)), F.when(F.col("_s") == 0, F.col("id")), F.desc("id"))
    kept = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return kept.select("query_id", "id", "source", "score", "rank")


def id_split(key: Column, val: float = 0.15) -> Column:
    """``val`` for the first ten-thousandths of the keys' hashes."""
    return F.when(T.hash_bucket(key) % 10000 < int(val * 10000), "val").otherwise("train")


def qrels(positives: DataFrame) -> DataFrame:
    return positives.select("query_id", "id", F.lit(1).alias("label")).distinct()


def reranker_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(pair_id, query_id, id, label) of queries with negatives, one for each pair_id."""
    some = negatives.select("query_id").distinct()
    pos = positives.join(some, "query_id", "left_semi").select("query_id", "id", F.lit(1).alias("label"))
    rows = pos.unionByName(negatives.select("query_id", "id", F.lit(0).alias("label")))
    return rows.select(T.stable_id("pair", F.col("query_id"), F.col("id"), F.col("label")).alias("pair_id"), "query_id", "id", "label").dropDuplicates(["pair_id"])


def triplets(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(triplet_id, query_id, positive_id, negative_id)."""
    rows = positives.select("query_id", F.col("id").alias("positive_id")).join(negatives.select("query_id", F.col("id").alias("negative_id")), "query_id")
    return rows.select(T.stable_id("tri", F.col("query_id"), F.col("positive_id"), F.col("negative_id")).alias("triplet_id"), "query_id", "positive_id", "negative_id")


def counts_by(rows: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, n) for each dimension and overall, in one pass."""
    pairs = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))


def difficulty(scores: Column) -> Column:
    """ln(1 + mean of the positive scores) / ln 4 between 0 and 1; .5 without any."""
    good = F.filter(scores, lambda s: s > 0)
    mean = F.aggregate(good, F.lit(0.0), lambda a, s: a + s) / F.size(good)
    return F.when(F.size(good) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(mean) / F.log(F.lit(4.0)))))


def weight(quality: Column, hard: Column, origin: Column) -> Column:
    """quality (.75 + .5 difficulty), times .92 for all but seed questions, between .15 and 1.25, six digits.

    Half a millionth is common here, as difficulty has six digits and counts half; it goes up if a million times the weight, as a double, does not fall short of it.
    """
    raw = quality * (0.75 + 0.5 * F.round(hard, 6)) * F.when(origin == "seed_qa", 1.0).otherwise(0.92)
    return F.round(F.greatest(F.lit(0.15), F.least(F.lit(1.25), raw)) * 1e6) / 1e6


def bi_encoder(queries: DataFrame, positives: DataFrame, negatives: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, query, positives, negatives, difficulty, weight): texts in order of id; queries that lack either side are dropped."""
    text = corpus.select("id", "text")

    def side(rows: DataFrame, name: str) -> DataFrame:
        pair = F.struct("id", "text")
        return rows.select("query_id", "id").distinct().join(text, "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x.text).alias(name))

    hard = negatives.groupBy("query_id").agg(difficulty(F.array_sort(F.collect_list("score"))).alias("difficulty"))
    rows = queries.join(side(positives, "positives"), "query_id").join(side(negatives, "negatives"), "query_id").join(hard, "query_id")
    return rows.select("query_id", "query", "positives", "negatives", "difficulty", weight(F.col("quality"), F.col("difficulty"), F.col("origin")).alias("weight"))


def cross_encoder(pairs: DataFrame, negatives: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(pair_id, query_id, query, text, label, quality, weight): a pair is as difficult as its own negative score says; positives are half difficult."""
    scores = negatives.select("query_id", "id", F.lit(0).alias("label"), F.when(F.col("score") > 0, F.array("score")).alias("scores"))
    rows = pairs.join(scores, ["query_id", "id", "label"], "left").join(queries.select("query_id", "query", "quality", "origin"), "query_id").join(corpus.select("id", "text"), "id", "left")
    hard = difficulty(F.coalesce("scores", F.array().cast("array<double>")))
    return rows.select("pair_id", "query_id", "query", F.coalesce("text", F.lit("")).alias("text"), "label", "quality", weight(F.col("quality"), hard, F.col("origin")).alias("weight"))


def curriculum(rows: DataFrame, least: float = 0.9) -> DataFrame:
    return rows.where((F.col("split") == "train") & (F.col("quality") >= least))
