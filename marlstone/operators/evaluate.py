"""Ranking metrics and groundedness of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rank_metrics(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, recall, mrr, ndcg) of every query with relevant ids; ranked: (query_id, id, rank), qrels: (query_id, id)."""
    rel = qrels.select("query_id", "id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = rel.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"])
    cut = n.crossJoin(F.broadcast(n.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    met = cut.join(hits, "query_id", "left")
    inside = F.col("rank") <= F.col("k")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("n").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    gain = F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    return (
        met.groupBy("query_id", "k", "n")
        .agg(F.sum(F.when(inside, 1).otherwise(0)).alias("hit"), F.min(F.when(inside, F.col("rank"))).alias("first"), gain.alias("gain"))
        .select("query_id", "k", (F.col("hit") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("gain") / ideal).alias("ndcg"))
    )


def breakdown(metrics: DataFrame, queries: DataFrame, dims: tuple[str, ...] = ("origin", "query_type", "domain")) -> DataFrame:
    """Means overall and by each dimension: (level, value, k, queries, recall, mrr, ndcg), with one pass of grouping sets."""
    pairs = F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("level"), F.col(d).alias("value")) for d in dims])
    rows = metrics.join(queries.select("query_id", *dims), "query_id").withColumn("p", F.explode(pairs))
    return rows.groupBy("p.level", "p.value", "k").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def grounded(answer: Column, context: Column) -> Column:
    """Every email, url and digit token of the answer is in the context, and max(4, n / 3) of its important tokens at most are not."""
    own, known = T.important_tokens(answer), T.important_tokens(context)
    hard = F.filter(own, lambda t: t.contains("@") | t.contains("http") | t.rlike("[0-9]"))
    missing = F.size(F.array_except(own, known))
    return (F.size(F.array_except(hard, known)) == 0) & (missing <= F.greatest(F.lit(4), F.floor(F.size(own) / 3).cast("int")))


def grounded_in_conversation(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, order, grounded) of every assistant message against all messages before it (key, order, role, text).

    A token is known if the conversation had it before: the first place of each token is one row, so no message is collected again for those after it.
    """
    rows = messages.select(key, order, "role", T.important_tokens("text").alias("t"))
    first = rows.select(key, order, F.explode("t").alias("token")).groupBy(key, "token").agg(F.min(order).alias("_first"))
    own = rows.where("role = 'assistant'").select(key, order, F.explode_outer("t").alias("token"))
    met = own.join(first, [key, "token"], "left").withColumn("_new", F.col("token").isNotNull() & (F.coalesce("_first", F.col(order)) >= F.col(order)))
    hard = F.col("token").contains("@") | F.col("token").contains("http") | F.col("token").rlike("[0-9]")
    by = met.groupBy(key, order).agg(F.count("token").alias("n"), F.sum(F.col("_new").cast("int")).alias("missing"), F.sum((F.col("_new") & F.coalesce(hard, F.lit(False))).cast("int")).alias("hard"))
    return by.select(key, order, ((F.col("hard") == 0) & (F.col("missing") <= F.greatest(F.lit(4), F.floor(F.col("n") / 3)))).alias("grounded"))


def coverage(tokens: Column, x: Column) -> Column:
    """Share of the distinct tokens that are substrings of a text."""
    distinct = F.array_distinct(tokens)
    return F.size(F.filter(distinct, lambda t: x.contains(t))) / F.greatest(F.lit(1), F.size(distinct))


def focus(answer_tokens: Column, question_tokens: Column) -> Column:
    """Share of the answer's tokens that the question has."""
    return F.size(F.filter(answer_tokens, lambda t: F.array_contains(question_tokens, t))) / F.greatest(F.lit(1), F.size(answer_tokens))


#: Weights of an answer's parts, bonuses by where it comes from, the support of a grounded answer, and the lead that another answer needs.
WEIGHTS = {"support": 0.35, "relevance": 0.22, "focus": 0.18, "brevity": 0.13, "reward": 0.12}
BONUS = {"original": 0.02, "rule": 0.18, "fallback": 0.02}
GUARDED, LEAD, RESCUE = 0.85, 0.08, 0.3
SHORT_INTENTS = ("factoid", "contact", "howto")


def answer_score(guarded: Column, support: Column, relevance: Column, focused: Column, length: Column, intent: Column, specificity: Column, reward: Column, source: Column) -> Column:
    """The score by which answers to one question are ranked.

    A grounded answer's support is GUARDED at least; answers over 220 characters lose brevity under SHORT_INTENTS; steps count .12 each, .35 at most, in how-to answers.
    """
    brief = F.when(intent.isin(*SHORT_INTENTS), F.least(F.lit(1.0), 220.0 / F.greatest(F.lit(220.0), length.cast("double")))).otherwise(1.0)
    held = F.when(guarded, F.greatest(support, F.lit(GUARDED))).otherwise(support)
    bonus = F.lit(0.0)
    for name, value in BONUS.items():
        bonus = F.when(source == name, value).otherwise(bonus)
    out = WEIGHTS["support"] * held + WEIGHTS["relevance"] * relevance + WEIGHTS["focus"] * focused + WEIGHTS["brevity"] * brief + WEIGHTS["reward"] * (reward - 0.5) + bonus
    return out + F.when(intent == "howto", F.least(F.lit(0.35), 0.12 * specificity)).otherwise(0.0)


def choose_answer(candidates: DataFrame, key: str) -> DataFrame:
    """(key, answer, top): of candidates (key, text, source, total, guarded, pos) the best, if it leads the original by LEAD; the original if it is the best; the best
    if the original is not grounded and the best reaches RESCUE; else the original. Ties go to the earlier ``pos``."""
    order = F.struct(-F.col("total"), F.col("pos"))
    own = F.col("source") == "original"
    by = candidates.groupBy(key).agg(
        F.min_by("text", order).alias("best"), F.min_by("source", order).alias("from"), F.max("total").alias("top"),
        F.coalesce(F.max(F.when(own, F.col("total"))), F.lit(0.0)).alias("base"), F.max(F.when(own, F.col("text"))).alias("own"), F.coalesce(F.max(F.when(own, F.col("guarded"))), F.lit(False)).alias("held"),
    )
    switch = (F.col("from") != "original") & ((F.col("top") >= F.col("base") + LEAD) | (~F.col("held") & (F.col("top") >= RESCUE)))
    return by.select(key, F.when(switch, F.col("best")).otherwise(F.col("own")).alias("answer"), "top")


#: By how much a rule's answer must be more specific in how-to questions, and more to the point in others.
STEP_LEAD, FOCUS_LEAD = 0.4, 0.03


def rule_first(same: Column, intent: Column, guarded: Column, rule_steps: Column, steps: Column, rule_focus: Column, focused: Column, rule_length: Column, length: Column) -> Column:
    """What a rule's answer does before any ranking: ``keep`` the given answer (the same words), ``rule`` (take the rule's), or null (rank).

    Lists take the rule's answer. Under SHORT_INTENTS it is taken where the given answer is not grounded, is less specific by STEP_LEAD in a how-to
    question, has less focus by FOCUS_LEAD, or is twice as long.
    """
    short = ~guarded | ((intent == "howto") & (rule_steps >= steps + STEP_LEAD)) | (rule_focus >= focused + FOCUS_LEAD) | (rule_length * 2 <= F.greatest(F.lit(1), length))
    return F.when(same, "keep").when((intent == "list") | (intent.isin(*SHORT_INTENTS) & short), "rule")


def verified_answer(candidates: DataFrame, key: str) -> DataFrame:
    """(key, answer, how): of candidates (those of ``choose_answer``, and norm, intent, steps, focus, length) the answer after all rules.

    The first candidate whose source is ``rule`` (by ``pos``) is the rule's answer. ``how`` is rule, keep or ranked. Without an original answer the best stays.
    """
    fields = F.struct("pos", "text", "norm", "intent", "guarded", "steps", "focus", "length")
    two = candidates.groupBy(key).agg(F.min(F.when(F.col("source") == "rule", fields)).alias("r"), F.min(F.when(F.col("source") == "original", fields)).alias("o"))
    way = rule_first(F.col("r.norm") == F.col("o.norm"), F.col("o.intent"), F.col("o.guarded"), F.col("r.steps"), F.col("o.steps"), F.col("r.focus"), F.col("o.focus"), F.col("r.length"), F.col("o.length"))
    way = F.when(F.col("r").isNotNull() & F.col("o").isNotNull(), way)
    rows = choose_answer(candidates, key).join(two.select(key, "r", "o", way.alias("way")), key)
    answer = F.when(F.col("way") == "keep", F.col("o.text")).when(F.col("way") == "rule", F.col("r.text")).otherwise(F.col("answer"))
    return rows.select(key, answer.alias("answer"), F.coalesce("way", F.lit("ranked")).alias("how"), "top")


def replaces(guarded: Column, same: Column, focus_gain: Column, coverage_gain: Column, length: Column, answer_length: Column, reward_gain: Column) -> Column:
    """Whether a grounded candidate of other words takes an answer's place: more focus (.03) or coverage (.15), 80 characters shorter, or a better reward (.12) at hardly less of both (.08)."""
    better = (focus_gain >= 0.03) | (coverage_gain >= 0.15) | (length + 80 < answer_length) | ((reward_gain >= 0.12) & (focus_gain + coverage_gain >= -0.08))
    return guarded & ~same & (length > 0) & better
