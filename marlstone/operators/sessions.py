"""Conversations, feedback, reviews and contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def turn_pairing(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_id, user_turn, question, answer): each assistant message with the latest user message before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.last(F.when(F.col("role") == "user", F.struct("turn", "text")), ignorenulls=True).over(w)
    rows = messages.withColumn("_u", user).where("role = 'assistant'")
    return rows.select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("turn_id"), F.col("_u.turn").alias("user_turn"), F.coalesce("_u.text", F.lit("")).alias("question"), F.col("text").alias("answer")
    )


def parse_debug(rows: DataFrame, col: str, schema: str) -> DataFrame:
    """``rows`` with the JSON text as a struct of the schema; what can't be read is a struct of nulls."""
    return rows.withColumn(col, F.from_json(F.coalesce(col, F.lit("{}")), schema))


#: Routes and families that take no feedback, routes that always do, and the domain that counts as none.
CLOSED_ROUTES = ("meta", "out_of_scope", "control", "clarification", "web_notice_only")
CLOSED_FAMILIES = ("meta", "out_of_scope", "clarification")
OPEN_ROUTES = ("policy_block", "sensitive_block", "partial_scope", "admin_review_override")
NO_DOMAIN = "general_docs"


def feedback_eligible(turns: DataFrame) -> DataFrame:
    """(turn_id, eligible): no closed route or family, and a route that always takes feedback or a domain. ``turns`` has route, family and domain."""
    route, group, domain = (F.coalesce(c, F.lit("")) for c in ("route", "family", "domain"))
    ok = ~route.isin(*CLOSED_ROUTES) & ~group.isin(*CLOSED_FAMILIES) & (route.isin(*OPEN_ROUTES) | ~domain.isin("", NO_DOMAIN))
    return turns.select("turn_id", ok.alias("eligible"))


def history_totals(messages: DataFrame) -> DataFrame:
    """One row: files, messages, turns (half of each file's messages, rounded down)."""
    by = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("files"), F.sum("n").alias("messages"), F.sum(F.floor(F.col("n") / 2)).alias("turns"))


def top_counters(rows: DataFrame, metrics: dict[str, Column], limit: int = 12) -> DataFrame:
    """(metric, value, n, rank): the ``limit`` most frequent values of each metric; blank values left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("string").alias("value")) for k, v in metrics.items()]))
    counts = rows.select(each.alias("e")).where("e.value <> ''").groupBy("e.metric", "e.value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("metric").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


#: Marks of a question about a unit, which gives two turns of context, and domains that give one.
CONTEXT_MARKS = ("khoa ", "phong ", "hieu truong", "pho hieu truong", "ban giam hieu", "co so", "cong sinh vien")
CONTEXT_DOMAINS = ("khoa_chuyen_mon", "phong_ban_va_chuc_nang", "ban_giam_hieu", "co_so_vat_chat", "portal_howto")


def session_memory(turns: DataFrame, marks: tuple[str, ...] = CONTEXT_MARKS, domains: tuple[str, ...] = CONTEXT_DOMAINS) -> DataFrame:
    """What a session remembers after its last turn, one row for each conv_id.

    turns: conv_id, turn, answered, domain, doc, entity, unit, qtype, retrieved (array), topic, channel, use_history, question, question_n (its normal form), answer.
    The last answered turn gives domain, doc, entity, unit, type, six retrieved ids and topic; every turn gives query and channel, and its answer unless it has none
    and is not answered. Turns of context: an answered turn that asks without history sets them to 2 (a mark in the question), 1 (its domain is listed) or 0; any other
    turn takes one. So only the last two turns decide them, and all else is the latest of something: partial aggregates, no conversation is gathered.
    """
    found = F.struct("domain", "doc", "entity", "unit", "qtype", F.array_join(F.slice("retrieved", 1, 6), ",").alias("ids"), "topic")
    sets = F.col("answered") & ~F.col("use_history")
    value = F.when(T.any_hint(F.col("question_n"), list(marks)), 2).when(F.col("domain").isin(*domains), 1).otherwise(0)
    latest = turns.groupBy("conv_id").agg(
        F.max_by(F.when(F.col("answered"), found), F.when(F.col("answered"), F.col("turn"))).alias("f"),
        F.max_by(F.struct("question", "channel"), "turn").alias("s"),
        F.max_by(F.when(F.col("answered") | (F.col("answer") != ""), F.col("answer")), F.when(F.col("answered") | (F.col("answer") != ""), F.col("turn"))).alias("answer"),
    )
    after = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) - 1
    tail = turns.select("conv_id", "turn", F.when(sets, value).alias("v")).withColumn("after", after).where("after < 2")
    left = tail.groupBy("conv_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("after"))).alias("v"), F.min(F.when(F.col("v").isNotNull(), F.col("after"))).alias("after"))
    rows = latest.join(left, "conv_id")
    text = lambda c, none="": F.coalesce(c, F.lit(none))
    return rows.select(
        "conv_id",
        text("f.domain").alias("active_domain"),
        text("f.doc").alias("active_doc"),
        text("f.entity").alias("last_entity"),
        text("f.unit").alias("last_named_unit"),
        text("f.qtype", "factoid").alias("last_question_type"),
        text("f.ids").alias("last_retrieved_ids"),
        text("f.topic").alias("last_topic"),
        F.col("s.question").alias("last_user_query"),
        text("answer").alias("last_assistant_answer"),
        F.col("s.channel").alias("last_channel"),
        F.coalesce(F.greatest(F.lit(0), F.col("v") - F.col("after")), F.lit(0)).cast("int").alias("context_turns"),
    )


def file_samples(turns: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` turns of each conversation, texts cut."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("conv_id", "n", F.substring("question", 1, 100).alias("question"), F.substring("answer", 1, 60).alias("extra"))


def review_current(log: DataFrame, variants: DataFrame) -> DataFrame:
    """State of each turn's review: the last write wins, the first gives created_at, defaults for unknown verdicts and kinds, variants unioned."""
    last = F.max_by(F.struct("user_question", "assistant_answer", "verdict", "review_kind", "approved_answer", "active", "updated_at"), "seq")
    state = log.groupBy("turn_id").agg(last.alias("s"), F.min("updated_at").alias("created_at"), F.count("*").alias("writes"))
    verdict = F.when(F.col("s.verdict").isin("correct", "incorrect", "missing", "excessive", "partial"), F.col("s.verdict")).otherwise("partial")
    kind = F.when(F.col("s.review_kind").isin("answer", "policy"), F.col("s.review_kind")).otherwise("answer")
    approved = F.when((F.trim("s.approved_answer") == "") & (F.col("s.verdict") == "correct"), F.col("s.assistant_answer")).otherwise(F.col("s.approved_answer"))
    named = variants.groupBy("turn_id").agg(F.slice(F.sort_array(F.collect_set(T.norm("variant"))), 1, 40).alias("variants"))
    out = state.select("turn_id", verdict.alias("verdict"), kind.alias("review_kind"), approved.alias("approved_answer"), "s.active", "created_at", "s.updated_at", "writes")
    return out.join(named, "turn_id", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))


def feedback_current(log: DataFrame) -> DataFrame:
    """State of each turn's feedback: the last write, its rating between 1 and 5 (3 if none is given), the first created_at."""
    last = F.max_by(F.struct("student_id", "question", "answer", "rating", "answer_suggestion", "updated_at"), "seq")
    s = log.groupBy("turn_id").agg(last.alias("s"), F.min("updated_at").alias("created_at"))
    rating = F.when(F.coalesce("s.rating", F.lit(0)) == 0, 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), "s.rating")))
    return s.select("turn_id", "s.student_id", rating.cast("int").alias("rating"), F.trim("s.answer_suggestion").alias("answer_suggestion"), "created_at", "s.updated_at")


def contribution_state(changes: DataFrame) -> DataFrame:
    """Contributions with a valid status (else pending)."""
    return changes.withColumn("status", F.when(F.col("status").isin("pending", "approved", "rejected"), F.col("status")).otherwise("pending"))


def contribution_reviews(changes: DataFrame) -> DataFrame:
    """Approved contributions as review rows."""
    ok = contribution_state(changes).where("status = 'approved'")
    return ok.select("turn_id", F.col("original_question").alias("user_question"), F.col("bot_answer").alias("assistant_answer"), F.lit("missing").alias("verdict"), F.col("user_contribution").alias("approved_answer"), F.col("contribution_id").alias("linked"))


def store_listing(rows: DataFrame, keep: Column, time: str, key: list[str], limit: int = 200) -> DataFrame:
    """The newest rows that are kept."""
    return rows.where(keep).orderBy(F.desc(time), *key).limit(limit)


def review_usage(matches: DataFrame) -> DataFrame:
    """(review_turn, usage, last_used, learned): uses of each review, and the questions that it met (40 at most)."""
    return matches.groupBy("review_turn").agg(F.count("*").alias("usage"), F.max("used_at").alias("last_used"), F.slice(F.sort_array(F.collect_set("question")), 1, 40).alias("learned"))


def contribution_capture(messages: DataFrame, gap: Column, reply_class: Column) -> DataFrame:
    """Assistant messages that admit a gap with the user's next message, if that provides the answer: pending contributions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)}).where((F.col("role") == "assistant") & gap & (F.col("_role") == "user"))
    rows = rows.withColumn("class", reply_class).where("class = 'provide'")
    return rows.select("conv_id", "turn", F.col("_text").alias("user_contribution"), F.lit("pending").alias("status"))
