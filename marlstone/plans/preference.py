"""X: preference, SFT, PPO data and the reward model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import preference as X
from .common import Plans, d_ascii, d_bucket, d_norm, d_ws

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
VIEWS = ("turns", "reviews_v", "review_variants_v", "feedback_v", "contrib_v")

P.add("x1_eligible_turns", lambda t: X.eligible_turns(t).select("turn_id"), "turns", sql="SELECT turn_id FROM turns WHERE trim(question) <> '' AND trim(answer) <> ''")
_named = "SELECT DISTINCT turn_id, trim(variant) AS key FROM review_variants_v WHERE trim(variant) <> ''"
D_REVIEWS = f"""SELECT t.turn_id, r.turn_id AS review_turn, r.seq FROM turns t JOIN reviews_v r ON t.turn_id = r.turn_id WHERE review_kind = 'answer'
        UNION SELECT t.turn_id, r.turn_id, r.seq FROM turns t JOIN ({_named}) n ON {d_ws('t.question')} = n.key JOIN reviews_v r ON r.turn_id = n.turn_id WHERE review_kind = 'answer'"""
P.add(
    "x2_turn_reviews",
    X.turn_reviews,
    "turns",
    "reviews_v",
    "review_variants_v",
    sql=f"SELECT DISTINCT turn_id, review_turn, seq FROM ({D_REVIEWS})",
)
D_LAST = "SELECT * FROM feedback_v QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY updated_at DESC, seq DESC) = 1"
P.add("x3_turn_feedback", X.turn_feedback, "turns", "feedback_v", sql=f"SELECT t.turn_id, rating, answer_suggestion FROM turns t LEFT JOIN ({D_LAST}) f USING (turn_id)")
P.add(
    "x4_turn_contributions",
    X.turn_contributions,
    "turns",
    "contrib_v",
    sql=f"SELECT t.turn_id, contribution_id, user_contribution FROM turns t JOIN contrib_v c ON {d_ws('t.question')} = {d_ws('c.original_question')} WHERE status = 'approved' AND {d_ws('t.question')} <> ''",
)
_order = "lpad(CAST(1000000 - seq AS VARCHAR), 7, '0') || ':' || review_turn"
D_CAND = f"""et AS (SELECT * FROM turns WHERE trim(question) <> '' AND trim(answer) <> ''), fl AS ({D_LAST}), tr AS ({D_REVIEWS}),
    rv AS (SELECT tr.turn_id, tr.review_turn, tr.seq, r.verdict, r.approved_answer, r.assistant_answer FROM tr JOIN et ON et.turn_id = tr.turn_id JOIN reviews_v r ON r.turn_id = tr.review_turn AND r.seq = tr.seq),
    fb AS (SELECT et.turn_id, et.answer, coalesce(fl.rating, 0) AS rating, fl.answer_suggestion FROM et LEFT JOIN fl USING (turn_id)),
    c0 AS (SELECT turn_id, answer AS text, 'original' AS label, 0.4e0 AS score, 'history' AS source, '0:' AS pos FROM et
        UNION ALL SELECT turn_id, approved_answer, 'preferred', CASE WHEN verdict IN ('correct', 'missing', 'partial') THEN 0.98 ELSE 0.96 END, 'review', '1:' || {_order} FROM rv
        UNION ALL SELECT turn_id, assistant_answer, 'rejected', 0.1, 'review', '1:' || {_order} FROM rv WHERE verdict IN ('incorrect', 'excessive', 'missing', 'partial')
        UNION ALL SELECT turn_id, answer_suggestion, 'preferred', CASE WHEN rating <= 2 THEN 0.88 ELSE 0.7 END, 'feedback', '2:' FROM fb
        UNION ALL SELECT turn_id, answer, 'preferred', 0.85, 'feedback', '3:' FROM fb WHERE rating >= 4
        UNION ALL SELECT turn_id, answer, 'rejected', 0.15, 'feedback', '4:' FROM fb WHERE rating <= 2
        UNION ALL SELECT et.turn_id, user_contribution, 'preferred', 0.88, 'contribution', '5:' || contribution_id FROM et JOIN contrib_v c ON {d_ws('et.question')} = {d_ws('c.original_question')} WHERE status = 'approved'),
    cand AS (SELECT turn_id, {d_ws('text')} AS text, label, score, source, pos FROM c0 WHERE {d_ws('text')} <> '')"""
_ST = "CASE label WHEN 'preferred' THEN 3 WHEN 'rejected' THEN 2 ELSE 1 END"
D_DEDUPE = f"""{D_CAND}, d1 AS (SELECT *, min(pos) OVER (PARTITION BY turn_id, text) AS first FROM cand QUALIFY row_number() OVER (PARTITION BY turn_id, text ORDER BY {_ST} DESC, score DESC, pos) = 1),
    ded AS (SELECT *, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY {_ST} DESC, score DESC, first, text) AS INTEGER) AS rank FROM d1)"""
D_PAIRS = f"""{D_DEDUPE}, bp AS (SELECT * FROM ded WHERE label = 'preferred' QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY rank) = 1),
    br AS (SELECT * FROM ded WHERE label = 'rejected' QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY rank) = 1),
    pairs AS (SELECT bp.turn_id, bp.text AS chosen, bp.source AS chosen_source, bp.score AS chosen_score, br.text AS rejected, br.source AS rejected_source FROM bp JOIN br USING (turn_id)),
    sft AS (SELECT bp.turn_id, et.question AS prompt, bp.text AS response, bp.source FROM bp JOIN et USING (turn_id))"""


def candidates(*views):
    return X.answer_candidates(*views)


def deduped(*views):
    return X.candidate_dedupe(candidates(*views))


def pairs(*views):
    return X.preference_pairs(deduped(*views))


def sft(*views):
    return X.sft_rows(X.eligible_turns(views[0]), deduped(*views))


P.add("x5_answer_candidates", lambda *v: candidates(*v).groupBy("turn_id", "text", "label", "score", "source").agg(F.count("*").alias("n")), *VIEWS, sql=f"WITH {D_CAND} SELECT turn_id, text, label, score, source, count(*) AS n FROM cand GROUP BY ALL")
P.add("x6_candidate_dedupe", lambda *v: deduped(*v).select("turn_id", "text", "label", "score", "source", "rank"), *VIEWS, sql=f"WITH {D_DEDUPE} SELECT turn_id, text, label, score, source, rank FROM ded")
P.add("x7_preference_pairs", pairs, *VIEWS, sql=f"WITH {D_PAIRS} SELECT * FROM pairs")
P.add("x8_sft_rows", sft, *VIEWS, sql=f"WITH {D_PAIRS} SELECT * FROM sft")


def meta(*v):
    return X.turn_meta(*v[:5], candidates(*v[:5]), v[5] if len(v) > 5 else None)


_set = lambda c, t: f"coalesce((SELECT list_sort(list(DISTINCT {c})) FROM {t} x WHERE x.turn_id = et.turn_id AND {c} <> ''), [])"
D_META = f"""{D_PAIRS}, rm AS (SELECT tr.turn_id, r.verdict, r.review_kind FROM tr JOIN reviews_v r ON r.turn_id = tr.review_turn AND r.seq = tr.seq), meta AS (SELECT et.turn_id, {_set('verdict', 'rm')} AS verdicts, {_set('review_kind', 'rm')} AS kinds, {_set('source', 'cand')} AS sources,
    coalesce((SELECT count(*) FROM rm x WHERE x.turn_id = et.turn_id), 0) AS reviews, coalesce(fl.rating, 0) AS rating, fl.turn_id IS NOT NULL AS has_feedback, (SELECT count(*) FROM contrib_v c WHERE status = 'approved' AND """ + f"""{d_ws('et.question')} <> '' AND {d_ws('et.question')} = {d_ws('c.original_question')}) AS contributions FROM et LEFT JOIN fl USING (turn_id))"""
_join = lambda c: F.array_join(c, ",").alias(c)
P.add(
    "x9_turn_meta",
    lambda *v: meta(*v).select("turn_id", "domain", "route", "rating", "has_feedback", _join("verdicts"), _join("kinds"), "has_review", "reviews", "contributions", _join("sources")),
    *VIEWS,
    "facts_v",
    sql=f"""WITH {D_META} SELECT m.turn_id, coalesce(f.domain, '') AS domain, coalesce(f.route, '') AS route, m.rating, has_feedback, array_to_string(verdicts, ',') AS verdicts, array_to_string(kinds, ',') AS kinds, reviews > 0 AS has_review, reviews,
        contributions, array_to_string(sources, ',') AS sources FROM meta m LEFT JOIN facts_v f USING (turn_id)""",
)
P.add(
    "x10_rlhf_dataset",
    lambda *v: X.summary(turns=X.eligible_turns(v[0]), candidates=deduped(*v), preferences=pairs(*v), sft=sft(*v)),
    *VIEWS,
    sql=f"WITH {D_PAIRS} SELECT 'turns' AS name, count(*) AS rows FROM et UNION ALL SELECT 'candidates', count(*) FROM ded UNION ALL SELECT 'preferences', count(*) FROM pairs UNION ALL SELECT 'sft', count(*) FROM sft",
)
P.add(
    "x11_preference_filter",
    lambda *v: X.preference_filter(pairs(*v), meta(*v), ["incorrect", "missing", "excessive"], None, 5).select("turn_id", "chosen", "rejected", "rating"),
    *VIEWS,
    sql=f"WITH {D_META} SELECT turn_id, chosen, rejected, rating FROM pairs JOIN meta USING (turn_id) WHERE list_has_any(verdicts, ['incorrect', 'missing', 'excessive']) AND rating > 0 AND rating <= 5",
)
P.add(
    "x12_salted_split",
    lambda *v: sft(*v).select("turn_id", X.salted_split(F.col("turn_id"), "sft", 0.2).alias("split"), X.salted_split(F.col("turn_id"), "sft", 0).alias("none")),
    *VIEWS,
    sql=f"WITH {D_PAIRS} SELECT turn_id, CASE WHEN {d_bucket(chr(39) + 'sft:' + chr(39) + ' || turn_id')} / 4294967295.0e0 < 0.2 THEN 'val' ELSE 'train' END AS split, 'train' AS none FROM sft",
)
P.add(
    "x13_format_projection",
    lambda *v: X.formats(pairs(*v), v[0]),
    *VIEWS,
    sql=f"""WITH {D_PAIRS}, j AS (SELECT p.*, et.question FROM pairs p JOIN et USING (turn_id))
        SELECT turn_id, 'messages' AS framework, CAST(to_json({{'messages': [{{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': chosen}}]}}) AS VARCHAR) AS row FROM j
        UNION ALL SELECT turn_id, 'instruction', CAST(to_json({{'instruction': question, 'input': '', 'output': chosen}}) AS VARCHAR) FROM j
        UNION ALL SELECT turn_id, 'dpo', CAST(to_json({{'prompt': question, 'chosen': chosen, 'rejected': rejected}}) AS VARCHAR) FROM j""",
)
P.add(
    "x14_reward_examples",
    lambda *v: X.reward_examples(pairs(*v), v[0]),
    *VIEWS,
    sql=f"WITH {D_PAIRS}, j AS (SELECT p.*, et.question FROM pairs p JOIN et USING (turn_id)) SELECT DISTINCT question, answer, label FROM (SELECT question, chosen AS answer, 1 AS label FROM j UNION ALL SELECT question, rejected, 0 FROM j)",
)


def with_reward(rows, question, answer, name):
    rows = rows.withColumns({"_q": T.norm_ascii(question), "_a": T.norm_ascii(answer), "_n": F.length(T.ws(answer))})
    return rows.withColumn(name, X.reward(F.col("_q"), F.col("_a"), F.col("_n"))).drop("_q", "_a", "_n")


_listed = lambda xs: ", ".join(f"'{x}'" for x in xs)


def d_reward(q: str, a: str, n: str) -> str:
    """The reward of normalised texts and the answer's length."""
    kept = lambda x: f"list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda t: length(t) >= 2 AND t NOT IN ({_listed(X.STOPWORDS)}))"
    tq, ta = f"list_distinct({kept(q)})", kept(a)
    cover = f"(len(list_filter({tq}, lambda t: contains({a}, t))) / greatest(1, len({tq})))"
    focus = f"(len(list_filter({ta}, lambda t: list_contains({tq}, t))) / greatest(1, len({ta})))"
    has = lambda x, xs: "(" + " OR ".join(f"contains({x}, '{h}')" for h in xs) + ")"
    return f"""CAST(CASE WHEN {n} = 0 THEN 0 ELSE greatest(0.0, least(1.0, 0.45 + 0.24 * {cover} + 0.18 * CASE WHEN {n} <= 220 THEN 1 WHEN {n} <= 600 THEN 0.82 WHEN {n} <= 1200 THEN 0.62 ELSE 0.42 END
        + least(0.18, 1.4 * {focus}) - CASE WHEN {has(q, X.DIRECT)} AND {has(a, X.EVASIVE)} THEN 0.28 ELSE 0 END
        - CASE WHEN contains({a}, '{X.NOTHING}') AND {cover} < 0.25 THEN 0.18 ELSE 0 END - CASE WHEN len(list_distinct({ta})) <= 2 THEN 0.15 ELSE 0 END)) END AS DOUBLE)"""


P.add(
    "x15_reward_heuristic",
    lambda t: with_reward(t, "question", "answer", "reward").select("turn_id", F.round("reward", 6).alias("reward")),
    "turns",
    sql=f"SELECT turn_id, round({d_reward('q', 'a', 'n')}, 6) AS reward FROM (SELECT turn_id, {d_ascii('question')} AS q, {d_ascii('answer')} AS a, length({d_ws('answer')}) AS n FROM turns)",
)


def reward_model(docs, labels):
    rows = docs.join(labels, "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    from pyspark.ml.functions import vector_to_array

    model = X.reward_model(rows)
    return model.transform(docs.select("doc_id", "text")).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("reward"))


P.add("x16_reward_model", reward_model, "documents", "labels")


def scored_pairs(*v):
    rows = pairs(*v).join(v[0].select("turn_id", "question"), "turn_id")
    rows = with_reward(with_reward(rows, "question", "chosen", "generated_reward"), "question", "rejected", "baseline_reward")
    return rows.select("turn_id", F.col("chosen").alias("generated"), F.col("rejected").alias("baseline"), "generated_reward", "baseline_reward", (F.length("chosen") > 20).alias("evidence"))


D_SCORED = f"""{D_PAIRS}, sp AS (SELECT turn_id, chosen AS generated, rejected AS baseline, {d_reward('q', 'c', 'length(chosen)')} AS gr, {d_reward('q', 'r', 'length(rejected)')} AS br_, length(chosen) > 20 AS evidence
    FROM (SELECT p.*, {d_ascii('et.question')} AS q, {d_ascii('chosen')} AS c, {d_ascii('rejected')} AS r FROM pairs p JOIN et USING (turn_id)))"""
P.add(
    "x17_self_preference",
    lambda *v: X.self_preference(scored_pairs(*v)).select("turn_id", "winner", F.round("gap", 6).alias("gap")),
    *VIEWS,
    sql=f"""WITH {D_SCORED} SELECT turn_id, CASE WHEN gr - br_ >= 0.08 AND gr >= 0.52 AND evidence THEN 'generated' WHEN br_ - gr >= 0.08 AND br_ >= 0.52 THEN 'baseline' END AS winner, round(CAST(abs(gr - br_) AS DOUBLE), 6) AS gap
        FROM sp WHERE winner IS NOT NULL ORDER BY round(abs(gr - br_), 9) DESC, turn_id LIMIT 50""",
)


def ppo(*v):
    return X.ppo_prompts(pairs(*v), sft(*v), v[0])


D_PPO = f"""{D_PAIRS}, u AS (SELECT p.turn_id, et.question AS prompt, chosen AS reference, rejected, 'preference' AS source, 0 AS k FROM pairs p JOIN et USING (turn_id)
    UNION ALL SELECT turn_id, prompt, response, '', 'sft', 1 FROM sft), ppo AS (SELECT 'ppo-' || substr(sha1(prompt || chr(0) || reference || chr(0)), 1, 16) AS id, prompt, reference, rejected, source FROM u
    QUALIFY row_number() OVER (PARTITION BY prompt, reference ORDER BY k, turn_id) = 1)"""
P.add("x18_ppo_prompts", ppo, *VIEWS, sql=f"WITH {D_PPO} SELECT * FROM ppo")
P.add(
    "x19_reward_audit",
    lambda *v: with_reward(ppo(*v).orderBy("id").limit(40), "prompt", "reference", "reward").select("id", F.round("reward", 6).alias("reward")),
    *VIEWS,
    sql=f"WITH {D_PPO}, s AS (SELECT id, {d_ascii('prompt')} AS q, {d_ascii('reference')} AS a, length({d_ws('reference')}) AS n FROM ppo ORDER BY id LIMIT 40) SELECT id, round({d_reward('q', 'a', 'n')}, 6) AS reward FROM s",
)
