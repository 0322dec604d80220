"""Q and J: utterance classes, conversations and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as Q
from ..operators import sessions as J
from ..operators.classify import Rule
from .common import Plans, d_ascii, d_norm

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle

# Rules for the driver's texts, so that every class occurs.
META = [Rule("greeting", ("thats", "onen")), Rule("thanks", ("this",), ("the",)), Rule("help", ("from", "with"), ("and",)), Rule("complaint", ("that",), (), "word")]
SENSITIVE = [Rule("allowed", ("are",)), Rule("private_data", ("of", "by"), (), "word", 2), Rule("account", ("was",), ("for",))]
TYPES = [Rule("list", ("are",)), Rule("contact", ("at",)), Rule("compare", ("with",)), Rule("summary", ("that", "this"), (), "word", 2), Rule("howto", ("for",))]
DOMAINS = [("alpha", "the"), ("beta", "of the"), ("gamma", "with"), ("delta", "ation"), ("eps", "this")]
TOPICS = [Rule("law", ("the", "of the", "by")), Rule("trade", ("with", "from")), Rule("place", ("in", "at", "on"), delta=0.5)]
NOTICE = [Rule("notice", ("is", "was"), ("the",))]
GAPS = [Rule("gap", ("that", "for"))]
EXACT = ("the", "of")
TITLES, UNIT_WORDS, TERMS, ASKING, ANCHORS, SHORT = ("the", "of", "by", "ba", "da"), ("and", "same"), ("the", "of", "and", "to", "in"), ("with the", "is a"), ("tion",), ("on and", "so what")
POLICY = [Rule("self_profile_not_supported", ("from the",), mode="contains"), Rule("academic_material_not_supported", ("ation",), mode="contains"), Rule("academic_detail_not_supported", ("ing ",), mode="contains")]
PRIVATE = Q.Sensitive(
    allowed=("are the",), hints=("secret", "ght"), group="er", group_code="[a-z]{2}[0-9]{2}", person_code="[0-9]{4}", grades=("is",), person_info=("was",),
    group_info=("at",), persons=("ma",), counts=("li", "many"), group_counts=("st",), units=("co", "un"),
)
QUESTIONISH, CUES, DECLINE = ("who", "which"), ("the", "es "), ("nein", "not now")
VERBS, TARGETS = ("by", "from", "for"), ("that", "this")
COMMON = ("the", "and", "that", "this", "with", "from", "for")
ALIASES = [("the", "definite"), ("with", "together"), ("of the", "belonging"), ("from", "origin")]

USER = ("conversations",)


def user(c):
    return c.where("role = 'user'").withColumn("x", T.norm_ascii("text"))


D_USER = f"u AS (SELECT conv_id, turn, text, {d_ascii('text')} AS x FROM conversations WHERE role = 'user')"


def d_hint(x: str, t: str, mode: str) -> str:
    if mode == "equals":
        return f"{x} = '{t}'"
    if mode == "word" and " " not in t:
        return f"regexp_matches(' ' || {x} || ' ', '[^a-z0-9]{t}[^a-z0-9]')"
    return f"contains({x}, '{t}')"


def d_any(x: str, terms, mode: str) -> str:
    return "(" + " OR ".join(d_hint(x, t, mode) for t in terms) + ")"


def d_rule(r: Rule, x: str = "x") -> str:
    out = d_any(x, r.any_terms, r.mode) if r.min_hits == 1 else "(" + " + ".join(f"CAST({d_hint(x, t, r.mode)} AS INT)" for t in r.any_terms) + f") >= {r.min_hits}"
    return f"({out} AND NOT {d_any(x, r.none_terms, r.mode)})" if r.none_terms else f"({out})"


def d_label(rules: list[Rule], x: str = "x", default: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {d_rule(r, x)} THEN '{r.label}'" for r in rules) + f" ELSE '{default}' END"


X = lambda: F.col("x")
_TK = "list_filter(string_split(x, ' '), lambda t: t <> '')"
_AL = "regexp_extract_all(x, '[a-z0-9]+')"
_list = lambda ts: "[" + ", ".join(f"'{t}'" for t in ts) + "]"
D_BOTH = f"(list_has_any({_AL}, {_list(VERBS)}) AND list_has_any({_AL}, {_list(TARGETS)}))"


def _label(name, column, sql):
    P.add(name, lambda c: user(c).select("conv_id", "turn", column().alias("label")), *USER, sql=f"WITH {D_USER} SELECT conv_id, turn, {sql} AS label FROM u")


_label("q1_meta_intent", lambda: Q.first_label(X(), META), d_label(META))
def low():
    return Q.low_signal(X(), EXACT, (Q.first_label(X(), META) != "") | (POLICY_OF() != "") | (Q.sensitive_class(X(), PRIVATE) != ""), TITLES, UNIT_WORDS, TERMS, ASKING, ANCHORS, SHORT)


def POLICY_OF():
    return Q.policy_class(X(), VERBS, TARGETS, POLICY)


_cont = lambda words: d_any("x", words, "contains")
_sq = lambda words: ", ".join(f"'{w}'" for w in words)
D_POLICY = f"CASE WHEN {D_BOTH} THEN 'harmful_or_violent' ELSE {d_label(POLICY)} END"
D_PRIVATE = f"""CASE WHEN {_cont(PRIVATE.allowed)} THEN '' WHEN {_cont(PRIVATE.hints)} AND contains(x, '{PRIVATE.group}') AND {_cont(PRIVATE.group_counts)} THEN 'class_scope_not_supported' WHEN {_cont(PRIVATE.hints)} AND contains(x, '{PRIVATE.group}') THEN 'class_private_info'
    WHEN {_cont(PRIVATE.hints)} OR regexp_matches(x, '{PRIVATE.person_code}') THEN 'student_private_info' WHEN regexp_matches(x, '{PRIVATE.group_code}') THEN 'class_private_info'
    WHEN {_cont(PRIVATE.persons)} AND ({_cont(PRIVATE.grades)} OR {_cont(PRIVATE.person_info)}) THEN 'student_private_info' WHEN contains(x, '{PRIVATE.group}') AND {_cont(PRIVATE.persons)} THEN 'class_private_info'
    WHEN contains(x, '{PRIVATE.group}') AND {_cont(PRIVATE.counts)} AND {_cont(PRIVATE.units)} THEN 'class_scope_not_supported' WHEN contains(x, '{PRIVATE.group}') AND {_cont(PRIVATE.counts)} THEN 'class_private_info' ELSE '' END"""
_person = f"(len({_AL}) BETWEEN 2 AND 6 AND NOT {_cont(ASKING)} AND {_AL}[2] NOT IN ({_sq(UNIT_WORDS)}) AND {_AL}[1] IN ({_sq(TITLES)}) AND len(list_filter({_AL}[2:], lambda t: NOT regexp_full_match(t, '[a-z]+'))) = 0)"
_fragment = f"(len({_AL}) BETWEEN 2 AND 5 AND NOT {_cont(ASKING)} AND len(list_filter({_AL}, lambda t: t NOT IN ({_sq(TERMS)}))) = 0)"
D_LOW = f"(x <> '' AND (x IN ({_sq(EXACT)}) OR (NOT ({d_label(META)} <> '' OR {D_POLICY} <> '' OR {D_PRIVATE} <> '') AND ({_person} OR {_fragment} OR (len({_TK}) <= 3 AND NOT {_cont(ANCHORS)} AND x IN ({_sq(SHORT)}))))))"
P.add("q2_low_signal", lambda c: user(c).select("conv_id", "turn", low().alias("low")), *USER, sql=f"WITH {D_USER} SELECT conv_id, turn, {D_LOW} AS low FROM u")
_label("q3_policy_class", lambda: POLICY_OF(), D_POLICY)
_label("q4_sensitive_class", lambda: Q.sensitive_class(X(), PRIVATE), D_PRIVATE)
_label("q5_question_type", lambda: Q.first_label(X(), TYPES, "factoid"), d_label(TYPES, default="factoid"))
_ORDER = [Rule(DOMAINS[k][0], (DOMAINS[k][1],), mode="contains") for k in sorted(range(len(DOMAINS)), key=lambda k: (-len(DOMAINS[k][1]), k))]
D_DOMAIN = d_label(_ORDER)
_label("q6_domain_detect", lambda: Q.longest_hint(X(), DOMAINS), D_DOMAIN)
_PTS = [f"CASE WHEN h{k} > 0 THEN h{k} + {r.delta} ELSE 0 END" for k, r in enumerate(TOPICS)]
_H = ", ".join("(" + " + ".join(f"CASE WHEN {d_hint('x', t, r.mode)} THEN {len(t.split())} ELSE 0 END" for t in r.any_terms) + f") AS h{k}" for k, r in enumerate(TOPICS))
P.add(
    "q7_topic_detect",
    lambda c: user(c).select("conv_id", "turn", Q.best_topic(X(), TOPICS).alias("topic")),
    *USER,
    sql=f"""WITH {D_USER}, h AS (SELECT *, {_H} FROM u), p AS (SELECT *, {', '.join(f'{e} AS p{k}' for k, e in enumerate(_PTS))} FROM h)
        SELECT conv_id, turn, CASE WHEN greatest(p0, p1, p2) = 0 THEN '' WHEN p0 >= p1 AND p0 >= p2 THEN 'law' WHEN p1 >= p2 THEN 'trade' ELSE 'place' END AS topic FROM p""",
)


def place_filter(customers, nations, regions):
    """Places named in a text, found by an equi-join on the word; the longer name overrides."""
    rows = customers.join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey).select("c_custkey", F.concat_ws(" ", F.lit("office in"), "n_name", F.lit("for"), "c_mktsegment").alias("text"))
    places = nations.select(F.lower("n_name").alias("place"), "n_regionkey").join(regions, F.col("n_regionkey") == regions.r_regionkey).select("place", F.lower("r_name").alias("region"))
    words = rows.select("c_custkey", F.explode(T.ngrams(F.split(T.norm_ascii("text"), " "), 1, 2)).alias("place")).distinct()
    hit = words.join(F.broadcast(places), "place")
    return hit.groupBy("c_custkey").agg(F.max_by("place", F.struct(F.length("place"), "place")).alias("place"), F.max_by("region", F.struct(F.length("place"), "place")).alias("region"))


P.add(
    "q8_place_filter",
    place_filter,
    "customer",
    "nation",
    "region",
    sql=f"""WITH t AS (SELECT c_custkey, {d_ascii("concat_ws(' ', 'office in', n_name, 'for', c_mktsegment)")} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)
        SELECT c_custkey, lower(n_name) AS place, lower(r_name) AS region FROM t JOIN nation ON contains(' ' || x || ' ', ' ' || lower(n_name) || ' ') JOIN region ON n_regionkey = r_regionkey
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(n_name) DESC, lower(n_name) DESC) = 1""",
)
P.add("q9_notice_query", lambda c: user(c).select("conv_id", "turn", NOTICE[0].holds(X()).alias("notice")), *USER, sql=f"WITH {D_USER} SELECT conv_id, turn, {d_rule(NOTICE[0])} AS notice FROM u")
CLASSES = lambda: [("meta", Q.first_label(X(), META) != ""), ("clarification", low()), ("policy", Q.both(X(), VERBS, TARGETS)), ("sensitive", Q.first_label(X(), SENSITIVE).isin("private_data", "account")), ("domain", Q.longest_hint(X(), DOMAINS) != ""), ("notice", NOTICE[0].holds(X()))]
D_CLASSES = [("meta", f"{d_label(META)} <> ''"), ("clarification", D_LOW), ("policy", D_BOTH), ("sensitive", f"{d_label(SENSITIVE)} IN ('private_data', 'account')"), ("domain", f"{D_DOMAIN} <> ''"), ("notice", d_rule(NOTICE[0]))]
SCOPE = lambda: Q.out_of_scope(X(), [c for n, c in CLASSES() if n in ("meta", "policy")], ("by", "at"), COMMON)
D_SCOPE = f"(NOT {d_any('x', ('by', 'at'), 'word')} AND len(list_filter({_AL}, lambda t: length(t) >= 3 AND t NOT IN ({', '.join(repr(t) for t in COMMON)}))) >= 2 AND NOT ({D_CLASSES[0][1]}) AND NOT {D_BOTH})"
P.add("q10_out_of_scope", lambda c: user(c).select("conv_id", "turn", SCOPE().alias("out")), *USER, sql=f"WITH {D_USER} SELECT conv_id, turn, {D_SCOPE} AS out FROM u")
FAMILY = lambda: Q.family([*CLASSES()[:4], ("out_of_scope", SCOPE()), *CLASSES()[4:]])
D_FAMILY = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in [*D_CLASSES[:4], ("out_of_scope", D_SCOPE), *D_CLASSES[4:]]) + " ELSE 'general' END"
_label("q11_query_family", lambda: FAMILY(), D_FAMILY)
P.add(
    "q12_query_expand",
    lambda q: q.withColumn("x", T.norm_ascii("query")).select("query_id", Q.expand(F.col("query"), X(), ALIASES).alias("expanded")),
    "queries_v",
    sql=f"""WITH q AS (SELECT query_id, query, {d_ascii('query')} AS x FROM queries_v) SELECT query_id, concat_ws(' ', query, {', '.join(f"CASE WHEN {d_hint('x', a, 'word')} THEN '{b}' END" for a, b in ALIASES)}) AS expanded FROM q""",
)
D_TURNX = f"tx AS (SELECT *, {d_ascii('question')} AS x FROM turns)"


def turnsx(t):
    return t.withColumn("x", T.norm_ascii("question"))


def followup(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turnsx(t).withColumn("left", F.greatest(F.lit(0), F.least(F.lit(4), F.row_number().over(w) - 1)))
    return rows.select("turn_id", Q.followup(X(), F.col("left"), *FOLLOW).alias("followup"))


#: Units, phrases that end a unit's name, words that name none, hints, anchors, field words, generic forms.
FOLLOW = (("in", "de"), ("with", "the"), ("a", "this", "la"), ("this", "that"), ("license",), ("an", "er"), ("and then",))
_unit = rf"trim(regexp_extract(regexp_extract(x, '\b(?:{'|'.join(FOLLOW[0])})\s+([a-z0-9][a-z0-9\s&.-]*)', 1), '^(.*?)(?:\b(?:{'|'.join(FOLLOW[1])})\b|$)', 1))"
P.add(
    "q13_followup_detect",
    followup,
    "turns",
    sql=f"""WITH {D_TURNX}, w AS (SELECT *, greatest(0, least(4, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)) AS lft FROM tx)
        SELECT turn_id, lft > 0 AND len(list_filter(string_split({_unit}, ' '), lambda t: t <> '' AND t NOT IN ({_sq(FOLLOW[2])}))) = 0 AND ({_cont(FOLLOW[3])} OR (NOT {_cont(FOLLOW[4])} AND ({_cont(FOLLOW[5])} OR x IN ({_sq(FOLLOW[6])})))) AS followup FROM w""",
)
ROUTE = lambda: F.when(F.col("family").isin("meta", "clarification", "policy", "sensitive", "out_of_scope"), F.col("family")).otherwise("answer")


def routed(t):
    rows = turnsx(t).withColumns({"family": FAMILY(), "domain": Q.longest_hint(X(), DOMAINS), "intent": Q.first_label(X(), TYPES, "factoid")})
    return rows.withColumn("route", ROUTE()).withColumn("top_k", F.when(F.col("intent") == "list", 8).when(F.col("intent") == "compare", 6).otherwise(4))


D_ROUTED = f"""{D_TURNX}, r0 AS (SELECT *, {D_FAMILY} AS family, {D_DOMAIN} AS domain, {d_label(TYPES, default='factoid')} AS intent FROM tx),
    routed AS (SELECT *, CASE WHEN family IN ('meta', 'clarification', 'policy', 'sensitive', 'out_of_scope') THEN family ELSE 'answer' END AS route, CASE intent WHEN 'list' THEN 8 WHEN 'compare' THEN 6 ELSE 4 END AS top_k FROM r0)"""
P.add("q14_route_cascade", lambda t: routed(t).select("turn_id", "route", "domain", "intent", "top_k"), "turns", sql=f"WITH {D_ROUTED} SELECT turn_id, route, domain, intent, top_k FROM routed")
KINDS = [Rule("contact", ("at", "by")), Rule("location", ("in",)), Rule("role", ("was",)), Rule("howto", ("for",)), Rule("history", ("on",)), Rule("function", ("to",))]
P.add(
    "q15_dataset_query_type",
    lambda q: q.withColumn("x", T.norm_ascii("query")).select("query_id", Q.first_label(X(), KINDS, "generic").alias("kind")),
    "queries_v",
    sql=f"WITH q AS (SELECT query_id, {d_ascii('query')} AS x FROM queries_v) SELECT query_id, {d_label(KINDS, default='generic')} AS kind FROM q",
)
def REPLY(text, x):
    return Q.reply_class(text, x, DECLINE, Q.first_label(x, META) != "", QUESTIONISH, CUES)


def d_reply(text: str, x: str) -> str:
    has = lambda words: d_any(x, words, "contains")
    n = f"len(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
    return f"CASE WHEN {x} = '' THEN 'other' WHEN {has(DECLINE)} THEN 'decline' WHEN {d_label(META, x)} <> '' OR contains({text}, '?') OR {has(QUESTIONISH)} OR {n} < 3 THEN 'other' WHEN {has(CUES)} OR {n} >= 6 THEN 'provide' ELSE 'other' END"


_label("q16_reply_class", lambda: REPLY(F.col("text"), X()), d_reply("text", "x"))
P.add(
    "q17_gap_detect",
    lambda t: routed(t).withColumn("a", T.norm_ascii("answer")).select("turn_id", (F.col("route").isin("answer", "out_of_scope") & GAPS[0].holds(F.col("a"))).alias("gap")),
    "turns",
    sql=f"WITH {D_ROUTED} SELECT turn_id, route IN ('answer', 'out_of_scope') AND {d_rule(GAPS[0], 'a')} AS gap FROM (SELECT *, {d_ascii('answer')} AS a FROM routed)",
)
UNITS = [Rule("head", ("was", "is")), Rule("contact", ("at",)), Rule("history", ("from",)), Rule("programs", ("of",))]
P.add(
    "q18_unit_topic",
    lambda q: q.withColumn("x", T.norm_ascii("query")).select("query_id", Q.first_label(X(), UNITS, "overview").alias("topic")),
    "queries_v",
    sql=f"WITH q AS (SELECT query_id, {d_ascii('query')} AS x FROM queries_v) SELECT query_id, {d_label(UNITS, default='overview')} AS topic FROM q",
)
STEPS = [Rule("step", ("then",), delta=1.0), Rule("by", ("by",), delta=0.5), Rule("to", ("to the",), delta=0.75), Rule("note", ("that",), delta=-0.5)]
P.add(
    "q19_howto_specificity",
    lambda t: t.withColumn("x", T.norm_ascii("answer")).select("turn_id", F.round(Q.score(X(), STEPS), 6).alias("score")),
    "turns",
    sql=f"SELECT turn_id, CAST({' + '.join(f'CASE WHEN {d_rule(r)} THEN {r.delta} ELSE 0 END' for r in STEPS)} AS DOUBLE) AS score FROM (SELECT turn_id, {d_ascii('answer')} AS x FROM turns)",
)
LIMITS = [Rule("salary", ("by", "was")), Rule("address", ("at", "in")), Rule("family", ("with",))]
_label("q20_detail_limit", lambda: Q.first_label(X(), LIMITS), d_label(LIMITS))

P.add("j1_turn_pairing", J.turn_pairing, "conversations", sql="SELECT conv_id, turn, turn_id, user_turn, question, answer FROM turns")
P.add(
    "j2_debug_parse",
    lambda e: J.parse_debug(e, "props", "page string, k int, referrer string").select("event_id", F.col("props.page").alias("page"), F.col("props.k").alias("k")),
    "events",
    sql="SELECT event_id, json_extract_string(props, '$.page') AS page, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
P.add(
    "j3_feedback_eligible",
    lambda t: J.feedback_eligible(routed(t)),
    "turns",
    sql=f"WITH {D_ROUTED} SELECT turn_id, route NOT IN ({_sq(J.CLOSED_ROUTES)}) AND family NOT IN ({_sq(J.CLOSED_FAMILIES)}) AND (route IN ({_sq(J.OPEN_ROUTES)}) OR domain NOT IN ('', '{J.NO_DOMAIN}')) AS eligible FROM routed",
)
P.add("j4_history_totals", J.history_totals, "conversations", sql="SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(n // 2) AS BIGINT) AS turns FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
P.add(
    "j5_top_counters",
    lambda t: J.top_counters(routed(t), {"route": F.col("route"), "domain": F.col("domain"), "intent": F.col("intent"), "question": T.norm("question")}),
    "turns",
    sql=f"""WITH {D_ROUTED}, e AS (SELECT 'route' AS metric, route AS value FROM routed UNION ALL SELECT 'domain', domain FROM routed UNION ALL SELECT 'intent', intent FROM routed UNION ALL SELECT 'question', {d_norm('question')} FROM routed)
        SELECT metric, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, value) AS INTEGER) AS rank FROM e WHERE value <> '' GROUP BY metric, value QUALIFY rank <= 12""",
)


#: Marks and domains that occur in these tables.
MEMORY = {"marks": ("with ", "from "), "domains": ("gamma",)}


def session_turns(t):
    """Turns with their eight best ids."""
    return t.withColumn("retrieved", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat("first_id", F.lit("-"), i))).drop("first_id")


D_MEMORY = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS after, array_to_string(list_transform(range(1, 7), lambda i: first_id || '-' || i), ',') AS ids,
        CASE WHEN answered AND NOT use_history THEN CASE WHEN contains(question_n, 'with ') OR contains(question_n, 'from ') THEN 2 WHEN domain = 'gamma' THEN 1 ELSE 0 END END AS v FROM session_turns_v),
    f AS (SELECT * FROM n WHERE answered QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY after) = 1), a AS (SELECT * FROM n WHERE answered OR answer <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY after) = 1),
    r AS (SELECT conv_id, greatest(0, v - after) AS left_ FROM n WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY after) = 1), l AS (SELECT * FROM n WHERE after = 0)
    SELECT l.conv_id, coalesce(f.domain, '') AS active_domain, coalesce(f.doc, '') AS active_doc, coalesce(f.entity, '') AS last_entity, coalesce(f.unit, '') AS last_named_unit, coalesce(f.qtype, 'factoid') AS last_question_type,
        coalesce(f.ids, '') AS last_retrieved_ids, coalesce(f.topic, '') AS last_topic, l.question AS last_user_query, coalesce(a.answer, '') AS last_assistant_answer, l.channel AS last_channel, CAST(coalesce(left_, 0) AS INTEGER) AS context_turns
    FROM l LEFT JOIN f USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN r USING (conv_id)"""
P.add("j6_session_state", lambda t: J.session_memory(session_turns(t), **MEMORY), "session_turns_v", sql=D_MEMORY)
P.add("j7_per_file_samples", J.file_samples, "turns", sql="SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, substr(question, 1, 100) AS question, substr(answer, 1, 60) AS extra FROM turns QUALIFY n <= 6")
P.add(
    "j8_review_current",
    lambda r, v: J.review_current(r, v).withColumn("variants", F.array_join("variants", "|")),
    "reviews_v",
    "review_variants_v",
    sql=f"""WITH l AS (SELECT *, min(updated_at) OVER (PARTITION BY turn_id) AS created_at, count(*) OVER (PARTITION BY turn_id) AS writes FROM reviews_v QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY seq DESC) = 1),
        n AS (SELECT turn_id, array_to_string(list_sort(list(DISTINCT {d_norm('variant')}))[1:40], '|') AS variants FROM review_variants_v GROUP BY turn_id)
        SELECT turn_id, CASE WHEN verdict = 'unknown' THEN 'partial' ELSE verdict END AS verdict, review_kind, CASE WHEN trim(approved_answer) = '' AND verdict = 'correct' THEN assistant_answer ELSE approved_answer END AS approved_answer,
        active, created_at, updated_at, writes, coalesce(variants, '') AS variants FROM l LEFT JOIN n USING (turn_id)""",
)
D_FEEDBACK = """SELECT turn_id, student_id, CAST(CASE WHEN rating = 0 THEN 3 ELSE greatest(1, least(5, rating)) END AS INTEGER) AS rating, trim(answer_suggestion) AS answer_suggestion, min(updated_at) OVER (PARTITION BY turn_id) AS created_at, updated_at
    FROM feedback_v QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY seq DESC) = 1"""
P.add("j9_feedback_current", J.feedback_current, "feedback_v", sql=D_FEEDBACK)
P.add(
    "j10_contribution_state",
    lambda c: J.contribution_state(c).select("contribution_id", "status").join(J.contribution_reviews(c).select(F.col("linked").alias("contribution_id"), "approved_answer"), "contribution_id", "left"),
    "contrib_v",
    sql="SELECT contribution_id, CASE WHEN status = 'bogus' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'approved' THEN user_contribution END AS approved_answer FROM contrib_v",
)
P.add(
    "j11_store_listing",
    lambda r: J.store_listing(r, F.col("verdict") != "correct", "updated_at", ["turn_id"]).select("turn_id", "seq", "verdict", "updated_at", F.substring("user_question", 1, 60).alias("q")),
    "reviews_v",
    sql="SELECT turn_id, seq, verdict, updated_at, substr(user_question, 1, 60) AS q FROM reviews_v WHERE verdict <> 'correct' ORDER BY updated_at DESC, turn_id LIMIT 200",
)


def usage(turns, variants):
    named = variants.select(F.col("turn_id").alias("review_turn"), T.norm("variant").alias("key")).distinct()
    m = turns.select(T.norm("question").alias("key"), "question", F.col("turn_id").alias("used_at")).join(named, "key")
    return J.review_usage(m).withColumn("learned", F.array_join("learned", "|"))


P.add(
    "j12_review_usage",
    usage,
    "turns",
    "review_variants_v",
    sql=f"""WITH n AS (SELECT DISTINCT turn_id AS review_turn, {d_norm('variant')} AS key FROM review_variants_v)
        SELECT review_turn, count(*) AS usage, max(turn_id) AS last_used, array_to_string(list_sort(list(DISTINCT question))[1:40], '|') AS learned FROM turns JOIN n ON {d_norm('question')} = key GROUP BY review_turn""",
)
P.add(
    "j13_contribution_capture",
    lambda c: J.contribution_capture(c, GAPS[0].holds(T.norm_ascii("text")), REPLY(F.coalesce("_text", F.lit("")), T.norm_ascii("_text"))),
    "conversations",
    sql=f"""WITH w AS (SELECT *, lead(role) OVER o AS r2, lead(text) OVER o AS t2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, t2 AS user_contribution, 'pending' AS status FROM (SELECT *, {d_ascii('text')} AS x, {d_ascii("coalesce(t2, '')")} AS y FROM w) WHERE role = 'assistant' AND r2 = 'user' AND {d_rule(GAPS[0], 'x')} AND {d_reply("coalesce(t2, '')", 'y')} = 'provide'""",
)
