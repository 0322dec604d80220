"""Rules on rows whose results were worked out by hand, with the fixed values of the library."""

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunking, classify, evaluate, knowledge, preference, retriever_data, search, sessions


def one(spark, column, **values):
    """The value of a column over one row of string, number and list values."""
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_candidates_and_pairs(spark):
    turns = spark.createDataFrame([("t1", "q one", "first answer"), ("t2", "q two", "second answer"), ("t3", "q three", "third answer")], "turn_id string, question string, answer string")
    reviews = spark.createDataFrame([("t1", 1, "incorrect", "answer", "better answer", "first answer"), ("t9", 1, "other", "answer", "by question", "x"), ("t1", 2, "correct", "policy", "policy text", "y")], "turn_id string, seq int, verdict string, review_kind string, approved_answer string, assistant_answer string")
    variants = spark.createDataFrame([("t9", "q two ")], "turn_id string, variant string")
    feedback = spark.createDataFrame([("t2", 5, "say more", "2026", 1), ("t1", 2, "told", "2026", 1)], "turn_id string, rating int, answer_suggestion string, updated_at string, seq int")
    contributions = spark.createDataFrame([("approved", "q  two", "c1", "a fact")], "status string, original_question string, contribution_id string, user_contribution string")
    rows = preference.answer_candidates(turns, reviews, variants, feedback, contributions)
    got = {(r.turn_id, r.text, r.label): round(r.score, 2) for r in rows.where("not (turn_id = 't1' and label = 'rejected')").collect()}
    assert got == {
        ("t1", "first answer", "original"): 0.4,
        ("t1", "better answer", "preferred"): 0.96,
        ("t1", "told", "preferred"): 0.88,
        ("t2", "second answer", "original"): 0.4,
        ("t2", "by question", "preferred"): 0.96,
        ("t2", "say more", "preferred"): 0.7,
        ("t2", "second answer", "preferred"): 0.85,
        ("t2", "a fact", "preferred"): 0.88,
        ("t3", "third answer", "original"): 0.4,
        ("t3", "third answer", "rejected"): 0.15,
    }
    assert sorted(r.score for r in rows.where("turn_id = 't1' and label = 'rejected'").collect()) == [0.1, 0.15]
    pairs = {r.turn_id: r for r in preference.preference_pairs(preference.candidate_dedupe(rows)).collect()}
    assert set(pairs) == {"t1"} and (pairs["t1"].chosen, pairs["t1"].rejected) == ("better answer", "first answer")


def test_reward(spark):
    def of(question, answer):
        return one(spark, preference.reward(T.norm_ascii("q"), T.norm_ascii("a"), F.length(T.ws("a"))), q=question, a=answer)

    # tokens hoc, phi; both in the answer; brevity 1; 2 of 4 answer tokens are the question's: 1.05, cut to 1
    assert of("hoc phi", "hoc phi mot trieu dong") == 1.0
    assert abs(of("hoc phi", "hoc bong mot trieu dong") - (0.45 + 0.12 + 0.18 + 0.18)) < 1e-9
    assert of("hoc phi", "  ") == 0.0
    # nothing covered, found nothing, two distinct tokens after stopwords
    assert abs(of("hoc phi", "khong tim thay") - (0.45 + 0.18 - 0.18 - 0.15)) < 1e-9
    long = "hoc phi " + "tien " * 150  # 758 characters
    assert abs(of("hoc phi", long) - (0.45 + 0.24 + 0.18 * 0.62 + 1.4 * 2 / 152)) < 1e-9


def test_usable_turns_and_quality(spark):
    turns = spark.createDataFrame(
        [("a", "q", "answer", "sales", 0.8), ("b", "q", "answer", "", 0.8), ("c", "q", "meta", "x", 0.9), ("d", "q", "answer", "x", None), ("e", "q", "answer", "", 0.5), ("f", "q", "answer", "x", 0.9), ("g", " ", "answer", "x", 0.9), ("h", "q", "answer", "x", 0.9)],
        "turn_id string, question string, route string, domain string, top_score double",
    )
    reviews = spark.createDataFrame([("f", "answer", "excessive"), ("e", "answer", "partial")], "turn_id string, review_kind string, verdict string")
    ratings = spark.createDataFrame([("h", 2)], "turn_id string, rating int")
    got = {r.turn_id: r.reason for r in retriever_data.usable_turns(turns, reviews, ratings).collect()}
    assert got == {"a": "ok", "b": "ok", "c": "bad_route:meta", "d": "no_contexts", "e": "low_confidence", "f": "review_rejected", "g": "empty_question", "h": "feedback_rejected"}
    rows = spark.createDataFrame([("a", "seed_qa", None, [], None), ("b", "history", 5, ["correct"], 1.0), ("c", "history", 3, ["missing"], 0.5)], "turn_id string, origin string, rating int, verdicts array<string>, top_score double")
    assert {r.turn_id: r.quality for r in retriever_data.query_quality(rows).collect()} == {"a": 1.0, "b": 1.0, "c": 0.67}
    assert one(spark, retriever_data.weight(F.lit(1.0), F.lit(1.0), F.lit("seed_qa")), k=1) == 1.25
    assert one(spark, retriever_data.weight(F.lit(0.1), F.lit(0.0), F.lit("history")), k=1) == 0.15


def test_boosts(spark):
    entity = lambda q, e: one(spark, search.entity_boost(F.col("q"), F.col("e")), q=q, e=e)
    assert [entity("email khoa co khi", "khoa co khi"), entity("co khi o dau", "khoa co khi"), entity("khi nao", "phong dao tao"), entity("tao va dao", "phong dao tao"), entity("x", "")] == [0.3, 0.2, 0.0, 0.12, 0.0]
    assert one(spark, search.type_boost(F.col("q"), F.col("t")), q="email cua khoa", t="contact") == 0.12
    assert one(spark, search.type_boost(F.col("q"), F.col("t")), q="gi", t="fact") == 0.03
    meta = search.metadata_boost(F.col("q"), F.col("terms"), F.col("i"), F.col("t"))
    # "cong nghe" is held, "khoa hoc" in part; the intent and the topic have their marks
    assert abs(one(spark, meta, q="email khoa cong nghe", terms=["cong nghe", "khoa hoc", "ab"], i=["contact"], t=["faculty"]) - (0.06 + 0.025 + 0.08 + 0.04)) < 1e-9
    pairs = spark.createDataFrame([("pho hieu truong", "hieu truong la", "role"), ("hieu truong", "hieu truong la", "role"), ("ha noi", "nam dinh", "fact")], "query string, text string, chunk_type string")
    assert [round(r.contrast, 2) for r in search.contrast_boost(pairs).collect()] == [-0.1, 0.24, -0.08]
    own = search.named("truong dai hoc x", "dhx")
    assert one(spark, search.type_boost(F.col("q"), F.col("t"), own["marks"]), q="dhx co gi", t="overview") == 0.12
    founded = spark.createDataFrame([("thanh lap", "truong dai hoc x duoc thanh lap", "fact")], "query string, text string, chunk_type string")
    assert [round(search.contrast_boost(founded, r).first().contrast, 2) for r in (search.CONTRAST, own["rules"])] == [0.12, 0.34]
    seed = search.lexical_seed_score(F.col("q"), F.split("q", " "), F.col("b"), F.lit(0.0))
    assert abs(one(spark, seed, q="hoc phi nganh", b="hoc phi nganh nao") - (1 + 0.25 + 0.06)) < 1e-9
    fields = search.field_boost(F.split("q", " "), F.col("t"), F.col("s"), F.col("e"), F.col("b"))
    assert abs(one(spark, fields, q="nganh nganh xa", t="nganh", s="-", e="-", b="nganh") - (0.08 + 0.06)) < 1e-9


def test_identifiers_and_knowledge(spark):
    assert one(spark, T.keyword_id("t"), t="node.js") == "kw-node.js-" + one(spark, F.substring(F.sha1("t"), 1, 10), t="node.js")
    assert one(spark, T.keyword_id("t"), t="a b/c").startswith("kw-a_b_c-") and one(spark, T.keyword_id("t"), t="???").startswith("kw-default-")
    assert one(spark, knowledge.sanitize(F.col("t"), ("cho hoi", "ban oi"), ("nhe", "vay")), t="Cho hỏi  học phí bao nhiêu vậy") == "hoc phi bao nhieu"
    assert [one(spark, knowledge.priority(F.col("t")), t=k) for k in ("role", "qa", "none")] == [98, 92, 70]
    chunks = spark.createDataFrame([("d", 90, "fact", "a", "1"), ("d", 90, "fact", "b", "2"), ("d", 98, "role", "a", "3")], "domain string, priority int, chunk_type string, entity_name string, id string")
    assert [r.id for r in knowledge.chunk_order(chunks).orderBy("rank").collect()] == ["3", "2", "1"]


def test_text_rules(spark):
    assert one(spark, chunking.summary(F.col("t")), t="Một câu: hai câu.") == "Một câu:"
    assert one(spark, chunking.summary(F.col("t"), 3), t="a b c, d e") == "a b c..."
    assert [one(spark, chunking.is_heading(F.col("t"), ("lich su",)), t=x) for x in ("1.2 Mục", "3 Mục", "Lịch sử trường", "HAI CHỮ", "một dòng thường")] == [True, True, True, True, False]
    assert one(spark, chunking.text_stats(F.col("t"))[3], t="a. b: c; d! e") == 5


def test_feedback_eligible(spark):
    rows = spark.createDataFrame([("a", "answer", "domain", "sales"), ("b", "meta", "domain", "sales"), ("c", "policy_block", "policy", ""), ("d", "answer", "domain", "general_docs"), ("e", "answer", "clarification", "sales")], "turn_id string, route string, family string, domain string")
    assert {r.turn_id: r.eligible for r in sessions.feedback_eligible(rows).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_replies_and_followups(spark):
    reply = classify.reply_class(F.col("t"), T.norm_ascii("t"), ("khong can",), F.lit(False), ("la gi",), ("dia chi",))
    assert [one(spark, reply, t=x) for x in ("", "không cần đâu", "phòng ở đâu vậy?", "dia chi moi la 12", "mot hai", "mot hai ba bon nam sau")] == ["other", "decline", "other", "provide", "other", "provide"]
    follow = classify.followup(F.col("q"), F.col("n"), ("khoa", "phong"), ("o dau", "email"), ("do", "nay"), ("con",), ("acme",), ("email", "dia chi"), ("tiep di",))
    assert [one(spark, follow, q=q, n=n) for q, n in (("email khoa do", 1), ("email khoa co khi", 1), ("email acme", 1), ("con gi", 1), ("con gi", 0), ("tiep di", 2))] == [True, False, False, True, False, True]


def test_replacement(spark):
    keep = lambda focus, cover, n, m, gain: one(spark, evaluate.replaces(F.lit(True), F.lit(False), F.lit(focus), F.lit(cover), F.lit(n), F.lit(m), F.lit(gain)), k=1)
    assert [keep(0.03, 0.0, 9, 9, 0.0), keep(0.0, 0.1, 9, 9, 0.0), keep(0.0, 0.0, 10, 91, 0.0), keep(-0.05, 0.0, 9, 9, 0.2), keep(-0.1, 0.0, 9, 9, 0.2)] == [True, False, True, True, False]


def test_weight_rounds_a_half_as_its_double_lies(spark):
    at = lambda quality, hard, origin: one(spark, retriever_data.weight(F.col("quality"), F.col("hard"), F.col("origin")), quality=quality, hard=hard, origin=origin)
    assert 0.75 + 0.5 * 0.003691 < 0.7518455 and (0.75 + 0.5 * 0.003691) * 1e6 == 751845.5
    assert at(1.0, 0.003691, "seed_qa") == 0.751846 and at(1.0, 0.008409, "seed_qa") == 0.754205
    assert at(1.0, 0.5, "seed_qa") == 1.0 and at(1.0, 0.5, "history") == 0.92 and at(0.1, 0.0, "seed_qa") == 0.15
