"""Rules of scans, vectors, headings, turn meta and answers, worked out by hand or by brute force on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunking, evaluate, index, preference, retriever_data, scan, vectors


def test_patterns_and_counts():
    p = scan.Patterns({"hoc", "hoc phi", "", "phi x"})
    assert {p.names[i] for i in p.inside("dong hoc phi")} == {"hoc", "hoc phi"} and p.inside("") == set() and scan.Patterns(set()).inside("x") == set()
    c = scan.Counts(3, [("a", 0), ("a", 0), ("a", 2), ("b", 1)])
    assert c.of(["a", "b", "z"]).tolist() == [2, 1, 1] and c.of([]).tolist() == [0, 0, 0]


@pytest.mark.parametrize("queries_of_a_group,rows_at_once", [(3, 5), (2048, 256)])
def test_seed_search_is_brute_force(spark, monkeypatch, queries_of_a_group, rows_at_once):
    monkeypatch.setattr(scan, "QUERIES", queries_of_a_group)
    monkeypatch.setattr(scan, "ROWS", rows_at_once)
    rnd, words = random.Random(2), ["hoc", "phi", "hocphi", "lich", "thi", "a", "lichthi"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    seeds = [(f"s{i}", text(rnd.randint(0, 6)), rnd.choice(["x", "y", None]), 0.1 * (i % 2)) for i in range(60)] + [(None, "hoc", "x", 0.0)]
    queries = [(f"q{i}", text(rnd.randint(0, 4)), rnd.choice(["x", "y", None])) for i in range(8)] + [(None, "hoc", "x")]
    s = spark.createDataFrame(seeds, "id string, body string, domain string, own double").repartition(3)
    got = {}
    for r in scan.seed_search(s, spark.createDataFrame(queries, "query_id string, query string, domain string"), F.col("body"), F.col("own"), 4).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    for name, q, domain in queries[:-1]:
        rows, qw = [], q.split(" ")
        distinct = list(dict.fromkeys(w for w in qw if w))
        for i, body, d, base in seeds[:-1]:
            if (d or "") == (domain or ""):
                score = sum(w in body.split(" ") for w in distinct) / max(1, len(distinct)) + (0.25 if q and q in body else 0) + 0.06 * sum(len(w) >= 4 and w in body for w in qw) + base
                rows.append((-round(score, 9), i, score))
        assert got.get(name, {}) == {i: pytest.approx(v) for _, i, v in sorted(rows)[:4]}


def test_qa_match_by_hand(spark):
    qa = spark.createDataFrame(
        [("a", "Đăng nhập", "vào cổng sinh viên", "login", ["cổng", "đăng nhập"], 1.0), ("b", "Học phí", "nộp học phí", "debt", ["học phí"], 0.0), ("c", "khác", "không", "", [], 0.0), ("d", None, None, None, None, None)],
        "qa_id string, question string, answer string, topic string, keywords array<string>, specificity double",
    )
    q = spark.createDataFrame([("1", "dang nhap cong sinh vien", "login", True), ("2", "hoc phi", "", False), ("3", "zz", "", False), ("4", "lich hoc phi", "", False)], "query_id string, query string, topic string, howto boolean")
    got = {r.query_id: (r.qa_id, round(r.score, 6)) for r in scan.qa_match(q, qa, {"debt": (("lich hoc",), -1.0)}, ("login",)).collect()}
    # 3 topic + 1.5 x 2 keywords + .25 x 4 words of four (dang nhap cong sinh vien: all five are) + .9 x 1 + .25
    assert got == {"1": ("a", 3 + 3 + 0.25 * 5 + 0.9 + 0.25), "2": ("b", 1.5), "4": ("b", 1.5 - 1.0)}


def test_vectors_prune_without_loss(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 6000)] + rng.normal(scale=0.05, size=(6000, 8)), np.zeros((3, 8)), np.tile(centres[0], (40, 1))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [1.0, float("nan")] * 4), (9002, [1.0, None] * 4)], "vec_id long, embedding array<double>").repartition(4)
    queries = rows.where("vec_id % 500 = 0 or vec_id in (6001, 6020)")
    found, met = vectors.nearest(rows, queries, 5)
    u = x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True)))
    got = {}
    for r in vectors.vector_search(rows, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in [*range(0, 6000, 500), 6001, 6020]:
        s = np.round(u @ u[q], 9)
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    blocks = -(-len(x) // vectors.BLOCK)
    share = np.mean([r.blocks for r in met.where("query_id < 6000").collect()]) / blocks
    assert share < 0.6 and found.count() > 0
    assert vectors.vector_search(rows.limit(0), queries, 5).count() == 0


def test_lsa_has_the_cosines_of_the_full_decomposition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    tokens = T.alnum_tokens("text", 2)
    got = {r.id: np.array(r.vector) for r in index.lsa_vectors(docs, tokens, "doc_id", rank=8).collect()}
    texts = {r.doc_id: r.t for r in docs.select("doc_id", tokens.alias("t")).collect()}
    terms = sorted({t for x in texts.values() for t in x})
    at, ids = {t: i for i, t in enumerate(terms)}, sorted(i for i in texts if texts[i])
    a = np.zeros((len(ids), len(terms)))
    for r, i in enumerate(ids):
        for t in texts[i]:
            a[r, at[t]] += 1
    a *= np.log((1 + len(texts)) / (1 + (a > 0).sum(0))) + 1
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    y = u[:, :8] * s[:8]
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    x = np.stack([got[i] for i in ids])
    assert x.shape == y.shape and np.abs(x @ x.T - y @ y.T).max() < 1e-4


def test_headings(spark):
    rows = [("Giai đoạn 1990 có rất nhiều chữ ở phía sau nên dài hơn mười từ", False), ("Khoa chuyên môn", True), ("Khoa chuyên môn", False), ("Giai", False)]
    df = spark.createDataFrame(rows, "text string, titled boolean")
    assert [r.h for r in df.select(chunking.is_heading(F.col("text"), titled=F.col("titled")).alias("h")).collect()] == [True, True, False, False]


def test_turn_meta_by_hand(spark):
    turns = spark.createDataFrame([("t1", "q one", "a"), ("t2", "q two", "b"), ("t3", "", "c")], "turn_id string, question string, answer string")
    reviews = spark.createDataFrame([("t1", 1, "correct", "answer", "", ""), ("t1", 2, "partial", "answer", "", "")], "turn_id string, seq int, verdict string, review_kind string, approved_answer string, assistant_answer string")
    variants = spark.createDataFrame([], "turn_id string, variant string")
    feedback = spark.createDataFrame([("t1", 2, "", "2025", 1), ("t1", 4, "", "2026", 2)], "turn_id string, rating int, answer_suggestion string, updated_at string, seq int")
    contributions = spark.createDataFrame([("approved", "q two", "c1", "x"), ("approved", "q  two", "c2", "y"), ("pending", "q two", "c3", "z")], "status string, original_question string, contribution_id string, user_contribution string")
    candidates = spark.createDataFrame([("t1", "review"), ("t1", "history"), ("t2", "history")], "turn_id string, source string")
    facts = spark.createDataFrame([("t1", "sales", "answer")], "turn_id string, domain string, route string")
    got = {r.turn_id: r.asDict() for r in preference.turn_meta(turns, reviews, variants, feedback, contributions, candidates, facts).collect()}
    assert set(got) == {"t1", "t2"}
    assert got["t1"] == {"turn_id": "t1", "domain": "sales", "route": "answer", "rating": 4, "has_feedback": True, "verdicts": ["correct", "partial"], "kinds": ["answer"], "has_review": True, "reviews": 2, "contributions": 0, "sources": ["history", "review"]}
    assert got["t2"] == {"turn_id": "t2", "domain": "", "route": "", "rating": 0, "has_feedback": False, "verdicts": [], "kinds": [], "has_review": False, "reviews": 0, "contributions": 2, "sources": ["history"]}
    pairs = spark.createDataFrame([("t1", "x"), ("t2", "y")], "turn_id string, chosen string")
    kept = preference.preference_filter(pairs, spark.createDataFrame([("t1", ["correct"], 4), ("t2", [], 0)], "turn_id string, verdicts array<string>, rating int"), None, None, 5)
    assert [r.turn_id for r in kept.collect()] == ["t1"]


def test_rule_answers_before_the_ranking(spark):
    def row(key, source, text, pos, intent="factoid", guarded=True, steps=0.0, focus=0.1, total=0.5):
        return (key, source, text, pos, text.lower(), intent, guarded, steps, focus, len(text), total)

    long = "the given answer is long enough here"
    rows = [
        row("same", "original", "Yes", 0), row("same", "rule", "yes", 1, total=2.0),
        row("list", "original", long, 0, intent="list"), row("list", "rule", "a longer text than that one, truly long", 1, intent="list", total=0.0),
        row("bad", "original", long, 0, guarded=False), row("bad", "rule", long + "!", 1, total=0.0),
        row("steps", "original", long, 0, intent="howto"), row("steps", "rule", long + "!", 1, steps=0.4, total=0.0),
        row("focus", "original", long, 0), row("focus", "rule", long + "!", 1, focus=0.13, total=0.0),
        row("short", "original", long, 0), row("short", "rule", "brief", 1, total=0.0),
        row("rank", "original", long, 0), row("rank", "rule", long + "!", 1, total=0.58),
        row("stay", "original", long, 0), row("stay", "rule", long + "!", 1, total=0.57),
        row("none", "original", long, 0), row("none", "fallback", "x", 1, total=0.9),
    ]
    df = spark.createDataFrame(rows, "turn_id string, source string, text string, pos int, norm string, intent string, guarded boolean, steps double, focus double, length int, total double")
    got = {r.turn_id: (r.how, r.answer) for r in evaluate.verified_answer(df, "turn_id").collect()}
    assert got["same"] == ("keep", "Yes") and got["list"][0] == got["bad"][0] == got["steps"][0] == got["focus"][0] == got["short"][0] == "rule"
    assert got["short"][1] == "brief" and got["rank"] == ("ranked", long + "!") and got["stay"] == ("ranked", long) and got["none"] == ("ranked", "x")


def test_question_text_makes_a_positive(spark):
    rows = spark.createDataFrame([("in the question", "", "", "", "hoc phi nganh"), ("nowhere", "x", "y", "z", "w")], "id string, title_n string, entity_n string, body string, question_n string")
    got = retriever_data.positive_match(rows, F.array(F.lit("phi"), F.lit("la"), F.lit("the")), ("the",)).collect()
    assert [r.id for r in got] == ["in the question"]


def test_lsa_holds_nothing_of_the_vocabulary_and_is_the_full_decomposition(spark, monkeypatch):
    monkeypatch.setattr("pyspark.mllib.linalg.distributed.RowMatrix", None)  # its solver's vectors are as long as the vocabulary
    monkeypatch.setattr(index, "POSTINGS", 900)
    monkeypatch.setattr(index, "STEP", 50)
    monkeypatch.setattr(index, "SLICE", 70)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 500) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: np.array(r.vector) for r in index.lsa_vectors(docs, F.split("text", " "), "doc_id", rank=6).collect()}
    words = sorted({w for t in texts for w in t.split()})
    tf = np.array([[t.split().count(w) for w in words] for t in texts], float)
    a = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    a /= np.sqrt((a * a).sum(1))[:, None]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :6] * s[:6]
    want /= np.sqrt((want * want).sum(1))[:, None]
    assert np.allclose(np.abs(np.array([got[i] for i in range(len(texts))])), np.abs(want), atol=1e-6)
