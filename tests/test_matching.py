"""Contexts and variants matched without pairs of equal titles or common words, against brute force."""

import random

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import entities, inverted, retriever_data


def test_contexts_find_the_best_row_of_any_shared_fields(spark):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    corpus = [(f"d{i}", some(1, 2, 3, None), some("seed", "local"), some("T a", "T b", ""), some("q one", "q two", ""), some("x", "y", "z", ""), some("k1", "k2", "k3", "")) for i in range(40)]
    contexts = [(f"c{i}", some("d3", "", "", "none"), some("seed", "local", ""), some("T a", "t b", ""), some("q one", "q three", ""), some("x", "y", ""), some("k1", "k9", ""), some(1, 2, None), some("x", "z", "")) for i in range(200)]
    c = spark.createDataFrame(corpus, "id string, doc_id int, source_kind string, title string, question string, text string, dedupe_key string")
    x = spark.createDataFrame(contexts, "context_id string, source_id string, kind string, title string, question string, answer string, dedupe_key string, doc_id int, text string")
    got = {r.context_id: (r.id, r.score) for r in retriever_data.resolve_contexts(x, c).collect()}
    want = {}
    for cid, source, kind, title, question, answer, key, doc, text in contexts:
        if any(source == r[0] for r in corpus):
            want[cid] = (source, None)
            continue
        rows = []
        for id_, cdoc, ckind, ctitle, cquestion, ctext, ckey in corpus:
            same = lambda a, b: a != "" and a.lower() == b.lower()
            if same(title, ctitle) or same(question, cquestion) or same(text, ctext) or same(answer, ctext) or same(key, ckey):
                score = 1.0 * (doc is not None and doc == cdoc) + 0.6 * (kind == ckind) + 0.9 * same(title, ctitle) + 1.2 * same(question, cquestion) + 1.0 * same(answer, ctext) + 0.8 * same(text, ctext)
                if score > 0:
                    rows.append((round(score, 6), id_))
        if rows:
            want[cid] = max(rows)[::-1]
    assert got == want and len(got) > 100


def test_variants_meet_by_rare_words_only(spark):
    rng = random.Random(7)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    questions = [(f"t{i}", text()) for i in range(150)]
    variants = [(f"r{i % 50:02}", text()) for i in range(120)] + [(f"r{i:02}", questions[i][1] + " more") for i in range(20)] + [("r30", questions[30][1])]
    t = spark.createDataFrame(questions, "turn_id string, question string")
    r = spark.createDataFrame([(f"r{i:02}", i != 3, "answer") for i in range(50)], "turn_id string, active boolean, review_kind string")
    v = spark.createDataFrame(variants, "turn_id string, variant string")
    got = {x.turn_id: (x.review_turn, round(x.score, 9)) for x in entities.variant_match(t, r, v).collect()}
    want = {}
    for tid, q in questions:
        rows = []
        for rid, w in variants:
            a, b = set(q.split()), set(w.split())
            score = 10.0 if q == w else len(a & b) / len(a) + 0.5 * (q in w or w in q)
            if rid != "r03" and a & b and score >= 0.75:
                rows.append((-round(score, 9), rid))
        if rows:
            want[tid] = (min(rows)[1], -min(rows)[0])
    assert got == want and len(got) > 20
    a = spark.createDataFrame([(f"the of q{i} x{i} y{i}", f"a{i}") for i in range(300)], "q string, a string")
    b = spark.createDataFrame([(f"the of q{i} x{i} z{i}", f"b{i}") for i in range(300)], "v string, b string")
    assert {(x.a[1:], x.b[1:]) for x in entities._near(a, b, 0.75).collect()} == {(str(i), str(i)) for i in range(300)}


def test_shards_are_cut_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(inverted, "TOKENS", 50)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(20 if i else 80))) for i in range(30)], "id long, text string").coalesce(1)
    index = inverted.build(docs, T.alnum_tokens("text"), grams=2, norms=True)
    sizes = [sum(memoryview(r.lengths).cast("i")) for r in index.docs.select(F.col("lengths")).collect()]
    assert sum(sizes) == 80 + 29 * 20 and sorted(sizes)[-1] == 80 and sorted(sizes)[-2] <= 50
    queries = spark.createDataFrame([(1, "w3 w5 w7")], "query_id long, query string")
    got = [(r.id, round(r.score, 9)) for r in inverted.search(index, queries, T.alnum_tokens("query"), 5, "tfidf").orderBy(F.desc(F.round("score", 9)), "id").collect()]
    monkeypatch.setattr(inverted, "TOKENS", 1 << 20)
    whole = inverted.build(docs, T.alnum_tokens("text"), grams=2, norms=True)
    assert got == [(r.id, round(r.score, 9)) for r in inverted.search(whole, queries, T.alnum_tokens("query"), 5, "tfidf").orderBy(F.desc(F.round("score", 9)), "id").collect()]


def test_pairs_of_variants_that_score_too_little_are_not_written(spark, monkeypatch):
    n = 60  # a word that all share is among the rarest: n * n pairs meet, none scores
    t = spark.createDataFrame([(f"t{i}", f"same q{i}") for i in range(n)] + [("t", "same found here too")], "turn_id string, question string")
    v = spark.createDataFrame([(f"r{i}", f"same v{i}") for i in range(n)] + [("r", "same found here now too")], "turn_id string, variant string")
    r = v.select("turn_id", F.lit(True).alias("active"), F.lit("answer").alias("review_kind"))
    written = []
    stored = entities.stored
    monkeypatch.setattr(entities, "stored", lambda df, name="table": (out := stored(df, name), written.append(out.count()))[0])
    got = [(x.turn_id, x.review_turn, x.score) for x in entities.variant_match(t, r, v, 0.9).collect()]
    assert got == [("t", "r", 1.0)] and max(written) < n * n / 4
