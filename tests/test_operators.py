"""Hand-computed cases, and a sample of the registered queries against their DuckDB twins (all of them with MARLSTONE_ALL=1)."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone import registry
from marlstone.functions import text as T
from marlstone.operators import chunking, evaluate, pages, preference, retriever_data, search
from marlstone.plans.common import TABLES

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normal_forms(spark):
    assert one(spark, T.norm_ascii(F.lit("Trường Đại học: (Kinh tế)! x@y.vn"))) == "truong dai hoc: kinh te x@y.vn"
    assert one(spark, T.slug(F.lit("  Đà Nẵng, 2024! "))) == "da-nang-2024"
    assert one(spark, T.slug(F.lit("!?"))) == "item"
    assert one(spark, T.norm(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("n, starts", [(0, []), (1, [0]), (220, [0]), (221, [0, 135]), (305, [0, 135]), (306, [0, 135, 270]), (400, [0, 135, 270])])
def test_word_windows(spark, n, starts):
    docs = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id long, text string")
    assert sorted(r.start for r in chunking.word_windows(docs).collect()) == starts


def test_id_split(spark):
    assert one(spark, T.hash_bucket(F.lit("q-abc")) % 10000) == 4916
    assert one(spark, retriever_data.id_split(F.lit("q-abc"), 0.15)) == "train"
    assert one(spark, retriever_data.id_split(F.lit("q-abc"), 0.5)) == "val"


@pytest.mark.parametrize("scores, units", [([2.0, 2.0], [1, 1]), ([0.0, 0.0], [0, 0]), ([1.0, 3.0], [0, 1])])
def test_minmax(spark, scores, units):
    rows = spark.createDataFrame([("q", k, s) for k, s in enumerate(scores)], "query_id string, id long, score double")
    assert [r.unit for r in search.minmax(rows, ("query_id",)).orderBy("id").collect()] == units


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("q", x, k + 1) for k, x in enumerate("xayb")], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string")
    r = evaluate.rank_metrics(ranked, rel, (3,)).first()
    assert (r.recall, r.mrr) == (0.5, 0.5)
    assert r.ndcg == pytest.approx(0.386853, abs=1e-6)


def test_difficulty_weight_priority(spark):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<double>")
    assert one(spark, retriever_data.difficulty(arr())) == 0.5
    assert one(spark, retriever_data.difficulty(arr(1.0))) == pytest.approx(0.5)
    assert one(spark, retriever_data.weight(F.lit(1.0), F.lit(0.5), F.lit("seed_qa"))) == pytest.approx(1.0)
    assert one(spark, retriever_data.weight(F.lit(1.0), F.lit(0.5), F.lit("history"))) == pytest.approx(0.92)
    assert [one(spark, search.priority_boost(F.lit(p))) for p in (250, -3, 98)] == [0.1, 0, 0.098]


def test_rejected_beats_original(spark):
    rows = spark.createDataFrame([("t", "same", "original", 0.4, "history", "0:"), ("t", "same", "rejected", 0.15, "feedback", "4:")], "turn_id string, text string, label string, score double, source string, pos string")
    got = preference.candidate_dedupe(rows).collect()
    assert [(r.label, r.score) for r in got] == [("rejected", 0.15)]


def test_grounding(spark):
    assert one(spark, evaluate.grounded(F.lit("write to a@b.co"), F.lit("no address"))) is False
    assert one(spark, evaluate.grounded(F.lit("room 12"), F.lit("it is room 12"))) is True


def test_diversified_pick(spark):
    rows = spark.createDataFrame([("q", "a", 1.0, "k1", "", "e", "fact"), ("q", "b", 0.95, "k1", "", "e", "fact"), ("q", "c", 0.7, "k2", "", "f", "fact")], "query_id string, id string, score double, dedupe_key string, parent string, entity string, chunk_type string")
    assert [r.id for r in search.diversified(rows, 3).orderBy("rank").collect()] == ["a", "c", "b"]


def test_html_blocks(spark):
    html = "<html><title>A &amp; B | Site</title><nav><p>menu item</p></nav><article><h1>Head<br>line</h1><p>One<script>var x='<p>no</p>';</script> two</p><p>x</p></article><p>after the end</p></html>"
    rows = pages.html_blocks(spark.createDataFrame([(1, "u", html), (2, "v", "<p>only text</p>"), (3, "w", None)], "page_id long, url string, html string")).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.title, r.text) for r in rows] == [(1, "A & B | Site", "Headline"), (1, "A & B | Site", "One two"), (2, "", "only text")]


def test_reward_model_prefers_chosen(spark):
    rows = [(f"good answer with reasons {k}", 1) for k in range(20)] + [(f"zzz qqq xxx {k}", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "text string, label int")
    got = preference.reward_model(df, features=500).transform(df).select("label", "probability").collect()
    assert min(r.probability[1] for r in got if r.label) > max(r.probability[1] for r in got if not r.label)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "pear plum"), (3, "plum plum fig"), (4, "kiwi")], "id long, text string")
    q = spark.createDataFrame([("q", "apple")], "query_id string, query string")
    got = search.bm25(q, T.alnum_tokens("query"), docs, T.alnum_tokens("text")).collect()
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert [(r.id, r.score) for r in got] == [(1, pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2))))]


QUICK = ("u1_", "u4_", "u9_", "c3_", "c6_", "c7_", "p4_", "m5_", "m9_", "k3_", "q7_", "q11_", "q14_", "j1_", "j6_", "j8_", "j9_", "x7_", "x12_", "d8_", "e5_", "r3_", "d2_", "d4_", "k7_", "q2_", "q4_", "q13_", "r11_", "r13_", "x15_", "e8_", "r28_", "s6_", "s8_", "s9_")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(v):
    return round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in registry.oracles() if os.environ.get("MARLSTONE_ALL") or n.startswith(QUICK)])
def test_query_is_its_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(f"select {', '.join(cols)} from ({registry.oracles()[name]})")
    assert got == sorted((tuple(rounded(v) for v in r) for r in res.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert registry.flagship(spark, SF).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_vector_search_takes_any_number_of_queries(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 4)).round(1)
    x[:40] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [2.0, 1.0]), (None, [1.0, 1.0]), (5002, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in search.vector_search(df, df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert set(got) == set(range(5002))
    assert [(r, i) for r, i, _ in got[5000]] == [(1, 5001)]
    u = x / np.maximum(1e-12, np.sqrt((x * x).sum(1, keepdims=True)))
    for q in [*range(0, 5000, 37), 5, 39]:
        s = np.round(u @ u[q], 9)
        want = sorted((i for i in range(5000) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [s[i] for _, i, _ in sorted(got[q])] == pytest.approx([s[i] for i in want], abs=2e-9)
    assert [i for _, i, _ in sorted(got[5])] == [0, 1, 2]


def test_reward_reads_the_whole_text(spark):
    from marlstone.plans.preference import reward_model

    head = "same words " * 200
    docs = spark.createDataFrame([(i, head + ("good tail" if i % 2 else "zzz qqq")) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    got = {r.doc_id: r.reward for r in reward_model(docs, labels).collect()}
    assert got[11] > 0.5 > got[10]


def test_reward_grams_are_those_of_the_texts(spark):
    import random
    from collections import Counter

    import numpy as np

    r = random.Random(3)
    texts = ["".join(r.choice("abÄ😀 \n") for _ in range(n)) for n in (0, 2, 3, 40, 500)]
    plain = [t.lower().replace("\n", "") for t in texts]
    want = [Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)) for t in plain]
    code = {g: int(next(preference.gram_hashes([g]))[1][-1]) for c in want for g in c}
    for window in (7, 1 << 20):  # grams over a window's end count once
        got = [Counter() for _ in texts]
        for place, h in preference.gram_hashes(plain, window):
            for p, x in zip(place.tolist(), h.tolist()):
                got[p][x] += 1
        assert got == [Counter({code[g]: k for g, k in c.items()}) for c in want]
    rows = spark.createDataFrame([*enumerate(texts), (9, None)], "id long, text string")
    words = preference.gram_vocabulary(rows, "text", 50)
    total = sum(want, Counter())
    assert sorted(total[g] for g in total if code[g] in set(words.tolist())) == sorted(total.values())[-50:]
    tf = {x.id: x.tf for x in preference.gram_counts(rows, "text", words).collect()}
    at = {int(w): k for k, w in enumerate(words)}
    for k, c in enumerate(want):
        assert dict(zip(tf[k].indices.tolist(), tf[k].values.tolist())) == {at[code[g]]: n for g, n in c.items() if code[g] in at}
    assert tf[9].numNonzeros() == 0 and np.all(words[1:] > words[:-1])


def test_reward_of_a_row_without_text(spark, tmp_path):
    rows = [(k, f"good answer with reasons {k}", 1) for k in range(20)] + [(k, f"zzz qqq xxx {k}", 0) for k in range(20, 40)] + [(40, None, 0)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = preference.reward_model(df, features=500)
    got = {r.id: r.probability[1] for r in model.transform(df).collect()}
    assert len(got) == 41 and min(got[k] for k in range(20)) > max(got[k] for k in range(20, 40))
    model.save(str(tmp_path / "model"))
    assert {r.id: r.probability[1] for r in preference.RewardModel.load(str(tmp_path / "model")).transform(df).collect()} == got
