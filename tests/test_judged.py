"""Exports of training data make positives and negatives once."""

from marlstone.operators import inverted, retriever_data
from marlstone.plans import training
from marlstone.plans.common import view


def test_a_curriculum_needs_two_indexes(spark, monkeypatch):
    made, build = [], inverted.build
    monkeypatch.setattr(inverted, "build", lambda *a, **k: made.append(1) or build(*a, **k))
    rows = training.curriculum(*[view(spark, "/root/testdata/sf0.001", t) for t in ("queries_v", "documents", "corpus_v")])
    assert rows.count() > 0 and len(made) == 2  # of the documents, and of the chunks' own words


def test_only_queries_short_of_retrieved_negatives_take_lexical_ones(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    got = spark.createDataFrame([("a", f"d{k}", 0.9 - k / 10) for k in range(3)] + [("b", "d1", 0.5), ("b", "d2", 0.4)], "query_id string, id string, score double")
    lex = spark.createDataFrame([(x, f"d{k}", 0.3 + k / 100, "lexical") for x in "abc" for k in range(9)], "query_id string, id string, score double, source string")
    few = retriever_data.short_of(q, got, 3)
    assert sorted(r.query_id for r in few.collect()) == ["b", "c"]
    rows = lambda x: sorted(map(tuple, retriever_data.hard_negatives(got, x, 3).collect()))
    assert rows(lex.join(few, "query_id", "left_semi")) == rows(lex) and len(rows(lex)) == 9


def test_triplets_search_no_chunk_for_queries_with_enough_negatives(spark, monkeypatch):
    asked, made = [], retriever_data.lexical_negatives
    monkeypatch.setattr(retriever_data, "lexical_negatives", lambda q, *a, **k: asked.append(q.count()) or made(q, *a, **k))
    views = [view(spark, "/root/testdata/sf0.001", t) for t in ("queries_v", "documents", "corpus_v")]
    _, negatives = training.judged(*views)
    full = negatives.where("source = 'retrieval'").groupBy("query_id").count().where("count = 8").count()
    assert full > 0 and asked == [views[0].count() - full]
