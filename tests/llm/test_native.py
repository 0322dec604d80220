"""Exact dedup, mixing and the pipeline's filters against brute force, with edge cases."""

import hashlib
from collections import Counter, defaultdict

import pytest

from marlstone.llm import exact_dedup, minhash, mixing
from marlstone.llm.common import join_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, repeated string, h string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0" if (i or 0) % 3 else "src1", 1, "x", "y") for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "c " * 5000), (7, "a"), (None, "lone"), (9, "b "), (10, "c " * 5000), (10, "c " * 5000)]


def test_exact_dedup(spark):
    got = {(r.doc_id, r.text_sha256): tuple(r)[1:4] for r in exact_dedup.exact_dedup(table(spark, ROWS)).collect()}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        for i in ids:
            assert got[i, hashlib.sha256(t.encode()).hexdigest()] == (keep, len(ids), i == keep)


def test_exact_dedup_row_count_and_least(spark):
    rows = table(spark, ROWS)
    assert exact_dedup.exact_dedup(rows).count() == len(ROWS)
    assert {r.keep_id for r in exact_dedup.exact_dedup(rows, keep="min").where("doc_id in (1, 3, 7)").collect()} == {1}
    kept = exact_dedup.drop_copies(rows)
    assert kept.columns == rows.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 5, 7, None, 9, 10, 10])
    assert {r.repeated for r in kept.collect()} == {"x"}


def test_empty_tables(spark):
    rows = table(spark, [])
    assert exact_dedup.exact_dedup(rows).count() == 0
    assert exact_dedup.drop_copies(rows).count() == 0
    assert mixing.mix_weights(rows, rounds=1).count() == 0
    assert mixing.sample(rows, rounds=1).count() == 0


def test_filter_has_no_false_negatives(spark):
    rows = spark.range(2000).selectExpr("id", "xxhash64(id % 1500) as h")
    n = 1 << 15
    marked = exact_dedup.maybe_repeated(rows, "h", n, exact_dedup.repeated_cells(rows, "h", n))
    flags = {r.id: r.repeated for r in marked.collect()}
    assert all(flags[k] for k in range(500)) and all(flags[k] for k in range(1500, 2000))
    assert sum(flags[k] for k in range(500, 1500)) < 100


def test_join_groups_with_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id) as key")
    groups = rows.groupBy("key").count()
    got = join_groups(rows, groups, ["key"], "count")
    assert got.count() == 5000
    assert got.where("key = 0").select("count").distinct().collect()[0][0] == 1667


def test_raking_reaches_the_targets(spark):
    cells = spark.createDataFrame([(s, l, "t", 10 * (k + 1)) for k, (s, l) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])], "source string, lang string, topic string, tokens long")
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 0.3), ("y", 0.7)], "lang string, target double"),
        "topic": spark.createDataFrame([("t", 1.0)], "topic string, target double"),
    }
    fitted, error = mixing.rake(cells, targets, 6)
    rows = fitted.collect()
    assert error < 1e-4
    share = lambda f: sum(r.weight for r in rows if f(r))
    assert share(lambda r: r.source == "a") == pytest.approx(0.5, abs=1e-4)
    assert share(lambda r: r.lang == "x") == pytest.approx(0.3, abs=1e-4)


def test_contradicting_targets_are_told(spark):
    docs = spark.createDataFrame([(0, "w " * 50, "x", "a", 1, "x", "y"), (1, "w " * 50, "y", "b", 1, "x", "y")], SCHEMA)
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double")}
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix_weights(docs, margins={"source": 1.0, "lang": 1.0}, targets=targets, rounds=3, strict=True)
    with pytest.warns(UserWarning, match="margin off"):
        mixing.mix_weights(docs, margins={"source": 1.0, "lang": 1.0}, targets=targets, rounds=3)


def test_mixing_samples_by_probability(spark):
    rows = table(spark, [(i, "w " * (1 + i % 50)) for i in range(400)] + [(400, None), (401, "")])
    got = mixing.mix_weights(rows, rounds=3).collect()
    assert len(got) == 402
    assert all(0 <= r.prob <= 1 for r in got) and max(r.prob for r in got) == pytest.approx(1)
    assert not any(r.sampled for r in got if r.doc_id in (400, 401))
    want = sum(r.prob for r in got)
    assert abs(sum(r.sampled for r in got) - want) < 5 * want**0.5
    again = {r.doc_id for r in mixing.sample(rows, rounds=3).collect()}
    assert again == {r.doc_id for r in got if r.sampled}


def test_mixing_with_a_rare_source_and_a_null_lang_keeps_its_size(spark):
    rows = [(i, "w " * 100, ("en", "de", "fr", "nl")[i % 7 % 4], f"src{i % 11 % 3}", 1, "x", "y") for i in range(3000)]
    for more in ([], [(3000, "w " * 100, "en", "rare", 1, "x", "y"), (3001, "w " * 100, None, "src0", 1, "x", "y")]):
        docs = spark.createDataFrame(rows + more, SCHEMA)
        got = mixing.mix_weights(docs, share=0.5).collect()
        tokens = sum(r.tokens for r in got)
        assert len(got) == len(rows + more) and all(0 < r.prob <= 1 for r in got)
        assert sum(r.prob * r.tokens for r in got) == pytest.approx(0.5 * tokens, rel=1e-6)
        assert sum(r.sampled for r in got) == pytest.approx(0.5 * len(got), rel=0.1)
        assert [r.prob for r in got if r.source == "rare" or r.lang == ""] == [1] * len(more)
        assert {r.doc_id for r in mixing.sample(docs, share=0.5).collect()} == {r.doc_id for r in got if r.sampled}
    # the margins that can be met are: tempered shares, to what the two rare documents lack
    kept = {s: sum(r.prob for r in got if r.source == s) for s in ("src0", "src1", "src2")}
    power = {s: sum(r.source == s for r in got) ** mixing.TEMPER["source"] for s in kept}
    for s in kept:
        assert kept[s] / sum(kept.values()) == pytest.approx(power[s] / sum(power.values()), rel=0.02)


def test_mixing_share_of_all_keeps_all(spark):
    got = mixing.mix_weights(table(spark, [(i, "w " * (1 + i % 50)) for i in range(60)] + [(60, None)]), share=1.0, rounds=2).collect()
    assert all(r.prob == pytest.approx(1 if r.tokens else 0) for r in got)
    with pytest.raises(ValueError):
        mixing.mix_weights(table(spark, ROWS), share=1.5)


def test_pipeline_mix_is_not_sized_by_the_rarest_source(spark):
    import corpus_pipeline

    rows = [(i, "w " * 100, "en", "src0", 1, "x", "y") for i in range(2000)] + [(2000, "w " * 100, "en", "rare", 1, "x", "y")]
    assert corpus_pipeline.mix(spark, spark.createDataFrame(rows, SCHEMA), "").count() > 800


def test_copies_are_dropped_by_id_and_text(spark):
    rows = [(1, "x"), (1, "y"), (2, "x"), (None, "z"), (None, "z"), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == [(1, "y"), (2, "x"), (3, "z")]
    named = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "w")], "doc_id string, text string")
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(named).collect()) == [("b", "w"), ("b", "x")]
    near = minhash.drop_near_copies(spark.createDataFrame([("a", "one two three four five six"), ("b", "One two three four five six"), ("b", "other words stand here now")], "doc_id string, text string"))
    assert sorted(tuple(r) for r in near.collect()) == [("a", "one two three four five six"), ("b", "other words stand here now")]
