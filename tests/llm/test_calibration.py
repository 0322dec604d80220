"""Rejection of the language model is calibrated on every training document."""

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import langid


def test_rejection_rests_on_all_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATE", 5, raising=False)  # the sample there once was
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abcde " if i % 2 else "vwxyz "), 60 + i)), "one" if i % 2 else "two") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang = lang_pred")
    want = {r.lang: r.most for r in found.groupBy("lang").agg(F.expr(f"percentile(entropy, {1 - langid.REJECTED})").alias("most")).collect()}
    assert set(want) == {"one", "two"}
    for lang, most in want.items():
        assert abs(model.most[model.langs.index(lang)] - langid.SLACK - most) < 1e-9


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(3, 1, 1500).round(2)] + [("b", 2.5)] + [("c", float(x)) for x in rng.random(40)]
    df = spark.createDataFrame(rows, "lang string, entropy double")
    for share in (0.0, 0.5, 0.995, 1.0):
        for lang, got in langid._quantiles(df, share).items():
            assert abs(got - np.quantile([x for k, x in rows if k == lang], share)) < 1e-12
