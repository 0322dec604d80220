"""Work that copies and long tables made grow: results stay, less moves."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import entities, index, inverted
from marlstone.plans import corpus
from marlstone.sources import tables


def test_adaptive_chunks_keep_the_mark_that_ends_a_sentence(spark, tmp_path):
    text = "One with the abc. Two is plain; one with the abc? One with the abc\nx y z. One with the abc! No more"
    spark.createDataFrame([(1, text, "en", "src001", len(text))], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus.QUERIES["c17_adaptive_chunk"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(corpus.ORACLE["c17_adaptive_chunk"]).fetchall())


def test_equal_questions_get_the_same_name(spark):
    q = spark.createDataFrame([(i, "Blue  steel anvil" if i % 2 else "blue steel ANVIL!") for i in range(50)] + [(90, "cold"), (91, ""), (92, None)], "question_id long, question string")
    n = spark.createDataFrame([("blue anvil",), ("cold anvil",), ("steel rod",)], "name string")
    got = {r.question_id: (r.name, r.score) for r in entities.entity_match(q, n, ("blue",), ("large",), ("tin",), ("standard",)).collect()}
    assert set(got) == {*range(50), 90} and len({got[i] for i in range(50)}) == 1 and got[90][0] == "cold anvil"


def test_vectors_of_shards_are_those_of_the_table(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(i))) for i in range(12)] + [(50, None)], "id long, text string").repartition(3)
    tokens = T.alnum_tokens("text", 2)
    made = inverted.build(docs, tokens, grams=2)
    assert dict(made.terms.dtypes)["term"] == "bigint"  # no term moves as text
    got = {r.id: (len(r.terms), sum(r.weights), max(r.weights)) for r in inverted.vectors(made).collect()}
    made.release()
    whole = index.tfidf(docs.withColumn("t", tokens), T.ngrams(F.col("t"), 1, 2)).groupBy("id").agg(F.count("*"), F.sum("weight"), F.max("weight")).collect()
    assert got == {r[0]: (r[1], pytest.approx(r[2]), pytest.approx(r[3])) for r in whole} and 50 not in got


def test_keywords_of_some_documents_are_those_among_all(spark):
    docs = spark.createDataFrame([(1, "apple pear pear"), (2, "pear plum"), (3, "plum fig fig kiwi"), (4, "kiwi")], "id long, text string")
    every = sorted(tuple(r) for r in index.keyword_weights(docs, T.keyword_terms("text")).collect())
    some = index.keyword_weights(docs, T.keyword_terms("text"), only=spark.createDataFrame([(3,), (3,), (9,)], "id long"))
    assert sorted(tuple(r) for r in some.collect()) == [r for r in every if r[0] == 3]


def test_long_rows_go_to_python_and_to_files_a_few_at_a_time(spark):
    rows = spark.range(12).repartition(1).withColumn("blob", F.expr("unhex(array_join(transform(sequence(1, 32768), i -> sha2(concat(id, ':', i), 256)), ''))"))
    table = tables.stored(rows, "rows", True)
    files = [pq.ParquetFile(f).metadata for f in Path(table.stored_path.removeprefix("file:")).glob("*.parquet")]
    assert max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) <= 5  # one group before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(tables._LIMIT)
    met = tables.stored(spark.read.parquet(table.stored_path).coalesce(1).mapInArrow(sizes, "n long"), "sizes")
    assert max(r.n for r in met.collect()) <= 5 and spark.conf.get(tables._LIMIT) == before
    assert met.agg(F.sum("n")).first()[0] == 12
    with pytest.raises(ZeroDivisionError), tables.small_batches(spark):
        1 / 0
    assert spark.conf.get(tables._LIMIT) == before
