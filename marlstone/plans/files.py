"""S, T: round trips through files, and streams with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as G
from ..operators import preference as X
from ..operators import retriever_data as D
from ..sources import files as S
from ..sources import published as R
from ..streaming import stateful as T
from ..streaming import upserts as U
from .common import Plans, d_bucket, scratch
from .preference import D_PAIRS, VIEWS, pairs, sft
from .sessions import D_FEEDBACK, MEMORY, session_turns

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle


def _trip(name, write, read):
    """Write a table, read it back."""

    def run(df, *more):
        path = scratch(df.sparkSession, name)
        write(df, path)
        return read(df.sparkSession, path)

    return run


P.add("s1_jsonl_scan", _trip("jsonl", lambda b, p: b.write.json(p), lambda s, p: S.read_jsonl(s, p, "item_id long, text string")), "benchmark", sql="SELECT item_id, text FROM benchmark")


def domain_map(customers, nations):
    """One document of domains, from customers by region, read back as rows."""
    rows = nations.select(F.concat(F.lit("r"), F.col("n_regionkey")).alias("k"), "n_nationkey", "n_name")
    one = rows.groupBy("k").agg(F.array_sort(F.collect_list("n_name")).alias("facts"))
    entry = F.struct(F.col("k").alias("title"), "facts")
    doc = one.agg(F.map_from_entries(F.collect_list(F.struct("k", entry))).alias("domains"))
    path = scratch(customers.sparkSession, "domains")
    doc.write.json(path)
    return S.read_domain_map(customers.sparkSession, path)


P.add(
    "s2_domain_map_scan",
    domain_map,
    "customer",
    "nation",
    sql="SELECT 'r' || n_regionkey AS domain, 'r' || n_regionkey AS title, 'facts' AS kind, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS pos, n_name AS value FROM nation",
)


def histories(c):
    item = F.struct("turn", "role", F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))
    path = scratch(c.sparkSession, "histories")
    rows.select("messages", F.col("conv_id").alias("user")).write.partitionBy("user").json(path)
    back = S.read_histories(c.sparkSession, path)
    return back.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.max("turn").alias("last"))


P.add("s3_history_scan", histories, "conversations", sql="SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(k) AS INTEGER) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY role")


def page_cache(p):
    rows = G.page_doc(p).select(F.concat_ws("-", "doc_id", "page_id").alias("doc_id"), "title", F.array("title").alias("blocks"))
    path = scratch(p.sparkSession, "cache")
    rows.withColumn("page", F.col("doc_id")).write.partitionBy("page").json(path)
    back = S.read_page_cache(p.sparkSession, path)
    return back.select(F.regexp_extract("doc_id", "-([0-9]+)$", 1).cast("long").alias("page_id"), "title", F.size("blocks").alias("blocks"))


_T = r"trim(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[\s\x0B]+', ' ', 'g')), ' [|–-] [^|–-]*$', ''))"
P.add("s4_page_cache_scan", page_cache, "pages", sql=f"SELECT page_id, {_T} AS title, 1 AS blocks FROM pages WHERE contains(html, '<p')")
P.add(
    "s5_store_scan",
    _trip("store", lambda f, p: S.write_store(f.select("turn_id", "rating", "updated_at"), p, "turn_id"), lambda s, p: S.read_store(s, p, "turn_id:string,rating:int,updated_at:string")),
    "feedback_v",
    sql="SELECT turn_id, rating, updated_at FROM feedback_v",
)
P.add("s6_jsonl_sink", _trip("sorted", lambda q, p: S.write_jsonl(q, p, "query_id", "corpus_id"), lambda s, p: S.read_jsonl(s, p, "query_id string, corpus_id string, label int")), "qrels_v", sql="SELECT query_id, corpus_id, label FROM qrels_v")
P.add("s7_qrels_tsv_sink", _trip("tsv", S.write_tsv, lambda s, p: S.read_tsv(s, p, "query_id string, corpus_id string, label int")), "qrels_v", sql="SELECT query_id, corpus_id, label FROM qrels_v")
P.add(
    "s8_split_partition_sink",
    _trip("split", lambda q, p: S.write_partitioned(q.select("query_id", "query", D.id_split(F.col("query_id"), 0.3).alias("split")), p, "split"), lambda s, p: S.read_partitioned(s, p, "query_id string, query string, split string").where("split = 'val'")),
    "queries_v",
    sql=f"SELECT query_id, query, 'val' AS split FROM queries_v WHERE {d_bucket('query_id')} % 10000 < 3000",
)


def layout(*v):
    """Published by framework, task and split; the rows that are there, and those that the manifest lists."""
    rows = X.framework_rows(pairs(*v), sft(*v), v[0])
    salted = {task: X.salted_split(F.col("turn_id"), salt, 0.3) for task, salt in (("sft", "sft"), ("preference", "pref"))}
    rows = rows.withColumn("split", F.when(F.col("task") == "sft", salted["sft"]).otherwise(salted["preference"]))
    spark, path, keys = v[0].sparkSession, scratch(v[0].sparkSession, "layout"), ("framework", "task", "split")
    R.publish_layout(rows, path, *keys)
    back = R.read_layout(spark, path, "turn_id string, row string, framework string, task string, split string")
    digest = F.sum(F.conv(F.substring(F.md5("row"), 1, 8), 16, 10).cast("long")).alias("digest")
    return back.groupBy(*keys).agg(F.count("*").alias("rows"), digest).join(R.read_manifest(spark, path, *keys).select(*keys, F.col("rows").alias("listed")), list(keys))


_salted = lambda salt: f"CASE WHEN {d_bucket(chr(39) + salt + ':' + chr(39) + ' || turn_id')} / 4294967295.0e0 < 0.3 THEN 'val' ELSE 'train' END"
_chat = "[{'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': response}]"
P.add(
    "s9_framework_layout_sink",
    layout,
    *VIEWS,
    sql=f"""WITH {D_PAIRS}, j AS (SELECT p.*, et.question FROM pairs p JOIN et USING (turn_id)),
        r AS (SELECT 'trl' AS framework, 'sft' AS task, {_salted('sft')} AS split, CAST(to_json({{'messages': {_chat}, 'prompt': prompt, 'completion': response}}) AS VARCHAR) AS row FROM sft
            UNION ALL SELECT 'axolotl', 'sft', {_salted('sft')}, CAST(to_json({{'instruction': prompt, 'input': '', 'output': response}}) AS VARCHAR) FROM sft
            UNION ALL SELECT 'unsloth', 'sft', {_salted('sft')}, CAST(to_json({{'messages': {_chat}}}) AS VARCHAR) FROM sft
            UNION ALL SELECT f.framework, 'preference', {_salted('pref')}, CAST(to_json({{'prompt': question, 'chosen': chosen, 'rejected': rejected}}) AS VARCHAR) FROM j CROSS JOIN (SELECT unnest(['trl', 'axolotl', 'unsloth']) AS framework) f)
        SELECT framework, task, split, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(row), 1, 8) AS BIGINT)) AS BIGINT) AS digest, count(*) AS listed FROM r GROUP BY ALL""",
)
P.add("s10_seed_chunk_export", _trip("chunks", lambda c, p: c.select("id", "text").write.json(p), lambda s, p: S.manifest(S.read_jsonl(s, p, "id string, text string"))), "corpus_v", sql="SELECT count(*) AS chunks, '1' AS schema_version FROM corpus_v")


def _stream(df, folder):
    """A table as a stream of files."""
    df.write.parquet(f"{folder}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in")


def stream_turns(c):
    folder = scratch(c.sparkSession, "stream")
    return T.run_to_files(T.stream_turn_pairing(_stream(c, folder)), folder)


def stream_sessions(t):
    folder = scratch(t.sparkSession, "stream")
    stream = T.stream_session_memory(_stream(session_turns(t), folder), **MEMORY)
    spark, out = t.sparkSession, f"{folder}/out"
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return X.latest(spark.read.parquet(out), "conv_id", "batch").drop("batch")


def stream_feedback(f):
    folder = scratch(f.sparkSession, "stream")
    U.keep(_stream(f, folder), folder, U.FEEDBACK).awaitTermination()
    return U.table(f.sparkSession, folder, U.FEEDBACK)


from .sessions import ORACLE as _BATCH  # noqa: E402

P.add("t1_stream_turn_pairing", stream_turns, "conversations", sql=_BATCH["j1_turn_pairing"])
P.add("t2_stream_session_state", stream_sessions, "session_turns_v", sql=None)
ORACLE["t2_stream_session_state"] = _BATCH["j6_session_state"]
ORACLE["t1_stream_turn_pairing"] = _BATCH["j1_turn_pairing"]
P.add("t3_stream_feedback_upsert", stream_feedback, "feedback_v", sql=D_FEEDBACK)
