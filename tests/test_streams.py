"""Published versions, keyed tables of a change stream and session memory: by hand, across restarts, and against the batch form."""

import json
import random

import pytest

from marlstone.operators import sessions
from marlstone.sources import published as R
from marlstone.streaming import upserts as U

CHANGES = "turn_id string, student_id string, question string, answer string, seq int, rating int, answer_suggestion string, updated_at string"


def changes(spark, rows):
    return spark.createDataFrame([(t, "s", "q", "a", n, r, f" {n} ", f"2026-01-{n:02d}") for t, n, r in rows], CHANGES)


def state(df):
    return sorted((r.turn_id, r.rating, r.answer_suggestion, r.created_at, r.updated_at) for r in df.collect())


def test_batches_fold_to_the_table_of_all_changes(spark, tmp_path):
    rnd, folder, log, written = random.Random(4), str(tmp_path), [], []
    for number in range(12):
        rows = [(f"t{rnd.randint(0, 400)}", len(log) + k, rnd.randint(0, 9)) for k in range(300 if number == 0 else 6)]
        log += rows
        written.append(U.apply(folder, U.FEEDBACK, changes(spark, rows), number))
    assert state(U.table(spark, folder, U.FEEDBACK)) == state(sessions.feedback_current(changes(spark, log)))
    sizes = [s["rows"] for s in U.version(spark, folder)["segments"]]
    assert all(a > U.RATIO * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 4
    # small batches rewrite little: the large segment was not touched by most of them
    assert sorted(written[1:])[len(written) // 2] < 60


def test_a_batch_counts_once_and_a_killed_one_not_at_all(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    assert U.table(spark, folder, U.FEEDBACK).count() == 0
    U.apply(folder, U.FEEDBACK, changes(spark, [("a", 1, 5), ("b", 1, 0)]), 0)
    before = state(U.table(spark, folder, U.FEEDBACK))
    assert before == [("a", 5, "1", "2026-01-01", "2026-01-01"), ("b", 3, "1", "2026-01-01", "2026-01-01")]
    more = changes(spark, [("a", 2, 9), ("c", 1, 1)])
    with monkeypatch.context() as m:
        m.setattr(R, "replace_text", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            U.apply(folder, U.FEEDBACK, more, 1)
    assert state(U.table(spark, folder, U.FEEDBACK)) == before  # the old version is whole
    assert U.apply(folder, U.FEEDBACK, more, 1) > 0 and U.apply(folder, U.FEEDBACK, more, 1) == 0  # told again after a restart
    assert state(U.table(spark, folder, U.FEEDBACK)) == [("a", 5, "2", "2026-01-01", "2026-01-02"), ("b", 3, "1", "2026-01-01", "2026-01-01"), ("c", 1, "1", "2026-01-01", "2026-01-01")]
    assert U.apply(folder, U.FEEDBACK, changes(spark, []), 2) == 0 and U.version(spark, folder)["batch"] == 2


def test_stream_restarts_where_it_ended(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    first, second = [("a", 1, 5), ("b", 3, 2)], [("b", 2, 4), ("a", 4, 1)]
    for rows in (first, second):
        changes(spark, rows).write.mode("append").parquet(source)
        U.keep(spark.readStream.schema(CHANGES).parquet(source), folder, U.FEEDBACK).awaitTermination()
    assert state(U.table(spark, folder, U.FEEDBACK)) == state(sessions.feedback_current(changes(spark, first + second)))


def test_published_layout(spark, tmp_path):
    path, schema = str(tmp_path), "id long, k string, s string"
    assert R.read_layout(spark, path, schema).count() == 0 and R.read_manifest(spark, path, "k").count() == 0
    rows = spark.createDataFrame([(1, "x", "train"), (2, "x", "val"), (3, "y", "train"), (4, "x", "train")], schema)
    one = R.publish_layout(rows, path, "k", "s")
    assert {(r.k, r.s, r.rows) for r in R.read_manifest(spark, path, "k", "s").collect()} == {("x", "train", 2), ("x", "val", 1), ("y", "train", 1)}
    with pytest.raises(ZeroDivisionError):
        R.publish(spark, path, lambda folder: rows.limit(1).write.json(folder) or 1 / 0)
    assert R.current(spark, path) == one and sorted(r.id for r in R.read_layout(spark, path, schema).collect()) == [1, 2, 3, 4]
    two = R.publish_layout(rows.where("id > 2"), path, "k", "s")
    assert R.vacuum(spark, path) == 2 and R.current(spark, path) == two
    assert sorted(r.id for r in R.read_layout(spark, path, schema).collect()) == [3, 4]


TURNS = "conv_id long, turn long, answered boolean, domain string, doc string, entity string, unit string, qtype string, retrieved array<string>, topic string, channel string, use_history boolean, question string, question_n string, answer string"


def turn(conv, n, answered=True, domain="d", question="q", answer="a", history=False, channel="docs", ids=()):
    return (conv, n, answered, domain, f"doc{n}", f"e{n}", f"u{n}", "howto", list(ids), f"t{n}", channel, history, question, question.lower(), answer)


def test_session_memory_by_hand(spark):
    rows = [
        # a unit asked for: two turns of context, of which the next turns take one each
        turn(1, 1, question="Khoa X", ids=[f"i{k}" for k in range(9)]), turn(1, 2, answered=False, question="hm", answer="", channel="web"),
        turn(2, 1, question="Khoa X"), turn(2, 2, history=True, question="and?"), turn(2, 3, answered=False, answer="control"),
        turn(3, 1, domain="portal_howto"),
        turn(4, 1, question="Khoa X"), turn(4, 2, question="other", answer=""),
        turn(5, 1, answered=False, question="hi", answer=""),
    ]
    got = {r.conv_id: r for r in sessions.session_memory(spark.createDataFrame(rows, TURNS)).collect()}
    assert [got[c].context_turns for c in range(1, 6)] == [1, 0, 1, 0, 0]
    assert (got[1].active_doc, got[1].last_entity, got[1].last_user_query, got[1].last_assistant_answer, got[1].last_channel) == ("doc1", "e1", "hm", "a", "web")
    assert got[1].last_retrieved_ids == "i0,i1,i2,i3,i4,i5" and got[1].last_topic == "t1" and got[1].last_question_type == "howto"
    assert (got[2].active_doc, got[2].last_assistant_answer) == ("doc2", "control")
    assert got[4].last_assistant_answer == "" and got[4].last_entity == "e2"
    assert (got[5].active_domain, got[5].last_question_type, got[5].last_user_query) == ("", "factoid", "hi")


def test_stream_of_several_batches_is_the_batch_form(spark, tmp_path):
    from marlstone.streaming import stateful

    rnd, source, out = random.Random(8), str(tmp_path / "in"), str(tmp_path / "rows")
    how = {"marks": ("khoa ",), "domains": ("d1",)}
    rows = [turn(c, n, rnd.random() < 0.7, rnd.choice(["d1", "d2"]), rnd.choice(["khoa a", "b", "c"]), rnd.choice(["", "x", "y"]), rnd.random() < 0.3, ids=["i", "j"]) for n in range(9) for c in range(7)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == k], TURNS).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.stream_session_memory(spark.readStream.schema(TURNS).parquet(source), **how)
        stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.selectExpr("*", f"{n} as batch").write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    last = {r.conv_id: r for r in spark.read.parquet(out).orderBy("batch").collect()}
    want = {r.conv_id: r for r in sessions.session_memory(spark.createDataFrame(rows, TURNS), **how).collect()}
    assert {c: {k: v for k, v in r.asDict().items() if k != "batch"} for c, r in last.items()} == {c: r.asDict() for c, r in want.items()}
    assert json.dumps(sorted(last)) == json.dumps(list(range(7)))
