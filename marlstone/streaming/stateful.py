"""Keyed state over message streams; each form agrees with its batch twin. ``upserts`` has the keyed tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TurnPairing(StatefulProcessor):
    """Pairs each assistant message with the latest user message of its conversation; rows of a batch are put in order of turn, batches come in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.user = handle.getValueState("user", "turn long, text string")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("turn")
        last = self.user.get() if self.user.exists() else None
        out = []
        for turn, role, text in zip(pdf.turn, pdf.role, pdf.text):
            if role == "user":
                last = (int(turn), text)
            elif role == "assistant":
                out.append((key[0], int(turn), f"{key[0]}:{turn}", last[0] if last else None, last[1] if last else "", text))
        if last is not None:
            self.user.update((int(last[0]), last[1]))
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "turn_id", "user_turn", "question", "answer"])
        frame["user_turn"] = frame["user_turn"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


class SessionMemory(StatefulProcessor):
    """The fold of ``session_memory`` over a stream of turns, in three keyed parts: what the last answered turn found, what was said last, and the
    turns of context left. With ``ttl_ms`` each part expires so long after its last change."""

    FOUND = ("active_domain", "active_doc", "last_entity", "last_named_unit", "last_question_type", "last_retrieved_ids", "last_topic")

    def __init__(self, marks: tuple[str, ...], domains: tuple[str, ...], ttl_ms: int | None = None) -> None:
        self.marks, self.domains, self.ttl_ms = marks, domains, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.found = handle.getValueState("found", ", ".join(f"{c} string" for c in self.FOUND), self.ttl_ms)
        self.said = handle.getValueState("said", "query string, answer string, channel string", self.ttl_ms)
        self.left = handle.getValueState("left", "turns int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("turn")
        found = self.found.get() if self.found.exists() else ("", "", "", "", "factoid", "", "")
        query, answer, channel = self.said.get() if self.said.exists() else ("", "", "docs")
        left = self.left.get()[0] if self.left.exists() else 0
        for r in pdf.itertuples():
            if r.answered:
                found = (r.domain, r.doc, r.entity, r.unit, r.qtype, ",".join(list(r.retrieved)[:6]), r.topic)
            answer = r.answer if r.answered or r.answer else answer
            query, channel = r.question, r.channel
            if not r.answered or r.use_history:
                left = max(0, left - 1)
            else:
                left = 2 if any(m in r.question_n for m in self.marks) else 1 if r.domain in self.domains else 0
        self.found.update(tuple(found))
        self.said.update((query, answer, channel))
        self.left.update((int(left),))
        yield pd.DataFrame([(key[0], *found, query, answer, channel, left)], columns=["conv_id", *self.FOUND, "last_user_query", "last_assistant_answer", "last_channel", "context_turns"])

    def close(self) -> None:
        pass


def stream_session_memory(turns: DataFrame, marks: tuple[str, ...], domains: tuple[str, ...], ttl_ms: int | None = None) -> DataFrame:
    """Session memory after each batch. Expiry needs processing time, which keeps a query running: leave it out for ``availableNow``."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = ", ".join(["conv_id long", *(f"{c} string" for c in SessionMemory.FOUND), "last_user_query string, last_assistant_answer string, last_channel string, context_turns int"])
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=SessionMemory(marks, domains, ttl_ms), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


def stream_turn_pairing(messages: DataFrame) -> DataFrame:
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "conv_id long, turn long, turn_id string, user_turn long, question string, answer string"
    return messages.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=TurnPairing(), outputStructType=schema, outputMode="Append", timeMode="None")


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All rows that the stream has now, written as Parquet and read back."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
