"""Keyed tables kept by a stream of changes: every batch adds a small segment, readers find a whole version, segments merge in tiers.

A segment holds one partial state for each key. States merge in any order and grouping, so a version is a list of segments in a manifest, which is swapped by
one rename. The newest two merge while the older is no more than RATIO times as large: sizes fall by that factor at least, so a row is rewritten a
logarithmic number of times and the work of a batch follows the batch. A batch that was applied before a restart is known by its number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import published as R

RATIO = 4
MANIFEST = "MANIFEST.json"


@dataclass(frozen=True)
class Fold:
    """schema: columns of a partial state, ``keys`` first; start: rows to partial states; merge: several of a key to one; finish: states to the table's rows."""

    keys: tuple[str, ...]
    schema: str
    start: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def version(spark: SparkSession, folder: str) -> dict:
    """{batch, segments: [{path, rows}], old: [path]} of the published version."""
    return json.loads(R.read_text(spark, f"{folder}/{MANIFEST}") or '{"batch": -1, "segments": [], "old": []}')


def _read(spark: SparkSession, folder: str, fold: Fold, segments: list[dict]) -> DataFrame:
    return spark.read.schema(fold.schema).parquet(*[f"{folder}/{s['path']}" for s in segments]) if segments else spark.createDataFrame([], fold.schema)


def _write(states: DataFrame, folder: str, fold: Fold) -> dict:
    spark, path = states.sparkSession, f"segment-{uuid.uuid4().hex}"
    states.write.parquet(f"{folder}/{path}")
    return {"path": path, "rows": spark.read.schema(fold.schema).parquet(f"{folder}/{path}").count()}


def apply(folder: str, fold: Fold, batch: DataFrame, number: int, ratio: int = RATIO) -> int:
    """Add a batch of changes and publish the new version; how many states were written. A number that is not above the published one changes nothing."""
    spark = batch.sparkSession
    now = version(spark, folder)
    if number <= now["batch"]:
        return 0
    segments, gone = now["segments"], []
    new = _write(fold.merge(fold.start(batch)), folder, fold)
    written = new["rows"]
    segments = [*segments, new] if new["rows"] else segments
    if not new["rows"]:
        gone.append(new["path"])
    while len(segments) > 1 and segments[-2]["rows"] <= ratio * segments[-1]["rows"]:
        pair = segments[-2:]
        one = _write(fold.merge(_read(spark, folder, fold, pair)), folder, fold)
        written += one["rows"]
        gone += [s["path"] for s in pair]
        segments = [*segments[:-2], one]
    R.replace_text(spark, f"{folder}/{MANIFEST}", json.dumps({"batch": number, "segments": segments, "old": gone}))
    for path in now["old"]:  # named by no version since the one before this
        place, fs = R._file_system(spark, f"{folder}/{path}")
        fs.delete(place, True)
    return written


def table(spark: SparkSession, folder: str, fold: Fold) -> DataFrame:
    """The published version's rows. A reader that began earlier keeps its segments for one more batch."""
    return fold.finish(fold.merge(_read(spark, folder, fold, version(spark, folder)["segments"])))


def keep(changes: DataFrame, folder: str, fold: Fold) -> StreamingQuery:
    """Run the stream of changes into the keyed table until it has no more rows."""
    return changes.writeStream.foreachBatch(lambda batch, number: apply(folder, fold, batch, number) and None).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()


def _last(states: DataFrame) -> DataFrame:
    return states.groupBy("turn_id").agg(F.max("last").alias("last"), F.min("created_at").alias("created_at"))


_LAST = "struct<seq:int,updated_at:string,student_id:string,question:string,answer:string,rating:int,answer_suggestion:string>"


def _finish(states: DataFrame) -> DataFrame:
    rating = F.when(F.coalesce("last.rating", F.lit(0)) == 0, 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), "last.rating")))
    return states.select("turn_id", "last.student_id", rating.alias("rating"), F.trim("last.answer_suggestion").alias("answer_suggestion"), "created_at", "last.updated_at")


#: Current feedback of each turn: the change with the greatest seq (of equal ones the latest) counts, the first one dates it.
FEEDBACK = Fold(
    ("turn_id",),
    f"turn_id string, last {_LAST}, created_at string",
    lambda rows: rows.select("turn_id", F.struct(F.col("seq").cast("int").alias("seq"), "updated_at", "student_id", "question", "answer", F.col("rating").cast("int").alias("rating"), "answer_suggestion").alias("last"), F.col("updated_at").alias("created_at")),
    _last,
    _finish,
)
