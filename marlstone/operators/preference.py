"""Preference, SFT and PPO rows from turns, reviews, feedback and contributions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..sources.tables import release, spread, stored

if TYPE_CHECKING:
    from pyspark.ml import PipelineModel

#: Score of a candidate answer by where it comes from, and the verdicts and ratings that decide it.
SCORES = {
    "original": 0.4,
    "review_approved": 0.98,
    "review_approved_other": 0.96,
    "review_rejected": 0.1,
    "suggestion_low": 0.88,
    "suggestion": 0.7,
    "feedback_high": 0.85,
    "feedback_low": 0.15,
    "contribution": 0.88,
}
APPROVING = ("correct", "missing", "partial")
REJECTING = ("incorrect", "excessive", "missing", "partial")
HIGH, LOW = 4, 2
#: Words without weight, marks of a direct question, and texts that answer none.
STOPWORDS = (
    "ban", "toi", "minh", "cho", "hoi", "ve", "la", "gi", "nao", "o", "dau", "co", "cua", "trong", "va", "hoac", "thi", "nhu", "the", "can", "hay", "duoc", "khong", "mot",
    "cac", "nhung", "nay", "do", "day", "truong",
)
DIRECT = (" la gi", " o dau", " day mon gi", " dao tao gi", " ai")
EVASIVE = ("lich su hinh thanh", "ngay nay da co lich su", "song song voi viec giang day", "khong tim thay du thong tin")
NOTHING = "khong tim thay"


def eligible_turns(turns: DataFrame) -> DataFrame:
    """Turns with a question and an answer."""
    return turns.where((F.trim("question") != "") & (F.trim("answer") != ""))


def turn_reviews(turns: DataFrame, reviews: DataFrame, variants: DataFrame) -> DataFrame:
    """(turn_id, review_turn, seq) of answer reviews of the same turn or with a variant that is the turn's question: two equi-joins, not one OR-join."""
    answers = reviews.where("coalesce(nullif(review_kind, ''), 'answer') = 'answer'").select(F.col("turn_id").alias("review_turn"), "seq")
    same = turns.select("turn_id").join(answers, F.col("turn_id") == F.col("review_turn"))
    named = variants.select(F.col("turn_id").alias("review_turn"), F.trim("variant").alias("key")).where("key <> ''").distinct()
    asked = turns.select("turn_id", T.ws("question").alias("key")).join(named, "key").select("turn_id", "review_turn")
    by_text = asked.join(answers, "review_turn").select("turn_id", "review_turn", "seq")
    return same.select("turn_id", "review_turn", "seq").unionByName(by_text).distinct()


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def turn_feedback(turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each turn with its newest feedback's rating and suggestion (null without)."""
    last = latest(feedback, "turn_id", "updated_at", "seq").select("turn_id", "rating", "answer_suggestion")
    return turns.select("turn_id").join(last, "turn_id", "left")


def turn_contributions(turns: DataFrame, contributions: DataFrame) -> DataFrame:
    """(turn_id, contribution_id, user_contribution) of approved contributions to the same question."""
    ok = contributions.where("status = 'approved'").select(T.ws("original_question").alias("key"), "contribution_id", "user_contribution")
    return turns.select("turn_id", T.ws("question").alias("key")).where("key <> ''").join(ok, "key").drop("key")


def answer_candidates(turns: DataFrame, reviews: DataFrame, variants: DataFrame, feedback: DataFrame, contributions: DataFrame, scores: dict[str, float] = SCORES) -> DataFrame:
    """(turn_id, text, label, score, source, pos): answers of a turn with what its reviews, feedback and contributions say of them.

    Reviews are those of ``turn_reviews``. A turn without a rating counts as rated 0, so its own answer is rejected with the score of low ratings. ``pos`` is the order of arrival.
    """
    turns = eligible_turns(turns)

    def part(rows: DataFrame, text: str, label: str, score, source: str, kind: int, seq="", when: Column | None = None) -> DataFrame:
        rows = rows if when is None else rows.where(when)
        pos = F.concat(F.lit(f"{kind}:"), seq if isinstance(seq, Column) else F.lit(seq))
        return rows.select("turn_id", T.ws(text).alias("text"), F.lit(label).alias("label"), (score if isinstance(score, Column) else F.lit(score)).alias("score"), F.lit(source).alias("source"), pos.alias("pos"))

    rev = turn_reviews(turns, reviews, variants).join(reviews.withColumnRenamed("turn_id", "review_turn"), ["review_turn", "seq"])
    newest = F.concat(F.lpad((F.lit(10**6) - F.col("seq")).cast("string"), 7, "0"), F.lit(":"), F.col("review_turn"))
    verdict = F.coalesce(F.trim("verdict"), F.lit(""))
    approved = F.when(verdict.isin(*APPROVING), scores["review_approved"]).otherwise(scores["review_approved_other"])
    fb = turns.select("turn_id", "answer").join(latest(feedback, "turn_id", "updated_at", "seq").select("turn_id", "rating", "answer_suggestion"), "turn_id", "left").withColumn("rating", F.coalesce("rating", F.lit(0)))
    told = F.when(F.col("rating") <= LOW, scores["suggestion_low"]).otherwise(scores["suggestion"])
    parts = [
        part(turns, "answer", "original", scores["original"], "history", 0),
        part(rev, "approved_answer", "preferred", approved, "review", 1, newest),
        part(rev, "assistant_answer", "rejected", scores["review_rejected"], "review", 1, newest, verdict.isin(*REJECTING)),
        part(fb, "answer_suggestion", "preferred", told, "feedback", 2),
        part(fb, "answer", "preferred", scores["feedback_high"], "feedback", 3, when=F.col("rating") >= HIGH),
        part(fb, "answer", "rejected", scores["feedback_low"], "feedback", 4, when=F.col("rating") <= LOW),
        part(turn_contributions(turns, contributions), "user_contribution", "preferred", scores["contribution"], "contribution", 5, F.col("contribution_id")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where("text <> ''")


def _strength() -> Column:
    """A rejected text stays rejected though the original says less."""
    return F.when(F.col("label") == "preferred", 3).when(F.col("label") == "rejected", 2).otherwise(1)


def candidate_dedupe(candidates: DataFrame) -> DataFrame:
    """Of each text of a turn the candidate with the strongest label and best score, the earlier one of equals; ``rank`` orders a turn's texts alike."""
    one = Window.partitionBy("turn_id", "text").orderBy(F.desc(_strength()), F.desc("score"), "pos")
    kept = candidates.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    first = candidates.groupBy("turn_id", "text").agg(F.min("pos").alias("first"))
    order = Window.partitionBy("turn_id").orderBy(F.desc(_strength()), F.desc("score"), "first", "text")
    return kept.join(first, ["turn_id", "text"]).withColumn("rank", F.row_number().over(order))


def _best(label: str) -> Column:
    return F.min_by(F.when(F.col("label") == label, F.struct("score", "text", "source")), F.when(F.col("label") == label, F.col("rank")))


def preference_pairs(candidates: DataFrame) -> DataFrame:
    """(turn_id, chosen, rejected, sources and scores): the first preferred and the first rejected text of each turn that has both."""
    both = candidates.groupBy("turn_id").agg(_best("preferred").alias("c"), _best("rejected").alias("r")).where("c is not null and r is not null")
    return both.select("turn_id", F.col("c.text").alias("chosen"), F.col("c.source").alias("chosen_source"), F.col("c.score").alias("chosen_score"), F.col("r.text").alias("rejected"), F.col("r.source").alias("rejected_source"))


def sft_rows(turns: DataFrame, candidates: DataFrame) -> DataFrame:
    """(turn_id, prompt, response, source): the first preferred text."""
    best = candidates.groupBy("turn_id").agg(_best("preferred").alias("c")).where("c is not null")
    return turns.select("turn_id", F.col("question").alias("prompt")).join(best, "turn_id").select("turn_id", "prompt", F.col("c.text").alias("response"), F.col("c.source").alias("source"))


def turn_meta(turns: DataFrame, reviews: DataFrame, variants: DataFrame, feedback: DataFrame, contributions: DataFrame, candidates: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(turn_id, domain, route, rating, has_feedback, verdicts, kinds, has_review, reviews, contributions, sources), of the reviews of ``turn_reviews``.

    facts: turn_id, domain, route; blank without them. A turn without a rating has 0.
    """
    reviews = turn_reviews(turns, reviews, variants).join(reviews.withColumnRenamed("turn_id", "review_turn"), ["review_turn", "seq"])
    reviews = reviews.withColumns({c: F.when(F.trim(c) != "", F.trim(c)) for c in ("verdict", "review_kind")})
    r = reviews.groupBy("turn_id").agg(F.sort_array(F.collect_set("verdict")).alias("verdicts"), F.sort_array(F.collect_set("review_kind")).alias("kinds"), F.count("*").alias("reviews"))
    s = candidates.groupBy("turn_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    f = latest(feedback, "turn_id", "updated_at", "seq").select("turn_id", "rating", F.lit(True).alias("has_feedback"))
    c = turn_contributions(turns, contributions).groupBy("turn_id").agg(F.count("*").alias("contributions"))
    own = eligible_turns(turns).select("turn_id")
    about = own.withColumns({"domain": F.lit(""), "route": F.lit("")}) if facts is None else own.join(facts.select("turn_id", "domain", "route"), "turn_id", "left")
    out = about.join(r, "turn_id", "left").join(s, "turn_id", "left").join(f, "turn_id", "left").join(c, "turn_id", "left")
    none, zero, no = F.array().cast("array<string>"), F.lit(0), F.lit(False)
    return out.select(
        "turn_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("domain", "route")], F.coalesce("rating", zero).alias("rating"), F.coalesce("has_feedback", no).alias("has_feedback"),
        *[F.coalesce(x, none).alias(x) for x in ("verdicts", "kinds")], F.col("reviews").isNotNull().alias("has_review"), F.coalesce("reviews", zero).alias("reviews"),
        F.coalesce("contributions", zero).alias("contributions"), F.coalesce("sources", none).alias("sources"),
    )


def summary(**tables: DataFrame) -> DataFrame:
    """(name, rows) of tables."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def preference_filter(pairs: DataFrame, meta: DataFrame, verdicts: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Pairs by verdict overlap and rating; with a bound given, rows without a rating fail."""
    rows = pairs.join(meta.select("turn_id", "verdicts", "rating"), "turn_id")
    if verdicts:
        rows = rows.where(F.arrays_overlap("verdicts", F.array(*[F.lit(v) for v in verdicts])))
    if low is not None or high is not None:
        rows = rows.where("rating > 0")
    if low is not None:
        rows = rows.where(F.col("rating") >= low)
    if high is not None:
        rows = rows.where(F.col("rating") <= high)
    return rows


def salted_split(key: Column, salt: str, val: float) -> Column:
    """``val`` for a share of the keys, fixed by the hash of salt and key; nothing at 0 or less, all at 1 or more."""
    if val <= 0 or val >= 1:
        return F.lit("train" if val <= 0 else "val")
    share = T.hash_bucket(F.concat(F.lit(f"{salt}:"), key)) / F.lit(4294967295.0)
    return F.when(share < val, "val").otherwise("train")


def formats(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(turn_id, framework, row): each pair as chat messages, as an instruction and as prompt / chosen / rejected, in JSON text."""
    rows = pairs.join(questions.select("turn_id", "question"), "turn_id")

    def chat(role: str, x: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(x).alias("content"))

    kinds = {
        "messages": F.struct(F.array(chat("user", "question"), chat("assistant", "chosen")).alias("messages")),
        "instruction": F.struct(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("chosen").alias("output")),
        "dpo": F.struct(F.col("question").alias("prompt"), "chosen", "rejected"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), F.to_json(v).alias("row")) for k, v in kinds.items()]))
    return rows.select("turn_id", each.alias("f")).select("turn_id", "f.framework", "f.row")


def framework_rows(pairs: DataFrame, sft: DataFrame, questions: DataFrame, frameworks: tuple[str, ...] = ("trl", "axolotl", "unsloth")) -> DataFrame:
    """(turn_id, framework, task, row): what each framework trains on, in JSON text: ``sft`` as messages or instructions, ``preference`` as prompt / chosen / rejected."""
    chat = lambda role, x: F.struct(F.lit(role).alias("role"), F.col(x).alias("content"))
    messages = F.array(chat("user", "prompt"), chat("assistant", "response")).alias("messages")
    one = {
        "trl": F.struct(messages, "prompt", F.col("response").alias("completion")),
        "axolotl": F.struct(F.col("prompt").alias("instruction"), F.lit("").alias("input"), F.col("response").alias("output")),
        "unsloth": F.struct(messages),
    }
    wrong = set(frameworks) - set(one)
    if wrong:
        raise ValueError(f"unknown frameworks {sorted(wrong)}")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), F.to_json(one[k]).alias("row")) for k in frameworks]))
    told = sft.select("turn_id", F.lit("sft").alias("task"), each.alias("f"))
    pair = F.to_json(F.struct(F.col("question").alias("prompt"), "chosen", "rejected"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), pair.alias("row")) for k in frameworks]))
    compared = pairs.join(questions.select("turn_id", "question"), "turn_id").select("turn_id", F.lit("preference").alias("task"), each.alias("f"))
    return told.unionByName(compared).select("turn_id", "f.framework", "task", "f.row")


def reward_examples(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Distinct (question, answer, label): 1 for chosen, 0 for rejected."""
    rows = pairs.join(questions.select("turn_id", "question"), "turn_id")
    each = F.explode(F.array(F.struct(F.col("chosen").alias("answer"), F.lit(1).alias("label")), F.struct(F.col("rejected").alias("answer"), F.lit(0).alias("label"))))
    return rows.select("question", each.alias("e")).select("question", "e.answer", "e.label").distinct()


def reward(question: Column, answer: Column, length: Column, stopwords: tuple[str, ...] = STOPWORDS, direct: tuple[str, ...] = DIRECT, evasive: tuple[str, ...] = EVASIVE, nothing: str = NOTHING) -> Column:
    """.45 + .24 of the question's tokens that the answer holds + .18 for brevity + focus times 1.4 (.18 at most), less penalties, between 0 and 1.

    ``question`` and ``answer`` are columns of the normalised texts without accents, ``length`` the answer's characters. Brevity is 1 up to 220 characters, .82 up to 600, .62 up to 1200, then .42;
    focus is the share of the answer's tokens that the question has. A direct question with an evasive answer loses .28, an answer that found nothing and covers under a quarter .18, one of
    two distinct tokens or fewer .15. An empty answer has 0.
    """
    stop = F.array(*[F.lit(w) for w in stopwords])
    q, a = (F.filter(F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)) for x in (question, answer))
    q = F.array_distinct(q)
    cover = F.when(F.size(q) > 0, F.size(F.filter(q, lambda t: answer.contains(t))) / F.size(q)).otherwise(0.0)
    focus = F.when((F.size(q) > 0) & (F.size(a) > 0), F.size(F.filter(a, lambda t: F.array_contains(q, t))) / F.size(a)).otherwise(0.0)
    brief = F.when(length <= 220, 1.0).when(length <= 600, 0.82).when(length <= 1200, 0.62).otherwise(0.42)
    raw = 0.45 + 0.24 * cover + 0.18 * brief + F.least(F.lit(0.18), focus * 1.4)
    raw = raw - F.when(T.any_hint(question, list(direct)) & T.any_hint(answer, list(evasive)), 0.28).otherwise(0.0)
    raw = raw - F.when(answer.contains(nothing) & (cover < 0.25), 0.18).otherwise(0.0) - F.when(F.size(F.array_distinct(a)) <= 2, 0.15).otherwise(0.0)
    return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


#: Characters of a gram; rows of counts a task holds; characters that are hashed at once.
GRAMS = (3, 4, 5)
HELD = 4_000_000
WINDOW = 1 << 20
#: What "." leaves out in Java.
LINE_ENDS = "\n\r\u0085\u2028\u2029"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(texts: list[str], window: int | None = None):
    """(places in ``texts``, 64 bits of hash) of all grams, those that begin in one window of characters at a time."""
    window = window or WINDOW
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for at in range(0, len(codes), window):
        own = owner[at : at + window + max(GRAMS) - 1]
        x = _mixed(codes[at : at + len(own)].astype(np.uint64))
        h, places, hashes = x, [], []
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + x[n - 1 :]
            if n in GRAMS:
                whole = np.flatnonzero(own[: len(h)][:window] == own[n - 1 :][:window])
                places.append(own[whole])
                hashes.append(h[whole])
        yield np.concatenate(places), np.concatenate(hashes)


def _text_groups(texts: pa.Array):
    """The texts in order, so many at once that they fill a window; one at least."""
    out, n = [], 0
    for t in texts:
        t = t.as_py()
        if out and n + len(t) > WINDOW:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _gram_texts(rows: DataFrame, text_col: str) -> Column:
    return F.translate(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), LINE_ENDS, "")


def gram_vocabulary(rows: DataFrame, text_col: str, features: int) -> np.ndarray:
    """Hashes of the grams that occur most often in all texts (of equals, those of smaller hash), ascending. Tasks add up their counts before they send them."""

    def work(batches):
        keys, counts, waiting, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for texts in _text_groups(batch.column(0)):
                for _, h in gram_hashes(texts):
                    waiting.append(np.unique(h, return_counts=True))
                    n += len(waiting[-1][0])
                if n > HELD:
                    keys, counts = _summed(np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]]))
                    waiting, n = [], 0
                    if len(keys) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = _summed(np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([counts, *[c for _, c in waiting]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    counted = spread(rows.select(_gram_texts(rows, text_col).alias("text"))).mapInArrow(work, "gram long, n long")
    top = counted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(features).select("gram")
    return np.sort(np.array([r.gram for r in top.collect()], np.int64).view(np.uint64))


def gram_counts(rows: DataFrame, text_col: str, vocabulary: np.ndarray, name: str = "tf") -> DataFrame:
    """The rows with ``name``, the sparse vector of how often each gram of the vocabulary occurs. One pass, no shuffle."""
    from pyspark.ml.linalg import VectorUDT

    size = len(vocabulary)
    kept = [c for c in rows.columns if c != text_col]
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def vectors(texts: list[str]) -> pa.Array:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for own, h in gram_hashes(texts):
            at = np.minimum(np.searchsorted(vocabulary, h), size - 1)
            hit = np.flatnonzero(vocabulary[at] == h)
            found, n = np.unique(own[hit].astype(np.int64) * size + at[hit], return_counts=True)
            codes, counts = (found, n) if not len(codes) else _summed(np.concatenate([codes, found]), np.concatenate([counts, n]))
        ends = pa.array(np.searchsorted(codes, np.arange(len(texts) + 1) * size).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((codes % max(size, 1)).astype(np.int32), counts.astype(np.float64))]
        return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), size, np.int32)), *lists], fields=list(kind))

    def work(batches):
        for batch in batches:
            at = 0
            for texts in _text_groups(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors(texts)], [*kept, name])
                at += len(texts)

    schema = StructType([*[rows.schema[c] for c in kept], StructField(name, VectorUDT())])
    return spread(rows.select(*kept, _gram_texts(rows, text_col).alias("_text"))).mapInArrow(work, schema)


@dataclass(frozen=True)
class RewardModel:
    """Hashes of the grams, and the fitted stages from counts to the probability."""

    vocabulary: np.ndarray
    stages: PipelineModel
    text_col: str

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``probability``, without their text."""
        return self.stages.transform(gram_counts(rows, self.text_col, self.vocabulary))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.text_col, self.vocabulary.view(np.int64).tolist())], "text_col string, grams array<long>").write.parquet(f"{path}/vocabulary")
        self.stages.save(f"{path}/stages")

    @classmethod
    def load(cls, path: str) -> RewardModel:
        from pyspark.ml import PipelineModel

        row = SparkSession.getActiveSession().read.parquet(f"{path}/vocabulary").first()
        return cls(np.array(row.grams, np.int64).view(np.uint64), PipelineModel.load(f"{path}/stages"), row.text_col)


def reward_model(examples: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 12000) -> RewardModel:
    """A fitted model: counts of the most frequent character 3- to 5-grams, TF-IDF of length 1, logistic regression with balanced weights.

    Grams are 64 bits of hash and are counted with numpy in each task; the counts of the examples are written once, and the fitting stages read them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, Normalizer

    n = examples.agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.5
    vocabulary = gram_vocabulary(examples, text_col, features)
    if not len(vocabulary):
        raise ValueError("no example has a text of three characters")
    weight = F.when(F.col(label_col) == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9))
    rows = stored(gram_counts(examples.select(text_col, label_col, weight.alias("weight")), text_col, vocabulary), "reward")
    model = LogisticRegression(labelCol=label_col, weightCol="weight", maxIter=30, regParam=0.01)
    stages = Pipeline(stages=[IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="features"), model]).fit(rows)
    release(rows)
    return RewardModel(vocabulary, stages, text_col)


def self_preference(rows: DataFrame, margin: float = 0.08, floor: float = 0.52, limit: int = 50) -> DataFrame:
    """Rows (turn_id, generated, baseline, rewards, evidence) as pairs: the better text is chosen if it leads by the margin, reaches the floor and has evidence."""
    up = F.col("generated_reward") - F.col("baseline_reward")
    win = F.when((up >= margin) & (F.col("generated_reward") >= floor) & F.col("evidence"), "generated").when((-up >= margin) & (F.col("baseline_reward") >= floor), "baseline")
    out = rows.withColumn("winner", win).where("winner is not null").withColumn("gap", F.abs(up))
    return out.orderBy(F.desc(F.round("gap", 9)), "turn_id").limit(limit)


def ppo_prompts(pairs: DataFrame, sft: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, prompt, reference, rejected, source): of preference and SFT rows, one for each prompt and reference, preferences first."""
    a = pairs.join(questions.select("turn_id", F.col("question").alias("prompt")), "turn_id").select("turn_id", "prompt", F.col("chosen").alias("reference"), "rejected", F.lit("preference").alias("source"), F.lit(0).alias("_k"))
    b = sft.select("turn_id", "prompt", F.col("response").alias("reference"), F.lit("").alias("rejected"), F.lit("sft").alias("source"), F.lit(1).alias("_k"))
    w = Window.partitionBy("prompt", "reference").orderBy("_k", "turn_id")
    one = a.unionByName(b).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return one.select(T.stable_id("ppo", F.col("prompt"), F.col("reference")).alias("id"), "prompt", "reference", "rejected", "source")
