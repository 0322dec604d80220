"""Many substrings at once: rows are scanned with an automaton of a group of queries, and each task keeps the best rows of each query.

Rules that ask whether words are inside a text, not among its words, can't be joined on equality, and one ``contains`` for each word and row costs
queries x rows x words. Here a group of queries becomes one Aho-Corasick automaton; a row is read once whatever the number of queries, what it holds is
counted for all of them together, and only the k best of each query leave the task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread

#: Queries of a group, on the driver and in every task; rows whose scores are merged at once.
QUERIES, ROWS = 2048, 256
DIGITS = 9


class Patterns:
    """Strings to find inside texts; empty ones are left out."""

    def __init__(self, patterns: set[str]):
        import ahocorasick

        self.names = sorted(p for p in patterns if p)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            self.automaton.add_word(p, i)
        if self.names:
            self.automaton.make_automaton()

    def inside(self, text: str) -> set[int]:
        """Numbers of the patterns that a text holds."""
        return {i for _, i in self.automaton.iter(text)} if self.names and text else set()


class Counts:
    """For each of some strings the queries that it counts for, as often as it does."""

    def __init__(self, queries: int, pairs: list[tuple[str, int]]):
        self.queries, at = queries, defaultdict(list)
        for s, q in pairs:
            at[s].append(q)
        self.at = {s: np.array(q) for s, q in at.items()}

    def of(self, strings) -> np.ndarray:
        """How often any of the strings counts for each query."""
        found = [self.at[s] for s in strings if s in self.at]
        return np.bincount(np.concatenate(found), minlength=self.queries) if found else np.zeros(self.queries, np.int64)


Scorer = Callable[[dict], np.ndarray]


def best(rows: DataFrame, queries: DataFrame, make: Callable[[list[dict]], Scorer], k: int, id_col: str = "id") -> DataFrame:
    """(query_id, id, score): each query's k best rows; ties (to nine digits) go to the smaller id.

    ``make`` turns a group's queries (as dicts) into a function from a row (a dict) to its score for each of them, -inf where it has none. Only columns
    of plain values are read, the id as text. Queries with a null id, and repeated ones but one of each, take no part.
    """
    own, out = queries.where("query_id is not null").dropDuplicates(["query_id"]), None
    groups = max(1, -(-own.count() // QUERIES))
    rows = spread(rows).withColumn(id_col, F.col(id_col).cast("string")).where(F.col(id_col).isNotNull())
    for g in range(groups):
        part = own if groups == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        asked = part.toArrow().to_pylist()
        if not asked:
            continue
        sent = rows.sparkSession.sparkContext.broadcast(asked)

        def work(batches, sent=sent):
            asked = sent.value
            score = make(asked)
            ids, scores = np.full((len(asked), 0), "", dtype="U1"), np.zeros((len(asked), 0))
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    some = batch.slice(a, ROWS).to_pylist()
                    new = np.stack([score(r) for r in some], axis=1)
                    names = np.broadcast_to(np.array([r[id_col] for r in some]), new.shape)
                    ids, scores = np.concatenate([ids, names], 1), np.concatenate([scores, new], 1)
                    order = np.lexsort((ids, -np.round(scores, DIGITS)), axis=1)[:, :k]
                    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            q, c = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[q, c].tolist(), pa.string()), pa.array(scores[q, c])], ["q", "id", "score"])

        found = rows.mapInArrow(work, "q int, id string, score double")
        order = Window.partitionBy("q").orderBy(F.desc(F.round("score", DIGITS)), "id")
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        names = rows.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(asked)), pa.int32()), "query_id": pa.array([r["query_id"] for r in asked])}))
        met = found.join(F.broadcast(names), "q").select("query_id", "id", "score")
        out = met if out is None else out.unionByName(met)
    return rows.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id string, score double") if out is None else out


def seed_search(seeds: DataFrame, queries: DataFrame, text: Column, base: Column, k: int, domain: str = "domain") -> DataFrame:
    """(query_id, id, score): the k best seeds of each query's domain by ``lexical_seed_score`` over all of them.

    Share of the distinct query words that are words of the text + .25 if the query is in the text + .06 for each query word of four
    characters inside it (again if repeated) + base. seeds: id, ``domain`` and what ``text`` (normalised) and ``base`` read; queries: query_id, query, domain.
    """

    def make(asked: list[dict]) -> Scorer:
        words = [a["query"].split(" ") for a in asked]
        distinct = [list(dict.fromkeys(w for w in x if w)) for x in words]
        n = np.array([max(1, len(x)) for x in distinct])
        equal = Counts(len(asked), [(w, q) for q, x in enumerate(distinct) for w in x])
        long = Counts(len(asked), [(w, q) for q, x in enumerate(words) for w in x if len(w) >= 4])
        whole = Counts(len(asked), [(a["query"], q) for q, a in enumerate(asked) if a["query"]])
        patterns, domains = Patterns({*long.at, *whole.at}), np.array([a["domain"] or "" for a in asked])

        def score(row: dict) -> np.ndarray:
            held = [patterns.names[i] for i in patterns.inside(row["text"])]
            value = equal.of(set(row["text"].split(" "))) / n + 0.25 * whole.of(held) + 0.06 * long.of(held) + row["base"]
            return np.where(domains == (row["domain"] or ""), value, -np.inf)

        return score

    rows = seeds.select("id", F.col(domain).alias("domain"), text.alias("text"), base.cast("double").alias("base"))
    return best(rows, queries.select("query_id", T.norm_ascii("query").alias("query"), "domain"), make, k)


def qa_match(
    queries: DataFrame, qa: DataFrame, adjust: dict[str, tuple[tuple[str, ...], float]] | None = None, steps: tuple[str, ...] = ()
) -> DataFrame:
    """(query_id, qa_id, score): the best QA row of each query, if it scores above 0; ties go to the smaller id.

    3 if both have the query's topic, 1.5 for each keyword of the row inside the query, .25 for each query word of four characters inside question or answer
    (again if repeated), ``adjust``: topic of the row -> (marks of a query, what it adds if one is in the query); for a how-to query .9 of the row's specificity, and .25 for
    the topics of ``steps``. queries: query_id, query, topic, howto; qa: qa_id, question, answer, topic, keywords (array), specificity.
    """
    adjust = adjust or {}

    def make(asked: list[dict]) -> Scorer:
        n = len(asked)
        words = Counts(n, [(w, q) for q, a in enumerate(asked) for w in a["query"].split() if len(w) >= 4])
        patterns = Patterns(set(words.at))
        topic, howto = np.array([a["topic"] or "" for a in asked]), np.array([bool(a["howto"]) for a in asked])
        marked = {t: np.array([any(m in a["query"] for m in marks) for a in asked]) * value for t, (marks, value) in adjust.items()}
        joined, begins = "\n".join(a["query"] for a in asked), np.cumsum([0, *[len(a["query"]) + 1 for a in asked]])
        known: dict[str, np.ndarray] = {}

        def holders(word: str) -> np.ndarray:
            """Which queries hold a keyword: all are searched as one text."""
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                at, found = joined.find(word), []
                while at >= 0 and word:
                    found.append(at)
                    at = joined.find(word, at + 1)
                one = np.zeros(n)
                one[np.searchsorted(begins, np.array(found, np.int64), side="right") - 1] = 1
                known[word] = np.ones(n) if not word else one  # an empty keyword is in every query
            return known[word]

        def score(row: dict) -> np.ndarray:
            value = 0.25 * words.of([patterns.names[i] for i in patterns.inside(row["text"])])
            if row["topic"]:
                value = value + 3.0 * (topic == row["topic"])
                if row["topic"] in marked:
                    value = value + marked[row["topic"]]
            for w in row["keywords"] or ():
                value = value + 1.5 * holders(w)
            value = value + howto * (0.9 * (row["specificity"] or 0.0) + (0.25 if row["topic"] in steps else 0.0))
            return np.where(value > 0, value, -np.inf)

        return score

    rows = qa.select(
        F.col("qa_id").alias("id"), F.concat_ws(" ", T.norm_ascii("question"), T.norm_ascii("answer")).alias("text"), "topic",
        F.transform("keywords", T.norm_ascii).alias("keywords"), F.col("specificity").cast("double").alias("specificity"),
    )
    return best(rows, queries.select("query_id", T.norm_ascii("query").alias("query"), "topic", "howto"), make, 1).withColumnRenamed("id", "qa_id")


class Holders:
    """Which of some short texts hold a string: all are searched as one text. Recent answers are kept."""

    def __init__(self, texts: list[str], limit: int = 100_000):
        self.joined, self.begins = "\n".join(texts), np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.n, self.limit, self.known = len(texts), limit, {}

    def of(self, s: str) -> np.ndarray | None:
        """True for the texts that hold it; None if none does."""
        if s not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            found, at = [], self.joined.find(s) if s else -1
            while at >= 0:
                found.append(at)
                at = self.joined.find(s, at + 1)
            one = None
            if found or not s:
                one = np.full(self.n, not s)
                one[np.searchsorted(self.begins, np.array(found, np.int64), side="right") - 1] = True
            self.known[s] = one
        return self.known[s]

    def any(self, marks) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for m in marks:
            one = self.of(m)
            if one is not None:
                out |= one
        return out


def boosted(rows: DataFrame, queries: DataFrame, names: list, weights: dict[str, float], norms: dict, k: int, prefixes, type_marks: dict, intent_marks: dict, topic_marks: dict, rules) -> DataFrame:
    """(query_id, id, score): each query's k best chunks by fused scores and all boosts of ``search``, made in one reading of a chunk for all queries.

    A chunk that shares no term with a query has no score there. rows: id, body, title, entity (normalised), chunk_type, domain, base (what it gets in
    every query), terms (array, normalised), keywords (array of term, weight), ``given`` (array of query_id, score, or null), and a column of ``inverted.fused_vectors``
    bytes for each name in ``weights``, which says what it counts; ``given`` counts 1. names: the order of the queries in those; queries: query_id, query (normalised), asked (its keyword terms).
    norms: the sum of the greatest of .05 and idf over a query's keyword terms. The boosts are field_boost, entity_boost, type_boost, metadata_boost, contrast_boost and .22 of the keyword score.
    """
    place = {n: i for i, n in enumerate(names)}

    def make(asked: list[dict]) -> Scorer:
        n, texts = len(asked), [a["query"] for a in asked]
        order = np.array([place[a["query_id"]] for a in asked])
        at = {a["query_id"]: i for i, a in enumerate(asked)}
        words = [t.split(" ") for t in texts]
        heads = Counts(n, [(w, q) for q, x in enumerate(words) for w in x[:6]])
        long = Counts(n, [(w, q) for q, x in enumerate(words) for w in x if len(w) >= 5])
        keys = Counts(n, [(w, q) for q, a in enumerate(asked) for w in dict.fromkeys(a["asked"])])
        norm = np.array([norms.get(a["query_id"], 1.0) for a in asked])
        in_head, in_body, holders = Patterns(set(heads.at)), Patterns(set(long.at)), Holders(texts)
        ruled = [(holders.any(r["query_any"]) & ~holders.any(r.get("query_none") or ()), r) for r in rules]
        known: dict[tuple, np.ndarray] = {}

        def first(x: str) -> np.ndarray:
            """Whether one of a query's first six words occurs."""
            return heads.of([in_head.names[i] for i in in_head.inside(x)]) > 0

        def named(entity: str) -> np.ndarray:
            rest = next((entity[len(p) :].strip(" ") for p in prefixes if entity.startswith(p)), entity)
            tokens = [t for t in entity.split(" ") if len(t) >= 3]
            found = sum((holders.any([t]).astype(int) for t in tokens), np.zeros(n, int))
            few = np.where(found == len(tokens), 0.18, np.where(found >= max(2, len(tokens) - 1), 0.12, 0.0)) if tokens else np.zeros(n)
            whole = np.where(holders.any([entity]), 0.30, np.where(holders.any([rest]) if rest else False, 0.20, few))
            return (whole if entity else np.zeros(n)) + 0.10 * first(entity)

        def typed(kind: str, domain: str) -> np.ndarray:
            out = np.where(holders.any(type_marks.get(kind, ())), 0.12, 0.03 if kind in ("overview", "fact") else 0.0) + 0.08 * first(kind)
            for tag, table in ((kind, intent_marks), (domain, topic_marks)):
                if tag in table:
                    out = out + table[tag][0] * holders.any(table[tag][1])
            return out

        def kept(key: tuple, value) -> np.ndarray:
            if key not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[key] = value(*key[1:])
            return known[key]

        def metadata(terms) -> np.ndarray:
            exact, part = np.zeros(n, int), np.zeros(n, int)
            for t in terms:
                if len(t) < 3:
                    continue
                parts = [holders.of(x) for x in t.split(" ") if len(x) >= 3]
                if all(x is None for x in parts):
                    whole = holders.of(t) if " " in t and not parts else None
                    exact += whole if whole is not None else 0
                    continue
                held = np.logical_and.reduce(parts[:4]) if all(x is not None for x in parts[:4]) else np.zeros(n, bool)
                whole = holders.of(t) if " " in t and len(parts) != len(t.split(" ")) else None  # else what holds the phrase holds its parts
                held = held if whole is None else held | whole
                exact += held
                part += np.logical_or.reduce([x for x in parts if x is not None]) & ~held
            return np.minimum(0.18, 0.06 * exact) + np.minimum(0.10, 0.025 * part)

        def score(row: dict) -> np.ndarray:
            value, met = np.zeros(n), np.zeros(n, bool)
            for c, w in weights.items():
                if row[c] is not None:
                    own = np.frombuffer(row[c])[order]
                    some = ~np.isnan(own)
                    met |= some
                    value[some] += w * own[some]
            for g in row["given"] or ():
                if g["query_id"] in at:
                    met[at[g["query_id"]]] = True
                    value[at[g["query_id"]]] += g["score"]
            if not met.any():
                return np.full(n, -np.inf)
            body, kind = row["body"], row["chunk_type"] or ""
            value = value + row["base"] + kept(("e", row["entity"]), named) + kept(("t", kind, row["domain"] or ""), typed) + 0.08 * first(row["title"])
            value += np.minimum(0.16, 0.03 * long.of([in_body.names[i] for i in in_body.inside(body)])) + metadata(row["terms"] or ())
            word = np.zeros(n)
            for t in row["keywords"] or ():
                if t["term"] in keys.at:
                    word[keys.at[t["term"]]] += t["weight"]
            value += np.minimum(0.22, 0.22 * word / norm)
            for asks, r in ruled:
                text, none = r.get("text_any"), r.get("text_none") or ()
                if (not r.get("type") or r["type"] == kind) and (not text or any(m in body for m in text)) and not any(m in body for m in none):
                    value = value + asks * float(r["delta"])
            return np.where(met, value, -np.inf)

        return score

    spark = rows.sparkSession  # joins may leave few partitions, and scoring costs far more than moving the rows
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return best(rows, queries, make, k)
