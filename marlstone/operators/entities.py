"""Entities in texts: matching, profiles, lists, contact lines, fields near a role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import release, stored


def variant_match(questions: DataFrame, reviews: DataFrame, variants: DataFrame, least: float = 0.75) -> DataFrame:
    """(turn_id, review_turn, score): best active answer review of each question: 10 for an equal variant, else token overlap + .5 if one holds the other."""
    rows = stored(questions.select("turn_id", T.norm_ascii("question").alias("q")).where("q <> ''"), "questions")
    own = reviews.where("active and coalesce(nullif(review_kind, ''), 'answer') = 'answer'")
    v = variants.join(own.select("turn_id").distinct(), "turn_id", "left_semi").select("turn_id", T.norm_ascii("variant").alias("v")).where("v <> ''")
    v = stored(v.groupBy("v").agg(F.min("turn_id").alias("review_turn")), "variants")
    asked = rows.select("q").distinct()
    same = asked.join(v.withColumnRenamed("v", "q"), "q").withColumn("score", F.lit(10.0))
    rest = stored(asked.join(v.select(F.col("v").alias("q")), "q", "left_anti").select("q", F.monotonically_increasing_id().alias("a")), "asked")
    known = stored(v.withColumn("b", F.monotonically_increasing_id()), "known")
    met, made = _scored(rest, known, least)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "review_turn")
    best = met.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    out = stored(rows.join(same.unionByName(best) if least <= 10 else best, "q").select("turn_id", "review_turn", "score"), "matches")
    release(rows, v, rest, known, *made)
    return out


#: What one text inside the other counts.
HOLDS = 0.5


def _near(asked: DataFrame, variants: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of ``_sides``."""
    sides, _ = _sides(asked, variants, least)
    return sides[0][0].join(sides[0][1], "t").unionByName(sides[1][0].join(sides[1][1], "t")).select("a", "b").distinct()


def _scored(asked: DataFrame, variants: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """(q, review_turn, score) of questions (q, a) and variants (v, b, review_turn) that score ``least`` without being equal, some of them twice; the tables made.

    Both texts stand beside their words, so a pair is scored where its words meet: pairs that score less are never written nor moved.
    """
    sides, made = _sides(asked, variants, least)
    split = lambda x: F.array_distinct(F.split(x, " "))
    holds, c = F.col("q").contains(F.col("v")) | F.col("v").contains(F.col("q")), F.size(F.array_intersect(split("q"), split("v")))
    score = F.when(c > 0, c / F.size(split("q")) + F.when(holds, HOLDS).otherwise(0.0))
    out = [left.join(asked, "a").select("t", "q").join(right.join(variants, "b").select("t", "v", "review_turn"), "t").select("q", "review_turn", score.alias("score")).where(F.col("score") >= least) for left, right in sides]
    return out[0].unionByName(out[1]), made


def _sides(asked: DataFrame, variants: DataFrame, least: float) -> tuple[list[tuple[DataFrame, DataFrame]], list[DataFrame]]:
    """Words (a, t) of questions (q, a) and (b, t) of variants (v, b), twice: texts that can score ``least`` without being equal share one of either; the tables made. None is lost, and only rare words make pairs.

    Of n distinct words a variant must hold ``least`` n: it has one of the question's rarest, as many as may be missing and one more. A text inside another has all its
    words but the first and last in it, so the rarest of these is shared; a text of two words or fewer shares any.
    """
    seq = lambda x: F.split(x, " ")
    inner = lambda x: F.when(F.size(seq(x)) > 2, F.array_distinct(F.slice(seq(x), 2, F.size(seq(x)) - 2))).otherwise(F.array_distinct(seq(x)))

    def words(rows: DataFrame, key: str, x: str) -> DataFrame:
        all_ = rows.select(key, F.size(seq(x)).alias("size"), F.array_distinct(seq(x)).alias("w"), inner(F.col(x)).alias("i"))
        out = all_.select(key, "size", F.size("w").alias("n"), "i", F.explode("w").alias("t"))
        return stored(out.select(key, "size", "n", F.array_contains("i", F.col("t")).alias("inside"), "t"), "words")

    q, v = words(asked, "a", "q"), words(variants, "b", "v")

    def ranked(own: DataFrame, key: str, other: DataFrame) -> DataFrame:
        """The words with how many texts of the other side have them."""
        return own.join(other.groupBy("t").agg(F.count("*").alias("df")), "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("df", "t")
        inside = rows.where("inside").withColumn("_r", F.row_number().over(w))
        return inside.where((F.col("_r") == 1) | (F.col("size") <= 2)).where("df > 0").select(key, "t")

    rare = ranked(q, "a", v)
    missing = F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9))
    first = rare.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("df", "t"))).where((F.col("_r") <= missing + 1) & (F.col("df") > 0)).select("a", "t")
    own, theirs = first.unionByName(rarest(rare, "a")).distinct(), rarest(ranked(v, "b", q), "b")
    only = lambda rows, some: rows.join(some.select("t").distinct(), "t", "left_semi")
    return [(own, only(v.select("b", "t"), own)), (only(q.select("a", "t"), theirs), theirs)], [q, v]


def entity_fragment(x: Column, units: tuple[str, ...], heads: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """What follows a unit's word (a head's before it comes first) in a normalised text, up to a phrase of ``stops``; '' if nothing does."""
    unit, stop = "|".join(units), "|".join(stops)
    out = F.lit("")
    for lead in (rf"\b(?:{unit})\s+", rf"\b(?:{'|'.join(heads)})\s+(?:{unit})\s+"):
        found = F.regexp_extract(x, lead + r"([a-z0-9][a-z0-9\s&.-]*)", 1)
        found = F.trim(F.regexp_extract(found, rf"^(.*?)(?:\b(?:{stop})\b|$)", 1))
        out = F.when(found != "", found).otherwise(out)
    return out


def entity_match(questions: DataFrame, names: DataFrame, units: tuple[str, ...], heads: tuple[str, ...], stops: tuple[str, ...], common: tuple[str, ...]) -> DataFrame:
    """(question_id, name, score): the best name of each question (question_id, question), of those that share a word with it.

    4 for the whole name in the question, 3 for the name without its unit's word, 3.5 for the question's fragment in that, each and a hundredth of its length; the share of the name's tokens
    that the question (its fragment, if there is one) has, .6 for each, 2.2 if the question's are all among them, 1.4 for each shared phrase of two to four tokens. Tokens have two
    characters and are not ``common``. Kept with 3 points, two shared tokens (or all of the question's), a shared phrase, or all of the question's tokens; ties go to the first name.
    """
    listed = F.array(*[F.lit(t) for t in common]) if common else F.array().cast("array<string>")
    own = lambda x: F.filter(F.split(x, " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(listed, t))
    asked = questions.select("question_id", T.norm_ascii("question").alias("q")).where("q <> ''").withColumn("key", F.md5("q"))
    q = asked.groupBy("key").agg(F.first("q").alias("q")).withColumn("f", entity_fragment(F.col("q"), units, heads, stops))  # equal questions meet the names once
    q = q.withColumn("qt", own(F.when(F.col("f") != "", F.col("f")).otherwise(F.col("q")))).withColumns({"qs": F.array_distinct("qt"), "qp": F.array_distinct(T.ngrams(F.col("qt"), 2, 4))})
    n = names.select("name", T.norm_ascii("name").alias("nn")).where("nn <> ''").distinct().withColumn("short", F.trim(F.regexp_replace("nn", rf"^(?:{'|'.join(units)})\s+", "")))
    n = n.withColumn("nt", own(F.col("short"))).withColumns({"ns": F.array_distinct("nt"), "np": F.array_distinct(T.ngrams(F.col("nt"), 2, 4))})
    words = lambda x: F.explode(F.array_distinct(F.filter(F.split(x, " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(listed, t)))).alias("t")
    pairs = q.select("key", words(F.col("q"))).join(n.select("name", words(F.col("nn"))), "t").select("key", "name").distinct()
    rows = pairs.join(q, "key").join(n, "name")
    hits, phrases = F.size(F.array_intersect("qs", "ns")), F.size(F.array_intersect("qp", "np"))
    size, inside = F.size("qs"), (F.size("qs") > 0) & (F.size(F.array_except("qs", "ns")) == 0)
    some = lambda ok, base, x: F.when(ok, base + F.length(x) / 100.0).otherwise(0.0)
    score = some(F.col("q").contains(F.col("nn")), 4.0, "nn") + some((F.col("short") != "") & F.col("q").contains(F.col("short")), 3.0, "short") + some((F.col("f") != "") & F.col("short").contains(F.col("f")), 3.5, "f")
    score = score + F.when(F.size("ns") > 0, hits / F.size("ns") + 0.6 * hits + F.when(inside, 2.2).otherwise(0.0)).otherwise(0.0) + 1.4 * phrases
    enough = (F.size("ns") > 0) & ((hits >= F.greatest(F.lit(1), F.least(F.lit(2), size))) | (phrases >= 1) | inside)
    kept = rows.withColumns({"score": F.round(score, 9), "_ok": enough}).where((F.col("score") > 0) & ((F.col("score") >= 3.0) | F.col("_ok")))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "name")
    best = kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "name", "score")
    return asked.select("question_id", "key").join(best, "key").select("question_id", "name", "score")


def entity_profiles(blocks: DataFrame, starts: Column, contact: Column, key: str = "doc_id") -> DataFrame:
    """(key, entity, lines, contacts): the current entity carried over ordered blocks; its texts and contact texts counted."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = blocks.withColumn("entity", F.last(F.when(starts, F.col("text")), True).over(w)).where("entity is not null")
    return rows.groupBy(key, "entity").agg(F.count("*").alias("lines"), F.sum(contact.cast("int")).cast("long").alias("contacts"), F.min("pos").alias("first_pos"))


def entity_list(docs: DataFrame, pattern: str, by: str) -> DataFrame:
    """(by, entity, n): documents that hold each entity, found by a pattern."""
    rows = docs.select(by, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("entity"))
    return rows.groupBy(by, "entity").agg(F.count("*").alias("n"))


def contact_lines(blocks: DataFrame, places: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """(key, field, place, text): lines with an email, a url or a phone number, labelled by the first place they name; each once."""
    field = F.when(F.col("text").contains("@"), "email").when(F.col("text").contains("http"), "web").when(F.col("text").rlike(r"\+?[0-9][0-9 ().-]{6,}[0-9]"), "phone")
    place = F.lit("")
    for name, word in reversed(places):
        place = F.when(T.norm("text").contains(word), name).otherwise(place)
    return blocks.select(key, field.alias("field"), place.alias("place"), "text").where("field is not null").distinct()


def field_proximity(blocks: DataFrame, role: Column, field: Column, reach: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, pos, found_pos): each role line with the first line that holds the field among itself and the ``reach`` next ones."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = blocks.withColumn("_hit", F.when(field, F.col("pos")))
    near = F.coalesce(F.col("_hit"), *[F.lead("_hit", k).over(w) for k in range(1, reach + 1)])
    return rows.withColumn("found_pos", near).withColumn("_role", role).where("_role and found_pos is not null").select(key, "pos", "found_pos")
