"""Record stores to chunks: variants, QA, facts, records, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sanitize(x: Column, prefixes: tuple[str, ...], suffixes: tuple[str, ...] = ()) -> Column:
    """A phrasing, normalised without accents, without filler words in front and filler behind, in the order of the lists; null under four characters."""
    out = T.norm_ascii(x)
    for p in prefixes:
        out = F.when(out.startswith(f"{p} "), F.trim(F.substring(out, len(p) + 1, 1 << 20))).otherwise(out)
    for s in suffixes:
        out = F.when(out.endswith(s), F.trim(F.regexp_replace(out, f"{s}$", ""))).otherwise(out)
    return F.when(F.length(out) >= 4, out)


def variant_group(rows: DataFrame, key: str, order: str, limit: int = 12) -> DataFrame:
    """(key, variants): the first distinct variants of each key."""
    first = rows.groupBy(key, T.norm_ascii("variant").alias("v")).agg(F.min(order).alias("_o")).where("v <> ''")
    w = Window.partitionBy(key).orderBy("_o", "v")
    top = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda x: x.v).alias("variants"))


def faq_upsert(existing: DataFrame, new: DataFrame, limit: int = 24) -> DataFrame:
    """(domain, key, question, answer, keywords): the later answer of a question (by its form without accents) wins; keywords are unioned in order of arrival, the first of
    those that are alike. New rows without question or answer are passed over. Inputs: domain, seq, question, answer, keywords."""
    new = new.where((F.trim("question") != "") & (F.trim("answer") != ""))
    rows = existing.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1))).withColumn("key", T.norm_ascii("question")).where("key <> ''")
    last = F.max_by(F.struct("question", "answer"), F.struct("_s", "seq"))
    words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", "seq", "keywords"))), lambda x: x.keywords))
    out = rows.groupBy("domain", "key").agg(last.alias("l"), T.unique_strings(words, limit).alias("keywords"))
    return out.select("domain", "key", "l.question", "l.answer", "keywords")


def fact_append(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with those new ones whose form without accents the domain lacks; of equal new ones the first by seq. Inputs: domain, seq, text. Forms meet as digests."""
    form = T.norm_ascii("text")
    key = F.when(form != "", F.sha1(form)).alias("key")
    have = facts.select("domain", key).distinct()
    w = Window.partitionBy("domain", "key").orderBy("seq")
    add = new.select("domain", "seq", F.trim("text").alias("text"), key).where("key is not null").join(have, ["domain", "key"], "left_anti").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return facts.select("domain", "seq", "text").unionByName(add.select("domain", "seq", "text"))


def record_text(*fields: Column) -> Column:
    """Values joined by bars, blanks left out."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(f.cast("string")), F.lit("")) for f in fields])


def dedupe_first(chunks: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chunk_order(chunks: DataFrame) -> DataFrame:
    """Rank of each chunk in its domain: by priority, type, entity and id, all descending."""
    w = Window.partitionBy("domain").orderBy(*[F.desc(c) for c in ("priority", "chunk_type", "entity_name", "id")])
    return chunks.withColumn("rank", F.row_number().over(w)).withColumn("chunks", F.count("*").over(Window.partitionBy("domain")))


#: Priority of a seed chunk by its type.
PRIORITY = {
    "overview": 100, "role": 98, "contact": 96, "location": 95, "howto": 94, "history": 90, "fact": 88, "structure": 84,
    "function": 84, "duty": 83, "qa": 92, "record": 92, "generic": 70,
}


def priority(kind: Column, table: dict[str, int] = PRIORITY) -> Column:
    out = F.lit(table["generic"])
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def seed_chunks(records: DataFrame, locations: DataFrame, facts: DataFrame, qa: DataFrame, titles: DataFrame, fact_type: Column, qa_type: Column, fact_meta: DataFrame | None = None, qa_meta: DataFrame | None = None) -> DataFrame:
    """(domain, kind, chunk_type, title, entity_name, text, priority, keywords, seq, dedupe_key, id): records, locations, facts and QA as chunks, in this order of kinds; of those of a domain with
    the same type, entity and text the first.

    records: domain, seq, text, name, role; locations: domain, seq, text, city, address; facts: domain, seq, text; qa: domain, seq, question, answer, keywords; titles: domain, domain_title.
    ``fact_type`` and ``qa_type`` find the type from the columns ``text``, and ``question`` and ``answer``. fact_meta (key, title) and qa_meta (key, unit_name, topic, keywords) add to those whose text
    (question) has that form without accents.
    """
    none, blank = F.array().cast("array<string>"), lambda *xs: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs])
    title = F.coalesce("domain_title", "domain")

    def part(rows: DataFrame, kind: str, k: int, text, chunk_type, entity, keywords, name=None) -> DataFrame:
        rows = rows.join(titles, "domain", "left")  # one row a domain
        return rows.select("domain", F.lit(kind).alias("kind"), F.lit(k).alias("_k"), "seq", T.ws(text).alias("text"), chunk_type.alias("chunk_type"), (title if name is None else F.coalesce(name, title)).alias("title"), F.coalesce(entity, title).alias("entity_name"), keywords.alias("keywords"))

    words = lambda *xs: T.unique_strings(F.array(*[F.coalesce(x, F.lit("")) for x in xs]), 24)
    facts = facts.withColumn("key", T.norm_ascii("text"))
    facts = facts.join(fact_meta.select("key", F.col("title").alias("m_title")), "key", "left") if fact_meta is not None else facts.withColumn("m_title", F.lit(None).cast("string"))
    qa = qa.withColumn("key", T.norm_ascii("question"))
    more = ["unit_name", "topic", F.col("keywords").alias("m_keywords")]
    qa = qa.join(qa_meta.select("key", *more), "key", "left") if qa_meta is not None else qa.withColumns({"unit_name": F.lit(None).cast("string"), "topic": F.lit(None).cast("string"), "m_keywords": none})
    rows = (
        part(records, "record", 0, "text", F.when(F.trim("role") != "", "role").otherwise("record"), blank("name", "role"), words(blank("name", "role"), F.col("role")))
        .unionByName(part(locations, "location", 1, "text", F.lit("location"), blank("city", "address"), words(F.col("city"), F.col("address"))))
        .unionByName(part(facts, "fact", 2, "text", fact_type, blank("m_title"), words(F.col("m_title"))))
        .unionByName(part(qa, "qa", 3, "answer", qa_type, blank("unit_name", "topic"), T.unique_strings(F.concat(F.coalesce("keywords", none), F.coalesce("m_keywords", none)), 24), blank("question")))
    )
    rows = rows.where("text <> ''").withColumn("dedupe_key", F.sha1(F.concat_ws("|", T.norm_ascii("chunk_type"), T.norm_ascii("entity_name"), T.norm_ascii("text"))))
    one = dedupe_first(rows, ["domain", "dedupe_key"], "_k", "seq").withColumn("priority", priority(F.when(F.col("kind") == "qa", "qa").otherwise(F.col("chunk_type"))))
    return one.drop("_k").withColumn("id", T.stable_id("s", F.col("domain"), F.col("chunk_type"), F.col("entity_name"), F.col("text"), size=12))
