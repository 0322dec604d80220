"""Blocks to typed chunks: headings, sections, windows, sentences, children, identity, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread, stored

SIZE, OVERLAP, LEAST = 170, 35, 220


#: Words that begin a heading, and titles that are headings in documents of that name only.
HEADING_PREFIXES = ("giai doan ",)
TITLES = ("lich su hinh thanh", "khoa chuyen mon", "phong ban va chuc nang", "co so vat chat")


def is_heading(x: Column, hints: tuple[str, ...] = (), prefixes: tuple[str, ...] = HEADING_PREFIXES, titled: Column | None = None, titles: tuple[str, ...] = TITLES) -> Column:
    """A number (``1`` or ``1.2``) before text, a known prefix, ten words at most with a section hint, ALL CAPS of 2 to 12 words, or one of ``titles`` where ``titled`` holds (the document goes by a title).

    Words, hints, prefixes and titles are those of the form without accents.
    """
    n = T.norm_ascii(x)
    words = F.size(F.filter(F.split(n, " "), lambda t: t != ""))
    numbered = n.rlike(r"^[0-9]+(?:\.[0-9]+)?\s*[.)]?\s+")
    caps = (x == F.upper(x)) & x.rlike(r"\p{Lu}") & words.between(2, 12)
    out = numbered | caps
    for p in prefixes:
        out = out | n.startswith(p)
    if hints:
        out = out | ((words <= 10) & T.any_hint(n, list(hints)))
    if titled is not None:
        out = out | (titled & n.isin(*titles))
    return (n != "") & out


def entity_heading(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Blocks that start an entity: rules (doc_class, prefix, max_words), a small table joined by class; ``blocks`` has doc_class."""
    met = blocks.join(F.broadcast(rules), "doc_class")
    ok = F.expr("startswith(lower(text), prefix)") & (F.size(T.words("text")) <= F.col("max_words"))
    return met.where(ok).select(*blocks.columns).distinct()


def section_carry(blocks: DataFrame, heading: Column, entity: Column, key: str = "doc_id") -> DataFrame:
    """Blocks with their section group, section and entity carried forward; an entity heading sets the section to ``overview``."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = blocks.withColumns({"_h": heading, "_e": entity})
    return rows.select(
        *blocks.columns,
        F.sum(F.when(F.col("_h") | F.col("_e"), 1).otherwise(0)).over(w).alias("grp"),
        F.coalesce(F.last(F.when(F.col("_e"), F.lit("overview")).when(F.col("_h"), F.col("text")), True).over(w), F.lit("overview")).alias("section"),
        F.coalesce(F.last(F.when(F.col("_e"), F.col("text")), True).over(w), F.lit("")).alias("entity"),
        (F.col("_h") | F.col("_e")).alias("heading"),
    )


def section_assemble(carried: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, grp, section, entity, first_pos, text): a section's blocks joined by line feeds in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "text")))), lambda x: x.text), "\n")
    return carried.groupBy(key, "grp").agg(F.max("section").alias("section"), F.max("entity").alias("entity"), F.min("pos").alias("first_pos"), body.alias("text")).where("text <> ''")


def word_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, k, start, words, text): one window up to ``least`` words, else windows of ``size`` that overlap, until one reaches the end."""
    rows = docs.select(F.col(id_col).alias("id"), T.words(text_col).alias("w")).withColumn("n", F.size("w"))
    many = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - overlap - 1), F.lit(size - overlap))
    at = F.when(F.col("n") <= least, F.array(F.lit(0))).otherwise(many)
    cut = rows.where("n > 0").select("id", "w", "n", F.posexplode(at).alias("k", "start"))
    piece = F.slice("w", F.col("start") + 1, F.when(F.col("n") <= least, F.col("n")).otherwise(F.lit(size)))
    return cut.select("id", "k", "start", piece.alias("p")).select("id", "k", "start", F.size("p").alias("words"), F.array_join("p", " ").alias("text"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, text): split after ``.!?;`` and white space."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(T.text(text_col), r"(?<=[.!?;])\s+")).alias("pos", "text"))
    return rows.withColumn("text", T.ws("text")).where("text <> ''")


def sentence_children(parts: DataFrame, markers: tuple[str, ...], leads: tuple[str, ...]) -> DataFrame:
    """(id, pos, text) of sentences with a marker, the sentence before put in front where it carries a lead."""
    before = F.lag("text").over(Window.partitionBy("id").orderBy("pos"))
    rows = parts.withColumn("_b", F.coalesce(before, F.lit("")))
    hit = rows.where(T.any_hint(T.norm("text"), list(markers), "contains"))
    return hit.select("id", "pos", F.when(T.any_hint(T.norm("_b"), list(leads), "contains"), F.concat_ws(" ", "_b", "text")).otherwise(F.col("text")).alias("text"))


def bullet_children(blocks: DataFrame, kind: Column, key: tuple[str, ...]) -> DataFrame:
    """Lines of four words or more, of sections with two of them at least, with their ``kind``."""
    rows = blocks.where(F.size(T.words("text")) >= 4).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    return rows.where("_n >= 2").withColumn("kind", kind).drop("_n")


def line_kind(x: Column, roles: tuple[str, ...], places: tuple[str, ...], most: int = 14) -> Column:
    """Kind of a short line: role, contact (an email or six digits), location (two place markers); the first that holds, else ''."""
    n, short = T.norm(x), F.size(T.words(x)) <= most
    hits = sum((n.contains(p).cast("int") for p in places), F.lit(0))
    return F.when(~short, "").when(T.any_hint(n, list(roles), "contains"), "role").when(n.contains("@") | x.rlike("[0-9]{6}"), "contact").when(hits >= 2, "location").otherwise("")


def record_group(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rec, record): every three consecutive blocks as one record."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = blocks.withColumn("_k", F.row_number().over(w) - 1).withColumn("rec", F.floor(F.col("_k") / 3).cast("int"))
    part = [F.max(F.when(F.col("_k") % 3 == k, F.col("text"))) for k in range(3)]
    return rows.groupBy(key, "rec").agg(F.concat_ws(" | ", *part).alias("record"))


def identity(prefix: str, *parts: Column) -> Column:
    """Chunk id: prefix and 12 digits of the SHA-1 over the parts, each ended by NUL."""
    return T.stable_id(prefix, *parts, size=12)


def summary(x: Column, words: int = 28) -> Column:
    """The first sentence, cut at so many words."""
    first = F.element_at(F.split(T.ws(x), r"(?<=[.!?;:])\s+"), 1)
    w = T.words(first)
    return F.when(F.size(w) <= words, first).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, words), " "), "[,;:. ]+$", ""), F.lit("...")))


def with_priority(chunks: DataFrame, table: DataFrame, default: int = 50) -> DataFrame:
    """Chunks with the priority of their type: table (chunk_type, type_priority), small."""
    return chunks.join(F.broadcast(table), "chunk_type", "left").withColumn("type_priority", F.coalesce("type_priority", F.lit(default)))


def typed(section: Column, body: Column, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]], default: str = "generic") -> Column:
    """Chunk type of the first rule (label, section hints, body hints) with a hit in its texts."""
    out = F.lit(default)
    for label, in_section, in_body in reversed(rules):
        hit = T.any_hint(section, list(in_section)) | T.any_hint(body, list(in_body))
        out = F.when(hit, label).otherwise(out)
    return out


def extract(x: Column, pattern: str, limit: int = 12) -> Column:
    """Distinct matches, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0))), 1, limit)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s<>\"')]+"


def dates(x: Column) -> Column:
    """``d/m`` and ``d/m/y`` dates, then years from 1900 to 2099, each once."""
    days = F.regexp_extract_all(x, F.lit(r"\b[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?\b"), F.lit(0))
    years = F.regexp_extract_all(x, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))
    return F.array_distinct(F.concat(days, years))


def text_stats(x: Column) -> list[Column]:
    """words, chars, lines and sentences (one at least of the last two)."""
    some = lambda a: F.greatest(F.lit(1), F.size(F.filter(a, lambda t: F.trim(t) != "")))
    return [
        F.size(T.words(x)).alias("words"),
        F.length(x).alias("chars"),
        some(F.split(x, "\n")).alias("lines"),
        some(F.split(T.ws(x), r"(?<=[.!?;:])\s+")).alias("sentences"),
    ]


def labels(x: Column, hints: list[tuple[str, tuple[str, ...]]], *more: Column, limit: int = 12) -> Column:
    """Tags of all hints that occur, in order, then the others; each once, blanks left out."""
    tags = F.array(*[F.when(T.any_hint(x, list(words)), tag) for tag, words in hints], *more)
    return F.slice(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != ""))), 1, limit)


#: Keys of the parsed page that a chunk's metadata passes on.
PASSED = ("category", "channel", "published_at", "authoritative", "source")
#: What metadata_text joins: scalars, then lists.
SCALARS = ("doc_title", "section", "chunk_type", "entity_type", "entity_name", "category", "source_url", "source_file", "published_at")
LISTS = ("topic_tags", "intent_tags", "search_terms", "keywords", "emails", "urls", "dates", "years")


#: Columns that may name a chunk's page: its own, those of the parsed page.
URLS = ("source_url", "page_source_url", "page_url")


def metadata(chunks: DataFrame, topics: list[tuple[str, tuple[str, ...]]], markers: dict[str, tuple[str, ...]], intents: dict[str, tuple[str, ...]]) -> DataFrame:
    """``chunks`` (doc_id, title, section, chunk_type, entity_type, entity_name, text, source_kind, source_path, and any of PASSED and keywords) with the struct ``metadata``.

    markers: contact, location, role, howto, each a list of substrings of the text's normal form; they make the flags and, with ``intents`` (tags by chunk type), the intent tags.
    The url is the chunk's own (URLS, the first that is there and not blank), else a source path that begins with http; where there is none, the path is the file. The text's forms are columns of their own, made once.
    """
    given = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in URLS if c in chunks.columns]
    url = F.coalesce(*given, F.when(F.lower("_p").startswith("http"), F.trim("_p")), F.lit(""))
    rows = spread(chunks).withColumns({"_c": T.ws("text")}).withColumns({"_n": T.norm_ascii("_c"), "_p": T.text("source_path")})
    rows = rows.withColumns({"_url": url, "_dates": dates(F.col("_c")), "_emails": extract(F.col("_c"), EMAIL)})
    rows = rows.withColumn("_urls", F.slice(F.array_distinct(F.filter(F.concat(extract(F.col("_c"), URL), F.array("_url")), lambda u: u != "")), 1, 12))
    rows = rows.withColumns({f"_{k}": T.any_hint(F.col("_n"), list(markers[k])) for k in ("contact", "location", "role", "howto")})
    rows = rows.withColumn("_topics", labels(F.col("_n"), topics, F.col("chunk_type"), F.col("entity_name")))
    typed_tags = F.array().cast("array<string>")
    for name, tags in intents.items():
        typed_tags = F.when(F.col("chunk_type") == name, F.array(*[F.lit(t) for t in tags])).otherwise(typed_tags)
    found = F.array(*[F.when(F.col(f"_{k}"), tag) for k, tag in (("contact", "contact"), ("location", "location"), ("role", "person_lookup"), ("howto", "howto"))])
    words, chars, _, sents = text_stats(F.col("_c"))
    lines = text_stats(F.col("text"))[2]
    own = F.concat_ws(" ", "title", "section", "entity_name", "chunk_type", F.array_join("_topics", " "), "_c")
    fields = [
        F.col("doc_id"), F.col("title").alias("doc_title"), F.col("section"), T.norm_ascii("section").alias("section_norm"), F.col("chunk_type"), T.norm_ascii("chunk_type").alias("chunk_type_norm"),
        F.col("entity_type"), F.col("entity_name"), T.norm_ascii("entity_name").alias("entity_norm"), F.col("source_kind"), F.col("_url").alias("source_url"), F.when(F.col("_url") == "", F.trim("_p")).otherwise("").alias("source_file"),
        F.col("_topics").alias("topic_tags"), F.slice(F.array_distinct(F.filter(F.concat(typed_tags, found), lambda t: t.isNotNull())), 1, 10).alias("intent_tags"),
        F.slice(F.array_distinct(T.keyword_terms(own)), 1, 28).alias("search_terms"),
        words.alias("word_count"), chars.alias("char_count"), lines.alias("line_count"), sents.alias("sentence_count"),
        *[F.col(f"_{k}").alias(f"has_{k}") for k in ("contact", "location", "role", "howto")], (F.size("_emails") > 0).alias("has_email"), (F.size("_urls") > 0).alias("has_url"),
        F.col("_emails").alias("emails"), F.col("_urls").alias("urls"), F.col("_dates").alias("dates"), F.filter("_dates", lambda d: d.rlike("^(?:19|20)[0-9]{2}$")).alias("years"),
        *[F.col(c) for c in (*PASSED, "keywords") if c in chunks.columns],
    ]
    return rows.withColumn("metadata", F.struct(*fields)).select(*chunks.columns, "metadata")


def metadata_text(meta: DataFrame, column: str = "metadata") -> Column:
    """Searchable text of a metadata struct: SCALARS, then LISTS, blanks and absent fields left out."""
    have = meta.schema[column].dataType.fieldNames()
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    lists = [F.array_join(F.filter(F.col(f"{column}.{k}"), lambda t: F.trim(t) != ""), " ") for k in LISTS if k in have]
    return F.concat_ws(" ", *[empty(F.col(f"{column}.{k}").cast("string")) for k in SCALARS if k in have], *[empty(x) for x in lists])


#: Types of sections whose lines are bullets, and types whose sentences are not searched for training.
BULLETED = ("function", "duty", "function_duty", "howto")
PLAIN = ("contact", "location")


def adaptive(
    docs: DataFrame,
    hints: tuple[str, ...],
    rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]],
    entity: Column,
    teach: tuple[str, ...] = (),
    leads: tuple[str, ...] = (),
    train: tuple[str, ...] = (),
    roles: tuple[str, ...] = (),
    places: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, grp, part, k, chunk_type, entity, section, text, id, parent_id, summary, priority) of documents (doc_id, text).

    Lines, headings and entity headings (``entity``, a condition on ``text``) give sections and their types. A section gives windows, and children with the first window as parent: sentences with a marker of
    ``teach`` (the sentence before put in front where it has a lead) or ``train``, bullets where the type has these, and short lines with a role, a contact or a place.
    Of chunks of a document with the same type, entity and text the first stays.
    """
    from .knowledge import dedupe_first, priority
    from .pages import lines

    carried = section_carry(lines(spread(docs)), is_heading(F.col("text"), hints), entity)
    sections = section_assemble(carried).withColumn("base", typed(T.norm("section"), T.norm("text"), rules))
    keyed = stored(sections.withColumn("sid", F.concat_ws(":", "doc_id", "grp")), "sections")  # four branches read it
    about = ["sid", "doc_id", "grp", "section", "entity", "base"]
    windows = word_windows(keyed, "sid").select(F.col("id").alias("sid"), "k", "text")
    parents = keyed.select(*about).join(windows, "sid").withColumns({"part": F.lit("window"), "chunk_type": F.col("base"), "_o": F.lit(0)})
    told = sentences(keyed, "sid").withColumn("_b", F.coalesce(F.lag("text").over(Window.partitionBy("id").orderBy("pos")), F.lit("")))
    n = T.norm("text")
    is_teach = T.any_hint(n, list(teach))
    told = told.join(keyed.select("sid", "base"), F.col("id") == F.col("sid")).where(is_teach | (T.any_hint(n, list(train)) & ~F.col("base").isin(*PLAIN)))
    said = F.when(is_teach & T.any_hint(T.norm("_b"), list(leads)), F.concat_ws(" ", "_b", "text")).otherwise(F.col("text"))
    told = told.select("sid", F.col("pos").alias("k"), F.when(is_teach, "teaching").otherwise("training").alias("chunk_type"), said.alias("text"))
    told = keyed.select(*about).join(told, "sid").withColumns({"part": F.lit("sentence"), "_o": F.lit(1)})
    each = keyed.select(*about, F.posexplode(F.split("text", "\n")).alias("k", "text"))
    bullets = bullet_children(each.where(F.col("base").isin(*BULLETED)), F.when(F.col("base") == "howto", "howto").otherwise("fact"), ("doc_id", "grp"))
    bullets = bullets.withColumnRenamed("kind", "chunk_type").withColumns({"part": F.lit("bullet"), "_o": F.lit(2)})
    short = each.where(F.size(T.words("text")) >= 3).withColumn("chunk_type", line_kind(F.col("text"), roles, places))
    short = short.where((F.col("chunk_type") != "") & ~((F.col("chunk_type") == "location") & (F.col("base") == "history"))).withColumns({"part": F.lit("line"), "_o": F.lit(3)})
    shown = [*about, "part", "_o", "k", "chunk_type", "text"]
    rows = parents.select(*shown).unionByName(told.select(*shown)).unionByName(bullets.select(*shown)).unionByName(short.select(*shown))
    own = lambda kind, k, text: identity("c", F.col("doc_id"), F.col("grp"), kind, k, text)
    first = parents.where("k = 0").select("sid", own(F.col("base"), F.lit(0), F.col("text")).alias("_first"))
    rows = rows.join(first, "sid", "left").withColumn("parent_id", F.when(F.col("part") != "window", F.col("_first")))
    rows = rows.withColumns({"_e": T.norm_ascii("entity"), "_t": F.sha1(T.norm_ascii("text"))})
    one = dedupe_first(rows, ["doc_id", "chunk_type", "_e", "_t"], "grp", "_o", "k")
    one = one.withColumns({"id": own(F.col("chunk_type"), F.col("k"), F.col("text")), "summary": summary(F.col("text")), "priority": priority(F.col("chunk_type"))})
    return one.select("doc_id", "grp", "part", "k", "chunk_type", "entity", "section", "text", "id", "parent_id", "summary", "priority")
