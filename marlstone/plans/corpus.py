"""P, C, M, K: pages, chunks, metadata, knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import knowledge as K
from ..operators import pages as G
from .common import Plans, d_ascii, d_norm, d_slug, d_terms, d_words, d_ws

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle

P.add("p1_html_blocks", lambda p: G.html_blocks(p), "pages")
#: (doc_id, pos, text) of the lines that are not blank.
D_LINES = f"lines AS (SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, {d_ws('line')} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE {d_ws('line')} <> '')"
PHRASES = ["license", "copyright"]


def navigation(docs):
    """The lines that three documents or more have."""
    return G.lines(docs).groupBy(F.col("text").alias("line")).agg(F.countDistinct("doc_id").alias("n")).where("n >= 3")


P.add(
    "p2_block_clean",
    lambda d: G.block_clean(G.lines(d), navigation(d), PHRASES).select("doc_id", "pos", F.md5("text").alias("text")),
    "documents",
    sql=f"""WITH {D_LINES}, nav AS (SELECT DISTINCT {d_norm('text')} AS n FROM lines GROUP BY text HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, pos, md5(text) AS text FROM lines WHERE len({d_words('text')}) > 2 AND NOT contains({d_norm('text')}, 'license') AND NOT contains({d_norm('text')}, 'copyright') AND {d_norm('text')} NOT IN (SELECT n FROM nav)""",
)
_TITLE = d_ws("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_SHORT = f"trim(regexp_replace({_TITLE}, ' [|–-] [^|–-]*$', ''))"
P.add("p3_page_doc", G.page_doc, "pages", sql=f"SELECT page_id, {_SHORT} AS title, 'web-' || {d_slug(_SHORT)} AS doc_id FROM pages WHERE contains(html, '<p')")
P.add("p4_url_frontier", lambda p: G.url_frontier(p, "https://"), "pages", sql="SELECT url, min(page_id) AS page_id FROM pages WHERE starts_with(url, 'https://') GROUP BY url")
P.add(
    "p5_incremental_build",
    lambda p: G.incremental(p, p.where("page_id % 2 = 0"))[1],
    "pages",
    sql="WITH t AS (SELECT count(*) AS urls, count(CASE WHEN url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) THEN 1 END) AS saved FROM pages) SELECT urls, saved, urls - saved AS skipped FROM t",
)
P.add(
    "p6_block_normalize",
    lambda d: G.block_normalize(G.lines(d).join(d.select("doc_id", F.substring_index("text", "\n", 1).alias("title")), "doc_id"), F.col("title")).select("doc_id", "pos", F.md5("text").alias("text")),
    "documents",
    sql=f"""WITH {D_LINES}, t AS (SELECT doc_id, {d_norm("string_split(text, chr(10))[1]")} AS title FROM documents) SELECT doc_id, pos, md5(text) AS text FROM lines JOIN t USING (doc_id) WHERE NOT starts_with({d_norm('text')}, 'posted on') AND {d_norm('text')} <> title""",
)
P.add("p7_cache_filename", lambda p: p.select("page_id", G.cache_filename(F.col("url")).alias("name")), "pages", sql=f"SELECT page_id, substr({d_slug('url')}, 1, 80) || '-' || substr(sha1(url), 1, 12) AS name FROM pages")

HINTS = ("the ", "license")
_hn, _hw = d_ascii("text"), f"len(list_filter(string_split({d_ascii('text')}, ' '), lambda t: t <> ''))"
D_HEAD = rf"""({_hn} <> '' AND (regexp_matches({_hn}, '^[0-9]+(?:\.[0-9]+)?\s*[.)]?\s+') OR (text = upper(text) AND regexp_matches(text, '\p{{Lu}}') AND {_hw} BETWEEN 2 AND 12)
    OR ({_hw} <= 10 AND (contains({_hn}, 'the ') OR contains({_hn}, 'license')))))"""
#: Prefixes and titles that occur in these tables; every seventh document goes by a title.
HEAD_PREFIXES, HEAD_TITLES = ("the ti", "der ", "las "), ("posted on monday", "all rights reserved")
D_HEAD1 = f"({D_HEAD} OR ({_hn} <> '' AND ({' OR '.join(f'starts_with({_hn}, {p!r})' for p in HEAD_PREFIXES)} OR (doc_id % 7 = 0 AND {_hn} IN ({', '.join(map(repr, HEAD_TITLES))})))))"
HEAD = lambda: C.is_heading(F.col("text"), HINTS)
P.add(
    "c1_heading_detect",
    lambda d: G.lines(d).select("doc_id", "pos", C.is_heading(F.col("text"), HINTS, HEAD_PREFIXES, F.col("doc_id") % 7 == 0, HEAD_TITLES).alias("heading")),
    "documents",
    sql=f"WITH {D_LINES} SELECT doc_id, pos, {D_HEAD1} AS heading FROM lines",
)


def prefixes(spark):
    return spark.createDataFrame([("en", "the", 12), ("fr", "la", 10), ("de", "der", 10), ("es", "la", 8)], "doc_class string, prefix string, max_words int")


P.add(
    "c2_entity_heading",
    lambda d: C.entity_heading(G.lines(d).join(d.select("doc_id", F.col("lang").alias("doc_class")), "doc_id"), prefixes(d.sparkSession)).select("doc_id", "pos"),
    "documents",
    sql=f"""WITH {D_LINES} SELECT doc_id, pos FROM lines JOIN documents d USING (doc_id) JOIN (VALUES ('en', 'the', 12), ('fr', 'la', 10), ('de', 'der', 10), ('es', 'la', 8)) r(c, p, m) ON d.lang = c
        WHERE starts_with(lower(lines.text), p) AND len({d_words('lines.text')}) <= m""",
)
ENTITY = lambda: F.lower(F.col("text")).startswith("the ") & (F.size(T.words("text")) <= 12)
D_CARRY = f"""{D_LINES}, h AS (SELECT *, {D_HEAD} AS h, starts_with(lower(text), 'the ') AND len({d_words('text')}) <= 12 AS e FROM lines), carried AS (SELECT doc_id, pos, text, CAST(sum(CASE WHEN h OR e THEN 1 ELSE 0 END) OVER w AS BIGINT) AS grp,
    coalesce(last_value(CASE WHEN e THEN 'overview' WHEN h THEN text END IGNORE NULLS) OVER w, 'overview') AS section, coalesce(last_value(CASE WHEN e THEN text END IGNORE NULLS) OVER w, '') AS entity, h OR e AS heading
    FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


def carried(d):
    return C.section_carry(G.lines(d), HEAD(), ENTITY())


P.add("c3_section_carry", lambda d: carried(d).select("doc_id", "pos", "grp", F.md5("section").alias("section"), F.md5("entity").alias("entity")), "documents", sql=f"WITH {D_CARRY} SELECT doc_id, pos, grp, md5(section) AS section, md5(entity) AS entity FROM carried")
D_SECTIONS = f"{D_CARRY}, sections AS (SELECT doc_id, grp, max(section) AS section, min(pos) AS first_pos, string_agg(CASE WHEN NOT heading THEN text END, chr(10) ORDER BY pos) AS text FROM carried GROUP BY doc_id, grp HAVING string_agg(CASE WHEN NOT heading THEN text END, '') <> '')"
P.add("c4_section_assemble", lambda d: C.section_assemble(carried(d)).select("doc_id", "grp", "first_pos", F.md5("text").alias("text")), "documents", sql=f"WITH {D_SECTIONS} SELECT doc_id, grp, first_pos, md5(text) AS text FROM sections")
RULES = [("howto", ("with", "das"), ("step",)), ("contact", (), ("@",)), ("history", ("was", "est"), ("19",)), ("fact", ("the",), ())]


def d_hints(x, words):
    return "(" + (" OR ".join(f"contains({x}, '{w}')" for w in words) or "false") + ")"


D_TYPED = "CASE " + " ".join(f"WHEN {d_hints(d_norm('section'), s)} OR {d_hints(d_norm('text'), b)} THEN '{n}'" for n, s, b in RULES) + " ELSE 'generic' END"
P.add(
    "c5_section_type",
    lambda d: C.section_assemble(carried(d)).select("doc_id", "grp", C.typed(T.norm("section"), T.norm("text"), RULES).alias("chunk_type")),
    "documents",
    sql=f"WITH {D_SECTIONS} SELECT doc_id, grp, {D_TYPED} AS chunk_type FROM sections",
)
D_WINDOWS = f"""ww AS (SELECT doc_id AS id, {d_words('text')} AS w FROM documents), st AS (SELECT id, w, unnest(CASE WHEN len(w) <= 220 THEN [0] ELSE range(0, greatest(1, len(w) - 35), 135) END) AS start FROM ww WHERE len(w) > 0),
    windows AS (SELECT id, CAST(start / 135 AS INTEGER) AS k, CAST(start AS INTEGER) AS start, CASE WHEN len(w) <= 220 THEN w ELSE w[start + 1:start + 170] END AS p FROM st)"""
P.add("c6_word_windows", lambda d: C.word_windows(d).select("id", "k", "start", "words", F.md5("text").alias("text")), "documents", sql=f"WITH {D_WINDOWS} SELECT id, k, start, CAST(len(p) AS INTEGER) AS words, md5(array_to_string(p, ' ')) AS text FROM windows")
D_SENT = rf"""ss AS (SELECT doc_id AS id, string_split(regexp_replace(text, '([.!?;])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    sents AS (SELECT id, CAST(pos - 1 AS INTEGER) AS pos, {d_ws('s')} AS text FROM (SELECT id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM ss) WHERE {d_ws('s')} <> '')"""
P.add("c7_sentence_split", lambda d: C.sentences(d).select("id", "pos", F.md5("text").alias("text")), "documents", sql=f"WITH {D_SENT} SELECT id, pos, md5(text) AS text FROM sents")
P.add(
    "c8_sentence_children",
    lambda d: C.sentence_children(C.sentences(d), ("with the", "avec"), ("that", "que")).select("id", "pos", F.md5("text").alias("text")),
    "documents",
    sql=f"""WITH {D_SENT}, b AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY id ORDER BY pos), '') AS b FROM sents)
        SELECT id, pos, md5(CASE WHEN contains({d_norm('b')}, 'that') OR contains({d_norm('b')}, 'que') THEN b || ' ' || text ELSE text END) AS text FROM b WHERE contains({d_norm('text')}, 'with the') OR contains({d_norm('text')}, 'avec')""",
)
P.add(
    "c9_bullet_children",
    lambda d: C.bullet_children(carried(d).where(~F.col("heading")), F.when(T.norm("text").contains("with"), "howto").otherwise("fact"), ("doc_id", "grp")).select("doc_id", "grp", "pos", "kind"),
    "documents",
    sql=f"WITH {D_CARRY} SELECT doc_id, grp, pos, CASE WHEN contains({d_norm('text')}, 'with') THEN 'howto' ELSE 'fact' END AS kind FROM carried WHERE NOT heading AND len({d_words('text')}) >= 4 QUALIFY count(*) OVER (PARTITION BY doc_id, grp) >= 2",
)
P.add(
    "c10_line_children",
    lambda d: G.lines(d).select("doc_id", "pos", C.line_kind(F.col("text"), ("was", "est "), ("in", "at", "on")).alias("kind")).where("kind <> ''"),
    "documents",
    sql=f"""WITH {D_LINES}, k AS (SELECT doc_id, pos, CASE WHEN len({d_words('text')}) > 14 THEN '' WHEN contains({d_norm('text')}, 'was') OR contains({d_norm('text')}, 'est ') THEN 'role' WHEN contains({d_norm('text')}, '@') OR regexp_matches(text, '[0-9]{{6}}') THEN 'contact'
        WHEN CAST(contains({d_norm('text')}, 'in') AS INT) + CAST(contains({d_norm('text')}, 'at') AS INT) + CAST(contains({d_norm('text')}, 'on') AS INT) >= 2 THEN 'location' ELSE '' END AS kind FROM lines) SELECT * FROM k WHERE kind <> ''""",
)
P.add(
    "c11_record_group",
    lambda d: C.record_group(G.lines(d)).select("doc_id", "rec", F.md5("record").alias("record")),
    "documents",
    sql=f"WITH {D_LINES}, n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM lines) SELECT doc_id, CAST(k // 3 AS INTEGER) AS rec, md5(string_agg(text, ' | ' ORDER BY k)) AS record FROM n GROUP BY ALL",
)
KIND3 = lambda: F.when(T.norm("text").contains("@"), "contact").when(T.norm("text").contains(" in "), "location").otherwise("overview")
P.add(
    "c12_sentence_records",
    lambda d: C.sentences(d).select("id", KIND3().alias("kind")).groupBy("id", "kind").agg(F.count("*").alias("n")),
    "documents",
    sql=f"WITH {D_SENT} SELECT id, CASE WHEN contains({d_norm('text')}, '@') THEN 'contact' WHEN contains({d_norm('text')}, ' in ') THEN 'location' ELSE 'overview' END AS kind, count(*) AS n FROM sents GROUP BY ALL",
)
P.add(
    "c13_chunk_identity",
    lambda d: d.select("doc_id", C.identity("chunk", F.col("source"), F.col("doc_id"), F.col("text")).alias("id"), F.substring(F.sha1(F.concat(T.norm("text"), F.lit("\0"))), 1, 12).alias("dedupe_key")),
    "documents",
    sql=f"SELECT doc_id, 'chunk-' || substr(sha1(source || chr(0) || doc_id || chr(0) || text || chr(0)), 1, 12) AS id, substr(sha1({d_norm('text')} || chr(0)), 1, 12) AS dedupe_key FROM documents",
)
_FIRST = rf"string_split(regexp_replace({d_ws('text')}, '([.!?;:])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1))[1]"
P.add(
    "c14_chunk_summary",
    lambda d: d.select("doc_id", C.summary(F.col("text")).alias("summary")),
    "documents",
    sql=f"SELECT doc_id, CASE WHEN len(w) <= 28 THEN f ELSE regexp_replace(array_to_string(w[1:28], ' '), '[,;:. ]+$', '') || '...' END AS summary FROM (SELECT doc_id, f, {d_words('f')} AS w FROM (SELECT doc_id, {_FIRST} AS f FROM documents))",
)


def priorities(spark):
    return spark.createDataFrame([("fact", 80), ("overview", 70), ("history", 40)], "chunk_type string, type_priority int")


P.add("c15_chunk_priority", lambda c: C.with_priority(c, priorities(c.sparkSession)).select("id", "type_priority"), "corpus_v", sql="SELECT id, CASE chunk_type WHEN 'fact' THEN 80 WHEN 'overview' THEN 70 WHEN 'history' THEN 40 ELSE 50 END AS type_priority FROM corpus_v")
_SRC = lambda: F.substring("source", 4, 9).cast("int")
P.add(
    "c16_provenance",
    lambda d: d.select("doc_id", F.when(_SRC() < 10, "web").otherwise("local").alias("source_kind"), F.lower(F.when(_SRC() % 3 == 0, "True").otherwise("no")).isin("true", "1", "yes").alias("is_authoritative"), F.when(_SRC() % 2 == 0, "unit").otherwise("document").alias("entity_type")),
    "documents",
    sql="SELECT doc_id, CASE WHEN s < 10 THEN 'web' ELSE 'local' END AS source_kind, s % 3 = 0 AS is_authoritative, CASE WHEN s % 2 = 0 THEN 'unit' ELSE 'document' END AS entity_type FROM (SELECT doc_id, CAST(substr(source, 4, 9) AS INT) AS s FROM documents)",
)
#: What the children of a section are found by: markers and leads of two kinds of sentences, markers of roles and places in lines.
TEACH, LEADS, TRAIN, ROLES, PLACES = ("with the", "avec"), ("that", "que"), ("license", "and the"), ("was", "est "), ("in", "at", "on")
_entity = lambda: F.lower("text").startswith("the ") & (F.size(T.words("text")) <= 12)
_kind = f"""CASE WHEN len({d_words('t')}) > 14 THEN '' WHEN {d_hints(d_norm('t'), ROLES)} THEN 'role' WHEN contains({d_norm('t')}, '@') OR regexp_matches(t, '[0-9]{{6}}') THEN 'contact'
    WHEN {' + '.join(f"CAST(contains({d_norm('t')}, '{p}') AS INT)" for p in PLACES)} >= 2 THEN 'location' ELSE '' END"""
P.add(
    "c17_adaptive_chunk",
    lambda d: C.adaptive(d, HINTS, RULES, _entity(), TEACH, LEADS, TRAIN, ROLES, PLACES).groupBy("doc_id", "part", "chunk_type").agg(F.count("*").alias("n"), F.count("parent_id").alias("children"), F.sum("priority").cast("long").alias("priority")),
    "documents",
    sql=rf"""WITH {D_SECTIONS.replace('max(section) AS section,', 'max(section) AS section, max(entity) AS entity,')}, t AS (SELECT doc_id, grp, entity, text, {D_TYPED} AS base, {d_words('text')} AS w FROM sections),
        wn AS (SELECT doc_id, grp, entity, base, unnest(CASE WHEN len(w) <= 220 THEN [0] ELSE range(0, len(w) - 35, 135) END) AS start, w FROM t),
        p AS (SELECT doc_id, grp, entity, 'window' AS part, base AS chunk_type, array_to_string(CASE WHEN len(w) <= 220 THEN w ELSE w[start + 1:start + 170] END, ' ') AS text, start AS k FROM wn),
        sn AS (SELECT doc_id, grp, entity, base, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM (SELECT *, string_split(regexp_replace(text, '([.!?;])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM t)),
        sl AS (SELECT *, {d_ws('s')} AS t, coalesce(lag({d_ws('s')}) OVER (PARTITION BY doc_id, grp ORDER BY k), '') AS b FROM sn WHERE {d_ws('s')} <> ''),
        sc AS (SELECT doc_id, grp, entity, 'sentence' AS part, CASE WHEN {d_hints(d_norm('t'), TEACH)} THEN 'teaching' ELSE 'training' END AS chunk_type, CASE WHEN {d_hints(d_norm('t'), TEACH)} AND {d_hints(d_norm('b'), LEADS)} THEN b || ' ' || t ELSE t END AS text, k
            FROM sl WHERE {d_hints(d_norm('t'), TEACH)} OR ({d_hints(d_norm('t'), TRAIN)} AND base NOT IN ('contact', 'location'))),
        ln AS (SELECT doc_id, grp, entity, base, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM (SELECT *, string_split(text, chr(10)) AS x FROM t)),
        bl AS (SELECT doc_id, grp, entity, 'bullet' AS part, CASE WHEN base = 'howto' THEN 'howto' ELSE 'fact' END AS chunk_type, t AS text, k FROM ln WHERE base IN ('function', 'duty', 'function_duty', 'howto') AND len({d_words('t')}) >= 4 QUALIFY count(*) OVER (PARTITION BY doc_id, grp) >= 2),
        lc AS (SELECT doc_id, grp, entity, 'line' AS part, {_kind} AS chunk_type, t AS text, k FROM ln WHERE len({d_words('t')}) >= 3 AND {_kind} <> '' AND NOT ({_kind} = 'location' AND base = 'history')),
        u AS (SELECT *, 0 AS o FROM p UNION ALL SELECT *, 1 FROM sc UNION ALL SELECT *, 2 FROM bl UNION ALL SELECT *, 3 FROM lc),
        one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_type, {d_ascii('entity')}, {d_ascii('text')} ORDER BY grp, o, k) = 1)
        SELECT doc_id, part, chunk_type, count(*) AS n, count(CASE WHEN part <> 'window' THEN 1 END) AS children, CAST(sum(CASE chunk_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.PRIORITY.items())} ELSE {K.PRIORITY['generic']} END) AS BIGINT) AS priority FROM one GROUP BY ALL""",
)

_list = lambda c: F.array_join(c, "|")


def d_extract(x, p):
    m = f"regexp_extract_all({x}, '{p}')"
    return f"array_to_string(list_filter({m}, lambda v, i: list_position({m}, v) = i)[1:12], '|')"


D_EMAIL, D_URL = C.EMAIL, C.URL.replace("'", "''")
P.add("m1_extract_emails", lambda d: d.select("doc_id", _list(C.extract(F.col("text"), C.EMAIL)).alias("emails")), "documents", sql=f"SELECT doc_id, {d_extract('text', D_EMAIL)} AS emails FROM documents")
P.add("m2_extract_urls", lambda p: p.select("page_id", _list(C.extract(F.concat_ws(" ", "url", "html"), C.URL)).alias("urls")), "pages", sql=f"SELECT page_id, {d_extract(chr(117) + 'h', D_URL)} AS urls FROM (SELECT page_id, url || ' ' || html AS uh FROM pages)")
_DATE = lambda: F.concat_ws(" ", F.lit("on"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("or in"), F.date_format("o_orderdate", "yyyy"))
_DD = "'on ' || strftime(o_orderdate, '%-d/%-m/%Y') || ' or in ' || strftime(o_orderdate, '%Y')"
P.add(
    "m3_extract_dates",
    lambda o: o.select("o_orderkey", _list(C.dates(_DATE())).alias("dates")),
    "orders",
    sql=rf"SELECT o_orderkey, array_to_string(list_filter(m, lambda v, i: list_position(m, v) = i), '|') AS dates FROM (SELECT o_orderkey, list_concat(regexp_extract_all(t, '\b[0-9]{{1,2}}/[0-9]{{1,2}}(?:/[0-9]{{2,4}})?\b'), regexp_extract_all(t, '\b(?:19|20)[0-9]{{2}}\b')) AS m FROM (SELECT o_orderkey, {_DD} AS t FROM orders))",
)
_some = lambda a: f"CAST(greatest(1, len(list_filter({a}, lambda t: trim(t) <> ''))) AS INTEGER)"
P.add(
    "m4_text_stats",
    lambda d: d.select("doc_id", *C.text_stats(F.col("text"))),
    "documents",
    sql=f"SELECT doc_id, CAST(len({d_words('text')}) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars, {_some('string_split(text, chr(10))')} AS lines, {_some(chr(115) + 'p')} AS sentences FROM (SELECT *, string_split(regexp_replace({d_ws('text')}, '([.!?;:]) ', '\\1' || chr(1), 'g'), chr(1)) AS sp FROM documents)",
)
MARKERS = {"contact": ("@", "tel"), "location": (" in the", "straße"), "role": ("was the", "est le"), "howto": ("for the", "pour")}
P.add(
    "m5_marker_flags",
    lambda d: d.withColumn("x", T.norm_ascii("text")).select("doc_id", *[T.any_hint(F.col("x"), list(w)).alias(f"has_{k}") for k, w in MARKERS.items()]),
    "documents",
    sql=f"SELECT doc_id, {', '.join(f'{d_hints(chr(120), w)} AS has_{k}' for k, w in MARKERS.items())} FROM (SELECT doc_id, {d_ascii('text')} AS x FROM documents)",
)
TOPICS = [("law", ("of the", "by the")), ("trade", ("with", "from")), ("place", (" in ", " at "))]


def d_labels(x, hints, *more):
    tags = ", ".join([*[f"CASE WHEN {d_hints(x, w)} THEN '{t}' END" for t, w in hints], *more])
    m = f"list_filter([{tags}], lambda t: t IS NOT NULL AND t <> '')"
    return f"array_to_string(list_filter({m}, lambda v, i: list_position({m}, v) = i)[1:12], '|')"


P.add(
    "m6_topic_tags",
    lambda c: c.withColumn("x", T.norm_ascii("text")).select("id", _list(C.labels(F.col("x"), TOPICS, F.col("chunk_type"), F.col("entity_name"))).alias("tags")),
    "corpus_v",
    sql=f"SELECT id, {d_labels('x', TOPICS, 'chunk_type', 'entity_name')} AS tags FROM (SELECT *, {d_ascii('text')} AS x FROM corpus_v)",
)
INTENTS = lambda: F.when(F.col("chunk_type") == "fact", "lookup").when(F.col("chunk_type") == "overview", "summary").otherwise("read")
P.add(
    "m7_intent_tags",
    lambda c: c.withColumn("x", T.norm_ascii("text")).select("id", _list(C.labels(F.col("x"), [], INTENTS(), F.when(F.col("x").contains("@"), "contact"), F.when(F.col("x").contains("for the"), "howto"), limit=10)).alias("tags")),
    "corpus_v",
    sql=f"""SELECT id, {d_labels('x', [], "CASE chunk_type WHEN 'fact' THEN 'lookup' WHEN 'overview' THEN 'summary' ELSE 'read' END", "CASE WHEN contains(x, '@') THEN 'contact' END", "CASE WHEN contains(x, 'for the') THEN 'howto' END")} AS tags FROM (SELECT *, {d_ascii('text')} AS x FROM corpus_v)""",
)
_ALL = "title || ' ' || entity_name || ' ' || text"
P.add(
    "m8_search_terms",
    lambda c: c.select("id", F.slice(F.array_distinct(T.keyword_terms(F.concat_ws(" ", "title", "entity_name", "text"))), 1, 28).alias("t")).select("id", _list("t").alias("terms")),
    "corpus_v",
    sql=f"SELECT id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:28], '|') AS terms FROM (SELECT id, {d_terms(_ALL, T.STOPWORDS)} AS w FROM corpus_v)",
)
INTENT_TAGS = {"fact": ("lookup", "contact"), "overview": ("summary",), "history": ("timeline", "howto")}


def metadata(c):
    rows = c.select(
        "id", "doc_id", "title", "text", "chunk_type", "entity_name", "source_kind", F.col("domain").alias("section"), F.lit("source").alias("entity_type"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://docs.example/"), "doc_id")).otherwise(F.concat(F.lit("file-"), "doc_id")).alias("source_path"),
        F.concat(F.lit("c"), F.col("priority") % 5).alias("category"), F.lit("2026").alias("published_at"), F.array("domain", F.lit("")).alias("keywords"),
    )
    return C.metadata(rows, TOPICS, MARKERS, INTENT_TAGS)


_uniq = lambda m, n: f"list_filter({m}, lambda v, i: list_position({m}, v) = i)[1:{n}]"
_em, _ur = f"regexp_extract_all(c, '{D_EMAIL}')", f"list_filter(list_append({_uniq(f'regexp_extract_all(c, {chr(39)}{D_URL}{chr(39)})', 12)}, source_url), lambda u: u <> '')"
_dt = rf"list_concat(regexp_extract_all(c, '\b[0-9]{{1,2}}/[0-9]{{1,2}}(?:/[0-9]{{2,4}})?\b'), regexp_extract_all(c, '\b(?:19|20)[0-9]{{2}}\b'))"
_it = "list_filter(list_concat(CASE chunk_type " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(t) for t in ts)}]" for k, ts in INTENT_TAGS.items()) + " ELSE [] END, [" + ", ".join(f"CASE WHEN {d_hints('x', MARKERS[k])} THEN '{t}' END" for k, t in (("contact", "contact"), ("location", "location"), ("role", "person_lookup"), ("howto", "howto"))) + "]), lambda t: t IS NOT NULL)"
_tt = "list_filter([" + ", ".join([*[f"CASE WHEN {d_hints('x', w)} THEN '{t}' END" for t, w in TOPICS], "chunk_type", "entity_name"]) + "], lambda t: t IS NOT NULL AND t <> '')"
D_METADATA = f"""m0 AS (SELECT *, domain AS section, {d_ws('text')} AS c, CASE WHEN doc_id % 3 = 0 THEN 'https://docs.example/' || doc_id ELSE '' END AS source_url, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'file-' || doc_id END AS source_file FROM corpus_v),
    m1 AS (SELECT *, {d_ascii('c')} AS x, {_em} AS em, {_ur} AS ur, {_dt} AS dt FROM m0), m2 AS (SELECT *, {_tt} AS tt, {_it} AS it FROM m1), m3 AS (SELECT *, {_uniq('tt', 12)} AS topic_tags, {_uniq('it', 10)} AS intent_tags FROM m2),
    m4 AS (SELECT *, {d_terms("concat_ws(' ', title, section, entity_name, chunk_type, array_to_string(topic_tags, ' '), c)", T.STOPWORDS)} AS st, string_split(regexp_replace(c, '([.!?;:]) ', '\\1' || chr(1), 'g'), chr(1)) AS sp FROM m3),
    md AS (SELECT id, doc_id, title AS doc_title, section, {d_ascii('section')} AS section_norm, chunk_type, {d_ascii('chunk_type')} AS chunk_type_norm, 'source' AS entity_type, entity_name, {d_ascii('entity_name')} AS entity_norm, source_kind, source_url, source_file,
        topic_tags, intent_tags, {_uniq('st', 28)} AS search_terms, CAST(len({d_words('c')}) AS INTEGER) AS word_count, CAST(length(c) AS INTEGER) AS char_count, {_some('string_split(text, chr(10))')} AS line_count, {_some('sp')} AS sentence_count,
        {', '.join(f"{d_hints('x', MARKERS[k])} AS has_{k}" for k in ('contact', 'location', 'role', 'howto'))}, len({_uniq('em', 12)}) > 0 AS has_email, len({_uniq('ur', 12)}) > 0 AS has_url, {_uniq('em', 12)} AS emails, {_uniq('ur', 12)} AS urls,
        {_uniq('dt', 1000)} AS dates, list_filter({_uniq('dt', 1000)}, lambda d: regexp_full_match(d, '(?:19|20)[0-9]{{2}}')) AS years, 'c' || priority % 5 AS category, '2026' AS published_at, [domain, ''] AS keywords FROM m4)"""
_ARRAYS = ("topic_tags", "intent_tags", "search_terms", "emails", "urls", "dates", "years", "keywords")
P.add(
    "m9_metadata_struct",
    lambda c: metadata(c).select("id", "metadata.*").select("*", *[F.array_join(k, "|").alias(f"{k}_") for k in _ARRAYS]).drop(*_ARRAYS).withColumn("doc_title", F.md5("doc_title")),
    "corpus_v",
    sql=f"WITH {D_METADATA} SELECT * EXCLUDE ({', '.join(_ARRAYS)}) REPLACE (md5(doc_title) AS doc_title), {', '.join(f"array_to_string({k}, '|') AS {k}_" for k in _ARRAYS)} FROM md",
)
_text = lambda k: f"nullif(trim({k}), '')"
_flat = lambda k: f"nullif(trim(array_to_string(list_filter({k}, lambda t: trim(t) <> ''), ' ')), '')"


def meta_text(c):
    rows = metadata(c)
    return rows.select("id", C.metadata_text(rows).alias("t"))


P.add(
    "m10_metadata_text",
    lambda c: meta_text(c).select("id", F.md5("t").alias("text")),
    "corpus_v",
    sql=f"WITH {D_METADATA} SELECT id, md5(concat_ws(' ', {', '.join(_text(k) for k in C.SCALARS)}, {', '.join(_flat(k) for k in C.LISTS)})) AS text FROM md",
)

PREFIXES, SUFFIXES = ("the", "of", "and"), ("the", "of")


def d_sanitize(x: str) -> str:
    out = d_ascii(x)
    for p in PREFIXES:
        out = f"CASE WHEN starts_with({out}, '{p} ') THEN trim(substr({out}, {len(p) + 1})) ELSE {out} END"
    for s in SUFFIXES:
        out = f"trim(regexp_replace({out}, '{s}$', ''))"
    return f"CASE WHEN length({out}) >= 4 THEN {out} END"


def spoken(c):
    return c.where("role = 'user'").select("conv_id", "turn", K.sanitize(F.col("text"), PREFIXES, SUFFIXES).alias("variant")).where("variant is not null")


D_SPOKEN = f"sp AS (SELECT conv_id, turn, {d_sanitize('text')} AS variant FROM conversations WHERE role = 'user' AND {d_sanitize('text')} IS NOT NULL)"
P.add("k1_variant_sanitize", spoken, "conversations", sql=f"WITH {D_SPOKEN} SELECT * FROM sp")
P.add(
    "k2_variant_group",
    lambda c: K.variant_group(spoken(c), "conv_id", "turn").select("conv_id", _list("variants").alias("variants")),
    "conversations",
    sql=f"WITH {D_SPOKEN}, f AS (SELECT conv_id, variant AS v, min(turn) AS o FROM sp GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o, v) AS r FROM f QUALIFY r <= 12) SELECT conv_id, string_agg(v, '|' ORDER BY r) AS variants FROM r GROUP BY conv_id",
)


def qa(t, odd):
    return t.where(f"conv_id % 3 <> {odd}").select(F.concat(F.lit("d"), F.col("conv_id") % 4).alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "question", "answer", F.array(F.concat(F.lit("k"), F.col("turn"))).alias("keywords"))


D_QA = lambda odd, s: f"SELECT 'd' || conv_id % 4 AS domain, {s} AS s, conv_id * 1000 + turn AS seq, question, answer, 'k' || turn AS kw, {d_ascii('question')} AS key FROM turns WHERE conv_id % 3 <> {odd}" + (" AND trim(question) <> '' AND trim(answer) <> ''" if s else "")
P.add(
    "k3_faq_upsert",
    lambda t: K.faq_upsert(qa(t, 0), qa(t, 1)).withColumn("keywords", _list("keywords")),
    "turns",
    sql=f"""WITH a AS (SELECT * FROM ({D_QA(0, 0)} UNION ALL {D_QA(1, 1)}) WHERE key <> '') SELECT domain, key, arg_max(question, s * 1000000000 + seq) AS question, arg_max(answer, s * 1000000000 + seq) AS answer,
        array_to_string(list_filter(list(kw ORDER BY s, seq), lambda x, i: list_position(list(kw ORDER BY s, seq), x) = i)[1:24], '|') AS keywords FROM a GROUP BY domain, key""",
)


def facts(d, odd):
    return d.where(f"doc_id % 2 = {odd}").select(F.col("lang").alias("domain"), F.col("doc_id").alias("seq"), F.trim("text").alias("text"))


D_FACTS = f"fa AS (SELECT lang AS domain, doc_id AS seq, trim(text) AS text, {d_ascii('text')} AS key FROM documents)"
D_APPENDED = f"""{D_FACTS}, ap AS (SELECT domain, seq, text FROM fa WHERE seq % 2 = 0 UNION ALL (SELECT domain, seq, text FROM fa o WHERE seq % 2 = 1 AND key <> '' AND NOT EXISTS (SELECT 1 FROM fa e WHERE e.seq % 2 = 0 AND e.domain = o.domain AND e.key = o.key)
    QUALIFY row_number() OVER (PARTITION BY domain, key ORDER BY seq) = 1))"""
P.add("k4_fact_append", lambda d: K.fact_append(facts(d, 0), facts(d, 1)).select("domain", "seq"), "documents", sql=f"WITH {D_APPENDED} SELECT domain, seq FROM ap")


def records(s):
    return s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("domain"), F.col("s_suppkey").alias("seq"), K.record_text(F.col("s_name"), F.col("s_nationkey"), F.col("s_acctbal")).alias("text"))


P.add(
    "k5_record_to_text",
    lambda s, c: s.select(F.col("s_suppkey").alias("k"), K.record_text(F.col("s_name"), F.col("s_nationkey")).alias("text")).unionByName(c.select(F.col("c_custkey").alias("k"), K.record_text(F.col("c_name"), F.col("c_mktsegment")).alias("text"))),
    "supplier",
    "customer",
    sql="SELECT s_suppkey AS k, concat_ws(' | ', nullif(trim(s_name), ''), CAST(s_nationkey AS VARCHAR)) AS text FROM supplier UNION ALL SELECT c_custkey, concat_ws(' | ', nullif(trim(c_name), ''), nullif(trim(c_mktsegment), '')) FROM customer",
)
QA_RULES = [("contact", ("by",), ("@",)), ("howto", ("for",), ("with the",)), ("fact", ("that",), ("this",))]
D_QATYPE = "CASE " + " ".join(f"WHEN {d_hints(d_norm('question'), s)} OR {d_hints(d_norm('answer'), b)} THEN '{n}'" for n, s, b in QA_RULES) + " ELSE 'generic' END"
D_QATYPE_ASCII = D_QATYPE.replace(d_norm("question"), d_ascii("question")).replace(d_norm("answer"), d_ascii("answer"))
P.add("k6_record_type", lambda t: t.select("turn_id", C.typed(T.norm("question"), T.norm("answer"), QA_RULES).alias("kind")), "turns", sql=f"SELECT turn_id, {D_QATYPE} AS kind FROM turns")


def seed(s, d, t, c, n):
    told = s.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("domain"), F.col("s_suppkey").alias("seq"), K.record_text(F.col("s_name"), F.col("s_nationkey")).alias("text"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "agent").otherwise("").alias("role"))
    places = c.where("c_custkey % 50 = 0").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("domain"), F.col("c_custkey").alias("seq"), K.record_text(F.col("c_name"), F.col("c_mktsegment")).alias("text"), F.col("c_mktsegment").alias("city"), F.lit("").alias("address"))
    titles = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("domain"), F.col("n_name").alias("domain_title"))
    fact_meta = d.where("doc_id % 10 = 0").groupBy(T.norm_ascii("text").alias("key")).agg(F.min("source").alias("title"))
    qa_meta = t.where("turn % 4 = 1").groupBy(T.norm_ascii("question").alias("key")).agg(F.lit("").alias("unit_name"), F.min(F.concat(F.lit("t"), "turn")).alias("topic"), F.array(F.lit("asked")).alias("keywords"))
    by_fact, by_qa = C.typed(T.norm_ascii("text"), T.norm_ascii("text"), SEED_RULES), C.typed(T.norm_ascii("question"), T.norm_ascii("answer"), QA_RULES)
    return K.seed_chunks(told, places, K.fact_append(facts(d, 0), facts(d, 1)), K.faq_upsert(qa(t, 0), qa(t, 1)).withColumn("seq", F.lit(0)), titles, by_fact, by_qa, fact_meta, qa_meta)


SEED_RULES = [("contact", ("@",), ("@",)), ("history", ("license",), ("license",))]
D_SEED_TYPE = "CASE WHEN contains(key, '@') THEN 'contact' WHEN contains(key, 'license') THEN 'history' ELSE 'generic' END"
_prio = "CASE coalesce(p.kind, '') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PRIORITY.items()) + f" ELSE {K.PRIORITY['generic']} END"
D_SEED = f"""{D_APPENDED}, a AS (SELECT * FROM ({D_QA(0, 0)} UNION ALL {D_QA(1, 1)}) WHERE key <> ''),
    q AS (SELECT domain, key, arg_max(question, s * 1000000000 + seq) AS question, arg_max(answer, s * 1000000000 + seq) AS answer, list(kw ORDER BY s, seq) AS kws FROM a GROUP BY domain, key),
    fm AS (SELECT {d_ascii('text')} AS key, min(source) AS title FROM documents WHERE doc_id % 10 = 0 GROUP BY 1), qm AS (SELECT {d_ascii('question')} AS key, min('t' || turn) AS topic FROM turns WHERE turn % 4 = 1 GROUP BY 1),
    tt AS (SELECT 'n' || n_nationkey AS domain, n_name AS domain_title FROM nation),
    u0 AS (SELECT 'n' || s_nationkey AS domain, 'record' AS kind, 0 AS k, s_suppkey AS seq, concat_ws(' | ', nullif(trim(s_name), ''), CAST(s_nationkey AS VARCHAR)) AS text, CASE WHEN s_suppkey % 3 = 0 THEN 'role' ELSE 'record' END AS chunk_type, NULL AS title, nullif(trim(s_name), '') AS entity, [s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'agent' ELSE '' END] AS kws FROM supplier
        UNION ALL SELECT 'n' || c_nationkey, 'location', 1, c_custkey, concat_ws(' | ', nullif(trim(c_name), ''), nullif(trim(c_mktsegment), '')), 'location', NULL, nullif(trim(c_mktsegment), ''), [c_mktsegment] FROM customer WHERE c_custkey % 50 = 0
        UNION ALL SELECT domain, 'fact', 2, seq, text, {D_SEED_TYPE}, NULL, title, [coalesce(title, '')] FROM (SELECT ap.*, {d_ascii('text')} AS key FROM ap) LEFT JOIN fm USING (key)
        UNION ALL SELECT domain, 'qa', 3, 0, answer, {D_QATYPE_ASCII}, nullif(trim(question), ''), topic, CASE WHEN topic IS NULL THEN kws ELSE list_append(kws, 'asked') END FROM q LEFT JOIN qm USING (key)),
    u AS (SELECT u0.domain, kind, k, seq, {d_ws('text')} AS text, chunk_type, coalesce(title, domain_title, u0.domain) AS title, coalesce(entity, domain_title, u0.domain) AS entity_name, list_filter(kws, lambda x: x <> '') AS kws FROM u0 LEFT JOIN tt USING (domain)),
    o AS (SELECT * FROM u WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY domain, {d_ascii('chunk_type')}, {d_ascii('entity_name')}, {d_ascii('text')} ORDER BY k, seq) = 1)"""
P.add(
    "k7_seed_chunks",
    lambda s, d, t, c, n: seed(s, d, t, c, n).select("domain", "kind", "chunk_type", F.md5("title").alias("title"), "entity_name", F.md5("text").alias("text"), F.col("priority").cast("int").alias("priority"), _list("keywords").alias("keywords")),
    "supplier",
    "documents",
    "turns",
    "customer",
    "nation",
    sql=f"""WITH {D_SEED}, p AS (SELECT *, CASE WHEN kind = 'qa' THEN 'qa' ELSE chunk_type END AS pk FROM o) SELECT domain, kind, chunk_type, md5(title) AS title, entity_name, md5(text) AS text, {_prio.replace("coalesce(p.kind, '')", 'pk')} AS priority,
        array_to_string(list_filter(kws, lambda x, i: list_position(kws, x) = i)[1:24], '|') AS keywords FROM p""",
)
P.add(
    "k8_dedupe_first",
    lambda d: K.dedupe_first(d.withColumn("key", F.sha1("text")), ["lang", "key"], F.col("doc_id") % 2, "doc_id").select("doc_id"),
    "documents",
    sql="SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id % 2, doc_id) = 1",
)
P.add(
    "k9_chunk_order",
    lambda c: K.chunk_order(c).select("id", "rank", "chunks"),
    "corpus_v",
    sql="SELECT id, CAST(row_number() OVER (PARTITION BY domain ORDER BY priority DESC, chunk_type DESC, entity_name DESC, id DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY domain) AS chunks FROM corpus_v",
)
