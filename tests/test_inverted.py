"""The inverted index against brute force in plain Python: single signals, fusion, tiers, small shards and blocks, ties and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import inverted as V

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]


def corpus(seed=1, n=160):
    rnd = random.Random(seed)
    docs = [(i, " ".join(rnd.choices(WORDS, [30, 12, 8, 5, 3, 2, 1, 1], k=rnd.randint(0, 25)))) for i in range(n)]
    docs += [(1000 + i, "alpha beta beta") for i in range(20)] + [(2000, None), (2001, ""), (7, "eta eta"), (2002, "alpha " * 9000)]
    return docs, [(f"q{i}", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 5)))) for i in range(25)] + [("qx", "unseen words"), ("qy", ""), ("qz", "alpha unseen")]


def signals(docs, query):
    """{signal: {row: score}} by the formulas."""
    toks = [(t or "").split() for _, t in docs]
    grams = [x + [f"{a} {b}" for a, b in zip(x, x[1:])] for x in toks]
    n = len(docs)
    df, gdf = Counter(t for x in toks for t in set(x)), Counter(t for x in grams for t in set(x))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    gidf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in gdf.items()}
    average = sum(map(len, toks)) / n
    q = query.split()
    qg = {t: c for t, c in Counter(q + [f"{a} {b}" for a, b in zip(q, q[1:])]).items() if t in gidf}
    size = math.sqrt(sum((c * gidf[t]) ** 2 for t, c in qg.items())) or 1
    out = {"bm25": {}, "tfidf": {}, "overlap": {}}
    for row, (x, g) in enumerate(zip(toks, grams)):
        if not set(x) & set(q):
            continue
        c = Counter(x)
        out["bm25"][row] = sum(k * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(x) / average)) for t, k in Counter(q).items() if t in c)
        out["overlap"][row] = len(set(x) & set(q)) / len(set(q))
        w = {t: k * gidf[t] for t, k in Counter(g).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out["tfidf"][row] = sum(qg[t] * gidf[t] / size * w[t] / norm for t in qg if t in w)
    return out


def blend(docs, query, weights):
    """The fusion of single scores, each between its least and greatest; absent documents count as 0 in the range."""
    got, total = signals(docs, query), sum(weights.values())
    out = Counter()
    for s, w in weights.items():
        scores = got[s]
        if not scores:
            continue
        high, low = max(scores.values()), min(scores.values())
        low = min(0.0, low) if len(scores) < len(docs) else low
        for row, v in scores.items():
            out[row] += w / total * ((v - low) / (high - low) if high - low >= 1e-9 else float(high > 0))
    return dict(out)


def best(docs, scores, k):
    rows = sorted(((-round(v, 9), docs[r][0], v) for r, v in scores.items()))[:k]
    return [(i, pytest.approx(v, abs=1e-8)) for _, i, v in rows]


def tables(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id string, query string")


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (-round(r.score, 9), r.id)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("shard", [8192, 37])
def test_signals_and_fusion(spark, monkeypatch, shard):
    monkeypatch.setattr(V, "SHARD", shard)
    docs, queries = corpus()
    d, q = tables(spark, docs, queries)
    index = V.build(d, T.alnum_tokens("text"), "doc_id", grams=2, norms=True)
    assert (index.count, index.length) == (len(docs), sum(len((t or "").split()) for _, t in docs))
    tokens = T.alnum_tokens("query")
    for s in ("bm25", "tfidf", "overlap"):
        got = ranked(V.search(index, q, tokens, 6, s))
        for name, text in queries:
            assert got.get(name, []) == best(docs, signals(docs, text)[s], 6), (s, text)
    weights = {"tfidf": 0.28, "overlap": 0.18, "bm25": 0.18}
    got, everything = ranked(V.fused(index, q, tokens, 6, weights)), ranked(V.fused(index, q, tokens, None, weights))
    for name, text in queries:
        want = blend(docs, text, weights)
        assert got.get(name, []) == best(docs, want, 6)
        assert everything.get(name, []) == best(docs, want, len(docs))
    share = V.reading(V.search(index, q, tokens, 1)).first().share
    assert 0 < share <= 1
    index.release()


def test_tiers_and_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERIES", 5)
    docs, queries = corpus(3)
    d, q = tables(spark, docs, queries)
    index = V.build(d, T.alnum_tokens("text"), "doc_id")
    got = {}
    for r in V.fused(index, q, T.alnum_tokens("query"), 2, {"bm25": 1.0}, F.col("id") % 3).collect():
        got.setdefault((r.query_id, r.id % 3), []).append(r.id)
    for name, text in queries:
        scores = blend(docs, text, {"bm25": 1.0})
        for tier in range(3):
            want = best(docs, {r: v for r, v in scores.items() if docs[r][0] % 3 == tier}, 2)
            assert sorted(got.get((name, tier), [])) == sorted(i for i, _ in want)


def test_no_documents_and_no_queries(spark):
    d, q = tables(spark, *corpus())
    index = V.build(d.limit(0), T.alnum_tokens("text"), "doc_id", 2, True)
    assert V.search(index, q, T.alnum_tokens("query"), 3).count() == 0 and V.fused(index, q, T.alnum_tokens("query"), 3, {"tfidf": 1.0}).count() == 0
    index = V.build(d, T.alnum_tokens("text"), "doc_id")
    assert V.search(index, q.limit(0), T.alnum_tokens("query"), 3).count() == 0


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    lists, impacts = {}, {"bm25": {}}
    for t in range(4):
        place = np.sort(rng.choice(6400, 1500, replace=False)).astype(np.int32)
        lists[t] = (place, np.ones(1500, np.int32))
        impacts["bm25"][t] = rng.random(1500) / (1 + place / 64)  # the first blocks hold the best
    own = V.Shard(6400, lists, impacts)
    parts = [("bm25", t, 1.0 + t) for t in range(4)]
    place, score, read = own.best(parts, 10)
    at, every = own.all(parts)
    order = np.lexsort((at, -np.round(every, 9)))[:10]
    assert place.tolist() == at[order].tolist() and np.allclose(score, every[order])
    assert read < 6000 / 4


def test_chunk_search_by_hand(spark):
    """All signals and boosts of a small corpus, recomputed row by row."""
    from marlstone.operators import search as S
    from marlstone.plans import retrieval as R

    texts = ["alpha beta gamma", "beta beta delta", "the alpha of the delta", "gamma only", "alpha beta gamma delta", "zeta"]
    docs = [(i, t) for i, t in enumerate(texts)]
    d, q = tables(spark, docs, [("q1", "alpha beta"), ("q2", "the delta")])
    c = spark.createDataFrame([(f"d{i}", i, "en" if i != 4 else "de", f"src{i % 2}", t[:5], t, "fact" if i % 2 else "overview", 10 * i, f"k{i % 4}", "local", "") for i, t in docs],
                              "id string, doc_id long, domain string, entity_name string, title string, text string, chunk_type string, priority int, dedupe_key string, source_kind string, question string")
    got = {}
    for r in R.chunk_search(q, d, c, F.col("domain") == "en", 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    inside = [(i, t) for i, t in docs if i != 4]
    n, toks = len(inside), {i: t.split() for i, t in inside}
    terms = {i: [w for w in x if w not in T.STOPWORDS and len(w) >= 3] for i, x in toks.items()}
    df = Counter(w for x in terms.values() for w in set(x))
    idf = {w: max(0.0, math.log(n / (1 + k)) + 1) for w, k in df.items()}
    for name, text in (("q1", "alpha beta"), ("q2", "the delta")):
        base = blend(inside, text, {"tfidf": 0.28 + 0.16, "overlap": 0.18, "bm25": 0.18})  # plain and bare tokens are the same here
        words = text.split()
        asked = [w for w in dict.fromkeys(words) if w not in T.STOPWORDS and len(w) >= 3]
        norm = sum(max(0.05, idf.get(w, 0.0)) for w in asked)
        rows = []
        for row, score in base.items():
            i, t = inside[row]
            kind = "fact" if i % 2 else "overview"
            weight = {w: (1 + math.log(terms[i].count(w))) * idf[w] for w in set(terms[i])}
            own = list(dict.fromkeys(terms[i]))[:28]
            meta = own + [f"{a} {b}" for a, b in zip(own, own[1:])]
            held = [m for m in meta if len(m) >= 3 and ((" " in m and m in text) or all(p in text for p in [p for p in m.split() if len(p) >= 3][:4]))]
            part = [m for m in meta if len(m) >= 3 and m not in held and any(p in text for p in m.split() if len(p) >= 3)]
            boost = sum(v for v, x in ((0.08, t[:5].strip()), (0.08, kind), (0.10, f"src{i % 2}")) if any(w in x for w in words[:6]))
            boost += min(0.16, 0.03 * sum(len(w) >= 5 and w in t for w in words)) + min(0.18, 0.06 * len(held)) + min(0.10, 0.025 * len(part))
            asks = {"history": ("the ", "of "), "overview": (" in ", " to "), "fact": ("and",), "generic": ("license",)}
            boost += 0.12 if any(m in text for m in asks[kind]) else 0.03
            boost += 0.10 if kind == "overview" and " in " in text else 0.0
            boost += min(100, 10 * i) / 1000 + min(0.22, 0.22 * sum(weight.get(w, 0.0) for w in asked) / norm)
            for rule in R.CONTRAST:
                hold = any(m in text for m in rule["query_any"]) and not any(m in text for m in rule.get("query_none", ()))
                hold = hold and (not rule.get("text_any") or any(m in t for m in rule["text_any"])) and not any(m in t for m in rule.get("text_none", ()))
                boost += rule["delta"] if hold and (not rule["type"] or rule["type"] == kind) else 0.0
            rows.append({"id": f"d{i}", "score": score + boost, "dedupe_key": f"k{i % 4}", "entity": f"src{i % 2}", "chunk_type": kind})
        want = []
        while rows and len(want) < 3:
            pick = min(rows, key=lambda r: (-round(r["score"], 9), r["id"]))
            rows.remove(pick)
            want.append((len(want) + 1, pick["id"], pytest.approx(pick["score"], abs=1e-6)))
            for r in rows:
                r["score"] -= sum(v for c_, v in {"dedupe_key": 0.35, "entity": 0.04, "chunk_type": 0.02}.items() if r[c_] == pick[c_])
        assert sorted(got[name]) == want
    assert S.FUSION["vector"] == 0.20


def test_boosts_in_one_reading_are_the_column_rules(spark):
    """``scan.boosted`` against the boosts as column expressions over all pairs, and one row of scores for each document against ``fused``."""
    from marlstone.operators import scan as C
    from marlstone.operators import search as S

    rng = random.Random(11)
    words = ["khoa", "toan hoc", "ha noi", "nam dinh", "hieu truong", "pho", "email", "lien he", "thanh lap", "ab", "hoc phan", "day mon", "nganh nao", "x", "duoc thanh lap", "xem", "tien than"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    kinds = ["contact", "history", "overview", "fact", "teaching", None]
    chunks = [(f"d{i}", some(12), some(2), rng.choice(["khoa toan hoc", "phong ", "ha noi", "", "ab x", "truong pho ab"]).strip(), kinds[i % 6], rng.choice(["faculty", "en", None]), i % 7 / 100,
               [some(rng.randint(1, 2)) for _ in range(6)] + ["ab x"], [{"term": "khoa", "weight": 0.4}, {"term": "noi", "weight": 2.0}][: i % 3], [{"query_id": f"q{j}", "score": 0.0} for j in range(8)]) for i in range(40)]
    d = spark.createDataFrame(chunks, "id string, body string, title string, entity string, chunk_type string, domain string, base double, terms array<string>, keywords array<struct<term: string, weight: double>>, given array<struct<query_id: string, score: double>>")
    asks = [(f"q{j}", some(rng.randint(1, 5)), ["khoa", "noi"][: j % 3]) for j in range(8)]
    q = spark.createDataFrame(asks, "query_id string, query string, asked array<string>")
    intents, topics = {"contact": S.INTENT_MARKS["contact"], "history": (0.1, ("lap",))}, S.TOPIC_MARKS
    norms = {n: 1.7 for n, _, _ in asks}
    got = {(r.query_id, r.id): r.score for r in C.boosted(d, q, [n for n, _, _ in asks], {}, norms, 99, S.PREFIXES, S.TYPE_MARKS, intents, topics, S.CONTRAST).collect()}
    both = S.contrast_boost(d.crossJoin(q).withColumn("text", F.col("body")), S.CONTRAST)
    x = F.col
    word = F.aggregate(F.filter("keywords", lambda t: F.array_contains(x("asked"), t.term)), F.lit(0.0), lambda a, t: a + t.weight) / 1.7
    score = x("base") + x("contrast") + S.field_boost(F.split("query", " "), x("title"), x("chunk_type"), x("entity"), x("body")) + S.entity_boost(x("query"), x("entity")) + S.type_boost(x("query"), x("chunk_type"))
    score = score + S.metadata_boost(x("query"), x("terms"), F.array("chunk_type"), F.array("domain"), intents, topics) + F.least(F.lit(0.22), 0.22 * word)
    want = {(r.query_id, r.id): r.score for r in both.select("query_id", "id", score.alias("score")).collect()}
    assert len(got) == 320 and got == pytest.approx(want, abs=1e-9)

    d, q = tables(spark, [(i, some(9)) for i in range(50)], [(f"q{j}", some(2)) for j in range(5)])
    index = V.build(d, T.alnum_tokens("text", 2), "doc_id", 2, True)
    names, weights = [f"q{j}" for j in range(6)], {"tfidf": 0.3, "bm25": 0.2}
    rows = V.fused_vectors(index, q, T.alnum_tokens("query", 2), weights, names).collect()
    own = {(n, r.id): s for r in rows for n, s in zip(names, np.frombuffer(r.scores).tolist()) if s == s}
    assert own and own == pytest.approx({(r.query_id, r.id): r.score for r in V.fused(index, q, T.alnum_tokens("query", 2), None, weights).collect()}, abs=1e-9)


@pytest.mark.parametrize("tokens", [1 << 18, 90])
def test_many_queries_at_once_find_what_each_finds_alone(spark, monkeypatch, tokens):
    monkeypatch.setattr(V, "TOKENS", tokens)
    monkeypatch.setattr(V, "STEP", 300)  # some queries at a time
    docs, queries = corpus(11)
    docs += [(i + 10_000, "common " + (docs[i][1] or "")) for i in range(len(docs))]  # a word that most have: weights may be 0 or less
    queries = [(f"{name}-{k}", f"{text} {'common' if k % 3 == 0 else ''}" if k else text) for name, text in queries for k in range(5)] + [("only", "common"), ("none", "nowhere"), ("blank", "")]
    d, q = tables(spark, docs, queries)
    index = V.build(d, T.alnum_tokens("text"), "doc_id", grams=2, norms=True)
    weights = {"tfidf": 0.28, "overlap": 0.18, "bm25": 0.18}

    def found():
        one = [ranked(V.search(index, q, T.alnum_tokens("query"), 6, s)) for s in weights]
        spans = {(r.query_id, r.signal): (r.high, r.low) for r in V.ranges(index, q, T.alnum_tokens("query"), tuple(weights)).collect()}
        return *one, ranked(V.fused(index, q, T.alnum_tokens("query"), 6, weights)), spans

    monkeypatch.setattr(V, "MANY", 1 << 30)
    alone = found()
    met = []
    monkeypatch.setattr(V, "_over_flat", lambda *a, f=V._over_flat: met.append(a[2]) or f(*a))
    monkeypatch.setattr(V, "MANY", 2)
    assert len(queries) > 32 and found() == alone and len(met) == 6 and len(alone[3]) > 32
    index.release()
