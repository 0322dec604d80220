"""Ranked search against brute force in plain Python, with ties, repeated rows, nulls and long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import rangemax

DOCS = "doc_id long, text string, item_id int, score string, rank string, id string"
ITEMS = "item_id long, text string, doc_id int, query string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    bags = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def table(spark, docs, items):
    return spark.createDataFrame([(i, t, 7, "a", "b", "c") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 7, "q") for i, t in items], ITEMS)


def rows(found):
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


WORDS = ["the", "The", "of", "Éa", "éa", "x9", "z", "漢字", "a_b", "don't", "to"]


@pytest.mark.parametrize("docs_of_a_block", [5, 8192])
def test_equals_brute_force(spark, monkeypatch, docs_of_a_block):
    monkeypatch.setattr(rangemax, "DOCS", docs_of_a_block)
    rnd = random.Random(docs_of_a_block)
    text = lambda n: " ".join(rnd.choices(WORDS, [9, 1, 5, 2, 2, 1, 1, 1, 1, 1, 4], k=n))
    docs = [(i // 2, text(rnd.randint(0, 30))) for i in range(300)] + [(900, None), (901, ""), (902, " \n-"), (None, "the z z"), (903, "x9 " * 20000)]
    items = [(i, text(rnd.randint(1, 6))) for i in range(30)] + [(30, None), (31, ""), (32, "unseen"), (33, "the"), (33, "z z"), (None, "漢字")]
    d, q = table(spark, docs, items)
    assert rows(rangemax.search(d.repartition(3), q)) == brute(docs, items)


def test_equal_scores_go_to_the_smaller_id(spark):
    docs, items = [(i, "same words here") for i in range(40, 0, -1)] + [(50, "other")] * 3, [(1, "words")]
    d, q = table(spark, docs, items)
    assert [r[2] for r in sorted(rows(rangemax.search(d, q, k=7)), key=lambda r: r[1])] == [1, 2, 3, 4, 5, 6, 7]


def test_groups_of_queries_and_empty_tables(spark, monkeypatch):
    docs, items = [(i, f"w{i % 5} w{i % 3}") for i in range(50)], [(i, f"w{i} w1") for i in range(8)]
    d, q = table(spark, docs, items)
    want = rows(rangemax.search(d, q))
    monkeypatch.setattr(rangemax, "QUERY_BYTES", 10)
    assert rows(rangemax.search(d, q)) == want == brute(docs, items)
    assert rangemax.search(d.limit(0), q).count() == 0
    assert rangemax.search(d, q.limit(0)).count() == 0


def test_maxima_bound_every_interval_and_few_documents_are_scored():
    rnd = np.random.default_rng(3)
    key = np.unique(rnd.integers(0, 6 * 4000, 9000))
    code, doc = key // 4000, key % 4000
    impact = rnd.integers(1, 10**9, len(key)) // (1 + doc)  # large ones stand together
    block = rangemax.Block(np.arange(4000), code, doc, impact)
    for a, b in rnd.integers(0, len(key), (200, 2)):
        a, b = min(a, b), max(a, b)
        b = min(b, a + int(np.bincount(code).max()))
        best, at = block.maxima(np.array([a]), np.array([b]))
        assert best[0] == (impact[a:b].max() if b > a else 0) and (b == a or impact[at[0]] == best[0])
    (scores, ids), scored = block.search(np.arange(6), 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    sums = np.bincount(doc, weights=impact, minlength=4000).astype(np.int64)
    assert scores.tolist() == sorted(sums.tolist(), reverse=True)[:10] and (sums[ids] == scores).all()
    assert scored < 1000
