"""Collocations against brute force in plain Python, with frequent words, copies, nulls and long texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, own int, freq long, a long, n long"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, inside, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in long.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            spans = lambda q: {q[i : i + len(p)] for i in range(len(q) - len(p) + 1)}
            if not any(len(q) > len(p) and p in spans(q) and 100 * b >= inside * a for q, b in long.items()):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, t.decode(), -a, le, ri, n[lang], -s) for r, (s, a, t, le, ri) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def run(spark, docs, parts=3, **how):
    rows = spark.createDataFrame([(i, t, la, "x", 1, 2, 3, 4) for i, (t, la) in enumerate(docs)], SCHEMA).repartition(parts)
    found = phrases.collocations(rows, **how)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def texts(seed, count=120):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "a", "b", "é", "漢字", "co-op", "x\ty", "(z)"]
    weights = [20, 2, 9, 5, 5, 4, 9, 9, 2, 2, 1, 1, 1]
    text = lambda n: "".join(rnd.choices(vocabulary, weights)[0] + rnd.choice([" ", " ", " ", "  ", ", ", ". ", "\n", "\t"]) for _ in range(n))
    copy = text(400)
    return [(text(rnd.randint(0, 60)), rnd.choice(["en", "de", None, "und"])) for _ in range(count)] + [(copy, "en")] * 30 + [("x " + copy, "de")] * 5


EDGES = [(None, None), ("", "en"), (" .,\n", "en"), ("one", "fr"), ("a " * 20000, "en"), ("w" * 40000, "en"), ("new york " * 3000, None)]


@pytest.mark.parametrize("least,longest,inside,top", [(10, 5, 100, 2000), (3, 4, 80, 7), (200, 2, 100, 2000)])
def test_equals_brute_force(spark, least, longest, inside, top):
    docs = texts(least) + EDGES
    assert run(spark, docs, least=least, longest=longest, inside=inside, top=top) == brute(docs, least, longest, inside, top)


def test_small_chunks_buckets_and_flushes_change_nothing(spark, monkeypatch):
    docs = texts(5, 60) + EDGES
    want = brute(docs, 6, 5, 100, 2000)
    # workers read the module anew, so only what the driver hands on is changed here
    monkeypatch.setattr(phrases, "BUCKET_BITS", 8)
    assert run(spark, docs, parts=7, least=6) == want


def test_parse_counts_each_word_once_and_repeats_share_chunks():
    passage = " ".join(f"w{i % 400}x{i % 7}" for i in range(3000))
    both = [(f"head number {k} {passage} tail {k}").encode() for k in range(2)]
    data, bounds = np.frombuffer(b"".join(both), np.uint8), np.cumsum([0, *map(len, both)])
    chunk, own, doc = phrases.chunks(data, bounds, 5)
    assert own.sum() == 2 * 3000 + 2 * 5 and own.max() <= phrases.MOST
    assert len({*zip(chunk.to_pylist(), own.tolist())}) < 0.6 * len(own)


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(rows).count() == 0
    assert run(spark, [(None, None), ("", "en")]) == []
