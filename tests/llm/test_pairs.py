"""Top-k search, suffix repeats, near-duplicates, components and the pipeline against brute force."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from marlstone.llm import components, covertree, minhash, suffix

SCHEMA = "doc_id long, text string, lang string, id string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b") for i, t in rows], SCHEMA)


# --- top-k -----------------------------------------------------------------


def brute_top(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and v]
    out = []
    for q, qv in good:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_cover_tree_invariants():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.2, (150, 3)) for c in (0, 4, 9)] + [np.ones((50, 3))])
    tree = covertree.Tree(points, 8)
    assert len(tree.kids) > 20

    def below(node):
        return np.concatenate([below(c) for c in tree.kids[node]]) if tree.kids[node] else tree.rows[node]

    assert sorted(below(0)) == list(range(len(points)))
    for node, kids in enumerate(tree.kids):
        gap = np.sqrt(((points[below(node)] - tree.centre[node]) ** 2).sum(1))
        assert gap.max() <= tree.radius[node] + 1e-9
        for a in kids:
            assert np.linalg.norm(tree.centre[a] - tree.centre[node]) <= covertree.BASE ** tree.level[node] + 1e-9
            assert all(a == b or np.linalg.norm(tree.centre[a] - tree.centre[b]) > covertree.BASE ** (tree.level[node] - 1) for b in kids)
    leaf, far = tree.descend(points)
    assert all(not tree.kids[k] for k in leaf) and np.allclose(far, np.linalg.norm(points - tree.centres[leaf], axis=1))
    met = []
    covertree.dual(tree, tree, lambda node: 100.0, lambda a, b: met.append((a, b)))
    assert 0 < len(met) < len(tree.leaves()) ** 2
    high = {(a, b) for a in tree.leaves() for b in tree.leaves() if (points[tree.rows[a]] @ points[tree.rows[b]].T).max() >= 100}
    assert high <= set(met)


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(i, [float(i), 1.0]) for i in range(1, 8)], (7, [7.0, 1.0]), (6, [0.0, 30.0])]
    got = [tuple(r) for r in covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 30 << 16), (0, 2, 7, 7 << 16), (0, 3, 6, 6 << 16), (0, 4, 5, 5 << 16), (0, 5, 4, 4 << 16)]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, None), (401, [float("nan")] * 8), (402, [None] * 8), (403, [float("inf")] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top(rows, 5, 10)
    assert sorted(map(tuple, covertree.top_k(df, 5, 10).collect())) == want
    assert sorted(map(tuple, covertree.top_k(df, 5, 10, block=32, group=4).collect())) == want
    assert covertree.top_k(df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in covertree.top_k(two, 5, 50).collect()] == [(0, 1, 1, 256 * 128)]


# --- suffix array ----------------------------------------------------------


def brute_suffix(rows):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = {}
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé \n") for _ in range(300)) for _ in range(6)]
    rows = [(i * 3, "".join(base[rng.randrange(6)][rng.randrange(200) :][: rng.randrange(150)] for _ in range(6))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 49), (504, "a" * 50), (505, base[0]), (506, base[0]), (507, base[0] * 30)]
    got = {r[0]: tuple(r)[1:] for r in suffix.remove_repeats(table(spark, rows)).collect()}
    assert got == brute_suffix(rows)
    assert suffix.remove_repeats(table(spark, [])).count() == 0


def test_remove_repeats_with_repeated_and_text_ids(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc \n") for _ in range(200)) for _ in range(4)]
    rows = [(1, base[0]), (5, base[0][:120] + base[1]), (5, base[2] + base[1]), (5, base[2]), (None, base[0]), (7, base[2][40:] + base[0])]
    got = sorted(tuple(r) for r in suffix.remove_repeats(table(spark, rows)).collect() if r[0] is not None)
    first = {}
    for i, t in sorted((i, t.encode()) for i, t in rows if i is not None):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    want = []
    for i, t in rows:
        if i is not None:
            gone = np.zeros(len(t), bool)
            for k in range(len(t) - 49):
                if first[t.encode()[k : k + 50]] < i:
                    gone[k : k + 50] = True
            kept = np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
            want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)
    names = spark.createDataFrame([(f"n{i}" if i else None, t) for i, t in rows], "doc_id string, text string")
    by_name = sorted((int(r[0][1:]), *tuple(r)[1:]) for r in suffix.remove_repeats(names).collect() if r[0])
    assert by_name == got


def test_strings_of_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", 3)
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(80))) + line[rng.randrange(20) :] + "".join(rng.choice("xyz ") for _ in range(40))) for i in range(40)]
    got = {r[0]: tuple(r)[1:] for r in suffix.remove_repeats(table(spark, rows)).collect()}
    assert got == brute_suffix(rows)


def test_maximal_repeats_of_frames():
    rng = random.Random(8)
    anchor = b"0123456789abcdefghijklmno"
    sides = ["".join(rng.choice("ab") for _ in range(25)) for _ in range(3)]

    def near(x):
        k = rng.randrange(26)
        return (x[:k] + rng.choice("ab") + x[k + 1 :])[:25]

    frames = {(near(rng.choice(sides)), near(rng.choice(sides))) for _ in range(40)}
    rows = np.zeros(len(frames), suffix._FRAME)
    for k, (a, b) in enumerate(sorted(frames)):
        rows[k]["doc"], rows[k]["left"], rows[k]["right"], rows[k]["text"] = k, 25, 50, np.frombuffer(a.encode() + anchor + b.encode(), np.uint8)
    text = [bytes(r["text"]) for r in rows]
    want = set()
    for left in range(26):
        for right in range(max(25, 50 - left), 51):
            by = {}
            for k, t in enumerate(text):
                by.setdefault(t[25 - left : 25 + right], []).append(k)
            for group in by.values():
                wider = left < 25 and len({text[k][24 - left] for k in group}) == 1
                longer = right < 50 and len({text[k][25 + right] for k in group}) == 1
                if len(group) > 1 and not wider and not longer:
                    want.add((left, right, tuple(group)))
    got = {(a, b, tuple(sorted(p.tolist()))) for a, b, p in suffix.maximal_repeats(rows)}
    assert got == want and len(want) > 10


def test_intervals_of_a_suffix_array():
    text = np.frombuffer(b"banana$$$anana$$$$nana$$$$$$", np.uint8)[:21].reshape(3, 7)
    order, lcp = suffix.suffix_array(text, np.full(3, 7))
    spans = suffix.intervals(np.array([0, 3, 3, 1, 2]), 1)
    assert spans == [(3, 0, 3), (2, 3, 5), (1, 0, 5)]
    assert len(order) == 3 and lcp[0] == 0


# --- near duplicates -------------------------------------------------------


def words(t):
    out, now = [], ""
    for c in (t or "").translate({c: c + 32 for c in range(65, 91)}):
        if c == " " or "\t" <= c <= "\r":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def brute_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_dedup(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(60)]
        for k in range(1 + 3 * (g % 4) + 20 * (g == 5)):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(60)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one"), (n + 5, " x é"), (n + 6, rows[0][1].upper()), (n + 7, "a b " * 3000), (n + 8, "A b " * 2999)]
    for size in (2, 5):
        got = {r[0]: tuple(r)[1:4] for r in minhash.near_dedup(table(spark, rows), size, 80).collect()}
        assert got == brute_near(rows, size, 80)
    assert minhash.near_dedup(table(spark, [])).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r[0]: tuple(r)[1:4] for r in minhash.near_dedup(table(spark, rows), 2, 80).collect()}
    assert got == brute_near(rows, 2, 80)


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for l in links for x in l if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert all(got[i] == find(i) for i in got)
    assert {x for a, b in links if a is not None and a != b for x in (a, b)} == set(got)


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encode"]
    by = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = by["exact dedup"](spark, docs, sf)
    assert one.columns == docs.columns
    last = {}
    for i, t in sorted(rows.items()):
        last[t] = i
    assert {r.doc_id for r in one.collect()} == set(last.values())
    near = by["near dedup"](spark, one, sf)
    want = {i for i, x in brute_near([(r.doc_id, r.text) for r in one.collect()], 5, 80).items() if x[2]}
    assert {r.doc_id for r in near.collect()} == want and near.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= len(want)
    assert all(r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest() for r in out.collect())


def test_top_k_searches_every_length(spark):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(20)] + [(50, [1.0]), (51, [2.0]), (52, [3.0, 1.0])]
    got = sorted(map(tuple, covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 10).collect()))
    long = lambda q, d: 65536 * (q * d + 1) + 16384
    assert got == [(0, 1, 1, long(0, 1)), (0, 2, 2, long(0, 2)), (10, 1, 19, long(10, 19)), (10, 2, 18, long(10, 18)), (50, 1, 51, 131072)]
