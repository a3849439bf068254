"""SimHash near-duplicates and exact search against brute force."""

import random

import numpy as np
import xxhash

from marketlens.llm import simhash as S, topk as K


def brute_fingerprint(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, max_bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    r = random.Random(1)
    texts = ["", None, "a", "A b", "a b c d", "\x1cx É é", " a  B\tc\nd e "] + [" ".join(r.choice(("ab", "Cd", "é", "x.")) for _ in range(r.randint(0, 80))) for _ in range(80)]
    for t in texts:
        assert S.fingerprint(t) == brute_fingerprint(t), t


def test_golay_keys_meet_within_two_bits():
    code = S.golay()
    assert sorted(set(code.count.tolist())) == [1, 6]
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        near = words.copy()
        for i in range(len(near)):
            for b in r.choice(23, flips, replace=False):
                near[i] ^= 1 << int(b)
        (ka, na), (kb, nb) = code.keys(words), code.keys(near)
        assert all(set(ka[i, : na[i]]) & set(kb[i, : nb[i]]) for i in range(len(words)))


def planted(n=150, seed=4):
    r = np.random.default_rng(seed)
    fps = [int(x) for x in r.integers(0, 1 << 63, n)]
    for _ in range(3):  # chains of up to four bits, and one dense group
        for x in fps[:n]:
            if r.random() < 0.3:
                y = x
                for b in r.choice(64, int(r.integers(1, 6)), replace=False):
                    y ^= 1 << int(b)
                fps.append(y)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 60, 3) for b in range(1, 30, 3) if a != b]
    return sorted(set(fps))


def test_components_equal_brute_force(spark):
    fps = planted()
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in S.components(S.links_of(df)).collect()}
    want = brute_components(fps)
    groups = {}
    for x, c in zip(fps, want, strict=True):
        groups.setdefault(c, set()).add(x)
    mine = {}
    for x in fps:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)
    left = spark.range(100).selectExpr("id AS doc_id", "CASE WHEN id < 60 THEN 0 ELSE id END AS fp")
    right = left.groupBy("fp").agg({"*": "count"}).withColumnRenamed("count(1)", "n").withColumn("name", S.F.col("fp") * 10)
    joined = S.spread_join(left, right, "fp", 100)
    assert sorted((r["doc_id"], r["name"]) for r in joined.collect()) == [(i, 0 if i < 60 else 10 * i) for i in range(100)]
    assert S.spread_join(left.limit(0), right.limit(0), "fp", 0).count() == 0
    fps = planted(60)
    texts = [(i, f"word{i} " * 3) for i in range(40)] + [(100 + i, "same text for all of these rows") for i in range(60)]
    got = S.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == 100 and {r["component_id"] for r in got if r["doc_id"] >= 100} == {100}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = {r["node"] & (1 << 64) - 1: r["root"] & (1 << 64) - 1 for r in S.components(S.links_of(df)).collect()}
    parts = brute_components(fps)
    assert all((found.get(a, a) == found.get(b, b)) == (parts[i] == parts[j]) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]))


def test_long_chain_is_one_component(spark):
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    got = S.components(edges).collect()
    assert len(got) == 400 and {r["root"] for r in got} == {0}  # the root has no row


def test_near_duplicates_and_the_one_that_stays(spark):
    base = " ".join(f"word{i}" for i in range(600))
    near = base.replace("word300 ", "changed ")
    rows = [(5, base), (3, near), (9, base), (7, "other text of its own here"), (8, ""), (6, None), (None, base), (1, " \n"), (7, "other text of its own here")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = {(r["doc_id"]): r["component_id"] for r in S.near_duplicates(df).collect()}
    assert got[8] == got[6] == got[1] == 1 and got[7] == 7
    fps = [S.fingerprint(base), S.fingerprint(near)]
    linked = bin(fps[0] ^ fps[1]).count("1") <= 4
    assert got[9] == got[5] == (3 if linked else 5) and got[None] == got[5]
    for broadcast in (200_000, 0):
        kept = [r["doc_id"] for r in S.keep_one(df, broadcast_rows=broadcast).collect()]
        assert sorted(kept, key=str) == sorted([1, 7, None, *([3] if linked else [3, 5])], key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def brute_top(vectors, k=10, every=100):
    out = {}
    for q, v in vectors:
        if q % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k_equals_brute_force(spark):
    r = random.Random(6)
    rows = [(i, [r.choice((r.gauss(0, 1), 0.5)) for _ in range(40)]) for i in range(700)] + [(800 + i, [0.25] * 40) for i in range(30)]
    bad = [(900, None), (1000, [float("nan")] * 40), (1100, [1.0, None]), (1200, [float("inf")] * 40), (None, [1.0] * 40), (1300, []), (1301, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 AS rank", "2 AS score").repartition(7)
    v = K.integer_vectors(df)
    plain = [(x["id"], x["v"]) for x in v.collect()]
    assert {i for i, _ in plain} == {*range(700), *range(800, 830), 1301}
    want = brute_top(plain)
    for size in (16 << 20, 1000):  # one block of queries; several
        got = {}
        for x in K.top_k(v, v.filter("id % 100 = 0"), query_bytes=size).collect():
            got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
        assert {q: [(i, s) for _, i, s in sorted(g)] for q, g in got.items()} == want
        assert all([x[0] for x in sorted(g)] == list(range(1, 11)) for g in got.values())


def test_large_components_stay_exact():
    r = np.random.default_rng(1)
    v = r.integers(-(1 << 28), 1 << 28, (50, 20))
    s = K.Search(np.array([0]), v[:1], 3)
    s.add(np.arange(50), v)
    want = sorted(((-int(v[0].astype(object) @ v[i].astype(object)), i) for i in range(1, 50)))[:3]
    assert list(zip(s.best_id[0], s.best_score[0])) == [(i, -x) for x, i in want]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    v = K.integer_vectors(df)
    assert [tuple(r) for r in K.top_k(v, v.filter("id = 0")).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


def test_repeated_candidates_and_queries(spark):
    rows = [(0, [3.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    v = K.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = K.top_k(v, v.filter("id = 0"), k=3).orderBy("rank").collect()  # the query is [1, 1], its first vector in order
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1 << 20), (1, 1 << 20), (2, 1 << 20)]


def test_floors_drop_only_what_cannot_be_among_the_best():
    r = np.random.default_rng(3)
    v = r.integers(-1000, 1000, (5000, 24))
    plain, bound = K.Search(np.arange(8), v[:8], 10), None
    plain.add(np.arange(5000), v)
    bound = K.Search(np.arange(8), v[:8], 10, np.array([x[-1] for x in plain.best_score]))
    for at in range(0, 5000, 700):
        bound.add(np.arange(at, min(at + 700, 5000)), v[at : at + 700])
    assert [x.tolist() for x in plain.best_id] == [x.tolist() for x in bound.best_id]


def test_memory_does_not_grow_with_the_queries_times_the_batch():
    import tracemalloc

    r = np.random.default_rng(4)
    v, q = r.integers(-1000, 1000, (K.BATCH, 16)), r.integers(-1000, 1000, (20_000, 16))
    tracemalloc.start()
    K.Search(np.arange(20_000) + 10**6, q, 2).add(np.arange(K.BATCH), v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all products at once would be 1.3 GB
