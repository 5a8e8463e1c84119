import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from stallmark.operators import anomaly, benchmark, graph, listings, skew, textops, vectors


def test_benchmark(spark):
    rows = [("m", 50000.0)] * 8 + [("m", 25000.0)] * 2 + [("small", 1.0)] * 4 + [("m", None), ("m", 0.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "model string, price double")
    out = benchmark.price_benchmark(df, "model", "price").collect()
    assert [(r.model, r.n, r.median) for r in out] == [("m", 10, 50000.0)]
    total = {r.model: (r.below_35, r.below_50) for r in benchmark.price_thresholds(df, "model", "price").collect()}
    assert total == {"m": (2, 2), "ALL": (2, 2)}
    pos = benchmark.price_position(df.withColumn("id", F.monotonically_increasing_id()), "id", "model", "price").collect()
    assert {(r.price, r.percentile_rank) for r in pos} == {(50000.0, 100.0), (25000.0, 20.0)}


def test_canonical_and_duplicates(spark):
    df = spark.createDataFrame([("a", 2, "t2", "q2"), ("a", 1, "t1", "q1"), ("a", 3, "t3", "q1"), (None, 1, "x", "q")], "lid string, ts int, title string, q string")
    r = listings.canonical_listings(df, "lid", ["ts"], {"title": F.col("title")}, "ts", F.col("q")).collect()
    assert [tuple(x) for x in r] == [("a", "t1", 1, 3, 3, "q1, q2")]
    d = spark.createDataFrame([(1, "s", "u"), (2, "s", "v"), (3, "z", "u"), (4, None, None)], "id int, k string, u string")
    out = listings.duplicate_rules(d, "id", [("k", 1.0, [F.col("k")]), ("u", 0.85, [F.col("u")])])
    assert {tuple(x) for x in out.collect()} == {(2, "k", 1.0, 1), (3, "u", 0.85, 1)}


def test_jaccard_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 12))]) for i in range(150)]
    docs += [(1000 + i, list(w[:-1])) for i, (_, w) in enumerate(docs[:40])]
    df = spark.createDataFrame(docs, "id int, w array<string>")
    got = {(r.a, r.b) for r in textops.jaccard_pairs(df, "id", "w", None, 0.7).collect()}
    sets: dict[frozenset, int] = {}
    for i, w in docs:
        if len(set(w)) >= 3:
            sets[frozenset(w)] = min(i, sets.get(frozenset(w), i))
    want = {(min(i, j), max(i, j)) for (x, i), (y, j) in itertools.combinations(sets.items(), 2) if len(x & y) / len(x | y) >= 0.7}
    assert got == want and want


def test_jaccard_joins_are_not_broadcast_and_hot_words_are_split(spark, monkeypatch):
    """Small enough for Catalyst to broadcast every side; in a larger run its guesses cost the driver its memory."""
    docs = [(i, "s" if i % 7 else None, [f"w{k}" for k in range(9) if k != i % 12] + [f"v{i % 3}"]) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, block string, w array<string>")
    sets: dict[tuple, int] = {}
    for i, b, w in docs:
        sets.setdefault((b, frozenset(w)), i)
    want = {(x, y) for (b, v), x in sets.items() for (c, w), y in sets.items() if b == c and b is not None and x < y and len(v & w) / len(v | w) >= 0.8}
    plain = textops.jaccard_pairs(df, "id", "w", "block", 0.8)
    assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(skew, "find_hot", lambda t, keys, total, floor=0: skew.cut(skew.hot_keys(t, keys, 3, total)))
    monkeypatch.setattr(textops, "find_hot", skew.find_hot)
    split = textops.jaccard_pairs(df, "id", "w", "block", 0.8)
    assert want == {(r.a, r.b) for r in plain.collect()} == {(r.a, r.b) for r in split.collect()} and len(want) > 15


def test_jaccard_classes_are_not_broadcast(spark):
    docs = [(1, "s", list("abcdefghi")), (2, "s", list("ihgfedcba")), (3, "s", list("abcdefgh")), (4, None, list("abcdefgh")), (5, None, list("abcdefgh")), (6, "s", ["a"])]
    df = skew.cut(spark.createDataFrame(docs, "id int, block string, w array<string>"))
    got = textops.jaccard_classes(df, "id", "w", "block", skew.cut(textops.jaccard_pairs(df, "id", "w", "block", 0.8)))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.class_id, r.copies, r.links) for r in got.collect()) == [(1, 1, 2, 2), (2, 1, 2, 2), (3, 3, 1, 2), (4, 4, 2, 1), (5, 4, 2, 1)]


def test_shared_phrases_need_no_join(spark):
    common, band, edge = "common phrase here", "within the band", "exactly thirty hold"
    docs = [(i, f"{common} x{i} y{i} {band if i < 4 else ''} {edge if i % 2 else ''} z{i}".split()) for i in range(60)] + [(None, f"{band} q".split())]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    got = textops.shared_phrases(df, "id", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    want: dict[tuple, int] = {}
    held: dict[str, set] = {}
    for i, t in docs:
        t = [w for w in t if len(w) >= 2]
        for n in (3, 4, 5):
            for k in range(len(t) - n + 1):
                held.setdefault(" ".join(t[k : k + n]), set()).add(i)
    for phrase, ids in held.items():
        if len(phrase) >= 12 and 2 <= len(ids) <= 30:
            for pair in itertools.combinations(sorted(x for x in ids if x is not None), 2):
                want[pair] = want.get(pair, 0) + 1
    assert {(r.a, r.b): r.phrases for r in got.collect()} == want and (1, 59) in want and (0, 58) not in want


def test_ngrams_and_phrases(spark):
    df = spark.createDataFrame([(1, "red apple pie today".split()), (2, "red apple pie again".split()), (3, ["one"]), (4, [])], "id int, t array<string>")
    got = {(r.n, r.phrase, r.tf, r.df) for r in textops.ngram_frequencies(df, "id", "t").collect()}
    assert (3, "red apple pie", 2, 2) in got and (2, "apple pie", 2, 2) in got
    assert [tuple(r) for r in textops.shared_phrases(df, "id", "t").collect()] == [(1, 2, 1)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id bigint, v array<double>")
    got = vectors.cosine_topk(df, "id", "v", 5).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    np.fill_diagonal(s, -9)
    for i in range(60):
        want = sorted(range(60), key=lambda j: (-s[i, j], j))[:5]
        assert got[got.q == i].sort_values("rank").n.tolist() == want
    h = [(i, rng.integers(0, 2**32), rng.integers(0, 2**32)) for i in range(80)]
    h += [(200 + i, a ^ 7, b ^ 3) for i, a, b in h[:20]] + [(300, h[0][1], h[0][2])]
    hd = spark.createDataFrame([(int(i), int(a), int(b)) for i, a, b in h], "id bigint, h0 bigint, h1 bigint")
    got = {tuple(r) for r in vectors.hamming_pairs(hd, "id", 10).collect()}
    want = {(int(i), int(j), bin(int(a ^ c)).count("1") + bin(int(b ^ d)).count("1")) for (i, a, b), (j, c, d) in itertools.combinations(h, 2)}
    assert got == {w for w in want if w[2] <= 10} and got


def test_components(spark):
    rng = random.Random(5)
    e = [(f"{rng.randrange(120):03d}", f"{rng.randrange(120):03d}") for _ in range(70)]
    e += [("hub", f"h{i:03d}") for i in range(60)]
    got, one = ({r.id: r.component for r in graph.components(spark.createDataFrame(e, "a string, b string"), n).collect()} for n in (0, 1_000))
    assert got == one and graph.components(spark.createDataFrame([], "a string, b string")).count() == 0
    parent: dict[str, str] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in e:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    ids = {v for a, b in e if a != b for v in (a, b)}
    assert got == {v: find(v) for v in ids}


def test_salted_join_matches_plain(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([(None, 5)], "k bigint, x bigint"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, -1)], "k bigint, y bigint")
    hot = spark.createDataFrame([(0,), (None,)], "k bigint")
    got = skew.salted_join(big, small, ["k"], hot, F.col("x"), "left")
    plain = big.join(small.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    assert got.select("k", "x", "y").exceptAll(plain.select("k", "x", "y")).isEmpty() and got.count() == plain.count()


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    s = anomaly.isolation_scores(df, "id", ["a", "b"], trees=40).toPandas()
    assert s.sort_values("score").id.iloc[-1] == "999"
    again = anomaly.isolation_scores(df.repartition(3), "id", ["a", "b"], trees=40).toPandas()
    assert dict(zip(s.id, s.score)) == dict(zip(again.id, again.score))
