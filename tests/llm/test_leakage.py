import random

import numpy as np

from stallmark.llm import leakage

ITEM = "Daabam a humid lantern from Hiprat weighed 65 borrowed landlords worth 3750 kito coupons while no locksmith of Naattaka was insured since 1971".split()


def find(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()}


def test_winnowing_guarantee():
    rng = random.Random(7)
    v = leakage.Vocabulary()
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(30)] for _ in "ab")
        run = [f"r{rng.random()}" for _ in range(leakage.K + leakage.WINDOW - 1)]
        x, y = a[:9] + run + a[9:], b[:17] + run + b[17:]
        assert np.intersect1d(leakage.winnow(v.hashes(x))[1], leakage.winnow(v.hashes(y))[1]).size


def test_leaks(spark):
    w = list(ITEM)
    edited = list(w)
    edited[4], edited[11] = "to", "cobblers"
    inserted = w[:6] + ["very"] + w[6:]
    shuffled = sorted(w)
    docs = [
        (1, "before " + " ".join(w[3:17]) + " after"), (2, "x " + " ".join(w[3:16]) + " y"), (3, "<b>" + ",\n".join(edited).upper() + "</b>"), (4, " ".join(inserted)),
        (5, " ".join(shuffled)), (6, None), (7, ""), (8, "please read the case carefully before anything else and then answer it in one sentence only"), (9, "filler word " * 30_000 + " ".join(w)),
    ]
    instruction = "Please read the case carefully before anything else and then answer it in one sentence only. "
    assert find(spark, docs, [(1, instruction + " ".join(w)), (2, instruction + "Another item " + " ".join(f"q{i}" for i in range(20))), (3, None)]) == {(1, 1), (3, 1), (4, 1), (9, 1)}
    assert find(spark, [(1, "x")], []) == set() and find(spark, [], [(1, " ".join(w))]) == set()


def test_openings_are_shared_over_all_items(spark):
    items = [(i, f"Answer the question below: {' '.join(f'w{i}x{j}' for j in range(20))}") for i in range(40)]
    items += [(90, "Only sentence here that stays because it is the last of all of them now"), (90, None), (None, "x y z"), (91, "short one")]
    it = spark.createDataFrame(items, "item_id bigint, text string")
    words = {r.item_id: r.words for r in leakage.plain_items(it).collect()}
    assert all(words[i][0] == f"w{i}x0" and len(words[i]) == 20 for i in range(40)) and len(words[90]) == 15
    long = "<div class='" + "a" * 500 + "'>"
    docs = [(1, "noise " * 50 + " ".join(f"W7x{j}," for j in range(16))), (2, "Answer the question below: and nothing else of it at all in here today ok"), (3, " ".join(f"w9x{j}" + (f" {long} " if j == 7 else "") for j in range(20))), (4, None), (5, ""), (1, "w7x0 w7x1 w7x2")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.words for r in leakage.find_leaks(d, it).collect()}
    assert got == {(1, 7): 16, (3, 9): 20}
    assert leakage.find_leaks(d.limit(0), it).count() == 0 and leakage.find_leaks(d, it.limit(0)).count() == 0
