import itertools
import math
import random
from collections import Counter

import pytest

from stallmark.llm import products

SCHEMA = "record_id bigint, title string, description string, model string, brand string, group_id int"


def test_attributes():
    a = products.attributes
    x = a("Krarkrarix handset naldhato p2088neo 1024gb", "8192 mb ram. 10.4 inches")
    assert x == {"acc": "-", "sto": "1024", "ram": "8", "scr": "10.4"}
    assert a("NALDHATO P-2088 Neo | 1TB | RAM 8GB | 26.4cm screen", None) == x
    assert a("64 GB RAM 8GB Naldhato P2088", None)["ram"] == "8" and a("8gb ram 512 gigabyte Naldhato P2088", None)["sto"] == "512"
    assert a("hurry Carry case for Haathava RaditoD2677 Lite", "128gb") == {"acc": "carry case"}
    assert a("20.5 cu ft fridge Zachak F 9633", None)["cap"] == a("580 litre fridge Zachak F9633", None)["cap"]
    assert a(None, None) == {"acc": "-"}


def test_codes_of_any_length():
    c = products.codes
    for t in ("Naldhato P2088 Neo 64gb", "naldhatoP-2088Neo", "NALDHATO P 2088 neo, 14 inch"):
        assert c(t) == [("naldhato", "p2088", "neo")]
    assert c("Galaxy S21 ultra") == [("galaxy", "s21", "ultra")] and c("Foldy X123456")[0][1] == "x123456"
    assert c("ram 12gb 64 gigs 345 litre 5 years") == [] and c(None) == []


def test_groups(spark):
    t = [
        (1, "Kishkova Ghithas K3358 Pro 128gb black"), (2, "kishkova GHITHAS K-3358Pro 128 gigs hurry"), (3, "Kishkova Ghithas K3358 Pro 256gb"), (4, "Kishkova Ghithas K3358 128gb"),
        (5, "Back cover for Kishkova Ghithas K3358 Pro"), (6, "back cover for kishkova ghithas k 3358 pro red"), (7, "no model here"), (8, None), (9, "Kishkova Ghithas K3358 Pro 128gb black"), (10, "Ghithas K3358 Pro"),
        (11, "Raarvkrato M2544 earphones"), (12, "Sharora raarvkratoM2544 gold headphones"), (13, "Zubrela S21 4gb ram 64gb"), (14, "zubrela s-21 64 gb"), (15, "zubrela S21 4 gb ram"), (15, "zubrela S21 4 gb ram"), (None, "zubrela S21"),
    ]
    df = spark.createDataFrame([(i, x, None, None, None, 1) for i, x in t], SCHEMA)
    g = {r.id: r.group_id for r in products.same_products(df).collect()}
    # 10 leaves the storage open and fits two products, so it joins none; 13 to 15 fit each other and contradict nothing
    assert g == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 1, 10: 10, 11: 11, 12: 11, 13: 13, 14: 13, 15: 13}
    assert products.group_pairs(products.same_products(df.limit(0))).count() == 0


def test_records_without_code_meet_on_all_their_words(spark, monkeypatch):
    """Their rarest words are slips of the pen, so the words they share come later."""
    t = ["walnut dining bench carved rustic qwa qwb qwc sale", "qwd qwe qwf rustic carved bench dining walnut sale", "steel kettle sale", "cotton curtain sale", "qwg qwh qwi qwj walnut sale"]
    df = spark.createDataFrame([(i, x, None, None, None, 1) for i, x in enumerate(t)], SCHEMA)
    assert {r.id: r.group_id for r in products.same_products(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    rng = random.Random(5)
    sets = {c: {f"w{int(rng.random() ** 2 * 25)}" for _ in range(rng.randrange(1, 8))} for c in range(60)}
    df_ = Counter(w for s in sets.values() for w in s)
    w = {x: math.log(1 + 60 / n) for x, n in df_.items()}
    total = {c: sum(w[x] for x in s) for c, s in sets.items()}
    want = set()
    for a, b in itertools.combinations(sets, 2):
        both = sets[a] & sets[b]
        if len(both) >= 2 and 2 * sum(w[x] for x in both) > min(total[a], total[b]):
            want.add((a, b))
    held = spark.createDataFrame([(c, x, df_[x], w[x]) for c, s in sets.items() for x in sorted(s)], "cid bigint, term string, df bigint, w double")
    assert {(r.cid_a, r.cid_b) for r in products.alike(held).collect()} == want and len(want) > 100
    monkeypatch.setattr(products, "HOT_KEY", 5)
    assert {(r.cid_a, r.cid_b) for r in products.alike(held).collect()} == want


def test_threshold_decides(spark):
    """Products that differ in one attribute share their code; only the reinforced weights tell them apart."""
    rows, true, n = [], {}, 0
    for m, (v, s) in itertools.product(range(12), itertools.product(("", " Pro", " Lite"), (64, 128))):
        for style in ("{n} {c}{v} {s}gb hurry", "{s} GB {n}{c}{v} best deal", "{n} {c}{v} - {s} gigs"):
            n += 1
            rows.append((n, style.format(n="Vandrika" if m % 2 else "Kishkova", c=f"K{3300 + m}", v=v, s=s), None, None, "Vandrika", 0))
            true[n] = (m, v, s)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(a, b) for a, b in itertools.combinations(true, 2) if true[a] == true[b]}

    def found(**kw):
        return {(r.record_a, r.record_b) for r in products.group_pairs(products.same_products(df, **kw)).collect()}

    assert found() == want
    assert len(want) < 0.5 * len(found(match=0.0))


def test_reinforcement_equals_brute_force(spark, monkeypatch):
    classes = {1: ({"a", "b", "c|sto=1"}, 2), 2: ({"a", "b", "c|sto=2"}, 1), 3: ({"a", "c|sto=1", "d"}, 3), 4: ({"b", "d"}, 1)}
    apart = {(1, 2): ["sto"], (2, 3): ["sto"]}
    cands = {(1, 2), (1, 3), (2, 3), (2, 4)}
    x = dict.fromkeys(("a", "b", "c|sto=1", "d"), 0.5)
    held = {t: [n for ts, n in classes.values() if t in ts] for t in {*x, "c|sto=2"}}
    y, moved = 0.5, 1.0
    while moved >= products.TOLERANCE:
        score = {}
        for a, b in cands:
            s = sum(x.get(t, 0.0) for t in classes[a][0] & classes[b][0])
            score[a, b] = s / (s + (y if (a, b) in apart else 0.0) + products.REST)
        new = {}
        for t in x:
            n = sum(held[t])
            inside = sum(k * (k - 1) / 2 for k in held[t])
            new[t] = (inside + sum(v * classes[a][1] * classes[b][1] for (a, b), v in score.items() if t in classes[a][0] & classes[b][0]) + 0.5) / (n * (n - 1) / 2 + 1)
        moved = max([abs(new[t] - x[t]) for t in x] + [abs(new["c|sto=1"] - y)])
        x, y = new, new["c|sto=1"]
    cls = spark.createDataFrame([(i, n, sorted(ts)) for i, (ts, n) in classes.items()], "cid bigint, n bigint, terms array<string>")
    pairs = spark.createDataFrame([(a, b, classes[a][1] * classes[b][1], sorted(classes[a][0] & classes[b][0]), apart.get((a, b), [])) for a, b in cands], "cid_a bigint, cid_b bigint, pairs bigint, shared array<string>, apart array<string>")
    got, rounds = products.reinforce(cls, pairs)
    assert {(r.cid_a, r.cid_b): r.score for r in got.collect()} == pytest.approx(score, abs=1e-9) and rounds > 2
    monkeypatch.setattr(products, "MOST_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        products.reinforce(cls, pairs)
