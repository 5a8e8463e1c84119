import itertools
import random
import re

from pyspark.sql import functions as F

from stallmark.llm import neardup


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(25, 60))] for _ in range(120)]
    for t in texts[:80]:
        for edits in (2, 4, 7):
            u = list(t)
            for _ in range(edits):
                u[rng.randrange(len(u))] = rng.choice(vocabulary)
            texts.append(u)
    texts += texts[:5]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(texts)] + [(9000, None, "x"), (9001, "", "x"), (9002, "short text", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, words string")
    member, pairs = neardup.near_duplicates(df, "id", neardup.word_set(F.col("text")), 0.7, 20)
    got = {tuple(r) for r in neardup.expand_pairs(member, pairs).collect()}
    sets = {i: s for i, t, _ in rows if t and len(s := set(re.findall(r"\w+", t))) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert not got - want and len(want - got) <= 0.01 * len(want) and len(want) > 100


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    member, pairs = neardup.near_duplicates(df, "id", neardup.word_set(F.col("text")))
    assert neardup.expand_pairs(member, pairs).count() == 0


def test_crowded_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base[:26] + [f"x{rng.randrange(12)}" for _ in range(3)])) for i in range(60)] + [(100 + i, " ".join(rng.sample(base, 25))) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    words = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b])}

    def found():
        member, pairs = neardup.near_duplicates(df, "id", neardup.word_set(F.col("t")), 0.8)
        return {(r.record_a, r.record_b) for r in neardup.expand_pairs(member, pairs).collect()}

    plain = found()
    monkeypatch.setattr(neardup, "HOT_BLOCK", 3)  # every block of the template is crowded, classes are split
    assert found() == plain == want
