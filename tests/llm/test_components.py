import random

from stallmark.llm.components import connected_components


def brute(ids, pairs):
    p = {}

    def find(v):
        while p.setdefault(v, v) != v:
            v = p[v]
        return v

    for v in ids:
        find(v)
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        p[y] = x
    return {v: find(v) for v in p}


def test_against_union_find(spark):
    rng = random.Random(4)
    perm = list(range(200))
    rng.shuffle(perm)
    pairs = [(f"c{perm[i]:03d}", f"c{perm[i + 1]:03d}") for i in range(199)]  # one long chain
    pairs += [("hub", f"h{i}") for i in range(150)] + [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(60)]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[:20]]
    df = spark.createDataFrame(pairs + [(None, "lost"), ("self", "self")], "a string, b string")
    got = connected_components(spark.createDataFrame([("alone",), ("lost",), (None,)], "id string"), df).collect()
    want = brute(["alone", "lost"], pairs)
    assert {r.id: r.group_id for r in got if r.id != "self"} == want and len(got) == len({r.id for r in got})


def test_empty(spark):
    e = spark.createDataFrame([], "a string, b string")
    assert connected_components(e.select("a"), e).count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([("x",)], "id string"), e).collect()] == [("x", "x")]
