import math
import random

from pyspark.sql import functions as F

from stallmark.llm import percentiles as P


def exact(values, q):
    s = sorted(values)
    return s[max(1, (round(q * 10_000) * len(s) + 9999) // 10_000) - 1]


def test_order_key_round_trip(spark):
    rng = random.Random(1)
    v = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308, float("inf"), float("-inf")]
    v += [math.ldexp(rng.uniform(1, 2) * rng.choice([-1, 1]), rng.randint(-1074, 1023)) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", P.order_key(F.col("v")).alias("k")).select("v", "k", P.key_value(F.col("k")).alias("w")).collect()
    assert all(r.v == r.w for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(v)


def test_selection_against_sort(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1e3), float(rng.randrange(5)), -7.5])) for _ in range(400)] + [("a", None), ("b", float("nan")), (None, 3.0), ("one", 9.0)]
    df = spark.createDataFrame(rows, "level string, value double").withColumn("key", F.lit("clash"))
    s = P.summarise(df, F.col("value"), {"g": F.col("level")})
    got = {(r.g, r.q): (r.n, r.value) for r in P.radix_select(s, ["g"]).collect()}
    for g in ("a", "b", "one", None):
        v = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        for q in P.QUANTILES:
            assert got[g, q] == (len(v), exact(v, q))


def test_parts_combine_and_error_is_bounded(spark):
    rng = random.Random(3)
    v = [rng.lognormvariate(5, 2) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    parts = [P.summarise(df.filter(F.col("i") % 3 == k), F.col("v"), {"g": F.lit("x")}, bits=32) for k in range(3)]
    for r in P.radix_select(P.merge(*parts), ["g"]).collect():
        e = exact(v, r.q)
        assert e * (1 - 2.0**-20) <= r.value <= e


def test_empty(spark):
    s = P.summarise(spark.createDataFrame([], "v double"), F.col("v"), {"g": F.lit("x")})
    assert P.radix_select(s, ["g"]).count() == 0
