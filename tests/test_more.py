import itertools
import random

from pyspark.sql import functions as F

from stallmark import cli
from stallmark.functions import visual
from stallmark.operators import percentiles, ranking, textops
from stallmark.sources import sinks
from stallmark.streaming import clusters, ingest


def test_number_rows(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("x"), F.lit(1).alias("number_"))
    got = {r.x: r.number for r in ranking.number_rows(df.repartition(7), [F.desc("x")]).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(got, reverse=True))}
    assert ranking.number_rows(df.limit(0), [F.col("x")]).count() == 0
    r = spark.createDataFrame([(7,), (123456,)], "n bigint").select(ranking.labelled(F.col("n"), "COMP", 4)).collect()
    assert [x[0] for x in r] == ["COMP-0007", "COMP-123456"]


def test_interpolated_percentiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([rng.uniform(-5, 5), float(rng.randrange(4))])) for _ in range(400)] + [(None, 1.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {(r.g): (list(r.p), r.n) for r in df.filter("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    got = {r.g: ([r.a, r.b, r.c], r.n) for r in percentiles.interpolated(df, F.col("v"), {"g": F.col("g")}, {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and max(abs(x - y) for x, y in zip(got[k][0], want[k][0])) < 1e-9 for k in got)


def test_percentiles_with_many_open_targets(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.sqrt(F.col("id").cast("double")).alias("v"))
    few = {tuple(r) for r in percentiles.interpolated(df, F.col("v"), {"g": F.col("g")}, {"m": 0.5}).collect()}
    monkeypatch.setattr(percentiles, "FEW", -1)
    assert {tuple(r) for r in percentiles.interpolated(df, F.col("v"), {"g": F.col("g")}, {"m": 0.5}).collect()} == few


def test_ngrams_and_tfidf_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "xy"[i % 2], [rng.choice("lamp desk the old 12 chair red".split()) for _ in range(rng.randrange(9))]) for i in range(40)] + [(99, None, ["lamp"])]
    df = spark.createDataFrame(docs, "id int, g string, t array<string>")
    want = {}
    for i, _, t in docs:
        for n in (1, 2, 3):
            for j in range(len(t) - n + 1):
                k = (n, " ".join(t[j : j + n]))
                if any(w not in textops.STOPWORDS for w in t[j : j + n]):
                    want.setdefault(k, []).append(i)
    got = {(r.n, r.phrase): (r.tf, r.df) for r in textops.ngram_frequencies(df, "id", "t").collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items() if len(set(v)) >= 2}
    t = textops.tfidf(df, "g", "id", "t").collect()
    assert {r.group_value for r in t} == {"x", "y"} and all(r.df == sum(r.term in d[2] for d in docs) for r in t) and {r.term for r in t} == {"lamp", "desk", "old", "chair", "red"}


def test_visual(spark):
    df = spark.createDataFrame([("iphone 13 pro max 128 gb demo unit m2 sealed 2tb iphone 13 pro max ps5",), (None,)], "t string")
    r = df.select(*[c.alias(n) for n, c in visual.observed(F.col("t")).items()]).collect()
    assert r[0].asDict() == {"observed_models": ["PS5 Console", "iPhone 13 Pro Max"], "observed_storages": ["128GB", "2TB"], "observed_chips": ["M2"], "observed_demo_cues": ["DEMO UNIT"], "observed_conditions": ["Sealed"]}
    assert all(v == [] for v in r[1].asDict().values())


def test_clusters_of_batches_equal_those_of_all(spark, tmp_path):
    rng = random.Random(6)
    e = [(f"v{rng.randrange(60):02d}", f"v{rng.randrange(60):02d}") for _ in range(50)]
    src, state, cp = (str(tmp_path / x) for x in ("in", "state", "cp"))
    for part in (e[:20], e[20:35], e[35:], e[:5]):
        spark.createDataFrame(part, "a string, b string").write.mode("append").parquet(src)
        clusters.cluster_stream(spark.readStream.schema("a string, b string").parquet(src), state, cp).awaitTermination()
    got = {r.id: r.component for r in clusters.clusters(spark, state).collect()}
    assert got == {r.id: r.component for r in clusters.merge_clusters(None, spark.createDataFrame(e, "a string, b string")).collect()}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("v=")]) <= 2


def test_sinks(spark, tmp_path):
    t = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert sinks.insert_absent(df, t, ["k"]) == 2 and sinks.insert_absent(df, t, ["k"]) == 0
    assert sinks.insert_absent(spark.createDataFrame([("c", 9)], "k string, v int"), t, ["k"]) == 1
    lines = str(tmp_path / "lines")
    for _ in range(2):
        sinks.append_lines(sinks.stamp(df, "run-1", "1", "2026-01-01 00:00:00"), lines)
    assert spark.read.json(lines).filter("run_id = 'run-1'").count() == 8
    (tmp_path / "x1.txt").write_text("same")
    (tmp_path / "x2.txt").write_text("same")
    sinks.keep_raw(spark, str(tmp_path / "x*.txt"), str(tmp_path / "raw"), "c1")
    assert spark.read.parquet(str(tmp_path / "raw")).select("case", "file_name").count() == 1
    p = spark.createDataFrame([("b", "a", "k"), ("a", "b", "k"), ("a", "a", "k"), ("a", None, "k")], "x string, y string, k string")
    r = sinks.relationship_records(p, "x", "y", "k").collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].seen) == ("a", "b", 2)


def test_state_does_not_grow_with_sightings(spark, tmp_path):
    src, state, cp = (str(tmp_path / x) for x in ("in", "state", "cp"))
    for lo, hi in itertools.pairwise((0, 5, 9, 12)):
        spark.createDataFrame([("k", f"s{i % 10}", i) for i in range(lo, hi)], "key string, sighting string, at int").write.mode("append").parquet(src)
        ingest.upsert_stream(spark.readStream.schema("key string, sighting string, at int").parquet(src), state, cp).awaitTermination()
    r = ingest.latest_state(spark, state).collect()
    assert [(x.key, x.first_seen, x.last_seen, x.sightings) for x in r] == [("k", 0, 9, 10)]


def test_cli(capsys):
    assert cli.main(["list"]) == 0 and "price_benchmark" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/tmp"]) == 2
