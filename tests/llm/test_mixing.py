from pyspark.sql import functions as F

from stallmark.llm import mixing


def run(spark, docs, targets, **k):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, weight double")
    return mixing.mix(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **k)


def test_shares_epochs_and_caps(spark):
    docs = [(i, "big", 10, 1.0) for i in range(1000)] + [(2000 + i, "small", 10, 1.0) for i in range(30)] + [(5000, "other", 10, 1.0), (5001, None, 10, 1.0), (5002, "big", None, 1.0)]
    sel, rep = run(spark, docs, [("big", 0.5, 1), ("small", 0.4, 4), ("none", 0.1, 2)], budget=2000)
    got = {r.source: r for r in rep.collect()}
    assert got["big"].reached == 1000 and got["small"].reached == 800 and got["none"].reached == 0
    use = {r.doc_id: r.repeats for r in sel.filter("source = 'small'").collect()}
    assert len(use) == 30 and set(use.values()) <= {2, 3} and sum(use.values()) == 80
    sel, rep = run(spark, docs, [("small", 1.0, 4)], budget=100_000)
    assert {r.repeats for r in sel.collect()} == {4} and rep.first().reached == 1200


def test_sample_is_the_run_of_smallest_keys(spark):
    docs = [(i, "s", 1 + i % 7, 0.2 + (i % 5) / 5) for i in range(500)]
    sel, _ = run(spark, docs, [("s", 1.0, 1)], budget=700)
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, weight double")
    keyed = sorted((r.k, r.doc_id, r.tokens) for r in d.select(mixing.sampling_key(F.col("doc_id"), F.col("weight"), 7).alias("k"), "doc_id", "tokens").collect())
    want, total = set(), 0
    for _, i, t in keyed:
        if total + t > 700:
            break
        want.add(i)
        total += t
    assert {r.doc_id for r in sel.collect()} == want


def test_empty_and_tokens(spark):
    sel, rep = run(spark, [], [("s", 1.0, 1)])
    assert sel.count() == 0 and rep.first().reached == 0
    t = spark.createDataFrame([("Hello world",), (None,), ("",)], "text string")
    assert [r.tokens for r in mixing.count_tokens(t, "text").collect()] == [2, 0, 0]


def test_counts_of_both_libraries_agree():
    import os

    import pytest

    files = [mixing.TOKENIZER, mixing.TOKENIZER.replace(".tiktoken", ".json")]
    if not all(map(os.path.exists, files)):
        pytest.skip("no vocabulary files")
    texts = ["", "it's 12 o'clock  \n\n <|endoftext|> नमस्ते", "word " * 3_000, "x" * 2_000] * 100
    assert mixing._counter(files[0])(texts) == mixing._counter(files[1])(texts)
