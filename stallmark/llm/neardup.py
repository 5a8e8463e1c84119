"""Near-duplicate records: all pairs whose word sets have a Jaccard similarity of at least a threshold.

Each distinct word set (exact copies are one class from here on) gets two fingerprints: a vector of minimum hashes,
split into blocks of ``rows`` components, and a 128-bit parity sketch in which every word flips one bit. By the
pigeonhole principle two sets whose minimum hashes differ in fewer components than there are blocks share a whole
block, so the sets are joined on blocks. The sketches of a joined pair must then lie within the Hamming distance that
the threshold allows: sketches of sets differ in at most as many bits as the sets differ in words, and sets a, b with
Jaccard t differ in at most (1 - t) / (1 + t) * (a + b) words, so this step loses nothing. What is left is compared
word by word.

A pair of similarity s shares a block with probability 1 - (1 - s**rows)**blocks: 0.991 at 0.70, 0.9997 at 0.75 and
1 - 2e-7 at 0.80 for the defaults. No block is capped and no pair dropped; crowded blocks are joined on rare words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.operators.skew import balanced_join, find_hot, join_with_hot
from stallmark.session import cut

BLOCKS, ROWS = 80, 8
#: Classes in a block, or records in a class, from which comparing all with all is split up.
HOT_BLOCK = 1_000
BUCKETS = 1 << 18


def word_set(*texts: Column) -> Column:
    """Sorted distinct words of the texts joined by blanks, in lower case; a word is a run of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(words))


@lru_cache(maxsize=1)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_917)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _fingerprint(hashes: np.ndarray, blocks: int, rows: int) -> tuple[np.ndarray, int, int]:
    a, b = _coefficients(blocks * rows)
    x = hashes.astype(np.uint64)
    m = ((x[:, None] * a[None, :] + b[None, :]) >> np.uint64(32)).min(axis=0).astype(np.uint64).reshape(blocks, rows)
    mix = np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        mix = (mix ^ m[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        mix ^= mix >> np.uint64(29)
    bit = (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(57)
    sketch = 0
    for k in bit.tolist():
        sketch ^= 1 << k
    lo, hi = sketch & (2**64 - 1), sketch >> 64
    return mix.view(np.int64), lo - 2**64 if lo >= 2**63 else lo, hi - 2**64 if hi >= 2**63 else hi


def fingerprint_blocks(sets: DataFrame, blocks: int, rows: int) -> DataFrame:
    """``cid``, ``hashes`` (array<bigint>) to ``cid``, ``size``, ``lo``, ``hi``, ``blocks`` (array<bigint>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_fingerprint(np.asarray(h, dtype=np.int64), blocks, rows) for h in pdf["hashes"]]
            yield pd.DataFrame({"cid": pdf["cid"], "size": [len(h) for h in pdf["hashes"]], "lo": [o[1] for o in out], "hi": [o[2] for o in out], "blocks": [o[0] for o in out]})

    return sets.mapInPandas(run, "cid bigint, size int, lo bigint, hi bigint, blocks array<bigint>")


def classes(df: DataFrame, ident: str, words: Column, least: int) -> DataFrame:
    """``id``, ``cid`` (smallest id with the same words), ``words`` for records of at least ``least`` different words."""
    d = df.select(F.col(ident).alias("id"), words.alias("words")).filter(F.size("words") >= least)
    d = cut(d.withColumn("content", F.sha2(F.concat_ws(" ", "words"), 256)))  # words are computed once
    same = d.groupBy("content").agg(F.min("id").alias("cid"))
    return balanced_join(d, same, ["content"], F.col("id")).select("id", "cid", "words")


def _candidates(b: DataFrame, key: list[str], near: Column, hot: DataFrame | None = None) -> DataFrame:
    """``cid_a`` < ``cid_b`` that share the key and pass ``near``, once each; hot keys are split over tasks."""
    x, y = (b.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "size", "lo", "hi")]) for s in "ab")
    j = x.hint("merge").join(y, key) if hot is None else join_with_hot(x, y, key, hot, F.col("cid_a"))
    return j.filter(near).select("cid_a", "cid_b").distinct()


def similar_classes(reps: DataFrame, threshold: float, blocks: int = BLOCKS, rows: int = ROWS) -> DataFrame:
    """``cid_a`` < ``cid_b``, ``similarity`` for all classes whose word sets reach the threshold. ``reps``: ``cid``, ``words``.

    No join is broadcast: blocks and words grow with the data. A block that more than HOT_BLOCK classes share (a template)
    would compare all of them with each other; within such a block the sets are joined on their rarest words instead.
    Of two sets that reach the threshold one of the first n - ceil(t * n) + 1 words, ordered from rare to frequent, is
    in both, so this loses nothing.
    """
    reps = cut(reps)
    hashed = reps.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    fp = cut(fingerprint_blocks(hashed, blocks, rows))
    b = fp.select("cid", "size", "lo", "hi", F.explode("blocks").alias("block"))
    apart = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
    near = F.lit((1 - threshold) / (1 + threshold) + 1e-9) * (F.col("size_a") + F.col("size_b"))
    long = F.greatest("size_a", "size_b") * F.lit(threshold - 1e-9) <= F.least("size_a", "size_b")
    near = (F.col("cid_a") < F.col("cid_b")) & long & (apart <= near)
    # a crowded block lies in a crowded bucket; only blocks of these few buckets (at most BUCKETS) are counted themselves
    bucket = F.pmod("block", F.lit(BUCKETS)).cast("int")
    busy = cut(b.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > HOT_BLOCK).select("bucket"))
    full = None
    if not busy.isEmpty():
        some = b.join(F.broadcast(busy), bucket == F.col("bucket"), "left_semi")
        full = cut(some.groupBy("block").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > HOT_BLOCK).select("block"))
    if full is None or full.isEmpty():
        pairs = _candidates(b, ["block"], near)
    else:
        cold = b.join(full.hint("merge"), "block", "left_anti")
        crowd = cut(b.join(full.hint("merge"), "block", "left_semi"))
        words = reps.join(crowd.select("cid").distinct().hint("merge"), "cid", "left_semi").select("cid", F.size("words").alias("n"), F.explode("words").alias("word"))
        df = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
        words = cut(words)
        ranked = join_with_hot(words, df, ["word"], find_hot(words, ["word"], words.count()), F.col("cid")).groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))  # a set of words a row
        first = ranked.select("cid", F.slice("w.word", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1).alias("first"))
        keyed = cut(crowd.join(first.hint("merge"), "cid").select("block", "cid", "size", "lo", "hi", F.explode("first").alias("word")))
        pairs = _candidates(cold, ["block"], near).unionByName(_candidates(keyed, ["block", "word"], near, find_hot(keyed, ["block", "word"], keyed.count(), floor=HOT_BLOCK))).distinct()
    pairs = pairs.join(reps.select(F.col("cid").alias("cid_a"), F.col("words").alias("wa")).hint("merge"), "cid_a")
    pairs = pairs.join(reps.select(F.col("cid").alias("cid_b"), F.col("words").alias("wb")).hint("merge"), "cid_b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return (
        pairs.select("cid_a", "cid_b", shared.alias("s"), (F.size("wa") + F.size("wb")).alias("n"))
        .withColumn("similarity", F.col("s") / (F.col("n") - F.col("s")))
        .filter(F.col("s") >= F.lit(threshold - 1e-12) * (F.col("n") - F.col("s")))
        .select("cid_a", "cid_b", "similarity")
    )


def near_duplicates(df: DataFrame, ident: str, words: Column, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Membership (``id``, ``cid``) and the pairs of class representatives (``cid_a``, ``cid_b``, ``similarity``).

    Records with null words or fewer than ``least`` different words take no part. Exact copies share a class; every
    link between different texts comes out.
    """
    member = cut(classes(df.filter(F.col(ident).isNotNull()), ident, words, least))
    reps = member.filter(F.col("id") == F.col("cid")).select("cid", "words").dropDuplicates(["cid"])
    return member.select("id", "cid"), similar_classes(reps, threshold)


def expand_pairs(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """All record pairs ``record_a`` < ``record_b`` of similar or equal classes; large classes are split over tasks."""
    member = cut(member)
    ma, mb = (member.select(F.col("id").alias(f"id_{s}"), F.col("cid").alias(f"cid_{s}")) for s in "ab")
    hot = find_hot(member, ["cid"], member.count(), floor=HOT_BLOCK)
    pairs = pairs.select("cid_a", "cid_b")
    across = pairs.join(ma.hint("merge"), "cid_a") if hot is None else join_with_hot(ma, pairs, ["cid_a"], hot.withColumnRenamed("cid", "cid_a"), F.col("id_a"))
    across = across.join(mb.hint("merge"), "cid_b") if hot is None else join_with_hot(mb, across, ["cid_b"], hot.withColumnRenamed("cid", "cid_b"), F.col("id_b"))
    x, y = ma.withColumnRenamed("cid_a", "cid"), mb.withColumnRenamed("cid_b", "cid")
    within = x.hint("merge").join(y, "cid") if hot is None else join_with_hot(x, y, ["cid"], hot, F.col("id_a"))
    every = across.select("id_a", "id_b").unionByName(within.filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b"))
    return every.select(F.least("id_a", "id_b").alias("record_a"), F.greatest("id_a", "id_b").alias("record_b"))
