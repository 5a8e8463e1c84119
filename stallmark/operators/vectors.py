"""Vectors and hashes: cosine top-k, Hamming join, threshold profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.session import cut

BLOCK = 4_096


def cosine_topk(vectors: DataFrame, ident: str, vector: str, k: int = 10, queries: DataFrame | None = None) -> DataFrame:
    """``q``, ``rank``, ``n``, ``similarity`` (4 digits): the k nearest of each query by cosine, ties by id, itself left out.

    A stated query set is searched against all rows in blocks: the queries are cut into blocks of BLOCK vectors, each a
    bounded broadcast, and every partition of the table keeps its k best per query before anything is shuffled.
    """
    q = (vectors if queries is None else queries).select(F.col(ident).cast("bigint").alias("q"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    base = vectors.select(F.col(ident).cast("bigint").alias("n"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        rows = part.toPandas()  # about BLOCK vectors
        if not len(rows):
            continue
        ids = rows["q"].to_numpy()
        m = np.stack(rows["v"].to_numpy()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, m))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for pdf in batches:
                if not len(pdf):
                    continue
                own = pdf["n"].to_numpy()
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                s = np.round(m @ x.T, 4)
                s[ids[:, None] == own[None, :]] = -9.0
                by_id = np.argsort(own, kind="stable")
                take = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
                r = np.take_along_axis(s, take, axis=1)
                hit = pd.DataFrame({"q": np.repeat(ids, take.shape[1]), "n": own[take].ravel(), "similarity": r.ravel()})
                yield hit[hit["similarity"] > -9.0]

        got = base.mapInPandas(best, "q bigint, n bigint, similarity double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return base.select(F.col("n").alias("q"), F.lit(1).alias("rank"), "n", F.lit(0.0).alias("similarity")).limit(0)
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "n")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("q", "rank", "n", "similarity")


def sign_hash(vector: str) -> list:
    """Two bigints holding 32 sign bits each of a 64-dimensional vector: a perceptual-hash stand-in."""

    def half(start: int):
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.get(F.col(vector), i + start) > 0, F.pow(F.lit(2.0), i)).otherwise(F.lit(0.0)))
        return F.aggregate(bits, F.lit(0.0), lambda a, x: a + x).cast("bigint")

    return [half(0).alias("h0"), half(32).alias("h1")]


def hamming_pairs(hashes: DataFrame, ident: str, limit: int = 10) -> DataFrame:
    """Pairs ``a`` < ``b`` of 64-bit hashes (``h0``, ``h1``: 32 bits each) at most ``limit`` bits apart, and the distance.

    Exact by the pigeonhole principle: the 64 bits are cut into limit + 1 bands, a pair within the limit agrees on one
    of them. Equal hashes are one class first, so a group of copies is joined once and expanded at the end.
    """
    h = hashes.select(F.col(ident).alias("id"), "h0", "h1").filter(F.col("h0").isNotNull() & F.col("h1").isNotNull())
    reps = cut(h.groupBy("h0", "h1").agg(F.min("id").alias("rep")))
    bits = F.concat(F.lpad(F.bin("h1"), 32, "0"), F.lpad(F.bin("h0"), 32, "0"))
    edges = [round(64 * i / (limit + 1)) for i in range(limit + 2)]
    bands = F.array(*[F.concat(F.lit(f"{i}:"), F.substring(bits, s + 1, e - s)) for i, (s, e) in enumerate(zip(edges, edges[1:]))])
    b = reps.select("rep", "h0", "h1", F.explode(bands).alias("band"))
    x, y = (b.select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "h0", "h1")]) for s in "xy")
    d = F.bit_count(F.col("h0_x").bitwiseXOR(F.col("h0_y"))) + F.bit_count(F.col("h1_x").bitwiseXOR(F.col("h1_y")))
    near = x.join(y, "band").filter("rep_x < rep_y").withColumn("distance", d).filter(F.col("distance") <= limit).select("rep_x", "rep_y", "distance").distinct()
    member = h.join(reps, ["h0", "h1"]).select("id", "rep")
    p = near.join(member.select(F.col("rep").alias("rep_x"), F.col("id").alias("x")), "rep_x").join(member.select(F.col("rep").alias("rep_y"), F.col("id").alias("y")), "rep_y")
    same = member.select("rep", F.col("id").alias("x")).join(member.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y", F.lit(0).alias("distance"))
    return p.select("x", "y", "distance").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
