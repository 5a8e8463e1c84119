"""Feature audit and matrix, robust scaling, isolation forest, persistence and sensitivity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.operators import percentiles

TREES, SAMPLE, SEED = 150, 256, 42


def feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing rate (4 digits), distinct values with null as one, constant flag; one pass."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count_if(F.col(c).isNull()).alias("m"), F.count_distinct(c).alias("d")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("missing"), (F.col(f"{c}.d") + F.when(F.col(f"{c}.m") > 0, 1).otherwise(0)).alias("distinct_values")) for c in columns])
    return n.select("rows", F.explode(rows).alias("r")).select("r.feature", F.round(F.col("r.missing") / F.col("rows"), 4).alias("missing_rate"), "r.distinct_values", (F.col("r.distinct_values") <= 1).alias("is_constant"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR of each column with exact percentiles; an IQR of zero counts as one. One row of statistics is joined."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    rows = percentiles.interpolated(long, F.col("value"), {"feature": F.col("feature")}, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()  # one row a column
    stats = {r.feature: (r.q1, r.q2, r.q3) for r in rows}
    out = df
    for c in columns:
        q1, q2, q3 = stats.get(c, (0.0, 0.0, 1.0))
        out = out.withColumn(c, F.round((F.col(c) - F.lit(q2)) / F.lit((q3 - q1) or 1.0), 6))
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or (x == x[0]).all():
        return (len(x),)
    while True:
        f = int(rng.integers(x.shape[1]))
        lo, hi = x[:, f].min(), x[:, f].max()
        if lo < hi:
            break
    at = rng.uniform(lo, hi)
    left = x[:, f] < at
    return f, at, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def _c(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _path(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        t, at, d = stack.pop()
        if len(t) == 1:
            out[at] = d + _c(t[0])
        else:
            left = x[at, t[0]] < t[1]
            stack += [(t[2], at[left], d + 1), (t[3], at[~left], d + 1)]
    return out


def isolation_scores(df: DataFrame, ident: str, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``id``, ``score`` (6 digits, larger is more isolated) of every row.

    The trees are fitted on a bounded sample (trees * sample rows in the order of a hash of the id, so independent of
    the partitioning) and scored on all rows in Arrow batches. Null features count as 0.
    """
    m = df.select(F.col(ident).cast("string").alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    rows = m.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(trees * sample).toPandas()
    x = rows[columns].to_numpy(dtype=float)
    rng = np.random.default_rng(seed)
    n = min(sample, len(x))
    forest = [_grow(x[rng.choice(len(x), n, replace=False)], rng, int(np.ceil(np.log2(max(n, 2))))) for _ in range(trees)] if n else []

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = pdf[columns].to_numpy(dtype=float)
            depth = sum(_path(t, v) for t in forest) / max(len(forest), 1)
            yield pd.DataFrame({"id": pdf["id"], "score": np.round(2.0 ** (-depth / max(_c(n), 1e-9)), 6)})

    return m.mapInPandas(score, "id string, score double")


def flag_share(scores: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Flag the top share of the scores per named contamination, at the exact percentile of the score."""
    r = percentiles.interpolated(scores, F.col("score"), {}, {n: 1 - s for n, s in shares.items()}).first()
    return scores.select("*", *[(F.col("score") > F.lit(r[n] if r else None).cast("double")).alias(n) for n in shares])
