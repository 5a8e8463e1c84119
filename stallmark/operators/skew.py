"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.session import cut

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys:
#: the list of them has a proven bound and may be broadcast whatever the size of the data.
HOT_SHARE = 1000
SALTS = 16
#: A key of fewer rows than this never slows a task down, so it is not looked for.
FLOOR = 200_000


def hot_keys(df: DataFrame, keys: list[str], floor: int = FLOOR, total: int | None = None) -> DataFrame:
    """Keys with more than max(floor, rows / HOT_SHARE) rows: at most HOT_SHARE rows come out."""
    total = df.count() if total is None else total
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(floor, total / HOT_SHARE)).select(*keys)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread: Column,
    how: str = "inner",
    salts: int = SALTS,
    strategy: str | None = None,
) -> DataFrame:
    """Shuffle join of ``big`` with ``small`` (one or few rows a key) whose hot keys are spread over ``salts`` tasks.

    ``hot`` lists the hot keys and must be bounded (see :func:`hot_keys`); ``spread`` is any column of ``big``
    that varies within a key. Keys compare null-safely and come out once. Other columns must not clash. ``strategy`` is a
    join hint ("merge": never broadcast).
    """
    h = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).withColumn("_hot", F.lit(True)))

    def same(df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_h_{k}")) for k in keys])

    gone = [f"_h_{k}" for k in keys] + ["_hot"]
    b = (
        big.withColumn("_spread", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        .join(h, same(big), "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(F.lit(0)))
        .drop("_spread", *gone)
    )
    s = (
        small.join(h, same(small), "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        .drop(*gone)
    )
    s = s.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_salt").alias("_s_salt"), *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]) & (F.col("_salt") == F.col("_s_salt"))
    return b.join(s.hint(strategy) if strategy else s, on, how).drop("_salt", "_s_salt", *[f"_s_{k}" for k in keys])


def find_hot(df: DataFrame, keys: list[str], total: int, floor: int = FLOOR) -> DataFrame | None:
    """The hot keys of a materialised table of ``total`` rows, or None: no key of at most ``floor`` rows is hot."""
    if total <= floor:
        return None
    hot = cut(hot_keys(df, keys, floor, total))
    return None if hot.isEmpty() else hot


def join_with_hot(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, spread: Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """:func:`salted_join` where there are hot keys, a plain shuffle join where there are none."""
    if hot is not None:
        return salted_join(big, small, keys, hot, spread, how, strategy=strategy)
    s = small.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, c: a & c, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return big.join(s.hint(strategy) if strategy else s, on, how).drop(*[f"_s_{k}" for k in keys])


def balanced_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join that finds the hot keys of ``big`` itself; ``big`` should be materialised since it is counted first."""
    return join_with_hot(big, small, keys, find_hot(big, keys, big.count()), spread, how)
