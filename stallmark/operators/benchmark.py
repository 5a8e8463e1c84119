"""Robust price benchmarks of groups, positions within a group, threshold counts, crosstabs and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.operators import percentiles

#: Smallest comparable group, groups that compare nothing, discount bands in percent of the median.
MIN_GROUP = 5
GENERIC = ["Unknown Product", "Generic Smartphone", "Generic Laptop"]
BANDS = [10, 20, 30, 35, 50]


def comparable(df: DataFrame, group: str, price: str) -> DataFrame:
    return df.filter((F.col(price) > 0) & ~F.isnan(price) & F.col(group).isNotNull() & ~F.col(group).isin(GENERIC))


def price_benchmark(df: DataFrame, group: str, price: str, least: int = MIN_GROUP) -> DataFrame:
    """Count, exact linear percentiles, mean, population deviation and range of each group of at least ``least`` rows.

    The percentiles are selected by digits, so no group is gathered in one buffer.
    """
    c = comparable(df, group, price)
    g = c.groupBy(F.col(group).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.avg(price).alias("mean_price"), F.stddev_pop(price).alias("std_price"),
    )
    p = percentiles.interpolated(c, F.col(price), {"model": F.col(group)}, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    return g.filter(F.col("n") >= least).join(p, "model").select(
        "model", "n", *[F.round(k, 4).alias(k) for k in ("min_price", "q1", "median", "q3", "max_price", "mean_price", "std_price")], F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
    )


def with_median(df: DataFrame, group: str, price: str, least: int = MIN_GROUP) -> DataFrame:
    """Comparable rows with the size and the median of their group; groups of fewer than ``least`` rows are left out."""
    c = comparable(df, group, price)
    m = percentiles.interpolated(c, F.col(price), {group: F.col(group)}, {"group_median": 0.5}).withColumnRenamed("n", "group_n").filter(F.col("group_n") >= least)
    return c.join(m, group)


def price_thresholds(df: DataFrame, group: str, price: str) -> DataFrame:
    """Per group and in total: rows at or below -10 to -50 % of the median (cumulative) and their share."""
    d = with_median(df, group, price).withColumn("_d", F.col(price) / F.col("group_median") - 1)
    counts = [F.count_if(F.col("_d") <= -b / 100).alias(f"below_{b}") for b in BANDS]
    return (
        d.rollup(F.col(group).alias("model")).agg(F.count(F.lit(1)).alias("n"), *counts)
        .select(F.coalesce("model", F.lit("ALL")).alias("model"), "n", *[f"below_{b}" for b in BANDS], F.round(100 * F.col("below_35") / F.col("n"), 1).alias("share_35_pct"))
    )


def price_position(df: DataFrame, ident: str, group: str, price: str) -> DataFrame:
    """Percentile rank, difference and ratio to the median, and flags of every comparable row.

    The rank needs no sort of a group in one task: rows are counted per distinct price first, ranked among these, and
    the result is joined back.
    """
    d = with_median(df, group, price)
    w = Window.partitionBy(group).orderBy(price)
    per = d.groupBy(group, price).agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(w)).drop("_c")
    r = F.col(price) / F.col("group_median")
    return d.join(per, [group, price]).select(
        F.col(ident).alias("id"), F.col(group).alias("model"), F.col(price).alias("price"), F.round(F.col("_upto") / F.col("group_n") * 100, 2).alias("percentile_rank"),
        F.round(F.col(price) - F.col("group_median"), 6).alias("delta"), F.round(r, 6).alias("ratio"),
        F.when(r - 1 <= -0.35, 1).otherwise(0).alias("flag_35"), F.when(r - 1 <= -0.5, 1).otherwise(0).alias("flag_50"),
    )


def crosstab_share(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of pairs of values and their share of the row, in percent."""
    n = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("row_value"), F.col(col).alias("col_value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("row_value")), 2))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Counts of fixed bins; values outside fall into bins 0 and bins + 1, null is left out."""
    return df.select(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
