"""Sequential numbers over a whole table, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.session import cut


def number_rows(df: DataFrame, order: list[Column], out: str = "number") -> DataFrame:
    """Add 1, 2, 3 .. in a total order. Rows are sorted by ranges, counted per range, and the counts (one row a range) added up."""
    s = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r.p: r.n for r in s.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a range
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    o = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p bigint, _start bigint")
    return s.join(F.broadcast(o), part == F.col("_p")).withColumn(out, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_p", "_start")


def labelled(number: Column, prefix: str, width: int) -> Column:
    """PREFIX-0001: a number filled with zeros, longer numbers whole."""
    s = number.cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))
