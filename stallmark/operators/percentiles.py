"""Percentiles of very large numeric columns by radix selection.

A double is mapped to a signed 64-bit integer that sorts like it. The histogram of the highest digit of these
integers finds, for every target rank, the digit that holds it; only the values under that digit are counted by the
next digit, and so on. A digit that holds one distinct value is the answer, so most ranks are found after a digit or
two. Each step moves digit counts (at most 2**16 a group) and never the values of a group, so no group is ever sorted or
gathered in one task.

The summary of a part of the data (a day, a file) is the table (group, integer, count). Summaries add up: the union
of the summaries of the parts, summed, is the summary of the whole. With ``bits`` = 64 results are exact order
statistics; with fewer bits a result is at most a factor 1 + 2**(12 - bits) below the exact one in magnitude (an
error of one digit), and a group keeps at most 2**bits counters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.operators.skew import HOT_SHARE, salted_join
from stallmark.session import cut

DIGIT_BITS = 16
SHIFTS = tuple(range(64 - DIGIT_BITS, -1, -DIGIT_BITS))
#: Up to this many open targets (counted before each step) are broadcast; more are joined by a salted shuffle.
FEW = 50_000


def order_key(value: Column) -> Column:
    """Order-preserving map from double to bigint; -0.0 counts as 0.0, null and NaN give null."""
    x = value.cast("double")
    a = F.abs(x)
    e0 = F.floor(F.log2(a)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e0) > a, e0 - 1).when(F.pow(F.lit(2.0), e0 + 1) <= a, e0 + 1).otherwise(e0)
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(2**52))).cast("bigint")
    bits = (
        F.when(a == 0, F.lit(0).cast("bigint"))
        .when(a == F.lit(float("inf")), F.lit(0x7FF << 52).cast("bigint"))
        .when(a < F.lit(2.0**-1022), (a / F.lit(5e-324)).cast("bigint"))
        .otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + mantissa)
    )
    return F.when(F.isnan(x), None).otherwise(F.when(x < 0, -bits).otherwise(bits))


def key_value(key: Column) -> Column:
    """Inverse of :func:`order_key`."""
    bits = F.abs(key)
    e = F.shiftright(bits, 52).cast("int")
    m = bits.bitwiseAND(F.lit((1 << 52) - 1).cast("bigint")).cast("double")
    mag = (
        F.when(e == 0, m * F.lit(5e-324))
        .when(e == 0x7FF, F.lit(float("inf")))
        .otherwise((F.lit(1.0) + m / F.lit(float(2**52))) * F.pow(F.lit(2.0), e - 1023))
    )
    return F.when(key < 0, -mag).otherwise(mag)


def summarise(df: DataFrame, value: Column, groups: dict[str, Column], bits: int = 64) -> DataFrame:
    """Mergeable summary: group columns, ``key`` (highest ``bits`` bits kept, rounded towards zero), ``cnt``.

    Null and NaN values are left out; an empty input gives an empty summary.
    """
    if not 12 < bits <= 64:
        raise ValueError("bits must be 13 to 64")
    key, low = order_key(value), F.lit(64 - bits)
    if bits < 64:
        mag = F.call_function("shiftleft", F.call_function("shiftright", F.abs(key), low), low)
        key = F.when(key < 0, -mag).otherwise(mag)
    return (
        df.select(*[c.alias(n) for n, c in groups.items()], key.alias("key"))
        .filter(F.col("key").isNotNull())
        .groupBy(*groups, "key")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def merge(*summaries: DataFrame) -> DataFrame:
    """Summary of the union of the parts the given summaries describe."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy(*[c for c in every.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def with_levels(summary: DataFrame, groups: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Repeat a summary once a level; a level keeps the named groups and has null in the others."""
    dtypes = dict(summary.dtypes)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("level"), *[(F.col(g) if g in keep else F.lit(None).cast(dtypes[g])).alias(g) for g in groups])
            for n, keep in levels.items()
        ]
    )
    return summary.select(F.explode(rows).alias("_l"), "key", "cnt").select("_l.*", "key", "cnt")


def select_ranks(summary: DataFrame, groups: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """Values of given ranks per group of a summary: groups, ``n``, ``tag``, ``value``.

    ``wanted`` maps the size of a group to an array of (tag, rank), ranks from 1 to n. ``summary`` should be a written
    table: every digit reads it once more.
    """
    size = summary.groupBy(*groups).agg(F.sum("cnt").alias("n"))
    target = size.select(*groups, "n", F.explode(wanted(F.col("n"))).alias("_t")).select(*groups, "n", F.col("_t.tag").alias("tag"), F.col("_t.rank").alias("rank"), F.lit(0).cast("bigint").alias("prefix"))
    parent, found, left, most = [*groups, "prefix"], [], 0, 0
    for i, shift in enumerate(SHIFTS):
        digit = F.shiftright("key", shift) if shift else F.col("key")
        if i == 0:
            under = summary.withColumn("prefix", F.lit(0).cast("bigint"))
        else:
            keyed, only = summary.withColumn("prefix", F.shiftright("key", SHIFTS[i - 1])), target.select(*parent).distinct()
            if left <= FEW:
                o = F.broadcast(only.select(*[F.col(c).alias(f"_o_{c}") for c in parent]))
                under = keyed.join(o, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in parent]), "left_semi")
            else:
                hot = target.filter(F.col("held") > max(20_000, most / HOT_SHARE)).select(*parent).distinct()
                under = salted_join(keyed, only, parent, hot, F.col("key"))
        hist = under.groupBy(*parent, digit.alias("digit")).agg(F.sum("cnt").alias("held"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = ", ".join(f"`{c}`" for c in parent)
        ends = hist.withColumn("upto", F.expr(f"sum(held) over (partition by {over} order by digit)"))
        t = target.select(*[F.col(c).alias(f"_t_{c}") for c in parent], "n", "tag", "rank")
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in parent])
        hit = ends.join(t, on & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("held")))
        hit = cut(hit.select(*groups, "n", "tag", (F.col("rank") - F.col("upto") + F.col("held")).alias("rank"), F.col("digit").alias("prefix"), "held", "lo", "hi"))
        found.append(hit.filter("lo = hi").select(*groups, "n", "tag", key_value(F.col("lo")).alias("value")))
        target = hit.filter("lo < hi")
        left, most = target.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        if not left:
            break
    return reduce(DataFrame.unionByName, found)


def _pick(quantiles: tuple[float, ...], at: Callable[[Column, int], Column]) -> Callable[[Column], Column]:
    return lambda n: F.array(*[F.struct(F.lit(q).alias("tag"), at(n, round(q * 10_000)).alias("rank")) for q in quantiles])


def radix_select(summary: DataFrame, groups: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Order statistics of rank ceil(q * n) per group of a summary: groups, ``q``, ``n``, ``value``.

    Repeated values count as often as they occur; a group of one value gives it for every q. q has four decimals.
    """
    rank = lambda n, q: F.greatest(F.lit(1).cast("bigint"), F.floor((n * q + 9999) / 10_000).cast("bigint"))
    return select_ranks(summary, groups, _pick(quantiles, rank)).select(*groups, F.col("tag").alias("q"), "n", "value")


def interpolated(df: DataFrame, value: Column, groups: dict[str, Column], quantiles: dict[str, float]) -> DataFrame:
    """Linear percentiles per group, one row a group: groups, ``n``, one column a name of ``quantiles``.

    Null and NaN count for nothing; groups without values do not come out. Two order statistics a quantile are selected
    by digits, so no group is gathered in one buffer. Without groups the result is one row, or none for no values.
    """
    s = cut(summarise(df, value, groups))
    names = list(quantiles)

    def wanted(n: Column) -> Column:
        rows = []
        for name in names:
            p = (n - 1) * F.lit(quantiles[name])
            rows += [F.struct(F.lit(f"{name}/lo").alias("tag"), (F.floor(p) + 1).cast("bigint").alias("rank")), F.struct(F.lit(f"{name}/hi").alias("tag"), (F.ceil(p) + 1).cast("bigint").alias("rank"))]
        return F.array(*rows)

    r = select_ranks(s, list(groups), wanted)
    at = {t: F.max(F.when(F.col("tag") == t, F.col("value"))) for name in names for t in (f"{name}/lo", f"{name}/hi")}
    r = r.groupBy(*groups).agg(F.max("n").alias("n"), *[c.alias(f"_{i}") for i, c in enumerate(at.values())])
    out = []
    for i, name in enumerate(names):
        lo, hi, p = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), (F.col("n") - 1) * F.lit(quantiles[name])
        out.append((lo + (hi - lo) * (p - F.floor(p))).alias(name))
    return r.filter("n is not null").select(*groups, "n", *out)
