"""Canonical listings from sightings, media, audits, duplicate rules, repository statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_listings(obs: DataFrame, listing: str, order: list[str], attrs: dict[str, Column], seen: str, query: Column) -> DataFrame:
    """One row a listing: attributes of its first sighting, first and last time seen, sightings, distinct queries in order.

    Pre-aggregated before the shuffle. Rows without a listing id are left out; ties of the order are broken by its later columns.
    """
    first = F.struct(*order)
    return obs.filter(F.col(listing).isNotNull()).groupBy(F.col(listing).alias("listing_id")).agg(
        *[F.min_by(c, first).alias(n) for n, c in attrs.items()], F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"),
        F.count(F.lit(1)).alias("observation_count"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(query.isNotNull(), query))), lambda q: q), ", ").alias("search_queries"),
    )


def completeness(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One pass: rows, and per column the number and rate (4 digits) of missing values; one row a column."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("rows"), *[F.count_if(c.isNull()).alias(k) for k, c in columns.items()])
    return row.unpivot("rows", list(columns), "column_name", "missing").select("column_name", "rows", "missing", F.round(F.col("missing") / F.greatest("rows", F.lit(1)), 4).alias("missing_rate"))


def duplicate_rules(df: DataFrame, ident: str, rules: list[tuple[str, float, list[Column]]]) -> DataFrame:
    """First earlier record each record repeats, by rules in order of priority.

    A rule is its name, its score and the columns that must be equal (and not null). A record is compared with all
    records of smaller ``ident``, and the earliest one is named. Per rule one window over its key replaces a self-join:
    the earliest record of a key is the minimum of the group.
    """
    d = df
    for i, (_, _, keys) in enumerate(rules):
        known = F.lit(True)
        for k in keys:
            known = known & k.isNotNull()
        d = d.withColumn(f"_v{i}", F.when(known, F.to_json(F.array(*[k.cast("string") for k in keys]))))  # no value can imitate the separators
    out = d
    for i, _ in enumerate(rules):
        first = d.filter(F.col(f"_v{i}").isNotNull()).groupBy(F.col(f"_v{i}").alias("_v")).agg(F.min(ident).alias(f"_f{i}"))
        out = out.join(first, out[f"_v{i}"] == first["_v"], "left").drop("_v")
    hit = [F.when(F.col(f"_f{i}") < F.col(ident), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("score"), F.col(f"_f{i}").alias("duplicate_of"))) for i, (n, s, _) in enumerate(rules)]
    return out.select(F.col(ident).alias("id"), F.coalesce(*hit).alias("h")).filter("h is not null").select("id", "h.rule", "h.score", "h.duplicate_of")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key under a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def stratified_head(df: DataFrame, stratum: str, order: str, quota: dict[str, int]) -> DataFrame:
    """First rows of each stratum up to its quota, in a fixed order."""
    q = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    w = Window.partitionBy(stratum).orderBy(order)
    return df.filter(F.col(stratum).isin(*quota)).withColumn("stratum_rank", F.row_number().over(w)).filter(F.col("stratum_rank") <= F.element_at(q, F.col(stratum)))
