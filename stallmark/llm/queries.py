"""Queries of the llm operators: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.llm import canonical, components, leakage, mixing, neardup, percentiles, pii, products, truncation
from stallmark.session import cut, spread, table

LEVELS = {"model_day": ["model", "day"], "model": ["model"], "day": ["day"], "all": []}


def _price_groups() -> dict[str, Column]:
    return {"model": F.col("product.model"), "day": F.to_date("collection_metadata.collected_at")}


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of price per model and day, per model, per day and of all, from one mergeable summary by day."""
    s = cut(percentiles.summarise(table(spark, d, "olx_listings"), F.col("price"), _price_groups()))
    r = percentiles.radix_select(percentiles.with_levels(s, ["model", "day"], LEVELS), ["level", "model", "day"])
    return r.withColumn("day", F.col("day").cast("string"))


def p1_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per model from summaries of single days of 32 bits (error below 1e-6 of the value), combined."""
    days = percentiles.summarise(table(spark, d, "olx_listings"), F.col("price"), _price_groups(), bits=32)
    return percentiles.radix_select(cut(percentiles.merge(days.drop("day"))), ["model"])


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "synthetic_listings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = pii.redact_table(_synthetic(spark, d), "record_id", {"title": True, "description": False}, pii.session_key(spark))
    return r.select("record_id", "field", F.explode("mentions").alias("m")).select("record_id", "field", "m.pii_kind", "m.occurrence")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of every record with placeholders."""
    r = pii.redact_table(_synthetic(spark, d), "record_id", {"title": True, "description": False}, pii.session_key(spark))
    return r.select("record_id", "field", "redacted")


def _listing_id(c: str) -> Column:
    x = F.upper(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    return F.when(F.length(x) > 0, x)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "image_matches").select(_listing_id("listing_a").alias("a"), _listing_id("listing_b").alias("b"))
    g = components.connected_components(None, m)
    return g.select(F.col("id").alias("listing_id"), "group_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return products.group_pairs(products.same_products(_synthetic(spark, d)))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a record with the group of its product."""
    return products.same_products(_synthetic(spark, d)).select(F.col("id").alias("record_id"), "group_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_values")
    a = canonical.map_values(table(spark, d, "olx_listings"), "record_id", "location", c, "city").withColumn("field", F.lit("olx_listings.location"))
    b = canonical.map_values(_synthetic(spark, d), "record_id", "brand", c, "brand").withColumn("field", F.lit("synthetic_listings.brand"))
    return a.unionByName(b).select("field", "record_id", "ref_id")


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _synthetic(spark, d).filter(F.length(F.regexp_replace("description", r"(?U)\s", "")) > 0)
    return neardup.near_duplicates(s, "record_id", neardup.word_set(F.col("title"), F.col("description")), 0.7, 20)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*_similar(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record: its class of equal word sets, its cluster of linked classes and the links of its class."""
    member, pairs = _similar(spark, d)
    pairs = cut(pairs)
    links = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    cluster = components.connected_components(member.select("cid"), pairs).select(F.col("id").alias("cid"), F.col("group_id").alias("cluster_id"))
    return member.join(cluster, "cid").join(links, "cid", "left").select(F.col("id").alias("record_id"), F.col("cid").alias("class_id"), "cluster_id", F.coalesce("links", F.lit(0)).alias("links"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: the number of affected documents and the longest leaked run."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest_run"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.count_tokens(spread(table(spark, d, "documents").select("doc_id", "source", "text")), "text").withColumn("weight", mixing.quality(F.col("text")))
    return mixing.mix(docs, table(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen document and how often it is used."""
    return _mix(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of the sources."""
    return _mix(spark, d)[1]


def _ends(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(truncation.score_ends(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _ends(spark, d).filter("cut").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of cut values per source."""
    return truncation.rates(_ends(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_percentiles, p1_merged_days, p2_found, p2_redacted, p3_found, p4_found, p4_groups, p5_found, p6_found, p6_classes, p7_found, p7_items, p8_selection, p8_report, p9_found, p9_rates)
}

#: p1_merged_days says what 32 bits leave of the exact value: 20 binary digits after the first. Only p1 and p3 have the form of a query that plain SQL runs over whole tables in reasonable time; p6 has it on small tables only.
SQL: dict[str, str] = {
    "p1_percentiles": """
with b as (
  select product.model as model, cast(collection_metadata.collected_at as date) as day, price
  from olx_listings where price is not null and not isnan(price)),
l as (
  select 'model_day' as level, model, day, price from b
  union all select 'model', model, null, price from b
  union all select 'day', null, day, price from b
  union all select 'all', null, null, price from b),
r as (
  select *, row_number() over (partition by level, model, day order by price) as rk,
         count(*) over (partition by level, model, day) as n from l),
t(qq, q) as (values (500, 0.05::double), (2500, 0.25::double), (5000, 0.5::double), (7500, 0.75::double), (9500, 0.95::double))
select level, model, cast(day as varchar) as day, q, n, price as value from r, t where rk = greatest(1, (qq * n + 9999) // 10000)
""",
    "p1_merged_days": """
with r as (
  select product.model as model, price, row_number() over (partition by product.model order by price) as rk, count(*) over (partition by product.model) as n
  from olx_listings where price is not null and not isnan(price)),
t(qq, q) as (values (500, 0.05::double), (2500, 0.25::double), (5000, 0.5::double), (7500, 0.75::double), (9500, 0.95::double)),
x as (select model, q, n, price, case when price <> 0 then pow(2, floor(log2(abs(price))) - 20) end as step from r, t where rk = greatest(1, (qq * n + 9999) // 10000))
select model, q, n, case when price = 0 then 0 else sign(price) * floor(abs(price) / step) * step end as value from x
""",
    "p3_found": r"""
with recursive m as (
  select nullif(upper(regexp_replace(listing_a, '^[\s\x{00A0}\x{200B}\x{FEFF}]+|[\s\x{00A0}\x{200B}\x{FEFF}]+$', '', 'g')), '') as a,
         nullif(upper(regexp_replace(listing_b, '^[\s\x{00A0}\x{200B}\x{FEFF}]+|[\s\x{00A0}\x{200B}\x{FEFF}]+$', '', 'g')), '') as b
  from image_matches),
ids as (select a as id from m where a is not null union select b from m where b is not null),
e as (select a, b from m where a <> b union select b, a from m where a <> b),
reach(id, r) as (select id, id from ids union select reach.id, e.b from reach join e on e.a = reach.r)
select id as listing_id, min(r) as group_id from reach group by id
""",
}
