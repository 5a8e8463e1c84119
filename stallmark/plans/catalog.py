"""Queries over the driver's tables, one per operator, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.functions import parsing, price, privacy, products, text
from stallmark.operators import anomaly, benchmark, graph, listings, textops, vectors
from stallmark.session import cut, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"\b([xw](?:, i)?|i) -> ", r"lambda \1: ", sql)
        return f

    return add


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def olx(spark, d):
    return table(spark, d, "olx_listings").select("*", F.col("product.model").alias("model"), F.col("discovery_context.query").alias("query"), F.col("collection_metadata.collected_at").alias("seen"))


# --- prices ----------------------------------------------------------------------------------------------------------

_GENERIC = ", ".join(map(q, benchmark.GENERIC))
_COMPARABLE = f"select record_id, product.model as model, price from olx_listings where price > 0 and not isnan(price) and product.model is not null and product.model not in ({_GENERIC})"
_MED = f"with c as ({_COMPARABLE}), m as (select model, count(*) as group_n, median(price) as group_median from c group by 1 having count(*) >= {benchmark.MIN_GROUP}), d as (select c.*, group_n, group_median from c join m using (model))"


@query(f"""
select model, count(*) as n, round(min(price), 4) as min_price, round(quantile_cont(price, 0.25), 4) as q1, round(median(price), 4) as median,
  round(quantile_cont(price, 0.75), 4) as q3, round(max(price), 4) as max_price, round(avg(price), 4) as mean_price, round(stddev_pop(price), 4) as std_price,
  round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) as iqr
from ({_COMPARABLE}) group by model having count(*) >= {benchmark.MIN_GROUP}""")
def price_benchmark(spark, d):
    return benchmark.price_benchmark(olx(spark, d), "model", "price")


_BANDS = ", ".join(f"count(*) filter (price / group_median - 1 <= {-b / 100}) as below_{b}" for b in benchmark.BANDS)


@query(f"{_MED} select coalesce(model, 'ALL') as model, count(*) as n, {_BANDS}, round(100.0 * count(*) filter (price / group_median - 1 <= -0.35) / count(*), 1) as share_35_pct from d group by rollup(model)")
def price_thresholds(spark, d):
    return benchmark.price_thresholds(olx(spark, d), "model", "price")


@query(f"""{_MED} select record_id as id, model, price, round(cume_dist() over (partition by model order by price) * 100, 2) as percentile_rank,
round(price - group_median, 6) as delta, round(price / group_median, 6) as ratio,
case when price / group_median - 1 <= -0.35 then 1 else 0 end as flag_35, case when price / group_median - 1 <= -0.5 then 1 else 0 end as flag_50 from d""")
def price_position(spark, d):
    return benchmark.price_position(olx(spark, d), "record_id", "model", "price")


@query("select case when price is null or isnan(price) then 'missing' when price = 0 then 'zero' when price < 0 then 'negative' else 'valid' end as price_status, count(*) as n from olx_listings group by 1")
def price_status_counts(spark, d):
    return table(spark, d, "olx_listings").groupBy(price.status(F.col("price")).alias("price_status")).agg(F.count(F.lit(1)).alias("n"))


@query("select width, count(*) as n from (select case when price < 0 then 0 when price >= 100000 then 21 else cast(floor(price / 5000) as bigint) + 1 end as width from olx_listings where price is not null and not isnan(price)) group by 1")
def price_histogram(spark, d):
    return benchmark.histogram(table(spark, d, "olx_listings").filter(~F.isnan("price")), F.col("price"), 0.0, 100000.0, 20).withColumnRenamed("bin", "width")


_P0 = "lower(price)"
for _s in price.CURRENCIES:
    _P0 = f"replace({_P0}, {q(_s)}, '')"
_P0 = f"trim(replace({_P0}, ',', ''))"


def _ex(x: str, p: str) -> str:
    return f"nullif(regexp_extract({x}, {q(p)}, 1), '')"


@query(f"""select record_id, coalesce(cast({_ex('p', price.THOUSAND)} as double) * 1e3, cast({_ex('p', price.LAKH)} as double) * 1e5, cast({_ex('p', price.NUMBER)} as double)) as amount,
case when currency is null then 'INR' when lower(trim(currency)) = '₹' or lower(trim(currency)) in ('rs.', 'rs', 'inr') then 'INR' when lower(trim(currency)) in ('$', 'usd') then 'USD' else upper(trim(currency)) end as currency
from (select record_id, currency, {_P0} as p from synthetic_listings)""")
def normalize_price(spark, d):
    t = table(spark, d, "synthetic_listings")
    return t.select("record_id", price.amount(F.col("price")).alias("amount"), price.currency(F.col("currency")).alias("currency"))


# --- sightings and audits --------------------------------------------------------------------------------------------


@query("""select listing_id, arg_min(title, (epoch_us(t), record_id)) as title, arg_min(price, (epoch_us(t), record_id)) as price, min(epoch_us(t)) as first_seen_at, max(epoch_us(t)) as last_seen_at,
count(*) as observation_count, coalesce(array_to_string(list_sort(list(distinct q) filter (q is not null)), ', '), '') as search_queries
from (select listing_id, record_id, coalesce(title, '') as title, coalesce(price, -1) as price, collection_metadata.collected_at as t, discovery_context.query as q from olx_listings) where listing_id is not null group by 1""")
def canonical_listings(spark, d):
    o = olx(spark, d)
    return listings.canonical_listings(o, "listing_id", ["seen", "record_id"], {"title": F.coalesce("title", F.lit("")), "price": F.coalesce("price", F.lit(-1.0))}, "seen", F.col("query")).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_seen_at", "last_seen_at")})


_AUDIT = {"title": "title", "description": "description", "price": "price", "location": "location", "posted_at": "posted_at", "model": "product.model", "brand": "product.brand", "storage": "product.storage"}


@query(" union all ".join(f"select {q(k)} as column_name, count(*) as rows, count(*) - count({c}) as missing, round((count(*) - count({c})) / greatest(count(*), 1), 4) as missing_rate from olx_listings" for k, c in _AUDIT.items()))
def observation_audit(spark, d):
    return listings.completeness(table(spark, d, "olx_listings"), {k: F.col(c) for k, c in _AUDIT.items()})


@query("select category, count(*) filter (collection_type = 'targeted') as targeted, count(*) filter (collection_type <> 'targeted') as other, count(*) as n from olx_listings group by 1")
def crosstab_counts(spark, d):
    t = table(spark, d, "olx_listings")
    return t.groupBy("category").agg(F.count_if(F.col("collection_type") == "targeted").alias("targeted"), F.count_if(F.col("collection_type") != "targeted").alias("other"), F.count(F.lit(1)).alias("n"))


@query("""select row_value, col_value, n, round(100.0 * n / sum(n) over (partition by row_value), 2) as row_pct from (
select category as row_value, product.condition as col_value, count(*) as n from olx_listings where category is not null and product.condition is not null group by 1, 2)""")
def crosstab_row_pct(spark, d):
    return benchmark.crosstab_share(table(spark, d, "olx_listings").select("category", F.col("product.condition").alias("condition")), "category", "condition")


@query("""select category, source, count(*) as n, count(distinct listing_id) as listings, count(*) filter (description is null) as missing_description,
count(*) filter (len(contact_signals) > 0) as with_contact from olx_listings group by 1, 2""")
def repository_stats(spark, d):
    return table(spark, d, "olx_listings").groupBy("category", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("listing_id").alias("listings"), F.count_if(F.col("description").isNull()).alias("missing_description"), F.count_if(F.size("contact_signals") > 0).alias("with_contact")
    )


@query("""with s as (select record_id, source, source_listing_id as sid, source_url as url, media[1].sha256 as sha, title, seller.phone as phone from synthetic_listings),
a as (select source, sid, min(record_id) as f from s where source is not null and sid is not null group by 1, 2), b as (select url, min(record_id) as f from s where url is not null group by 1),
c as (select sha, min(record_id) as f from s where sha is not null group by 1), e as (select title, phone, min(record_id) as f from s where title is not null and phone is not null group by 1, 2),
j as (select s.record_id as id, a.f as fa, b.f as fb, c.f as fc, e.f as fe from s left join a on s.source = a.source and s.sid = a.sid left join b on s.url = b.url left join c on s.sha = c.sha left join e on s.title = e.title and s.phone = e.phone)
select id, case when fa < id then 'source_id' when fb < id then 'url' when fc < id then 'media' else 'title_phone' end as rule,
case when fa < id or fb < id or fc < id then 1.0 else 0.85 end::double as score, case when fa < id then fa when fb < id then fb when fc < id then fc else fe end as duplicate_of
from j where fa < id or fb < id or fc < id or fe < id""")
def dedup_rules(spark, d):
    t = table(spark, d, "synthetic_listings")
    rules = [("source_id", 1.0, [F.col("source"), F.col("source_listing_id")]), ("url", 1.0, [F.col("source_url")]), ("media", 1.0, [F.get("media", F.lit(0))["sha256"]]), ("title_phone", 0.85, [F.col("title"), F.col("seller.phone")])]
    return listings.duplicate_rules(t, "record_id", rules)


@query("select sha256, count(*) as n, min(record_id) as first_record from (select record_id, unnest(media).sha256 as sha256 from synthetic_listings) where sha256 is not null group by 1 having count(*) > 1")
def media_dup_groups(spark, d):
    m = table(spark, d, "synthetic_listings").select("record_id", F.explode("media.sha256").alias("sha256")).filter("sha256 is not null")
    return m.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_record")).filter("n > 1")


_XT = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""select min(record_id) as first_record, count(*) as n, k_title from (select record_id, {_XT.format('title')} as k_title, left({_XT.format("coalesce(description, '')")}, 100) as k_body from synthetic_listings where title is not null)
where k_title <> '' group by k_title, k_body having count(*) > 1""")
def crosspost_groups(spark, d):
    t = table(spark, d, "synthetic_listings").filter("title is not null")
    k = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    x = t.select("record_id", k(F.col("title")).alias("k_title"), F.left(k(F.coalesce("description", F.lit(""))), F.lit(100)).alias("k_body")).filter("k_title <> ''")
    return x.groupBy("k_title", "k_body").agg(F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first_record", "n", "k_title")


@query("""with ids as (select distinct listing_id from olx_listings), m as (select match_id, upper(trim(listing_a)) as a, upper(trim(listing_b)) as b from image_matches)
select 'repeated_match_id' as check_name, count(*) as failures from (select match_id from m group by 1 having count(*) > 1)
union all select 'missing_side', count(*) from m where coalesce(a, '') = '' or coalesce(b, '') = ''
union all select 'self_match', count(*) from m where a = b
union all select 'unknown_listing', count(distinct a) from (select a from m union all select b from m) where coalesce(a, '') <> '' and a not in (select listing_id from ids where listing_id is not null)""")
def integrity_checks(spark, d):
    m = table(spark, d, "image_matches").select("match_id", F.upper(F.trim("listing_a")).alias("a"), F.upper(F.trim("listing_b")).alias("b"))
    ids = table(spark, d, "olx_listings").select(F.col("listing_id").alias("a")).distinct()
    n = F.count(F.lit(1)).alias("failures")

    def one(name, df):
        return df.agg(n).select(F.lit(name).alias("check_name"), "failures")

    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        one("repeated_match_id", m.groupBy("match_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
        .unionByName(one("missing_side", m.filter(empty(F.col("a")) | empty(F.col("b"))))).unionByName(one("self_match", m.filter("a = b")))
        .unionByName(one("unknown_listing", m.select(F.explode(F.array("a", "b")).alias("a")).filter(~empty(F.col("a"))).distinct().join(ids, "a", "left_anti")))
    )


@query("""select record_id, n_errors from (select record_id, (case when length(trim(coalesce(title, ''))) = 0 then 1 else 0 end) + (case when length(trim(coalesce(source, ''))) = 0 then 1 else 0 end)
+ (case when regexp_matches(regexp_replace(coalesce(price, ''), '[₹, ]|Rs\\.?', '', 'g'), '^-\\d+(?:\\.\\d+)?$') then 1 else 0 end) as n_errors from synthetic_listings)""".replace("\\\\", "\\"))
def validators(spark, d):
    t = table(spark, d, "synthetic_listings")
    return t.select("record_id", F.size(parsing.record_errors(F.col("title"), F.col("source"), F.col("price"))).cast("bigint").alias("n_errors"))


@query("select category as stratum, record_id, stratum_rank from (select category, record_id, row_number() over (partition by category order by record_id) as stratum_rank from olx_listings) where stratum_rank <= case category when 'smartphones' then 15 when 'laptops' then 12 when 'tablets' then 9 when 'audio' then 4 else 0 end")
def stratified_sample(spark, d):
    s = listings.stratified_head(table(spark, d, "olx_listings").select("category", "record_id"), "category", "record_id", {"smartphones": 15, "laptops": 12, "tablets": 9, "audio": 4})
    return s.select(F.col("category").alias("stratum"), "record_id", "stratum_rank")


# --- parsers ---------------------------------------------------------------------------------------------------------


def _words_sql(c: str, names: dict[str, list[str]]) -> str:
    return " ".join(f"when {' or '.join(f'contains({c}, {q(w)})' for w in ws)} then {q(n)}" for n, ws in names.items())


@query(f"""select record_id, case when c in ({', '.join(map(q, parsing.CONDITION_NAMES))}) then c {_words_sql('c', parsing.CONDITION_WORDS)} else 'unknown' end as condition_class
from (select record_id, lower(trim(condition)) as c from synthetic_listings)""")
def normalize_condition(spark, d):
    return table(spark, d, "synthetic_listings").select("record_id", parsing.condition_field(F.col("condition")).alias("condition_class"))


_ALL_CUES = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(coalesce(title, ''), {q('(?i)' + p)}), x -> trim(x))" for p in parsing.CUES) + ")"


@query(f"""select record_id, case when t is null then 'UNKNOWN' {' '.join(f'when regexp_matches(t, {q(p)}) then {q(n)}' for n, p in parsing.TITLE_CONDITIONS.items())} else 'UNKNOWN' end as condition_class,
array_to_string(list_filter(cues, x, i -> list_position(cues, x) = i), '|') as cues from (select record_id, lower(title) as t, {_ALL_CUES} as cues from synthetic_listings)""")
def condition_parse(spark, d):
    return table(spark, d, "synthetic_listings").select("record_id", parsing.condition_title(F.col("title")).alias("condition_class"), F.array_join(parsing.condition_cues(F.col("title")), "|").alias("cues"))


#: Names of products put before the titles of the tables, which hold none of these families: every branch of the rules is met.
SAMPLES = [
    "Apple iPhone 17 Pro Max 256GB Desert Titanium 100% battery health", "i phone se 2 64 gb", "iphone 13 back cover", "macbook pro m2 pro 16gb 512gb ssd space grey", "apple mac book 2019 intel", "macbook charger",
    "dualsense edge", "ps5 blue controller with charging dock", "PS5 slim digital edition", "playstation 4 pro 1tb", "xbox series x", "XBOX 360 empty box", "nintendo switch oled", "samsung galaxy s24 ultra 12/256", "a52 8gb 128gb",
    "galaxy z fold5 cover", "google pixel 8 pro 90% bh", "pixel 7a", "one plus nord ce 3", "oneplus 12 tempered glass", "lenovo thinkpad core i5 16 gb ram 1 tb ssd 14 inch", "hp", "dell xps adapter", "old mobile 32gb", "gaming notebook 17 inch 64gb",
    "", "box only", "sofa midnight black", "camera lens glass", "demo unit 512gb not for sale", "iphone 12 icloud lock dead 64 gb",
]


def _titles(spark, d):
    names = F.array(*map(F.lit, SAMPLES))
    t = F.concat_ws(" ", F.get(names, F.pmod("record_id", F.lit(len(SAMPLES))).cast("int")), F.col("title"))
    return spread(table(spark, d, "olx_listings").select("record_id", "title")).select("record_id", F.when(F.col("record_id") % 101 != 0, t).alias("title"), F.element_at(F.array(*map(F.lit, ["iphone", "MacBook ", "ps5 controller", "tv"])), (F.pmod(F.col("record_id") / F.lit(len(SAMPLES)), F.lit(4)) + 1).cast("int")).alias("query"))


_TITLES = f"""titles as (select record_id, case when record_id % 101 <> 0 then concat_ws(' ', ([{', '.join(map(q, SAMPLES))}])[record_id % {len(SAMPLES)} + 1], title) end as title,
(['iphone', 'MacBook ', 'ps5 controller', 'tv'])[cast(floor((record_id / {len(SAMPLES)}::double) % 4) as bigint) + 1] as query from olx_listings)"""


def _title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), x, i -> case when i > 1 and regexp_matches(string_split({x}, '')[i - 1], '\\p{{L}}') then lower(x) else upper(x) end), '')"


def _part(p: str, g: int) -> str:
    return f"nullif(trim(regexp_extract(t, {q(p)}, {g})), '')"


def _hit(p: str) -> str:
    return f"regexp_matches(t, {q(p)})"


_ACC = f"case when t = '' then 'unknown' {' '.join(f'when regexp_matches(lower(t), {q(p)}) then {q(n.lower())}' for n, p in parsing.ACCESSORIES.items())} else 'device' end"
_PAD = "contains(lower(t), 'controller')"
#: Test, category of a device, brand, family, model, variant, generation, confidence of each rule, as SQL.
_RULES = [
    ("t = ''", "'Unknown'", "null", "null", "null", "null", "null", "unknown"),
    (_hit(products.IPHONE), "'Smartphone'", "'Apple'", "'iPhone'", f"concat_ws(' ', 'iPhone', upper({_part(products.IPHONE, 1)}), {_title_sql(_part(products.IPHONE, 2))})", _title_sql(_part(products.IPHONE, 2)), f"upper({_part(products.IPHONE, 1)})", "high"),
    (_hit(products.MACBOOK), "'Laptop'", "'Apple'", "'MacBook'", f"concat_ws(' ', 'MacBook', {_title_sql(_part(products.MACBOOK, 1))})", _title_sql(_part(products.MACBOOK, 1)), f"upper({_part(products.MACBOOK, 2)})", "high"),
    (f"({_hit(products.PS5_CONTROLLER)} or ({_PAD} and contains(lower(t), 'ps5')))", "'Gaming Accessory'", "'Sony'", "'PlayStation'", "'DualSense Controller'", "'PS5 Controller'", "'PS5'", "high"),
    (f"({_hit(products.PS5)} and not {_PAD})", "'Gaming Console'", "'Sony'", "'PlayStation'", "'PlayStation 5'", "'Console'", "'PS5'", "high"),
    (_hit(products.PS4), "'Gaming Console'", "'Sony'", "'PlayStation'", "'PlayStation 4'", "null", "'PS4'", "high"),
    (_hit(products.XBOX), "'Gaming Console'", "'Microsoft'", "'Xbox'", _title_sql(_part(products.XBOX, 1)), "null", "'Xbox'", "high"),
    (_hit(products.NINTENDO), "'Gaming Console'", "'Nintendo'", "'Switch'", "'Nintendo Switch'", "null", "'Switch'", "high"),
    (_hit(products.SAMSUNG), "'Smartphone'", "'Samsung'", "'Galaxy'", f"'Galaxy ' || {_title_sql(_part(products.SAMSUNG, 1))}", "null", "null", "high"),
    (_hit(products.PIXEL), "'Smartphone'", "'Google'", "'Pixel'", f"'Pixel ' || {_title_sql(_part(products.PIXEL, 1))}", "null", "null", "high"),
    (_hit(products.ONEPLUS), "'Smartphone'", "'OnePlus'", "'OnePlus'", f"'OnePlus ' || {_title_sql(_part(products.ONEPLUS, 1))}", "null", "null", "high"),
    (_hit(products.LAPTOPS), "'Laptop'", _title_sql(f"regexp_extract(t, {q(products.LAPTOPS)}, 1)").replace("regexp_extract(t,", "regexp_extract(t,"), "'Laptop'", _title_sql(f"regexp_extract(t, {q(products.LAPTOPS)}, 1)"), "null", "null", "medium"),
    ("(contains(lower(t), 'phone') or contains(lower(t), 'mobile'))", "'Smartphone'", "'Generic / Other'", "'Mobile Phone'", "'Generic Smartphone'", "null", "null", "low"),
    ("(contains(lower(t), 'laptop') or contains(lower(t), 'notebook'))", "'Laptop'", "'Generic / Other'", "'Laptop'", "'Generic Laptop'", "null", "null", "low"),
    ("true", "'Unknown'", "'Unknown'", "'Unknown'", "'Unknown Product'", "null", "null", "unknown"),
]


def _rule(column: int) -> str:
    return "case " + " ".join(f"when {r[0]} then {r[column]}" for r in _RULES) + " end"


_FIXED = "('Gaming Accessory', 'Unknown')"
_PRODUCTS = f"""{_TITLES}, x0 as (select record_id, title, query, regexp_replace(coalesce(title, ''), {q(parsing.BLANKS)}, '', 'g') as t from titles),
x1 as (select *, {_ACC} as a0, {_rule(1)} as c0, regexp_extract({_rule(2)}, '^(\\S+)', 1) as b1, {_rule(2)} as b0, {_rule(3)} as product_family, {_rule(4)} as model, {_rule(5)} as variant, {_rule(6)} as generation,
 case {' '.join(f"when {r[0]} then {q(r[7])}" for r in _RULES)} end as normalization_confidence from x0),
x2 as (select *, case when normalization_confidence = 'medium' then b1 else b0 end as brand, case when a0 <> 'device' and normalization_confidence not in ('low', 'unknown') and c0 <> 'Gaming Accessory' then 'Accessory' else c0 end as product_category,
 case when c0 = 'Gaming Accessory' and a0 <> 'device' then 'accessory' else a0 end as accessory_or_device from x1)"""


@query(f"with {_PRODUCTS} select record_id, product_category, brand, product_family, model, variant, generation, accessory_or_device, normalization_confidence from x2")
def product_match(spark, d):
    p = _titles(spark, d).select("record_id", F.explode(F.array(products.product(F.col("title")))).alias("p"))
    return p.select("record_id", *[F.col(f"p.{n}").alias(n) for n in ("product_category", "brand", "product_family", "model", "variant", "generation", "accessory_or_device", "normalization_confidence")])


_REST = "when normalization_confidence = 'low' then 'ambiguous' else 'unknown'"


@query(f"""with {_PRODUCTS}, y as (select record_id, lower(trim(query)) as q0, coalesce(product_family, '') as f, coalesce(brand, '') as b, product_category as c, coalesce(model, '') as m, accessory_or_device = 'device' as dev, normalization_confidence from x2)
select record_id, case
when q0 = 'iphone' then case when f = 'iPhone' and dev then 'direct_match' when f = 'iPhone' then 'related_accessory' when b in ({', '.join(map(q, products.OTHER_THAN_IPHONE))}) or c in ({', '.join(map(q, products.NO_PHONES))}) then 'different_product' {_REST} end
when q0 = 'macbook' then case when f = 'MacBook' and dev then 'direct_match' when f = 'MacBook' then 'related_accessory' when c <> 'Laptop' or b <> 'Apple' then 'different_product' {_REST} end
when q0 = 'ps5 controller' then case when m = 'DualSense Controller' then 'direct_match' when f = 'PlayStation' and not dev then 'related_accessory' when m = 'PlayStation 5' or b in ({', '.join(map(q, products.OTHER_THAN_PAD))}) then 'different_product' {_REST} end
else case when normalization_confidence in ('high', 'medium') then 'direct_match' {_REST} end end as query_match_status from y""")
def query_match_status(spark, d):
    p = _titles(spark, d).select("record_id", "query", F.explode(F.array(products.product(F.col("title")))).alias("p"))
    return p.select("record_id", products.query_status(F.col("p"), F.col("query")).alias("query_match_status"))


def _num(p: str, g: int) -> str:
    return f"cast(nullif(regexp_extract(t, {q(p)}, {g}), '') as integer)"


_CHIP_SQL = " ".join(f"when contains(u, '{n}') and contains(u, '{k.upper()}') then '{n} {k}'" if k else f"when contains(u, '{n}') then '{n}'" for n, ks in products.CHIPS.items() for k in [*ks, ""])
_COLOUR_SQL = "coalesce(" + ", ".join(f"case when regexp_matches(lower(t), {q(chr(92) + 'b' + c + chr(92) + 'b')}) then {q(products.COLOURS[c])} end" for c in products.COLOUR_ORDER) + ")"


@query(f"""with {_TITLES}, x as (select record_id, trim(coalesce(title, '')) as t from titles), y as (select record_id, t, coalesce({_num(products.RAM, 1)}, {_num(products.DUAL, 1)}, {_num(products.DUAL, 3)}) as ram_gb,
 list_transform(regexp_extract_all(t, {q(products.GIGABYTES)}, 1), x -> cast(x as integer)) as sizes, coalesce({_num(products.BATTERY, 1)}, {_num(products.BATTERY, 2)}) as bat, nullif(trim(regexp_extract(t, {q(products.CHIP)}, 1)), '') as chip0 from x),
z as (select *, upper(chip0) as u, list_filter(sizes, x -> ram_gb is null or x <> ram_gb) as free from y)
select record_id, ram_gb, coalesce({_num(products.STORAGE, 1)}, {_num(products.STORAGE, 2)} * 1024, {_num(products.DUAL, 2)}, {_num(products.DUAL, 4)}, {_num(products.TERABYTES, 1)} * 1024, list_filter(free, x -> x >= 64)[1], case when ram_gb is null then list_filter(free, x -> x < 64)[1] end) as storage_gb,
 case when bat between 50 and 100 then bat end as battery_health_percent, {_num(products.YEAR, 1)} as year, cast(nullif(regexp_extract(t, {q(products.SCREEN)}, 1), '') as double) as screen_size_inches,
 case when chip0 is null then null {_CHIP_SQL} else {_title_sql('chip0')} end as chip, {_COLOUR_SQL} as color from z""")
def spec_parse(spark, d):
    return _titles(spark, d).select("record_id", *[c.alias(n) for n, c in products.specifications(F.col("title")).items()])


def _category_sql(c: str, s: str, t: str) -> tuple[str, str]:
    """Category and subcategory as CASE expressions over typed category, typed subcategory and title."""
    cat, sub = [], []
    typed = f"nullif({s}, '')"
    for name, (subs, _) in products.TAXONOMY.items():
        found = [f"case when lower({s}) = {q(x.lower())} then {q(x)} end" for x in subs] + [f"case when contains({t}, {q(x.lower())}) then {q(x)} end" for x in subs]
        cat.append(f"when {c} = {q(name)} then {q(name)}")
        sub.append(f"when {c} = {q(name)} then coalesce({', '.join([*found, typed])})")
    for alias, (a, b) in products.SUBCATEGORIES.items():
        test = f"when lower({s}) = {q(alias)} or lower({c}) = {q(alias)} then "
        cat.append(test + q(a))
        sub.append(test + q(b))
    word = lambda alias: f"regexp_matches({t}, {q(chr(92) + 'b' + alias + chr(92) + 'b')})"
    for name, (subs, aliases) in products.TAXONOMY.items():
        test = f"when lower({c}) in ({', '.join(map(q, aliases))}) then "
        found = [f"case when contains(lower({s}) || ' ' || {t}, {q(x.lower())}) then {q(x)} end" for x in subs] + [f"case when {word(k)} then {q(b)} end" for k, (a, b) in products.SUBCATEGORIES.items() if a == name]
        cat.append(test + q(name))
        sub.append(test + f"coalesce({', '.join([*found, typed])})")
    for alias, (a, b) in products.SUBCATEGORIES.items():
        cat.append(f"when {word(alias)} then {q(a)}")
        sub.append(f"when {word(alias)} then {q(b)}")
    return f"case {' '.join(cat)} else coalesce(nullif({c}, ''), 'Electronics') end", f"case {' '.join(sub)} else {typed} end"


_CAT, _SUB = _category_sql("c", "s", "t")
_CAT_IN = ["Smartphones", "mobile", "console", "Audio & Wearables", "", "camera", "Gaming", "pc"]


@query(f"""select record_id, {_CAT} as category, {_SUB} as subcategory from (select s.record_id, case when s.record_id % 3 = 0 then trim(coalesce(s.category, '')) else ([{', '.join(map(q, _CAT_IN))}])[s.record_id % {len(_CAT_IN)} + 1] end as c,
trim(coalesce(s.subcategory, '')) as s, lower(concat_ws(' ', ([{', '.join(map(q, SAMPLES))}])[s.record_id % {len(SAMPLES)} + 1], s.title)) as t from synthetic_listings s)""")
def category_normalize(spark, d):
    s = table(spark, d, "synthetic_listings")
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), F.pmod("record_id", F.lit(len(xs))).cast("int"))
    raw = F.when(F.col("record_id") % 3 == 0, F.col("category")).otherwise(at(_CAT_IN))
    x = s.select("record_id", F.explode(F.array(products.category(raw, F.col("subcategory"), F.concat_ws(" ", at(SAMPLES), F.col("title"))))).alias("x"))
    return x.select("record_id", "x.category", "x.subcategory")


@query("""select record_id, case when n >= 3 then p[-2] when n >= 1 then p[1] end as city, case when n >= 3 then p[-1] when n = 2 then p[2] end as state from (
select record_id, p, len(p) as n from (select record_id, list_filter(list_transform(string_split(location, ','), x -> regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), x -> x <> '') as p from olx_listings))""")
def parse_location(spark, d):
    city, state = parsing.city_and_state(F.col("location"))
    return table(spark, d, "olx_listings").select("record_id", city.alias("city"), state.alias("state"))


@query(f"""with c as (select lower(name) as k, min(state_name) as s from canonical_values where kind = 'city' group by 1),
l as (select record_id, location, list_filter(list_transform(string_split(location, ','), x -> regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), x -> x <> '') as parts from olx_listings),
p as (select record_id, unnest(parts) as part, generate_subscripts(parts, 1) as pos from l where location is not null),
h as (select record_id, arg_max(s, pos) as state_name, arg_max(part, pos) as city from p join c on lower(p.part) = c.k group by 1)
select l.record_id, case when h.record_id is not null then 'high' when l.location is null or regexp_replace(l.location, '^[\\s\\p{{Z}}]+', '') = '' then 'unknown' when len(parts) > 0 then 'medium' else 'low' end as confidence,
{_title_sql('coalesce(h.city, l.parts[-1])')} as city, h.state_name from l left join h using (record_id)""")
def location_hierarchy(spark, d):
    """Comma parts from right to left against the list of cities, joined by key, so its size does not matter; without a hit the last part counts as city."""
    o = table(spark, d, "olx_listings").select("record_id", "location")
    c = table(spark, d, "canonical_values").filter("kind = 'city'").groupBy(F.lower("name").alias("key")).agg(F.min("state_name").alias("state_name"))
    parts = F.filter(F.transform(F.split("location", ","), lambda x: parsing.strip(x)), lambda x: x != "")
    h = o.select("record_id", F.posexplode(parts).alias("pos", "part")).withColumn("key", F.lower("part")).join(c, "key").groupBy("record_id").agg(F.max_by("part", "pos").alias("hit"), F.max_by("state_name", "pos").alias("state_name"))
    last = F.try_element_at(parts, F.lit(-1))
    blank = F.col("location").isNull() | (parsing.strip(F.col("location")) == "")
    conf = F.when(F.col("hit").isNotNull(), "high").when(blank, "unknown").when(last.isNotNull(), "medium").otherwise("low")
    return o.join(h, "record_id", "left").select("record_id", conf.alias("confidence"), text.title_case(F.coalesce("hit", last)).alias("city"), "state_name")


_RED = "coalesce(text, '')"
for _p, _m in privacy.REDACTIONS:
    _RED = f"regexp_replace({_RED}, {q(_p)}, {q(_m)}, 'g')"


@query(f"select doc_id, md5(r) as text_hash, (length(r) - length(replace(r, '_REDACTED]', ''))) // 10 as marks from (select doc_id, {_RED} as r from documents)")
def pii_redact(spark, d):
    t = table(spark, d, "documents").select("doc_id", privacy.redact(F.col("text")).alias("r"))
    return t.select("doc_id", F.md5("r").alias("text_hash"), F.expr("(length(r) - length(replace(r, '_REDACTED]', ''))) div 10").alias("marks"))


@query(r"""select record_id, case when coalesce(p, '') = '' then '' when length(g) >= 10 then '+91 ' || g[1:2] || '******' || right(g, 2) else '[PHONE_REDACTED]' end as masked
from (select record_id, seller.phone as p, regexp_replace(coalesce(seller.phone, ''), '\D', '', 'g') as g from synthetic_listings)""")
def phone_mask(spark, d):
    return table(spark, d, "synthetic_listings").select("record_id", privacy.mask_phone(F.col("seller.phone")).alias("masked"))


def _hmac_sql(c: str, salt: str) -> str:
    key = salt.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"{b ^ pad:02X}" for b in key) for pad in (0x36, 0x5C))
    v, dg = f"lower(trim({c}))", f"regexp_replace(lower(trim({c})), '\\D', '', 'g')"
    clean = f"case when regexp_matches({v}, '^[\\d+\\-\\s()]+$') and length({dg}) >= 10 then right({dg}, 10) when regexp_matches({v}, '^[\\d+\\-\\s()]+$') and length({dg}) >= 7 then {dg} when {v} <> '' then {v} end"
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({clean}))))"


@query(f"select record_id, {_hmac_sql('seller.phone', 'salt')} as phone_hash, {_hmac_sql('seller.email', 'salt')} as email_hash from synthetic_listings")
def hash_identifier(spark, d):
    return table(spark, d, "synthetic_listings").select("record_id", privacy.hash_identifier(F.col("seller.phone"), "salt").alias("phone_hash"), privacy.hash_identifier(F.col("seller.email"), "salt").alias("email_hash"))


@query(r"select record_id, nullif(regexp_extract(listing_url, 'iid-(\d+)', 1), '') as listing_number, regexp_extract(listing_url, '^\w+://([^/?#]+)', 1) as host from olx_listings")
def url_fields(spark, d):
    return table(spark, d, "olx_listings").select("record_id", parsing.listing_id_of_url(F.col("listing_url")).alias("listing_number"), F.regexp_extract("listing_url", r"^\w+://([^/?#]+)", 1).alias("host"))


# --- texts -----------------------------------------------------------------------------------------------------------


def _norm_sql(c: str, kind: str) -> str:
    keep = text.KEEP[kind].replace("-", r"\-") if "\\-" not in text.KEEP[kind] else text.KEEP[kind]
    composed = f"replace(translate(coalesce({c}, ''), '０１２３４５６７８９\u00a0', '0123456789 '), '…', '...')"  # NFKC of what the tables hold
    return f"trim(regexp_replace(regexp_replace(lower({composed}), {q(f'[^{text.WORD_CLASS}{keep}]')}, ' ', 'g'), {q(chr(92) + 's+')}, ' ', 'g'))"


_TOK = r"list_filter(list_transform(string_split({}, ' '), w -> regexp_replace(w, '^[.,/\-_]+|[.,/\-_]+$', '', 'g')), w -> w <> '')"


@query(f"select record_id, {_norm_sql('title', 'title')} as title_text, {_norm_sql('title', 'listing')} as listing_text, len({_TOK.format(_norm_sql('title', 'listing'))}) as n_tokens from synthetic_listings")
def text_normalize(spark, d):
    t = table(spark, d, "synthetic_listings").select("record_id", text.compat(F.col("title")).alias("title"))
    x = text.normalise(F.col("title"), "listing", composed=True)
    return t.select("record_id", text.normalise(F.col("title"), composed=True).alias("title_text"), x.alias("listing_text"), F.size(text.tokens(x)).cast("bigint").alias("n_tokens"))


@query(r"""select script, count(*) as n from (select case when t = '' then 'empty' when v and l then 'mixed_latin_devanagari' when v then 'devanagari' when o and l then 'mixed_latin_other' when o then 'other_non_latin' when l then 'latin_english' else 'numeric_symbolic' end as script
from (select t, regexp_matches(t, '\p{Latin}') as l, regexp_matches(t, '\p{Devanagari}') as v, regexp_matches(regexp_replace(t, '[\p{Latin}\p{Devanagari}\x00-\x7F]', '', 'g'), '[\p{L}\p{N}]') as o from (
select coalesce(text, '') as t from documents union all select coalesce(seller.phone, '') from synthetic_listings union all select coalesce(brand, '') from synthetic_listings))) group by 1""")
def script_detect(spark, d):
    s = table(spark, d, "synthetic_listings")
    t = table(spark, d, "documents").select("text").unionByName(s.select(F.col("seller.phone").alias("text"))).unionByName(s.select(F.col("brand").alias("text")))
    return t.groupBy(text.script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def _docs(spark, d):
    """Documents with their words. The generators keep later expressions from computing the words once per use."""
    x = spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text")).withColumn("text", text.compat(F.col("text")))
    x = x.select("doc_id", "source", "lang", F.explode(F.array(text.normalise(F.col("text"), "listing", composed=True))).alias("norm"))
    return x.select("*", F.explode(F.array(text.tokens(F.col("norm")))).alias("tokens"))


_DOCS = f"d as (select doc_id, source, lang, norm, {_TOK.format('norm')} as tokens from (select doc_id, source, lang, {_norm_sql('text', 'listing')} as norm from documents))"


def _lex_sql(name: str) -> str:
    single = [w for w in text.LEXICONS[name] if " " not in w]
    return f"len(list_intersect(list_distinct(tokens), [{', '.join(map(q, single))}]))" + "".join(f" + (case when contains(norm, {q(p)}) then 1 else 0 end)" for p in text.LEXICONS[name] if " " in p)


@query(f"with {_DOCS} select doc_id, {', '.join(f'{_lex_sql(n)} as {n}_terms' for n in text.LEXICONS)} from d")
def lexicon_features(spark, d):
    return _docs(spark, d).select("doc_id", *[text.lexicon_count(F.col("tokens"), F.col("norm"), n).cast("bigint").alias(f"{n}_terms") for n in text.LEXICONS])


@query(f"with {_DOCS} select lang, count(*) as n, {', '.join(f'round(avg(case when {_lex_sql(n)} > 0 then 1.0 else 0.0 end), 4) as {n}_rate' for n in text.LEXICONS)} from d group by 1")
def lexicon_by_family(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.when(text.lexicon_count(F.col("tokens"), F.col("norm"), n) > 0, 1.0).otherwise(0.0)), 4).alias(f"{n}_rate") for n in text.LEXICONS])


_STOP = ", ".join(map(q, textops.STOPWORDS))
_GRAM = " union all ".join(f"select doc_id, {n} as n, unnest(list_transform(range(1, len(tokens) - {n - 2}), i -> array_to_string(tokens[i:i + {n - 1}], ' '))) as phrase from d where len(tokens) >= {n}" for n in (1, 2, 3))


@query(f"""with {_DOCS}, g as ({_GRAM}) select n, phrase, count(*) as tf, count(distinct doc_id) as df from g
where len(list_filter(string_split(phrase, ' '), w -> w not in ({_STOP}))) > 0 group by 1, 2 having count(distinct doc_id) >= 2""")
def ngram_frequencies(spark, d):
    return textops.ngram_frequencies(_docs(spark, d), "doc_id", "tokens")


@query(f"""with {_DOCS}, w as (select source, doc_id, unnest(tokens) as term from d), k as (select * from w where term not in ({_STOP}) and length(term) > 1 and not regexp_matches(term, '^\\d+$')),
z as (select source from d where source is not null group by 1 having count(*) >= {textops.MIN_DOCS}), n as (select count(*) as n_docs from d), t as (select source, term, count(*) as c from k group by 1, 2),
f as (select term, count(distinct doc_id) as df from k group by 1 having count(distinct doc_id) >= {textops.MIN_DF}), o as (select source, sum(c) as total from t group by 1),
s as (select source, term, c, df, round(c / total * (ln((1 + n_docs) / (1 + df)) + 1), 6) as tfidf from t join f using (term) join o using (source) join z using (source), n),
r as (select *, row_number() over (partition by source order by tfidf desc, term) as rank from s) select source as group_value, rank, term, c as tf, df, tfidf from r where rank <= {textops.TOP_TERMS}""")
def tfidf_top_terms(spark, d):
    return textops.tfidf(_docs(spark, d), "source", "doc_id", "tokens")


@query(f"with {_DOCS}, h as (select md5(norm) as text_hash, min(doc_id) as class_id, count(*) as copies from d where length(norm) > 0 group by 1 having count(*) > 1) select doc_id as id, class_id, copies, text_hash from h join (select doc_id, md5(norm) as text_hash from d where length(norm) > 0) using (text_hash)")
def exact_text_reuse(spark, d):
    return textops.exact_reuse(_docs(spark, d), "doc_id", "norm")


_SETS = f"with {_DOCS}, ws as (select doc_id as id, source as block, list_sort(list_distinct(tokens)) as w from d), v as (select * from ws where len(w) >= 3), reps as (select block, w, min(id) as id, count(*) as copies from v group by block, w), jp as (select x.block, x.id as a, y.id as b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) as j from reps x join reps y on x.block = y.block and x.id < y.id and least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w)) - 1e-9)"


@query(_SETS + " select block, a, b, round(j, 6) as jaccard from jp where j >= 0.8 - 1e-12")
def jaccard_pairs(spark, d):
    return textops.jaccard_pairs(_docs(spark, d), "doc_id", "tokens", "source", 0.8)


@query(_SETS + """, near as (select block, a as id, b as o from jp where j >= 0.8 - 1e-12 union all select block, b, a from jp where j >= 0.8 - 1e-12), far as (select near.id, sum(reps.copies) as n from near join reps on near.o = reps.id group by 1)
select v.id, v.block, reps.id as class_id, copies, cast(copies - 1 + coalesce(far.n, 0) as bigint) as links from v join reps on v.block is not distinct from reps.block and v.w = reps.w left join far on far.id = reps.id""")
def jaccard_classes(spark, d):
    """One row a document: its class of equal word sets, by which jaccard_pairs names it, and its number of links."""
    return textops.jaccard_classes(_docs(spark, d), "doc_id", "tokens", "source", cut(jaccard_pairs(spark, d)))


@query(f"""with {_DOCS}, w as (select doc_id as id, list_filter(tokens, x -> length(x) >= 2) as t from d),
g as (select distinct id, phrase from ({' union all '.join(f"select id, unnest(list_transform(range(1, len(t) - {n - 2}), i -> array_to_string(t[i:i + {n - 1}], ' '))) as phrase from w where len(t) >= {n}" for n in (3, 4, 5))}) where length(phrase) >= 12),
k as (select phrase from g group by 1 having count(*) between 2 and 30), h as (select g.* from g join k using (phrase)) select x.id as a, y.id as b, count(*) as phrases from h x join h y on x.phrase = y.phrase and x.id < y.id group by 1, 2""")
def shared_phrase_pairs(spark, d):
    return textops.shared_phrases(_docs(spark, d), "doc_id", "tokens")


# --- vectors and hashes ----------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 4)"
_KNN = f"k as (select * from (select a.vec_id as q, b.vec_id as n, {_COS} as similarity, row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id) where rank <= 10)"


@query(f"with {_KNN} select q, rank, n, similarity from k where q % 50 = 0")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.cosine_topk(e, "vec_id", "embedding", 10, e.filter("vec_id % 50 = 0"))


def _knn_all(spark, d):
    """The ten nearest of every vector, for counts and statistics."""
    return vectors.cosine_topk(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


@query(f"with {_KNN} select rank, round(avg(similarity), 8) as mean_similarity, round(stddev_samp(similarity), 8) as std_similarity from k group by rank")
def knn_rank_profile(spark, d):
    return _knn_all(spark, d).groupBy("rank").agg(F.round(F.avg("similarity"), 8).alias("mean_similarity"), F.round(F.stddev_samp("similarity"), 8).alias("std_similarity"))


@query(f"with {_KNN} select count(*) filter (similarity >= 0.5) as at_50, count(*) filter (similarity >= 0.7) as at_70, count(*) filter (similarity >= 0.9) as at_90, count(distinct least(q, n) || '-' || greatest(q, n)) filter (similarity >= 0.5) as pairs_50 from k")
def visual_pairs(spark, d):
    k = _knn_all(spark, d)
    pair = F.concat_ws("-", F.least("q", "n"), F.greatest("q", "n"))
    return k.agg(F.count_if(F.col("similarity") >= 0.5).alias("at_50"), F.count_if(F.col("similarity") >= 0.7).alias("at_70"), F.count_if(F.col("similarity") >= 0.9).alias("at_90"), F.count_distinct(F.when(F.col("similarity") >= 0.5, pair)).alias("pairs_50"))


def _hash_vectors(spark, d):
    """The vectors and, as near copies, each again with one component turned round and every tenth with nine."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    turned = lambda n: F.transform("embedding", lambda x, i: F.when(F.pmod(i - F.col("vec_id"), F.lit(64)) < n, -x).otherwise(x))
    return e.unionByName(e.select((F.col("vec_id") + 10_000_000).alias("vec_id"), turned(1).alias("embedding"))).unionByName(e.filter("vec_id % 10 = 0").select((F.col("vec_id") + 20_000_000).alias("vec_id"), turned(9).alias("embedding")))


_NEAR = "e0 as (select vec_id, embedding from embeddings), e1 as (select * from e0 union all select vec_id + 10000000, list_transform(embedding, x, i -> case when ((i - 1 - vec_id) % 64 + 64) % 64 < 1 then -x else x end) from e0 union all select vec_id + 20000000, list_transform(embedding, x, i -> case when ((i - 1 - vec_id) % 64 + 64) % 64 < 9 then -x else x end) from e0 where vec_id % 10 = 0)"
_SIGN = "list_transform(embedding, x -> case when x > 0 then 1 else 0 end)"
_HAM = f"{_NEAR}, s as (select vec_id, {_SIGN} as b from e1), p as (select x.vec_id as a, y.vec_id as b, list_sum(list_transform(range(1, 65), i -> case when x.b[i] <> y.b[i] then 1 else 0 end)) as distance from s x join s y on x.vec_id < y.vec_id)"


@query(f"with {_HAM} select a, b, cast(distance as integer) as distance from p where distance <= 10")
def hamming_pairs(spark, d):
    h = _hash_vectors(spark, d).select("vec_id", *[c.alias(n) for c, n in zip(vectors.sign_hash("embedding"), ("h0", "h1"))])
    return vectors.hamming_pairs(h, "vec_id", 10)


@query(f"with {_HAM} select {', '.join(f'count(*) filter (distance <= {t}) as within_{t}' for t in (4, 6, 8, 10))} from p")
def hamming_sensitivity(spark, d):
    return hamming_pairs(spark, d).agg(*[F.count_if(F.col("distance") <= t).alias(f"within_{t}") for t in (4, 6, 8, 10)])


# --- graph -----------------------------------------------------------------------------------------------------------

_EDGES = "m as (select upper(trim(listing_a)) as a, upper(trim(listing_b)) as b, case when sha256_match then 'exact' else 'perceptual' end as kind from image_matches), e as (select distinct least(a, b) as a, greatest(a, b) as b, kind from m where a <> '' and b <> '' and a <> b)"


def _edges(spark, d):
    m = table(spark, d, "image_matches").select(F.upper(F.trim("listing_a")).alias("a"), F.upper(F.trim("listing_b")).alias("b"), F.when(F.col("sha256_match"), "exact").otherwise("perceptual").alias("kind"))
    return m.filter("a <> '' and b <> '' and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").distinct()


@query(f"with {_EDGES} select kind, count(*) as edges, count(distinct a) as left_ends from e group by kind")
def graph_edges(spark, d):
    return _edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("left_ends"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(parsing.BLANKS)}, '', 'g')"


def _slug_sql(x: str) -> str:
    return f"translate(lower({_strip_sql(x)}), ' /:', '___')"



@query(f"""select kind, count(distinct id) as nodes from (select 'LISTING' as kind, listing_id as id from olx_listings where listing_id is not null
union all select 'PRODUCT', 'product:' || {_slug_sql('product.model')} from olx_listings where product.model is not null union all select 'CITY', 'city:' || {_slug_sql('location')} from olx_listings where {_strip_sql('location')} <> ''
union all select 'MEDIA', media_a from image_matches where media_a is not null union all select 'MEDIA', media_b from image_matches where media_b is not null) group by 1""")
def graph_nodes(spark, d):
    o, m = table(spark, d, "olx_listings"), table(spark, d, "image_matches")
    parts = [("LISTING", o, F.col("listing_id")), ("PRODUCT", o, F.concat(F.lit("product:"), text.slug(F.col("product.model")))), ("CITY", o.filter(parsing.strip(F.col("location")) != ""), F.concat(F.lit("city:"), text.slug(F.col("location")))), ("MEDIA", m, F.col("media_a")), ("MEDIA", m, F.col("media_b"))]
    every = None
    for kind, df, c in parts:
        p = df.select(F.lit(kind).alias("kind"), c.alias("id")).filter("id is not null")
        every = p if every is None else every.unionByName(p)
    return every.groupBy("kind").agg(F.count_distinct("id").alias("nodes"))


_CC = f"with recursive {_EDGES}, f as (select a, b from e union select b, a from e), reach(id, r) as (select a, a from f union select reach.id, f.b from reach join f on f.a = reach.r), c as (select id, min(r) as component from reach group by id)"


@query(f"{_CC} select id, component from c")
def connected_components(spark, d):
    return graph.components(_edges(spark, d))


@query(f"""{_CC}, l as (select listing_id as id, arg_min(coalesce(location, ''), record_id) as city, arg_min(coalesce(product.model, ''), record_id) as model, arg_min(coalesce(price, 0), record_id) as price from olx_listings group by 1),
n as (select component, count(*) as size, count(distinct city) as cities, count(distinct model) as models, min(price) as min_price, max(price) as max_price from c left join l using (id) group by 1),
k as (select component, count(*) as edges from (select distinct a, b from e) join c on a = id group by 1)
select component, size, cities, models, min_price, max_price, coalesce(edges, 0) as edges, cities > 1 as cross_city from n left join k using (component)""")
def component_summary(spark, d):
    e = cut(_edges(spark, d))
    first = lambda c, z: F.min_by(F.coalesce(F.col(c), F.lit(z)), "record_id")
    nodes = olx(spark, d).groupBy(F.col("listing_id").alias("id")).agg(first("location", "").alias("city"), first("model", "").alias("model"), first("price", 0.0).alias("price"))
    return graph.component_summary(cut(graph.components(e)), nodes, e)


@query(f"with {_EDGES}, f as (select a, b, kind from e union all select b, a, kind from e) select a as id, count(distinct b) as degree, count(distinct b) filter (kind = 'exact') as exact_neighbours, count(*) as edges from f group by 1")
def listing_graph_features(spark, d):
    return graph.node_features(_edges(spark, d))


@query(f"""with {_EDGES}, l as (select listing_id as id, arg_min(coalesce(category, ''), record_id) as g from olx_listings group by 1)
select least(x.g, y.g) as group_a, greatest(x.g, y.g) as group_b, kind, count(*) as n from e join l x on e.a = x.id join l y on e.b = y.id group by 1, 2, 3""")
def corridors(spark, d):
    """Links between groups, unordered; the listings are joined by key at both ends."""
    l = olx(spark, d).groupBy("listing_id").agg(F.min_by(F.coalesce("category", F.lit("")), "record_id").alias("g"))
    e = _edges(spark, d).join(l.select(F.col("listing_id").alias("a"), F.col("g").alias("ga")), "a").join(l.select(F.col("listing_id").alias("b"), F.col("g").alias("gb")), "b")
    return e.groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b"), "kind").agg(F.count(F.lit(1)).alias("n"))


_SIGNALS = f"""{_EDGES}, l as (select listing_id as id, arg_min(coalesce(lower(title), ''), record_id) as t, arg_min(coalesce(product.model, ''), record_id) as model, arg_min(coalesce(price, 0), record_id) as price from olx_listings group by 1),
p as (select a, b, max(case when kind = 'exact' then 1 else 0 end) as exact_image, max(case when kind = 'perceptual' then 1 else 0 end) as similar_image from e group by 1, 2),
s as (select p.*, case when x.t = y.t and x.t <> '' then 1 else 0 end as same_title, case when x.model <> y.model and x.model <> '' and y.model <> '' then 1 else 0 end as model_differs, case when abs(x.price - y.price) >= 5000 and abs(x.price - y.price) >= 0.5 * least(x.price, y.price) and x.price > 0 and y.price > 0 then 1 else 0 end as price_differs from p join l x on a = x.id join l y on b = y.id)"""


def _signals(spark, d):
    first = lambda c, z: F.min_by(F.coalesce(F.col(c), F.lit(z)), "record_id")
    l = olx(spark, d).withColumn("t", F.lower("title")).groupBy("listing_id").agg(first("t", "").alias("t"), first("model", "").alias("m"), first("price", 0.0).alias("p"))
    p = _edges(spark, d).groupBy("a", "b").agg(F.max(F.when(F.col("kind") == "exact", 1).otherwise(0)).alias("exact_image"), F.max(F.when(F.col("kind") == "perceptual", 1).otherwise(0)).alias("similar_image"))
    p = p.join(l.select(F.col("listing_id").alias("a"), *[F.col(c).alias(c + "a") for c in "tmp"]), "a").join(l.select(F.col("listing_id").alias("b"), *[F.col(c).alias(c + "b") for c in "tmp"]), "b")
    gap = F.abs(F.col("pa") - F.col("pb"))
    one = lambda c: F.when(c, 1).otherwise(0)
    return p.select(
        "a", "b", "exact_image", "similar_image", one((F.col("ta") == F.col("tb")) & (F.col("ta") != "")).alias("same_title"),
        one((F.col("ma") != F.col("mb")) & (F.col("ma") != "") & (F.col("mb") != "")).alias("model_differs"),
        one((gap >= 5000) & (gap >= 0.5 * F.least("pa", "pb")) & (F.col("pa") > 0) & (F.col("pb") > 0)).alias("price_differs"),
    )


_LAYERS = "exact_image + similar_image + same_title + model_differs + price_differs"
_STATUS = "case when exact_image = 1 and same_title = 1 then 'OBSERVED_DUPLICATION_CANDIDATE' when exact_image = 1 then 'OBSERVED_IMAGE_REUSE' when similar_image = 1 and same_title = 1 then 'CROSS_MODAL_SIMILARITY_CANDIDATE' else 'UNVERIFIED_RELATIONSHIP_CANDIDATE' end"


@query(f"with {_SIGNALS} select a, b, exact_image, similar_image, same_title, model_differs, price_differs, {_LAYERS} as layers, {_STATUS} as status from s where {_LAYERS} >= 2")
def multi_signal_pairs(spark, d):
    return _signals(spark, d).withColumn("layers", F.expr(_LAYERS)).filter("layers >= 2").withColumn("status", F.expr(_STATUS))


@query(f"with {_SIGNALS} select {_LAYERS} as layers, count(*) as pairs, round(100.0 * count(*) / sum(count(*)) over (), 2) as share_pct from s group by 1")
def tier_counts(spark, d):
    t = _signals(spark, d).groupBy(F.expr(_LAYERS).alias("layers")).agg(F.count(F.lit(1)).alias("pairs"))
    return t.withColumn("share_pct", F.round(100 * F.col("pairs") / F.sum("pairs").over(Window.partitionBy(F.lit(1))), 2))


@query(f"with {_SIGNALS} select row_number() over (order by {_LAYERS} desc, a, b) as position, a, b, {_LAYERS} as layers from s where {_LAYERS} >= 2 qualify position <= 100")
def review_queue(spark, d):
    """The first 100 pairs by number of signals: a top-k report."""
    r = _signals(spark, d).withColumn("layers", F.expr(_LAYERS)).filter("layers >= 2").orderBy(F.desc("layers"), "a", "b").limit(100)
    return r.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("layers"), "a", "b")).alias("position"), "a", "b", "layers")


@query("select check_name, d as differing, n from (select 'claimed_model' as check_name, count(*) filter (not contains(lower(title), lower(product.model))) as d, count(*) as n from olx_listings where title is not null and product.model is not null union all select 'claimed_storage', count(*) filter (not contains(lower(replace(title, ' ', '')), lower(product.storage))), count(*) from olx_listings where title is not null and product.storage is not null)")
def claim_mismatch(spark, d):
    t = table(spark, d, "olx_listings").select("title", F.col("product.model").alias("model"), F.col("product.storage").alias("storage"))
    m = t.filter("title is not null and model is not null").agg(F.count_if(~F.contains(F.lower("title"), F.lower("model"))).alias("differing"), F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit("claimed_model"))
    s = t.filter("title is not null and storage is not null").agg(F.count_if(~F.contains(F.lower(F.replace("title", F.lit(" "), F.lit(""))), F.lower("storage"))).alias("differing"), F.count(F.lit(1)).alias("n")).withColumn("check_name", F.lit("claimed_storage"))
    return m.unionByName(s)


# --- features and novelty --------------------------------------------------------------------------------------------


@query(f"""{_MED}, t as (select o.record_id, length(coalesce(o.title, '')) as title_chars, case when o.description is null then null else length(o.description) end as description_chars, len(o.contact_signals) as contacts,
case when o.price > 0 and not isnan(o.price) then round(ln(1 + o.price), 6) end as log_price, o.location is null as location_missing from olx_listings o)
select t.*, d.group_n as benchmark_n, round(d.price / d.group_median, 6) as price_ratio from t left join d using (record_id)""")
def feature_table(spark, d):
    """One row a record; 0 is observed absence, null is not available (no benchmark, no description)."""
    o = olx(spark, d)
    m = benchmark.with_median(o, "model", "price").select("record_id", F.col("group_n").alias("benchmark_n"), F.round(F.col("price") / F.col("group_median"), 6).alias("price_ratio"))
    return o.select(
        "record_id", F.length(F.coalesce("title", F.lit(""))).cast("bigint").alias("title_chars"), F.length("description").cast("bigint").alias("description_chars"), F.size("contact_signals").cast("bigint").alias("contacts"),
        F.when((F.col("price") > 0) & ~F.isnan("price"), F.round(F.log1p("price"), 6)).alias("log_price"), F.col("location").isNull().alias("location_missing"),
    ).join(m, "record_id", "left")


_NUM = ["title_chars", "description_chars", "contacts", "log_price", "benchmark_n", "price_ratio"]


@query(f"with f as ({SQL['feature_table']}) " + " union all ".join(f"select {q(c)} as feature, round((count(*) - count({c})) / count(*), 4) as missing_rate, count(distinct {c}) + (case when count(*) > count({c}) then 1 else 0 end) as distinct_values, count(distinct {c}) + (case when count(*) > count({c}) then 1 else 0 end) <= 1 as is_constant from f" for c in _NUM))
def feature_audit(spark, d):
    return anomaly.feature_audit(feature_table(spark, d), _NUM)


@query(f"with f as ({SQL['feature_table']}), q as (select " + ", ".join(f"quantile_cont(cast({c} as double), 0.5) as m_{c}, quantile_cont(cast({c} as double), 0.75) - quantile_cont(cast({c} as double), 0.25) as i_{c}" for c in _NUM) + " from f) select record_id, " + ", ".join(f"round(({c} - m_{c}) / (case when i_{c} = 0 then 1 else i_{c} end), 6) as {c}" for c in _NUM) + " from f, q")
def robust_scaled(spark, d):
    return anomaly.robust_scale(feature_table(spark, d).select("record_id", *_NUM), _NUM)


@query()
def isolation_forest(spark, d):
    return anomaly.isolation_scores(robust_scaled(spark, d), "record_id", _NUM)


@query()
def contamination_sensitivity(spark, d):
    """Flagged rows at nested contaminations, and the overlap of each with the widest."""
    names = {"top_01": 0.01, "top_02": 0.02, "top_05": 0.05, "top_10": 0.10}
    f = anomaly.flag_share(cut(isolation_forest(spark, d)), names)
    rows = [F.struct(F.lit(n).alias("name"), F.count_if(n).alias("flagged"), F.round(F.count_if(F.col(n) & F.col("top_10")) / F.greatest(F.lit(1), F.count_if(F.col(n) | F.col("top_10"))), 4).alias("jaccard")).alias(n) for n in names]
    return f.agg(*rows).select(F.explode(F.array(*names)).alias("r")).select("r.*")


@query()
def anomaly_persistence(spark, d):
    """How many of two feature spaces flag a row, for rows that any of them flags."""
    s = cut(robust_scaled(spark, d))
    a = anomaly.flag_share(cut(anomaly.isolation_scores(s, "record_id", ["log_price", "price_ratio"])), {"price_space": 0.05})
    b = anomaly.flag_share(cut(anomaly.isolation_scores(s, "record_id", _NUM)), {"full_space": 0.05})
    j = a.select("id", "price_space").join(b.select("id", "full_space"), "id")
    return j.withColumn("times_flagged", F.col("price_space").cast("int") + F.col("full_space").cast("int")).filter("times_flagged > 0").select(F.col("id").cast("bigint").alias("record_id"), "times_flagged")


@query("select event_type, epoch_us(date_trunc('hour', ts)) as window_start, count(*) as n, round(sum(value), 4) as total, count(distinct user_id) as users from events group by 1, 2")
def event_windows(spark, d):
    """Extension: tumbling hours of the event stream, the batch form of the streaming query."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users")).select("event_type", F.unix_micros(F.col("w.start").cast("timestamp")).alias("window_start"), "n", "total", "users")
