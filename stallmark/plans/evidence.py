"""Queries of the evidence operators: scores and bands, pair enrichment, clusters, complaint patterns, feature matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stallmark.functions import evidence, text
from stallmark.operators import benchmark, graph, percentiles
from stallmark.plans import catalog as c
from stallmark.plans.catalog import q, query
from stallmark.session import cut, table
from stallmark.sources import html

# --- bands and tiers over derived scores -----------------------------------------------------------------------------

_TIER = f"case when {{0}} is null then 'UNREADABLE' when {{0}} >= 0.7 then {q(evidence.AI)} when {{0}} <= 0.3 then {q(evidence.REAL)} else 'BORDERLINE' end"


@query("select case when coalesce(n_chars % 7, 0) = 0 then 'none' when (doc_id * 37) % 100 >= 70 then 'high' when (doc_id * 37) % 100 >= 40 then 'medium' else 'low' end as band, count(*) as n from documents group by 1")
def ocr_bands(spark, d):
    return table(spark, d, "documents").groupBy(evidence.ocr_band((F.col("doc_id") * 37) % 100, F.col("n_chars") % 7).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""select kind, confidence, count(*) as n from (select case when a <= 0.60 and ch >= 8 then 'SCREENSHOT' when ch >= 50 or b >= 3 then 'TEXT_HEAVY' when a between 0.65 and 0.85 and ch >= 30 then 'DOCUMENT_LIKE' else 'PHOTO' end as kind,
case when a <= 0.60 and ch >= 8 then 0.85 when ch >= 50 or b >= 3 then 0.80 when a between 0.65 and 0.85 and ch >= 30 then 0.75 when ch <= 5 then 0.90 else 0.70 end::double as confidence
from (select (doc_id % 20 + 6)::double / 16 as a, case when doc_id % 3 = 0 then length(text) else length(text) % 60 end as ch, len(string_split(text, chr(10))) / 4.0::double as b from documents where text is not null)) group by 1, 2""")
def image_type(spark, d):
    x = table(spark, d, "documents").filter("text is not null").select(((F.col("doc_id") % 20 + 6) / 16).alias("a"), F.when(F.col("doc_id") % 3 == 0, F.length("text")).otherwise(F.length("text") % 60).alias("ch"), (F.size(F.split("text", "\n")) / 4).alias("b"))
    x = x.select(evidence.image_type(F.col("a"), F.col("ch"), F.col("b")).alias("t"))
    return x.groupBy(F.col("t.kind").alias("kind"), F.col("t.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


_BOTH = f"({q(evidence.AI)}, {q(evidence.REAL)})"
_AGREE = f"case when a = b and a = {q(evidence.AI)} then 'AGREEMENT_AI' when a = b and a = {q(evidence.REAL)} then 'AGREEMENT_REAL' when a in {_BOTH} and b in {_BOTH} then 'DETECTOR_DISAGREEMENT' when a = 'BORDERLINE' or b = 'BORDERLINE' then 'BORDERLINE' else 'NO_CONCLUSIVE_SIGNAL' end"
_SCORES = "select vec_id, case when vec_id % 17 <> 0 then ((vec_id * 37) % 101) / 100.0::double end as x, ((vec_id * 53) % 101) / 100.0::double as y from embeddings"


def _scores(spark, d):
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.when(v % 17 != 0, (v * 37) % 101 / 100).alias("x"), ((v * 53) % 101 / 100).alias("y"))


@query(f"select a, b, g as agreement, g in ('DETECTOR_DISAGREEMENT', 'BORDERLINE') as escalated, count(*) as n from (select *, {_AGREE} as g from (select {_TIER.format('x')} as a, {_TIER.format('y')} as b from ({_SCORES}))) group by 1, 2, 3, 4")
def detector_agreement(spark, d):
    s = _scores(spark, d).select(evidence.tier(F.col("x")).alias("a"), evidence.tier(F.col("y")).alias("b")).withColumn("agreement", evidence.agreement(F.col("a"), F.col("b")))
    return s.groupBy("a", "b", "agreement", evidence.escalated(F.col("agreement")).alias("escalated")).agg(F.count(F.lit(1)).alias("n"))


@query("""select match_id, round(greatest(0, least(1, 1 - abs(a - b))), 4) as score, case when a >= 0.85 and b >= 0.80 then 'REAL_IMAGE_CANDIDATE' when abs(a - b) > 0.35 then 'BORDERLINE' else 'NO_CONCLUSIVE_SIGNAL' end as status
from (select match_id, 1 - dhash_distance / 64.0::double as a, 1 - phash_distance / 64.0::double as b from image_matches) where a is not null and b is not null""")
def semantic_divergence(spark, d):
    m = table(spark, d, "image_matches").filter("dhash_distance is not null and phash_distance is not null")
    a, b = 1 - F.col("dhash_distance") / F.lit(64.0), 1 - F.col("phash_distance") / F.lit(64.0)
    score, status = evidence.divergence(a, b)
    return m.select("match_id", score.alias("score"), status.alias("status"))


@query(f"select vec_id, case when greatest(abs(y - 0.5), abs(y - 0.45)) < 0.15 then 'STABLE' else 'SENSITIVE' end as robustness from ({_SCORES})")
def robustness_status(spark, d):
    return _scores(spark, d).select("vec_id", evidence.robustness(F.col("y") - 0.5, F.col("y") - 0.45).alias("robustness"))


# --- texts -----------------------------------------------------------------------------------------------------------

_CP = ", ".join(f"case when regexp_matches(t, {q(p)}) then {q(n)} end" for n, p in evidence.COMPLAINT_PATTERNS.items())


@query(f"""select doc_id, array_to_string(list_filter([{_CP}], x -> x is not null), ',') as patterns, list_max(list_transform(regexp_extract_all(r, {q(evidence.MONEY)}, 1), x -> cast(x as bigint))) as amount
from (select doc_id, coalesce(text, '') as r, lower(coalesce(text, '')) as t from documents where source = 'complaint_post')""")
def complaint_classify(spark, d):
    x = table(spark, d, "documents").filter("source = 'complaint_post'")
    return x.select("doc_id", F.array_join(evidence.complaint_patterns(F.col("text")), ",").alias("patterns"), evidence.largest_amount(F.col("text")).alias("amount"))


@query(f"select pattern, count(*) as n from (select unnest(list_filter([{_CP}], x -> x is not null)) as pattern from (select lower(coalesce(text, '')) as t from documents)) group by 1")
def pattern_library(spark, d):
    return table(spark, d, "documents").select(F.explode(evidence.complaint_patterns(F.col("text"))).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with o as (select price, {c._norm_sql('title', 'listing')} as norm from olx_listings where price > 0 and not isnan(price)), t as (select *, {c._TOK.format('norm')} as tokens from o),
k as (select quantile_cont(price, 0.25) as q1, median(price) as q2, quantile_cont(price, 0.75) as q3 from t)
select case when price <= q1 then 1 when price <= q2 then 2 when price <= q3 then 3 else 4 end as quartile, count(*) as n, {', '.join(f"round(avg(case when {c._lex_sql(n)} > 0 then 1.0 else 0.0 end), 4) as {n}_rate" for n in text.LEXICONS)} from t, k group by 1""")
def lexicon_by_price_quartile(spark, d):
    o = c.olx(spark, d).filter("price > 0 and not isnan(price)").select("price", text.compat(F.col("title")).alias("title"))
    o = o.select("price", F.explode(F.array(text.normalise(F.col("title"), "listing", composed=True))).alias("norm")).select("price", "norm", F.explode(F.array(text.tokens(F.col("norm")))).alias("words"))
    r = percentiles.interpolated(c.olx(spark, d).filter("price > 0"), F.col("price"), {}, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    q1, q2, q3 = (r.q1, r.q2, r.q3) if r else (0.0, 0.0, 0.0)
    p = F.col("price")
    has = lambda n: F.round(F.avg(F.when(text.lexicon_count(F.col("words"), F.col("norm"), n) > 0, 1.0).otherwise(0.0)), 4).alias(f"{n}_rate")
    return o.groupBy(F.when(p <= q1, 1).when(p <= q2, 2).when(p <= q3, 3).otherwise(4).alias("quartile")).agg(F.count(F.lit(1)).alias("n"), *map(has, text.LEXICONS))


_HITS = "list_filter([" + ", ".join(f"case when regexp_matches(t, {q(p)}) then {q(n)} || '=' || regexp_extract(t, {q(p)}, 0) end" for n, p in html.CLAIMS.items()) + "], x -> x is not null)"


@query(f"select record_id, array_to_string(list_transform({_HITS}, x, i -> i || ':' || x), '|') as claims from (select record_id, lower(coalesce(title, '') || ' ' || coalesce(description, '')) as t from synthetic_listings)")
def claims(spark, d):
    """Claims of a listing in order, as position:claim=evidence."""
    x = table(spark, d, "synthetic_listings").select("record_id", html.claims(F.col("title"), F.col("description")).alias("c"))
    return x.select("record_id", F.array_join(F.transform("c", lambda k: F.concat(k["position"].cast("string"), F.lit(":"), k["claim"], F.lit("="), k["evidence"])), "|").alias("claims"))


@query("select record_id, title, case when not isnan(price) then price end as price, nullif(regexp_extract(listing_url, 'iid-(\\d+)', 1), '') as listing_id from olx_listings")
def html_listing(spark, d):
    """Pages are rendered from all listings and parsed back; a title or price that a listing lacks is null."""
    o, p = table(spark, d, "olx_listings"), F.nanvl(F.col("price").cast("double"), F.lit(None))
    # decimal digits in place of an exponent; outside of the range a decimal holds in full, doubles print as they are
    plain = F.when(F.abs(p).between(1e7, 1e27), p.cast("decimal(38,10)").cast("string")).otherwise(p.cast("string"))
    ld = F.replace(F.to_json(F.struct(F.col("title").alias("name"), F.struct(plain.alias("price")).alias("offers"))), F.lit("<"), F.lit("\\u003c"))
    page = F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script></html>"))
    p = html.listing_pages(o.select(F.concat_ws("#", "listing_url", F.col("record_id").cast("string")).alias("url"), page.alias("html")))
    return p.select(F.substring_index("url", "#", -1).cast("bigint").alias("record_id"), "title", "price", "listing_id")


# --- pairs -----------------------------------------------------------------------------------------------------------

_PAIR = "m as (select upper(trim(listing_a)) as a, upper(trim(listing_b)) as b, sha256_match, phash_distance as p, dhash_distance as dh from image_matches), e as (select least(a, b) as a, greatest(a, b) as b, sha256_match, p, dh from m where a <> '' and b <> '' and a <> b)"


def _pairs(spark, d):
    m = table(spark, d, "image_matches").select(F.upper(F.trim("listing_a")).alias("a"), F.upper(F.trim("listing_b")).alias("b"), "sha256_match", F.col("phash_distance").alias("p"), F.col("dhash_distance").alias("dh"))
    return m.filter("a <> '' and b <> '' and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sha256_match", "p", "dh")


@query(f"with {_PAIR} select a, b, count(*) as images from e where sha256_match group by 1, 2")
def exact_media_pairs(spark, d):
    return _pairs(spark, d).filter("sha256_match").groupBy("a", "b").agg(F.count(F.lit(1)).alias("images"))


@query(f"with {_PAIR}, f as (select a as id, p from e union all select b, p from e) select id, count(*) as n, round(max(1 - p / 64.0::double), 6) as max_similarity, round(avg(1 - p / 64.0::double), 6) as mean_similarity from f where p is not null group by 1")
def similarity_stats(spark, d):
    e = _pairs(spark, d)
    f = e.select(F.col("a").alias("id"), "p").unionByName(e.select(F.col("b").alias("id"), "p")).filter("p is not null")
    s = 1 - F.col("p") / F.lit(64.0)
    return f.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(s), 6).alias("max_similarity"), F.round(F.avg(s), 6).alias("mean_similarity"))


@query(f"with {_PAIR} select case when p <= 4 and dh > 10 then 'phash_only' when p > 10 and dh <= 4 then 'dhash_only' when p <= 10 and dh <= 10 then 'agree_near' when p is null or dh is null then 'incomplete' else 'agree_far' end as outcome, count(*) as n from e group by 1")
def method_disagreement(spark, d):
    p, h = F.col("p"), F.col("dh")
    o = F.when((p <= 4) & (h > 10), "phash_only").when((p > 10) & (h <= 4), "dhash_only").when((p <= 10) & (h <= 10), "agree_near").when(p.isNull() | h.isNull(), "incomplete").otherwise("agree_far")
    return _pairs(spark, d).groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_META = "l as (select listing_id as id, arg_min(coalesce(location, ''), record_id) as city, arg_min(coalesce(product.model, ''), record_id) as model, arg_min(coalesce(price, 0), record_id) as price from olx_listings group by 1)"


def _meta(spark, d):
    first = lambda x, z: F.min_by(F.coalesce(F.col(x), F.lit(z)), "record_id")
    return c.olx(spark, d).groupBy(F.col("listing_id").alias("id")).agg(first("location", "").alias("city"), first("model", "").alias("model"), first("price", 0.0).alias("price"))


def _enriched(spark, d):
    e, l = _pairs(spark, d).select("a", "b").distinct(), _meta(spark, d)
    x, y = (l.select(F.col("id").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in ("city", "model", "price")]) for s in "ab")
    return e.join(x, "a").join(y, "b")


@query(f"""with {_PAIR}, {_META} select e.a, e.b, x.city as city_a, y.city as city_b, round(abs(x.price - y.price), 2) as price_gap, case when greatest(x.price, y.price) > 0 then round(100 * abs(x.price - y.price) / greatest(x.price, y.price), 2) end as gap_pct
from (select distinct a, b from e) e join l x on e.a = x.id join l y on e.b = y.id where x.city <> y.city and x.city <> '' and y.city <> ''""")
def cross_city_pairs(spark, d):
    p = _enriched(spark, d).filter("city_a <> city_b and city_a <> '' and city_b <> ''")
    gap, top = F.abs(F.col("price_a") - F.col("price_b")), F.greatest("price_a", "price_b")
    return p.select("a", "b", "city_a", "city_b", F.round(gap, 2).alias("price_gap"), F.when(top > 0, F.round(100 * gap / top, 2)).alias("gap_pct"))


@query(f"""with {_PAIR}, {_META}, p as (select e.a, e.b, x.model as ma, y.model as mb, x.price as pa, y.price as pb from (select distinct a, b from e) e join l x on e.a = x.id join l y on e.b = y.id)
select a, b, 'model_drift' as kind from p where ma <> mb and ma <> '' and mb <> '' union all select a, b, 'price_variance' from p where pa > 0 and pb > 0 and abs(pa - pb) >= 5000 and abs(pa - pb) / least(pa, pb) >= 0.5""")
def claim_drift(spark, d):
    p = cut(_enriched(spark, d))
    drift = p.filter("model_a <> model_b and model_a <> '' and model_b <> ''").select("a", "b", F.lit("model_drift").alias("kind"))
    gap = p.filter("price_a > 0 and price_b > 0 and abs(price_a - price_b) >= 5000 and abs(price_a - price_b) / least(price_a, price_b) >= 0.5").select("a", "b", F.lit("price_variance").alias("kind"))
    return drift.unionByName(gap)


@query(c._CC + """, k as (select c.component, bool_or(kind = 'exact') as x, bool_or(kind = 'perceptual') as p from e join c on e.a = c.id group by 1), n as (select component, count(*) as size from c group by 1)
select component, size, case when x and p then 'hybrid' when x then 'exact_only' else 'perceptual_only' end as cluster_type from n join k using (component)""")
def image_clusters(spark, d):
    e = cut(c._edges(spark, d))
    m = cut(graph.components(e))
    k = e.join(m.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.bool_or(F.col("kind") == "exact").alias("x"), F.bool_or(F.col("kind") == "perceptual").alias("p"))
    kind = F.when(F.col("x") & F.col("p"), "hybrid").when(F.col("x"), "exact_only").otherwise("perceptual_only")
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("size")).join(k, "component").select("component", "size", kind.alias("cluster_type"))


# --- features --------------------------------------------------------------------------------------------------------

_CATS = ["smartphones", "laptops", "tablets", "audio", "televisions"]


@query("select record_id, case when price > 0 and not isnan(price) then round(ln(1 + price), 6) else 0.0 end as log_price, " + ", ".join(f"case when category = {q(x)} then 1.0 else 0.0 end::double as is_{x}" for x in _CATS) + f", case when category is null or category not in ({', '.join(map(q, _CATS))}) then 1.0 else 0.0 end::double as is_other from olx_listings")
def feature_matrix(spark, d):
    k = F.col("category")
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    return table(spark, d, "olx_listings").select(
        "record_id", F.when((F.col("price") > 0) & ~F.isnan("price"), F.round(F.log1p("price"), 6)).otherwise(0.0).alias("log_price"), *[one(k == x).alias(f"is_{x}") for x in _CATS], one(k.isNull() | ~k.isin(*_CATS)).alias("is_other")
    )


@query(c._MED + ", f as (select d.record_id, price / group_median <= 0.65 as flagged from d) select category, count(*) as n, count(*) filter (flagged) as flagged, round(100.0 * count(*) filter (flagged) / count(*), 2) as rate_pct from f join olx_listings using (record_id) group by 1 having count(*) >= 50")
def anomaly_rate_by_group(spark, d):
    f = benchmark.with_median(c.olx(spark, d), "model", "price").withColumn("x", F.col("price") / F.col("group_median") <= 0.65)
    return f.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("flagged")).filter("n >= 50").withColumn("rate_pct", F.round(100 * F.col("flagged") / F.col("n"), 2))


#: Terms that must not occur in a feature name.
LEAK_TERMS = ["fraud", "scam", "risk", "probability", "danger", "target", "label", "verdict", "outcome", "truth"]


#: Columns put beside those of the feature table, of which the audit must report three.
PLANTED = ["risk_label", "is_Scam_listing", "colour"]


@query(f"select term, cast(len(list_filter(columns, x -> contains(lower(x), term))) as integer) as columns_found from (select unnest([{', '.join(map(q, LEAK_TERMS))}]) as term, list_concat((select list(column_name) from (describe {c.SQL['feature_table']})), [{', '.join(map(q, PLANTED))}]) as columns)")
def leakage_audit(spark, d):
    names = [*c.feature_table(spark, d).columns, *PLANTED]
    return spark.createDataFrame([(t, sum(t in n.lower() for n in names)) for t in LEAK_TERMS], "term string, columns_found int")


@query()
def pca_2d(spark, d):
    """Two principal components of the scaled features: moments in one pass, a 6 x 6 decomposition on the driver."""
    cols = c._NUM
    x = c.robust_scaled(spark, d).select("record_id", *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in cols])
    x = x.select("record_id", *[F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(k))).alias(k) for k in cols])
    row = x.agg(*[F.avg(k).alias(f"m{i}") for i, k in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    m = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            m[i, j] = m[j, i] = row[f"c{i}_{j}"] or 0.0
    vec = np.linalg.eigh(m)[1][:, ::-1][:, :2]
    vec *= np.where(vec[np.abs(vec).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)  # fixed sign
    part = lambda k: sum(((F.col(n) - F.lit(row[f"m{i}"] or 0.0)) * F.lit(float(vec[i, k])) for i, n in enumerate(cols)), F.lit(0.0))
    return x.select("record_id", F.round(part(0), 5).alias("pc1"), F.round(part(1), 5).alias("pc2"))


@query("select event_id, user_id, epoch_us(ts) as ts, epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as previous_ts from events qualify row_number() over (partition by user_id order by ts, event_id) <= 3")
def first_events(spark, d):
    """First three events of each user with the time before: a top-k per key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.unix_micros(F.lag("ts").over(w).cast("timestamp")).alias("previous_ts"), F.row_number().over(w).alias("r")).filter("r <= 3").drop("r")
