"""Queries of the graph tables, of texts of images against claims, of the feature store and of reports over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.functions import parsing, privacy, text, visual
from stallmark.operators import graph, ranking, vectors
from stallmark.plans import catalog as c
from stallmark.plans import evidence as e
from stallmark.plans.catalog import SQL, q, query
from stallmark.session import cut, table
from stallmark.sources import sinks


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- texts of images -------------------------------------------------------------------------------------------------

_READ = f"d as (select doc_id, listing_id, lower(concat_ws(' ', ([{', '.join(map(q, c.SAMPLES))}])[doc_id % {len(c.SAMPLES)} + 1], replace(coalesce(text, ''), chr(10), ' '))) as t from documents where source = 'ocr_dump')"


def _x(p: str, g: int) -> str:
    return f"regexp_extract_all(t, {q(p)}, {g})"


_OBS = {
    "models": f"list_concat(list_transform(list_zip({_x(visual.IPHONE, 1)}, {_x(visual.IPHONE, 2)}), x -> concat_ws(' ', 'iPhone', upper(x[1]), case when x[2] <> '' then {c._title_sql('x[2]').replace('x, i ->', 'w, i ->').replace('lower(x)', 'lower(w)').replace('upper(x)', 'upper(w)')} end)), "
    f"list_transform(list_zip({_x(visual.MACBOOK, 1)}, {_x(visual.MACBOOK, 2)}), x -> concat_ws(' ', 'MacBook', case when x[1] <> '' then {c._title_sql('x[1]').replace('x, i ->', 'w, i ->').replace('lower(x)', 'lower(w)').replace('upper(x)', 'upper(w)')} end, case when x[2] <> '' then upper(x[2]) end)), "
    f"case when regexp_matches(t, {q(visual.PAD)}) then ['PS5 DualSense Controller'] when regexp_matches(t, {q(visual.PS5)}) then ['PS5 Console'] else [] end)",
    "storages": f"list_transform(list_zip({_x(visual.STORAGE, 1)}, {_x(visual.STORAGE, 2)}), x -> case when x[1] <> '' then x[1] || 'GB' else x[2] || 'TB' end)",
    "chips": f"list_transform({_x(visual.CHIP, 1)}, x -> upper(x))", "demo_cues": f"list_transform({_x(visual.DEMO, 1)}, x -> upper(x))",
    "conditions": f"list_transform({_x(visual.CONDITION, 1)}, x -> {c._title_sql('x').replace('x, i ->', 'w, i ->').replace('lower(x)', 'lower(w)').replace('upper(x)', 'upper(w)')})",
}


def _read(spark, d):
    """Texts of images, each after a title of some product, so that every pattern is met."""
    names = F.array(*map(F.lit, c.SAMPLES))
    x = table(spark, d, "documents").filter("source = 'ocr_dump'")
    t = F.lower(F.concat_ws(" ", F.get(names, F.pmod("doc_id", F.lit(len(c.SAMPLES))).cast("int")), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))))
    return x.select("doc_id", "listing_id", t.alias("t"))


@query(f"with {_READ} select doc_id, " + ", ".join(f"array_to_string(list_sort(list_distinct({s})), '|') as observed_{k}" for k, s in _OBS.items()) + " from d")
def visual_specs(spark, d):
    return _read(spark, d).select("doc_id", *[F.array_join(v, "|").alias(k) for k, v in visual.observed(F.col("t")).items()])


_CLAIMED = "l as (select listing_id, arg_min(product.storage, record_id) as claimed from olx_listings where product.storage is not null and listing_id is not null group by 1)"


@query(f"""with {_READ}, {_CLAIMED}, o as (select doc_id, listing_id, unnest(list_distinct({_OBS['storages']})) as observed from d where listing_id is not null)
select doc_id, listing_id, upper(replace(claimed, ' ', '')) as claimed, observed, upper(replace(claimed, ' ', '')) <> observed as mismatch from o join l using (listing_id)""")
def storage_claims(spark, d):
    """Storage that the text of an image shows against the storage that its listing claims."""
    o = _read(spark, d).filter("listing_id is not null").select("doc_id", "listing_id", F.explode(visual.observed(F.col("t"))["observed_storages"]).alias("observed"))
    l = c.olx(spark, d).filter("product.storage is not null and listing_id is not null").groupBy("listing_id").agg(F.min_by("product.storage", "record_id").alias("claimed"))
    claimed = F.upper(F.replace("claimed", F.lit(" "), F.lit("")))
    return o.join(l, "listing_id").select("doc_id", "listing_id", claimed.alias("claimed"), "observed", (claimed != F.col("observed")).alias("mismatch"))


@query(f"with {_READ}, o as (select listing_id, unnest({_OBS['demo_cues']}) as cue from d) select cue, count(*) as n, count(distinct listing_id) as listings from o group by 1")
def demo_cues(spark, d):
    o = _read(spark, d).select("listing_id", F.explode(F.transform(F.regexp_extract_all("t", F.lit(visual.DEMO), F.lit(1)), F.upper)).alias("cue"))
    return o.groupBy("cue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("listing_id").alias("listings"))


# --- graph tables ----------------------------------------------------------------------------------------------------

_STATE = "st as (select lower(name) as k, min(state_name) as s from canonical_values where kind = 'city' and state_name is not null group by 1)"
_V = f"""{_STATE}, v as (select 'LISTING' as node_type, listing_id as node_id from olx_listings where listing_id is not null union select 'PRODUCT', 'product:' || {c._slug_sql('product.model')} from olx_listings where product.model is not null
union select 'PRODUCT_FAMILY', 'family:' || {c._slug_sql('product.subcategory')} from olx_listings where product.subcategory is not null
union select 'CITY', 'city:' || {c._slug_sql('location')} from olx_listings where {c._strip_sql('location')} <> '' union select 'STATE', 'state:' || {c._slug_sql('s')} from olx_listings join st on lower({c._strip_sql('location')}) = k
union select 'MEDIA', media_a from image_matches where media_a is not null union select 'MEDIA', media_b from image_matches where media_b is not null)"""


def _states(spark, d):
    return table(spark, d, "canonical_values").filter("kind = 'city' and state_name is not null").groupBy(F.lower("name").alias("k")).agg(F.min("state_name").alias("state"))


def _node(prefix: str, col: str):
    return F.concat(F.lit(prefix + ":"), text.slug(F.col(col)))


def _with_state(spark, d):
    o = c.olx(spark, d).select("listing_id", "location", "model", F.col("product.subcategory").alias("family"), F.lower(parsing.strip(F.col("location"))).alias("k"))
    return o.join(_states(spark, d), "k", "left")


@query(f"with {_V} select node_type, node_id from v")
def graph_vertices(spark, d):
    """One row a vertex of the six types."""
    o, m = _with_state(spark, d), table(spark, d, "image_matches")
    place = parsing.strip(F.col("location")) != ""
    parts = [
        o.select(F.lit("LISTING").alias("node_type"), F.col("listing_id").alias("node_id")), o.select(F.lit("PRODUCT").alias("node_type"), _node("product", "model").alias("node_id")),
        o.select(F.lit("PRODUCT_FAMILY").alias("node_type"), _node("family", "family").alias("node_id")), o.filter(place).select(F.lit("CITY").alias("node_type"), _node("city", "location").alias("node_id")),
        o.select(F.lit("STATE").alias("node_type"), _node("state", "state").alias("node_id")), m.select(F.lit("MEDIA").alias("node_type"), F.explode(F.array("media_a", "media_b")).alias("node_id")),
    ]
    return _all_of(parts).filter("node_id is not null").distinct()


@query(f"""with {_STATE}, ids as (select distinct listing_id from olx_listings where listing_id is not null), m as (select upper(trim(listing_a)) as l, media_a as x from image_matches union select upper(trim(listing_b)), media_b from image_matches)
select distinct * from (select listing_id as source, 'city:' || {c._slug_sql('location')} as target, 'IN_CITY' as relationship from olx_listings where listing_id is not null and {c._strip_sql('location')} <> ''
union all select listing_id, 'product:' || {c._slug_sql('product.model')}, 'HAS_PRODUCT' from olx_listings where listing_id is not null and product.model is not null
union all select l, x, 'HAS_MEDIA' from m join ids on m.l = ids.listing_id where x is not null
union all select 'city:' || {c._slug_sql('location')}, 'state:' || {c._slug_sql('s')}, 'CITY_IN_STATE' from olx_listings join st on lower({c._strip_sql('location')}) = k)""")
def graph_structure(spark, d):
    """Edges from listings to cities, products and media (of known listings), and from cities to states."""
    o, m = _with_state(spark, d), table(spark, d, "image_matches")
    ids = o.select("listing_id").filter("listing_id is not null").distinct()
    media = m.select(F.explode(F.array(F.struct(F.upper(F.trim("listing_a")).alias("l"), F.col("media_a").alias("x")), F.struct(F.upper(F.trim("listing_b")).alias("l"), F.col("media_b").alias("x")))).alias("p")).select("p.*")
    place = parsing.strip(F.col("location")) != ""
    parts = [
        o.filter(place & F.col("listing_id").isNotNull()).select(F.col("listing_id").alias("source"), _node("city", "location").alias("target"), F.lit("IN_CITY").alias("relationship")),
        o.filter("listing_id is not null and model is not null").select(F.col("listing_id").alias("source"), _node("product", "model").alias("target"), F.lit("HAS_PRODUCT").alias("relationship")),
        media.filter("x is not null").join(ids, F.col("l") == F.col("listing_id"), "left_semi").select(F.col("l").alias("source"), F.col("x").alias("target"), F.lit("HAS_MEDIA").alias("relationship")),
        o.filter("state is not null").select(_node("city", "location").alias("source"), _node("state", "state").alias("target"), F.lit("CITY_IN_STATE").alias("relationship")),
    ]
    return _all_of(parts).distinct()


_T = f"t as (select listing_id, arg_min({c._norm_sql('title', 'title')}, record_id) as k from olx_listings where listing_id is not null and title is not null group by 1), g as (select k, min(listing_id) as r from t where length(k) > 0 group by k)"
_REL = f"""{e._PAIR}, {_T}, r as (select a, b, 'EXACT_IMAGE' as family from e where sha256_match union select a, b, 'PERCEPTUAL_IMAGE' from e where p <= 10 union select a, b, 'GRADIENT_IMAGE' from e where dh <= 10 union select least(r, listing_id), greatest(r, listing_id), 'SAME_TITLE' from t join g using (k) where r <> listing_id)"""


@query(f"with {_REL} select a, b, family from r")
def graph_relations(spark, d):
    """Edges between listings, each pair and family once whatever its direction. Listings of one title are linked to the smallest of them."""
    m = e._pairs(spark, d)
    t = table(spark, d, "olx_listings").filter("listing_id is not null and title is not null").select("listing_id", "record_id", text.compat(F.col("title")).alias("title"))
    t = t.select("listing_id", "record_id", text.normalise(F.col("title"), composed=True).alias("k")).groupBy("listing_id").agg(F.min_by("k", "record_id").alias("k"))
    g = t.filter("length(k) > 0").groupBy(F.col("k").alias("k2")).agg(F.min("listing_id").alias("r"))
    same = t.join(g, F.col("k") == F.col("k2")).filter("r <> listing_id").select(F.least("r", "listing_id").alias("a"), F.greatest("r", "listing_id").alias("b"), F.lit("SAME_TITLE").alias("family"))
    parts = [m.filter("sha256_match").select("a", "b", F.lit("EXACT_IMAGE").alias("family")), m.filter("p <= 10").select("a", "b", F.lit("PERCEPTUAL_IMAGE").alias("family")), m.filter("dh <= 10").select("a", "b", F.lit("GRADIENT_IMAGE").alias("family")), same]
    return _all_of(parts).distinct()


@query(c._CC + ", n as (select component, count(*) as size from c group by 1) select component, size, 'COMP-' || case when length(r) < 4 then lpad(r, 4, '0') else r end as component_id from (select component, size, cast(row_number() over (order by size desc, component) as varchar) as r from n)")
def component_ids(spark, d):
    """Components numbered by size, then smallest id."""
    n = graph.components(c._edges(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    r = ranking.number_rows(n, [F.desc("size"), F.col("component")])
    return r.select("component", "size", ranking.labelled(F.col("number"), "COMP", 4).alias("component_id"))


@query(c._CC + ", n as (select component from c group by 1 order by count(*) desc, component limit 30) select distinct e.a, e.b, c.component from e join c on e.a = c.id join n using (component)")
def largest_components(spark, d):
    """Edges inside the 30 largest components: a top-k report."""
    edges = cut(c._edges(spark, d))
    m = cut(graph.components(edges))
    top = m.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(30).select("component")
    inside = m.join(F.broadcast(top), "component", "left_semi")
    return edges.select("a", "b").distinct().join(inside.withColumnRenamed("id", "a"), "a").select("a", "b", "component")


@query(f"with {c._EDGES}, f as (select a as id, b as other, kind from e union all select b, a, kind from e), hub as (select id from f group by id order by count(distinct other) desc, id limit 1) select f.id, other, kind from f join hub using (id)")
def neighbourhood(spark, d):
    """All neighbours of one listing, here of the one with the most: a lookup at either end of the edges."""
    x = cut(c._edges(spark, d))
    f = x.select(F.col("a").alias("id"), F.col("b").alias("other"), "kind").unionByName(x.select(F.col("b").alias("id"), F.col("a").alias("other"), "kind"))
    hub = f.groupBy("id").agg(F.count_distinct("other").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")
    return f.join(F.broadcast(hub), "id", "left_semi").select("id", "other", "kind")


_BITS = "list_transform(embedding, x -> case when x > 0 then 1 else 0 end)"
_STEP = "list_transform(range(1, 65), i -> case when embedding[i] > embedding[i % 64 + 1] then 1 else 0 end)"


@query(f"""with {c._NEAR}, s as (select vec_id, {_BITS} as p, {_STEP} as g from e1), j as (select x.vec_id as a, y.vec_id as b, list_sum(list_transform(range(1, 65), i -> case when x.p[i] <> y.p[i] then 1 else 0 end)) as p, list_sum(list_transform(range(1, 65), i -> case when x.g[i] <> y.g[i] then 1 else 0 end)) as g from s x join s y on x.vec_id < y.vec_id)
select a, b, p <= 8 as by_sign, g <= 10 as by_gradient from j where p <= 8 or g <= 10""")
def disjunctive_matches(spark, d):
    """Pairs that one of two hashes finds near (8 or 10 of 64 bits): a union of banded joins, no pair is compared with all."""
    v = c._hash_vectors(spark, d)
    h = v.select("vec_id", *[x.alias(n) for x, n in zip(vectors.sign_hash("embedding"), ("h0", "h1"))])
    turn = F.transform("embedding", lambda x, i: x - F.get("embedding", F.pmod(i + 1, F.lit(64))))
    g = cut(v.select("vec_id", turn.alias("step"))).select("vec_id", *[x.alias(n) for x, n in zip(vectors.sign_hash("step"), ("h0", "h1"))])
    p, s = vectors.hamming_pairs(h, "vec_id", 8).select("a", "b", F.lit(True).alias("p")), vectors.hamming_pairs(g, "vec_id", 10).select("a", "b", F.lit(True).alias("g"))
    return p.join(s, ["a", "b"], "full").select("a", "b", F.coalesce("p", F.lit(False)).alias("by_sign"), F.coalesce("g", F.lit(False)).alias("by_gradient"))


# --- reports ---------------------------------------------------------------------------------------------------------


@query("select collection_metadata.run_id as run_id, count(*) as collected, count(distinct listing_id) as listings, count(*) filter (title is null or price is null) as incomplete, count(*) - count(distinct listing_id) as seen_again, epoch_us(min(collection_metadata.collected_at)) as started, epoch_us(max(collection_metadata.collected_at)) as ended from olx_listings group by 1")
def run_counters(spark, d):
    at = F.col("collection_metadata.collected_at")
    o = table(spark, d, "olx_listings").groupBy(F.col("collection_metadata.run_id").alias("run_id")).agg(
        F.count(F.lit(1)).alias("collected"), F.count_distinct("listing_id").alias("listings"), F.count_if(F.col("title").isNull() | F.col("price").isNull()).alias("incomplete"), F.min(at).alias("lo"), F.max(at).alias("hi")
    )
    return o.select("run_id", "collected", "listings", "incomplete", (F.col("collected") - F.col("listings")).alias("seen_again"), F.unix_micros(F.col("lo").cast("timestamp")).alias("started"), F.unix_micros(F.col("hi").cast("timestamp")).alias("ended"))


_STAGES = {
    "sightings": "select count(*) as n from olx_listings", "listings": "select count(distinct listing_id) as n from olx_listings", "with_price": "select count(*) as n from olx_listings where price > 0 and not isnan(price)", "matches": "select count(*) as n from image_matches",
    "distinct_matches": "select count(distinct match_id) as n from image_matches", "submissions": "select count(*) as n from synthetic_listings", "documents": "select count(*) as n from documents", "distinct_texts": "select count(distinct text) as n from documents",
}


@query(" union all ".join(f"select {q(k)} as stage, n from ({s})" for k, s in _STAGES.items()))
def dataset_ledger(spark, d):
    """How many rows each stage holds."""
    o, m, s, t = (table(spark, d, n) for n in ("olx_listings", "image_matches", "synthetic_listings", "documents"))
    n = F.count(F.lit(1)).alias("n")
    counts = {
        "sightings": o.agg(n), "listings": o.agg(F.count_distinct("listing_id").alias("n")), "with_price": o.filter("price > 0 and not isnan(price)").agg(n), "matches": m.agg(n),
        "distinct_matches": m.agg(F.count_distinct("match_id").alias("n")), "submissions": s.agg(n), "documents": t.agg(n), "distinct_texts": t.agg(F.count_distinct("text").alias("n")),
    }
    return _all_of([x.select(F.lit(k).alias("stage"), "n") for k, x in counts.items()])


@query(f"with {e._PAIR}, {e._META}, x as (select a as id, sha256_match from e union all select b, sha256_match from e) select count(distinct id) as listings, count(distinct id) filter (sha256_match) as with_exact, (select count(*) from (select distinct e.a, e.b from e join l x on e.a = x.id join l y on e.b = y.id where x.city <> y.city and x.city <> '' and y.city <> '')) as cross_city_pairs from x")
def reuse_indicators(spark, d):
    p = e._pairs(spark, d)
    x = p.select(F.explode(F.array("a", "b")).alias("id"), "sha256_match").agg(F.count_distinct("id").alias("listings"), F.count_distinct(F.when(F.col("sha256_match"), F.col("id"))).alias("with_exact"))
    far = e._enriched(spark, d).filter("city_a <> city_b and city_a <> '' and city_b <> ''").agg(F.count(F.lit(1)).alias("cross_city_pairs"))
    return x.join(F.broadcast(far))  # one row each


@query("select case when n = 1 then 'once' when n <= 5 then 'two_to_five' else 'more' end as bucket, count(*) as titles, sum(n)::bigint as listings from (select title, count(*) as n from olx_listings where title is not null group by 1) group by 1")
def title_frequency(spark, d):
    t = table(spark, d, "olx_listings").filter("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(F.when(F.col("n") == 1, "once").when(F.col("n") <= 5, "two_to_five").otherwise("more").alias("bucket")).agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("listings"))


@query(f"with z as ({SQL['claim_drift']}), y as (select a as id, kind from z union all select b, kind from z) select id, count(*) filter (kind = 'model_drift') as model_drift, count(*) filter (kind = 'price_variance') as price_variance, count(*) as inconsistencies from y group by 1")
def inconsistency_counts(spark, d):
    y = e.claim_drift(spark, d).select(F.explode(F.array("a", "b")).alias("id"), "kind")
    one = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return y.groupBy("id").agg(one("model_drift"), one("price_variance"), F.count(F.lit(1)).alias("inconsistencies"))


@query("with a as (select distinct listing_id as id from olx_listings where listing_id is not null), m as (select listing_a as x from image_matches union select listing_b from image_matches), b as (select distinct upper(trim(x)) as id from m where trim(x) <> '') select side, count(*) as n from (select 'listings_only' as side from a where id not in (select id from b) union all select 'matches_only' from b where id not in (select id from a)) group by 1")
def id_differences(spark, d):
    """Ids on one side only, both ways."""
    a = table(spark, d, "olx_listings").select(F.col("listing_id").alias("id")).filter("id is not null").distinct()
    b = table(spark, d, "image_matches").select(F.explode(F.array("listing_a", "listing_b")).alias("x")).filter("trim(x) <> ''").select(F.upper(F.trim("x")).alias("id")).distinct()
    n = F.count(F.lit(1)).alias("n")
    return _all_of([x.exceptAll(y).select(F.lit(k).alias("side")).groupBy("side").agg(n) for k, x, y in (("listings_only", a, b), ("matches_only", b, a))])


@query("""with m as (select record_id, unnest(media) as m, generate_subscripts(media, 1) as pos from synthetic_listings), k as (select coalesce(nullif(regexp_extract(m.source_url, '/files/([^/?#;]+)', 1), ''), m.source_url) as task, record_id, pos, m.source_url as url from m where m.source_url is not null)
select task, arg_min(url, (record_id, pos)) as url, count(*) as asked from k group by 1""")
def media_tasks(spark, d):
    """One task a file id, else a URL; the first that asks wins."""
    m = table(spark, d, "synthetic_listings").select("record_id", F.posexplode("media").alias("pos", "m")).filter("m.source_url is not null")
    task = F.coalesce(F.nullif(F.regexp_extract("m.source_url", r"/files/([^/?#;]+)", 1), F.lit("")), F.col("m.source_url"))
    return m.groupBy(task.alias("task")).agg(F.min_by("m.source_url", F.struct("record_id", "pos")).alias("url"), F.count(F.lit(1)).alias("asked"))


@query(f"select record_id, seller.display_name as display_name, coalesce(trim(seller.phone), '') <> '' as has_phone, coalesce(trim(seller.email), '') <> '' as has_email, {c._hmac_sql('seller.phone', 'salt')} as phone_hash, {c._hmac_sql('seller.email', 'salt')} as email_hash from synthetic_listings")
def seller_profiles(spark, d):
    """Sellers with hashes in place of phone numbers and addresses."""
    has = lambda k: F.coalesce(F.trim(k), F.lit("")) != ""
    return table(spark, d, "synthetic_listings").select(
        "record_id", F.col("seller.display_name").alias("display_name"), has("seller.phone").alias("has_phone"), has("seller.email").alias("has_email"),
        privacy.hash_identifier(F.col("seller.phone"), "salt").alias("phone_hash"), privacy.hash_identifier(F.col("seller.email"), "salt").alias("email_hash"),
    )


@query(f"with {c._EDGES}, m0 as (select upper(trim(listing_a)) as a, upper(trim(listing_b)) as b, case when sha256_match then 'exact' else 'perceptual' end as kind from image_matches) select least(a, b) as a, greatest(a, b) as b, kind, count(*) as seen from m0 where a <> '' and b <> '' and a <> b group by 1, 2, 3")
def relationship_records(spark, d):
    m = table(spark, d, "image_matches").select(F.upper(F.trim("listing_a")).alias("x"), F.upper(F.trim("listing_b")).alias("y"), F.when(F.col("sha256_match"), "exact").otherwise("perceptual").alias("k")).filter("x <> '' and y <> ''")
    return sinks.relationship_records(m, "x", "y", "k").select("a", "b", "kind", "seen")


@query("select listing_id, arg_max(doc_id, (n_chars * case lang when 'en' then 0.9 when 'hi' then 0.7 else 0.5 end, -doc_id)) as doc_id, count(*) as variants from documents where listing_id is not null and text is not null group by 1")
def best_variant(spark, d):
    """Of several texts of a listing the one of the largest length times confidence."""
    t = table(spark, d, "documents").filter("listing_id is not null and text is not null")
    weight = F.col("n_chars") * F.when(F.col("lang") == "en", 0.9).when(F.col("lang") == "hi", 0.7).otherwise(0.5)
    return t.groupBy("listing_id").agg(F.max_by("doc_id", F.struct(weight, -F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("variants"))


# --- feature store ---------------------------------------------------------------------------------------------------

_BASE = f"""b as (select listing_id, min(record_id) as record_id, count(*) as observations, count(distinct discovery_context.query) as queries, count(distinct price) as prices, min(price) filter (price > 0) as lowest_price, max(price) filter (price > 0) as highest_price,
 epoch_us(min(collection_metadata.collected_at)) as first_seen, epoch_us(max(collection_metadata.collected_at)) as last_seen, max(len(contact_signals)) as contacts from olx_listings where listing_id is not null group by 1)"""
_LEX = ", ".join(f"{c._lex_sql(n)} as {n}_terms" for n in text.LEXICONS)

_STORE = f"""with recursive {_BASE}, x as (select b.*, {c._norm_sql("concat_ws(' ', o.title, o.description)", 'listing')} as norm, length(coalesce(o.title, '')) as title_chars, length(o.description) as description_chars, o.category, coalesce(nullif({c._strip_sql('o.location')}, ''), 'Unknown') as city,
 o.product.brand as brand, o.product.model as model, o.product.storage as storage, o.seller.seller_type as seller_type from b join olx_listings o using (record_id)), y as (select *, {c._TOK.format('norm')} as tokens from x)
select y.listing_id, y.record_id, observations, queries, prices, lowest_price, highest_price, first_seen, last_seen, contacts, title_chars, description_chars, y.category, city, y.brand, y.model, y.storage, y.seller_type, len(tokens) as token_count, {_LEX}, {', '.join(f'({c._lex_sql(n)}) > 0 as has_{n}' for n in text.LEXICONS)},
 coalesce(g.degree, 0) as degree, coalesce(g.exact_neighbours, 0) as exact_neighbours, coalesce(g.edges, 0) as graph_edges, coalesce(k.component, y.listing_id) as component, coalesce(i.model_drift, 0) as model_drift, coalesce(i.price_variance, 0) as price_variance,
 pp.percentile_rank, pp.ratio as price_ratio, pp.flag_35, pp.flag_50, pp.id is not null as benchmarked, pm.product_family, pm.accessory_or_device, pm.normalization_confidence
from y left join ({SQL['listing_graph_features']}) g on y.listing_id = g.id left join ({SQL['connected_components']}) k on y.listing_id = k.id left join ({SQL['inconsistency_counts']}) i on y.listing_id = i.id left join ({SQL['price_position']}) pp on y.record_id = pp.id
left join ({SQL['product_match']}) pm on y.record_id = pm.record_id"""


@query(_STORE)
def feature_store(spark, d):
    """One row a listing of ten tables: sightings, texts, lexicons, graph, component, inconsistencies, price position, product.

    Every table is brought to one row a key before it is joined, so no row multiplies. 0 is an observed absence; null is
    not available: prices without a benchmark, descriptions that are missing.
    """
    o = c.olx(spark, d).filter("listing_id is not null")
    positive = F.when(F.col("price") > 0, F.col("price"))
    first = lambda col: F.min_by(col, "record_id")
    b = o.groupBy("listing_id").agg(
        F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("observations"), F.count_distinct("query").alias("queries"), F.count_distinct("price").alias("prices"), F.min(positive).alias("lowest_price"), F.max(positive).alias("highest_price"),
        F.unix_micros(F.min("seen").cast("timestamp")).alias("first_seen"), F.unix_micros(F.max("seen").cast("timestamp")).alias("last_seen"), F.max(F.size("contact_signals")).cast("bigint").alias("contacts"),
        first(F.struct("title", "description", "category", "location", "product.brand", "product.model", "product.storage", "seller.seller_type")).alias("f"),
    )
    t = F.concat_ws(" ", "f.title", "f.description")
    b = b.select("*", text.compat(t).alias("t")).select("*", F.explode(F.array(text.normalise(F.col("t"), "listing", composed=True))).alias("norm")).select("*", F.explode(F.array(text.tokens(F.col("norm")))).alias("tokens"))
    lex = {n: text.lexicon_count(F.col("tokens"), F.col("norm"), n) for n in text.LEXICONS}
    b = b.select(
        "listing_id", "record_id", "observations", "queries", "prices", "lowest_price", "highest_price", "first_seen", "last_seen", "contacts", F.length(F.coalesce("f.title", F.lit(""))).cast("bigint").alias("title_chars"), F.length("f.description").cast("bigint").alias("description_chars"),
        "f.category", F.coalesce(F.nullif(parsing.strip(F.col("f.location")), F.lit("")), F.lit("Unknown")).alias("city"), "f.brand", "f.model", "f.storage", "f.seller_type", F.size("tokens").cast("bigint").alias("token_count"),
        *[v.cast("bigint").alias(f"{n}_terms") for n, v in lex.items()],
    )
    b = cut(b)
    b = b.select("*", *[(F.col(f"{n}_terms") > 0).alias(f"has_{n}") for n in text.LEXICONS])
    g = graph.node_features(c._edges(spark, d)).select(F.col("id").alias("listing_id"), "degree", "exact_neighbours", F.col("edges").alias("graph_edges"))
    k = graph.components(c._edges(spark, d)).select(F.col("id").alias("listing_id"), F.col("component").alias("comp"))
    i = inconsistency_counts(spark, d).select(F.col("id").alias("listing_id"), "model_drift", "price_variance")
    pp = c.price_position(spark, d).select(F.col("id").alias("record_id"), "percentile_rank", F.col("ratio").alias("price_ratio"), "flag_35", "flag_50", F.lit(True).alias("hit"))
    pm = cut(c.product_match(spark, d).select("record_id", "product_family", "accessory_or_device", "normalization_confidence"))
    j = b.join(g, "listing_id", "left").join(k, "listing_id", "left").join(i, "listing_id", "left").join(pp, "record_id", "left").join(pm, "record_id", "left")
    j = j.fillna(0, ["degree", "exact_neighbours", "graph_edges", "model_drift", "price_variance"])
    return j.withColumn("component", F.coalesce("comp", "listing_id")).withColumn("benchmarked", F.coalesce("hit", F.lit(False))).drop("comp", "hit")


@query()
def schema_breakdown(spark, d):
    """Per column of the feature store: kind, distinct values, missing rate, constant, mostly null; one pass."""
    f = cut(feature_store(spark, d))
    kinds = {n: "binary" if k == "boolean" else "numeric" if k in ("bigint", "int", "double") else "categorical" for n, k in f.dtypes}
    row = f.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.count_if(F.col(n).isNull()).alias("m"), F.approx_count_distinct(n).alias("d")).alias(n) for n in kinds])
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("kind"), F.col(f"{n}.m").alias("missing"), (F.col(f"{n}.d") <= 1).alias("is_constant")) for n, k in kinds.items()])
    return row.select("rows", F.explode(each).alias("r")).select("r.feature", "r.kind", F.round(F.col("r.missing") / F.greatest("rows", F.lit(1)), 4).alias("missing_rate"), "r.is_constant", (F.col("r.missing") >= 0.8 * F.col("rows")).alias("mostly_null"))
