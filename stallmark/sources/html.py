"""Listing and search pages: embedded JSON first, patterns as the way back, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
STATE = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
SCRIPT = r"(?is)<script\b[^>]*>.*?</script>"


def _found(html: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def listing_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Title, description, price, place and images of a listing page: linked data, else state, else patterns; null if absent."""
    h = F.col(html)
    ld, st = F.regexp_extract(h, LD, 1), F.regexp_extract(h, STATE, 1)
    get, seen = F.get_json_object, F.regexp_replace(h, SCRIPT, " ")  # patterns are for what the page shows
    base = "$.props.pageProps.ad"
    title = F.coalesce(get(ld, "$.name"), get(st, f"{base}.title"), _found(seen, r"(?is)<h1[^>]*>(.*?)</h1>"), _found(seen, r"(?is)<title[^>]*>(.*?)</title>"))
    amount = F.coalesce(get(ld, "$.offers.price"), get(st, f"{base}.price.value"), F.replace(F.nullif(F.regexp_extract(seen, r"₹\s*([\d,]+)", 1), F.lit("")), F.lit(","), F.lit("")))
    images = F.array_distinct(F.regexp_extract_all(h, F.lit(r'(https?://[^\s"\'<>]+?\.(?:jpe?g|png|webp))'), F.lit(1)))
    return pages.select(
        F.col(url).alias("url"), F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"iid-(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(F.col(url), r"/(\d{6,})", 1), F.lit(""))).alias("listing_id"),
        title.alias("title"), F.coalesce(get(ld, "$.description"), get(st, f"{base}.description"), _found(h, r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"')).alias("description"),
        amount.cast("double").alias("price"), F.coalesce(get(ld, "$.offers.availableAtOrFrom.address.addressLocality"), get(st, f"{base}.location")).alias("location"), images.alias("images"),
    )


def search_cards(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Cards of a search page: the item list of linked data, else item links; one row a distinct link in page order."""
    h = F.col(html)
    items = F.from_json(F.get_json_object(F.regexp_extract(h, LD, 1), "$.itemListElement"), "array<struct<url:string,name:string>>")
    links = F.transform(F.array_distinct(F.regexp_extract_all(h, F.lit(r'href="([^"]*/item/[^"]+)"'), F.lit(1))), lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("name")))
    return pages.select(F.col(url).alias("page_url"), F.posexplode(F.coalesce(F.when(F.size(items) > 0, items), links)).alias("position", "c")).select("page_url", "position", F.col("c.url").alias("url"), F.col("c.name").alias("title"))


#: Claims of a listing text and the words that make them.
CLAIMS = {
    "Army / Defence Officer Relocation": r"\b(army|cisf|defence|military|canteen|gate\s*pass)\b",
    "Urgent / Distress Sale": r"\b(urgent|distress|leaving\s*city|transfer|moving\s*abroad)\b",
    "Warehouse / Corporate Clearance": r"\b(clearance|warehouse|liquidation|office\s*closing|company\s*closing)\b",
    "Invoice / GST Bill Available": r"\b(invoice|bill|gst|receipt|original\s*bill)\b",
    "Advance / Token Required": r"\b(advance|token|booking|deposit|delivery\s*fee)\b",
    "WhatsApp / Off-Platform Contact": r"\b(whatsapp|wa\.me|call\s*on|message\s*on)\b",
}


def claims(title: Column, description: Column) -> Column:
    """Claims of title and description in a fixed order: ``position`` from 1, ``claim``, ``evidence`` (the first words that make it)."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    hits = F.array(*[F.struct(F.lit(n).alias("claim"), F.regexp_extract(text, p, 0).alias("evidence")) for n, p in CLAIMS.items()])
    return F.transform(F.filter(hits, lambda c: c["evidence"] != ""), lambda c, i: F.struct((i + 1).alias("position"), c["claim"].alias("claim"), c["evidence"].alias("evidence")))
