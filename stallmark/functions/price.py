"""Prices and currencies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:\.\d+)?)"
THOUSAND = NUMBER + r"\s*k\b"
LAKH = NUMBER + r"\s*(?:lakhs?|lacs?)\b"
#: Currency signs, in the order in which they are looked for.
CURRENCIES = {"₹": "INR", "rs.": "INR", "rs": "INR", "inr": "INR", "$": "USD", "usd": "USD"}


def amount(raw: Column) -> Column:
    """Number in a typed price: 45k, 1.5 lakh, Rs. 45,000; null if there is none. A sign is lost."""
    t = F.lower(raw)
    for sign in CURRENCIES:
        t = F.replace(t, F.lit(sign), F.lit(""))
    t = F.trim(F.replace(t, F.lit(","), F.lit("")))
    k, lakh, n = (F.regexp_extract(t, p, 1) for p in (THOUSAND, LAKH, NUMBER))
    return F.when(k != "", k.cast("double") * 1e3).when(lakh != "", lakh.cast("double") * 1e5).when(n != "", n.cast("double"))


def currency(raw: Column) -> Column:
    """Upper-case currency of a code or sign, INR for null."""
    known = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(raw))), F.upper(F.trim(raw)), F.lit("INR"))


def status(price: Column) -> Column:
    return F.when(price.isNull() | F.isnan(price), "missing").when(price == 0, "zero").when(price < 0, "negative").otherwise("valid")
