"""Text expressions: normalisers, tokens, script labels, lexicon counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters each normaliser keeps besides letters, digits, underscore and blanks.
KEEP = {"title": "", "listing": r"./\-+₹", "ocr": r"./\-+"}
WORD_CLASS = r"\p{L}\p{N}_\s"


def normalise(text: Column, kind: str = "title", composed: bool = False) -> Column:
    """NFKC and lower case, everything but words (and the kept signs) to a blank, blanks collapsed; null gives ''.

    ``composed`` says that the text went through :func:`compat` already.
    """
    t = F.lower(F.coalesce(text if composed else compat(text), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"[^{WORD_CLASS}{KEEP[kind]}]", " "), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which no built-in expression offers; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compat(text: Column) -> Column:
    """NFKC of a text; only texts with other than ASCII characters are sent to Python."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def sanitised(text: Column) -> Column:
    """NFKC, blanks collapsed, paragraph breaks kept, empty gives null."""
    return paragraphs(compat(text))


def title_case(text: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case; null stays null."""
    chars = F.split(text, "")
    cased = F.transform(chars, lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(cased, "")


def paragraphs(text: Column) -> Column:
    """Collapse blanks within paragraphs, keep paragraph breaks, drop empty ones; an empty result is null."""
    parts = F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    return F.when(joined != "", joined)


def tokens(normalised: Column) -> Column:
    """Words of a normalised text, stripped of .,/-_ at both ends; specifications such as 8/256 stay whole."""
    parts = F.transform(F.split(normalised, " "), lambda w: F.regexp_replace(w, r"^[.,/\-_]+|[.,/\-_]+$", ""))
    return F.filter(parts, lambda w: w != "")


def script(text: Column) -> Column:
    """Label of the scripts of the letters and digits of a text; null and '' are empty."""
    t = F.coalesce(text, F.lit(""))
    latin, deva = t.rlike(r"\p{IsLatin}"), t.rlike(r"\p{IsDevanagari}")
    other = F.regexp_replace(t, r"[\p{IsLatin}\p{IsDevanagari}\x00-\x7F]", "").rlike(r"[\p{L}\p{N}]")
    return (
        F.when(t == "", "empty").when(deva & latin, "mixed_latin_devanagari").when(deva, "devanagari")
        .when(other & latin, "mixed_latin_other").when(other, "other_non_latin").when(latin, "latin_english").otherwise("numeric_symbolic")
    )


#: The lexicons of the text features, single words and phrases.
LEXICONS: dict[str, list[str]] = {
    "urgency": [
        "urgent", "urgently", "immediate", "immediately", "quick", "fast", "today", "now", "emergency", "hurry", "asap", "leaving", "relocation",
        "relocating", "transfer", "shifting", "moving", "need gone", "sale today", "last chance", "limited time", "urgent sale",
    ],
    "contact_redirection": ["whatsapp", "call", "contact", "dm", "message", "msg", "ping", "telegram", "number", "phone", "chat", "inbox", "reach", "ring"],
    "transaction_payment": [
        "price", "cash", "cod", "cash on delivery", "upi", "payment", "advance", "token", "deposit", "booking", "refund", "emi", "fixed price", "fixed",
        "negotiable", "bargain", "cheap", "best price", "discount", "offer", "final price", "non negotiable", "rate", "cost", "gpay", "phonepe", "paytm",
    ],
    "clearance_commercial": [
        "clearance", "warehouse", "liquidation", "stock", "company", "office", "bulk", "wholesale", "dealer", "distributor", "lot", "shop", "store",
        "retailer", "supplier", "reseller", "godown", "surplus",
    ],
    "warranty_authenticity": [
        "original", "genuine", "authentic", "warranty", "bill", "invoice", "gst", "sealed", "box pack", "seal pack", "pin pack", "brand new",
        "apple care", "under warranty", "valid bill", "official", "100% original", "first owner", "indian unit", "indian", "usa unit", "bill box",
    ],
    "delivery_logistics": [
        "courier", "delivery", "transport", "shipping", "parcel", "dispatch", "pickup", "home delivery", "all india", "doorstep", "free delivery",
        "ship", "post", "speed post", "cargo",
    ],
    "condition_lexicon": [
        "new", "used", "like new", "mint", "flawless", "scratchless", "clean", "super clean", "neat", "perfect", "good condition", "excellent", "damaged",
        "broken", "repair", "refurbished", "renewed", "replaced", "dead", "faulty", "scratch", "cracked", "minor scratch", "battery health", "bh",
    ],
    "relocation": ["relocation", "relocating", "transfer", "shifting", "moving", "leaving", "going abroad", "urgent relocation", "flat shifting", "home shifting"],
    "company_claims": ["company", "corporate", "office", "official", "enterprise", "business", "company warranty", "company sealed", "company piece"],
}


def lexicon_count(words: Column, text: Column, name: str) -> Column:
    """Distinct single words among the tokens plus phrases contained in the text (as substrings)."""
    single = [t for t in LEXICONS[name] if " " not in t]
    n = F.size(F.array_intersect(words, F.array(*map(F.lit, single))))
    for phrase in (t for t in LEXICONS[name] if " " in t):
        n = n + F.when(F.contains(text, F.lit(phrase)), 1).otherwise(0)
    return n


def slug(text: Column) -> Column:
    """Part of a node id: trimmed, lower case, blank, slash and colon to underscore."""
    return F.translate(F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), " /:", "___")
