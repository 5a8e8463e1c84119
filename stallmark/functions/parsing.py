"""Parsers of titles and fields: conditions, specifications, accessories, places, URLs, HTML, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words per class of the condition field, in the order in which they are tried.
CONDITION_WORDS = {
    "new": ["brand new", "seal pack", "sealed", "unopened", "unused", "box pack"],
    "like_new": ["like new", "mint", "flawless", "open box", "box opened", "barely used", "almost new", "10/10", "9.5/10", "as new"],
    "good": ["good", "working", "fine", "clean", "minor scratches", "gently used", "8/10", "9/10", "used"],
    "fair": ["fair", "average", "scratched", "heavy use", "wear", "7/10", "functional"],
    "poor": ["poor", "broken", "cracked", "damaged", "faulty", "for parts", "repair", "not working", "dead"],
}
CONDITION_NAMES = ["new", "like_new", "good", "fair", "poor", "unknown"]

#: Patterns of the condition of a title, by priority, and of its cues.
TITLE_CONDITIONS = {
    "FOR_PARTS": r"\b(?:for\s+parts|damaged|broken|not\s+working|dead|faulty|bypass|display\s+broken|screen\s+cracked|face\s*id\s+issue)\b",
    "REFURBISHED": r"\b(?:refurbished|renewed|repaired|replacement\s+piece)\b",
    "NEW": r"\b(?:brand\s+new|sealed|unopened|unused|box\s*pack|seal\s*pack|pin\s*pack|new\s+piece)\b",
    "LIKE_NEW": r"\b(?:like\s+new|mint(?:\s+condition)?|flawless|scratchless|as\s+new|super\s+clean|neat\s+and\s+clean|10/10\s+condition|9\.9/10\s+condition)\b",
    "USED": r"\b(?:used|second\s*hand|pre[- ]owned|good\s+condition|running\s+condition|\d+\s*(?:days?|months?|years?)\s*old|under\s+warranty|bill\s*box)\b",
}
CUES = [
    r"\b\d+\s*(?:days?|months?|years?)\s*old\b",
    r"\b(?:100%|9\d%|8\d%|7\d%)\s*(?:battery\s*health|battery|bh)\b",
    r"\bbattery\s*(?:health)?\s*(?:100%|9\d%|8\d%|7\d%)\b",
    r"\b(?:brand\s+new|sealed|seal\s*pack|box\s*pack|unopened|unused)\b",
    r"\b(?:like\s+new|mint\s*condition|scratchless|flawless)\b",
    r"\b(?:second\s*hand|pre[- ]owned|used)\b",
    r"\b(?:bill\s*box|box\s*bill|with\s*bill|original\s*bill)\b",
    r"\b(?:under\s+warranty|apple\s+warranty)\b",
    r"\b(?:refurbished|renewed|repaired)\b",
    r"\b(?:broken|damaged|not\s*working|for\s*parts)\b",
]
#: Accessory classes by first match.
ACCESSORIES = {
    "CASE": r"\b(?:cases?|back\s*cover|pouch|silicone\s*case|leather\s*case)\b",
    "COVER": r"\b(?:covers?|flip\s*cover|skin|wrap|guard)\b",
    "CHARGER": r"\b(?:chargers?|adapter|power\s*adapter)\b",
    "CABLE": r"\b(?:cables?|cord)\b",
    "SCREEN_PROTECTOR": r"\b(?:tempered\s*glass|screen\s*guard|screen\s*protector|membrane)\b",
    "PART": r"\b(?:display\s*panel|motherboard|battery\s*replacement|spare\s*parts?|housing|body|camera\s*lens\s*glass)\b",
    "ACCESSORY": r"\b(?:dummy|box\s*only|empty\s*box|controller\s*grip|charging\s*dock|cooling\s*fan|stand|earphones?)\b",
}
#: Blanks of any kind at both ends.
BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def condition_field(raw: Column) -> Column:
    """Condition of a typed field: a class name itself, else the first class one of whose words it contains."""
    c = F.lower(F.trim(raw))
    out = F.when(c.isin(*CONDITION_NAMES), c)
    for name, words in CONDITION_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = out.when(hit, name)
    return F.coalesce(out, F.lit("unknown"))


def condition_title(title: Column) -> Column:
    t = F.lower(title)
    out = F.when(t.isNull(), "UNKNOWN")
    for name, p in TITLE_CONDITIONS.items():
        out = out.when(t.rlike(p), name)
    return out.otherwise("UNKNOWN")


def condition_cues(title: Column) -> Column:
    """Distinct cues as written, in the order of the patterns, within one pattern in the order of the text; [] for null."""
    t = F.coalesce(title, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(t, F.lit(f"(?i)({p})"), F.lit(1)), lambda x: F.trim(x)) for p in CUES])))


def accessory(title: Column) -> Column:
    t = F.lower(title)
    out = F.when(t.isNull(), "device")
    for name, p in ACCESSORIES.items():
        out = out.when(t.rlike(p), name.lower())
    return out.otherwise("device")


def city_and_state(raw: Column) -> tuple[Column, Column]:
    """Comma parts: of three or more the last two, of two both, of one the city alone."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: strip(p)), lambda p: p != "")
    n = F.size(parts)
    city = F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).when(n >= 1, F.try_element_at(parts, F.lit(1)))
    state = F.when(n >= 3, F.try_element_at(parts, F.lit(-1))).when(n == 2, F.try_element_at(parts, F.lit(2)))
    return city, state


def listing_id_of_url(url: Column) -> Column:
    """iid-<digits>, else the last path part of six digits or more."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"iid-(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/(\d{6,})", 1), F.lit("")))


def file_id_of_url(url: Column) -> Column:
    """/files/<id>/, else host and path without a size suffix."""
    own = F.nullif(F.regexp_extract(url, r"/files/([^/?#;]+)", 1), F.lit(""))
    return F.coalesce(own, F.regexp_replace(F.regexp_extract(url, r"^\w+://([^?#;]+)", 1), r"-\d+x\d+(?=\.\w+$)|\.\w+$", ""))


def record_errors(title: Column, source: Column, price: Column) -> Column:
    """Validation errors of a raw record, [] if it is valid."""
    plain = F.regexp_replace(price, r"[₹, ]|Rs\.?", "")
    return F.array_compact(F.array(
        F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) == 0, "Missing required field: 'title'"),
        F.when(F.length(F.trim(F.coalesce(source, F.lit("")))) == 0, "Missing required field: 'source'"),
        F.when(plain.rlike(r"^-\d+(?:\.\d+)?$"), "Price cannot be negative"),
    ))
