"""Specifications that a text read from an image shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions.text import title_case

#: What is looked for in texts of images.
IPHONE = r"(?i)\b(?:i\s*phone|iphone)\s*(1[1-7]|[6-9]|x[rs]?|x|se(?:\s*[123])?)\s*(pro\s*max|pro|max|plus|mini)?\b"
MACBOOK = r"(?i)\b(?:mac\s*book|macbook)\s*(air|pro)?\s*(m[1-4]|intel)?\b"
PAD = r"(?i)\b(?:dualsense|dual\s*sense|ps5\s*controller)\b"
PS5 = r"(?i)\b(?:ps5|playstation\s*5)\b"
STORAGE = r"(?i)\b(64|128|256|512)\s*(?:gb|g\b)|(1|2)\s*(?:tb|t\b)"
CHIP = r"(?i)\b(m1|m2|m3|m4|intel\s*i[3579]|core\s*i[3579])\b"
DEMO = r"(?i)\b(demo\s*unit|demo|not\s*for\s*sale|display\s*unit|activation\s*lock|carrier\s*lock|icloud\s*lock|bypass)\b"
CONDITION = r"(?i)\b(brand\s*new|sealed|refurbished|renewed|replacement|broken|damaged|crack|dead)\b"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def observed(text: Column) -> dict[str, Column]:
    """Sorted distinct models, storages, chips, demo cues and conditions of a normalised text; [] for null."""
    t = F.coalesce(text, F.lit(""))
    some = lambda c, value: F.when(c != "", value)
    phones = F.zip_with(_all(t, IPHONE, 1), _all(t, IPHONE, 2), lambda g, v: F.concat_ws(" ", F.lit("iPhone"), F.upper(g), some(v, title_case(v))))
    books = F.zip_with(_all(t, MACBOOK, 1), _all(t, MACBOOK, 2), lambda s, c: F.concat_ws(" ", F.lit("MacBook"), some(s, title_case(s)), some(c, F.upper(c))))
    play = F.array_compact(F.array(F.when(t.rlike(PAD), "PS5 DualSense Controller").when(t.rlike(PS5), "PS5 Console")))
    sizes = F.zip_with(_all(t, STORAGE, 1), _all(t, STORAGE, 2), lambda g, b: F.when(g != "", F.concat(g, F.lit("GB"))).otherwise(F.concat(b, F.lit("TB"))))
    out = {
        "models": F.concat(phones, books, play), "storages": sizes, "chips": F.transform(_all(t, CHIP, 1), F.upper),
        "demo_cues": F.transform(_all(t, DEMO, 1), F.upper), "conditions": F.transform(_all(t, CONDITION, 1), title_case),
    }
    return {f"observed_{k}": F.array_sort(F.array_distinct(c)) for k, c in out.items()}
