"""Pattern redaction, masks and keyed hashes of identifiers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and marks of the redaction, in their order.
REDACTIONS = [
    (r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"(?i)\b[a-zA-Z0-9.\-_]{2,256}@(?:okhdfcbank|okaxis|oksbi|okicici|paytm|ybl|ibl|axl|apl|upi)\b", "[UPI_REDACTED]"),
    (r"\b(?:\d{2}[-\s]?\d{6}[-\s]?\d{6}[-\s]?\d|\d{15})\b", "[IMEI_REDACTED]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}(?:[-\s]?\d{4})?\b", "[NUMERIC_ID_REDACTED]"),
    (r"(?:\+?91[-.\s]*)?[6-9]\d{9}\b|(?:\+?91[-.\s]*)?\d{5}[-.\s]*\d{5}\b", "[PHONE_REDACTED]"),
]


def redact(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for pattern, mark in REDACTIONS:
        t = F.regexp_replace(t, pattern, mark.replace("$", r"\$"))
    return t


def mask_phone(raw: Column) -> Column:
    d = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    return F.when(F.coalesce(raw, F.lit("")) == "", "").when(F.length(d) >= 10, F.concat(F.lit("+91 "), F.substring(d, 1, 2), F.lit("******"), F.right(d, F.lit(2)))).otherwise("[PHONE_REDACTED]")


def mask(text: Column, visible: int = 2) -> Column:
    """First and last ``visible`` characters, stars between; short texts become stars, null and '' a note."""
    n = F.length(text)
    masked = F.concat(F.left(text, F.lit(visible)), F.repeat(F.lit("*"), n - 2 * visible), F.right(text, F.lit(visible)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "[NOT PROVIDED]").when(n <= 2 * visible, F.repeat(F.lit("*"), n)).otherwise(masked)


def hash_identifier(raw: Column, salt: str) -> Column:
    """HMAC-SHA-256 in hex of the trimmed lower-case value; null for null and blank values.

    Of values that look like phone numbers the last ten digits count, of shorter ones of seven digits or more all digits.
    Built from sha2 on bytes: the padded key blocks are constants of the plan.
    """
    v = F.lower(F.trim(raw))
    digits = F.regexp_replace(v, r"\D", "")
    phone = v.rlike(r"^[\d+\-\s()]+$")
    v = F.when(phone & (F.length(digits) >= 10), F.right(digits, F.lit(10))).when(phone & (F.length(digits) >= 7), digits).when(v != "", v)
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(v, "UTF-8")), 256))), 256)
