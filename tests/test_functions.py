import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from stallmark.functions import parsing, price, privacy, text


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()[0]


def test_price(spark):
    for raw, want in (("₹45,000", 45000.0), ("45k", 45000.0), ("Rs. 45000", 45000.0), ("1.5 Lakh", 150000.0), ("INR 45,000", 45000.0), ("$499", 499.0), ("call", None), (None, None), ("", None)):
        assert one(spark, price.amount, raw) == want, raw
    assert one(spark, price.currency, None) == "INR"
    assert one(spark, price.currency, "usd") == "USD"
    assert [one(spark, price.status, v, "double") for v in (None, 0.0, -1.0, 5.0, float("nan"))] == ["missing", "zero", "negative", "valid", "missing"]


def test_conditions(spark):
    for raw, want in (("Like New", "like_new"), ("brand new sealed", "new"), ("used", "good"), ("poor", "poor"), ("", "unknown"), (None, "unknown"), ("10/10", "like_new")):
        assert one(spark, parsing.condition_field, raw) == want, raw
    assert one(spark, parsing.condition_title, "iPhone not working, sealed") == "FOR_PARTS"
    assert one(spark, parsing.condition_title, None) == "UNKNOWN"
    assert one(spark, parsing.condition_cues, "2 months old, scratchless, used") == ["2 months old", "scratchless", "used"]


def test_text(spark):
    assert one(spark, text.normalise, "  Straße ä—X,  9/10 ") == "straße ä x 9 10"
    assert one(spark, lambda c: text.normalise(c, "listing"), "8/256 GB, ₹500!") == "8/256 gb ₹500"
    assert one(spark, lambda c: text.tokens(text.normalise(c, "listing")), "8/256 GB. --") == ["8/256", "gb"]
    assert one(spark, text.script, "abc नमस्ते") == "mixed_latin_devanagari"
    assert [one(spark, text.script, t) for t in (None, "", "नमस्ते ж", "abc ж", "ж", "abc", "12 ₹")] == ["empty", "empty", "devanagari", "mixed_latin_other", "other_non_latin", "latin_english", "numeric_symbolic"]
    assert one(spark, text.title_case, "z fold5 o'neil 9PRO") == "Z Fold5 O'Neil 9Pro"
    assert one(spark, text.normalise, "ﬁne ４GB…") == "fine 4gb" and one(spark, text.sanitised, "  \n ") is None
    assert one(spark, text.paragraphs, "a  b\n\n\n c ") == "a b\n\nc"
    assert one(spark, text.nfkc, "ﬁ①") == "fi1"


def test_privacy(spark):
    assert one(spark, privacy.redact, "mail a.b@x.com or 9876543210") == "mail [EMAIL_REDACTED] or [PHONE_REDACTED]"
    assert one(spark, privacy.mask_phone, "+91 98765 43210") == "+91 91******10"
    assert [one(spark, privacy.mask, t) for t in ("abcdef", "abc", "", None)] == ["ab**ef", "***", "[NOT PROVIDED]", "[NOT PROVIDED]"]
    assert one(spark, lambda c: privacy.hash_identifier(c, "salt"), " ") is None
    assert one(spark, lambda c: privacy.hash_identifier(c, "salt"), "080-123 45") == hmac.new(b"salt", b"08012345", hashlib.sha256).hexdigest()
    want = hmac.new(b"salt", b"9876543210", hashlib.sha256).hexdigest()
    assert one(spark, lambda c: privacy.hash_identifier(c, "salt"), "+91 98765-43210") == want
    assert one(spark, lambda c: privacy.hash_identifier(c, "salt"), None) is None


def test_urls_places_validation(spark):
    assert one(spark, parsing.listing_id_of_url, "https://x.example/item/iid-123456") == "123456"
    assert one(spark, parsing.file_id_of_url, "https://x.example/files/ab12/image;s=1") == "ab12"
    city, state = parsing.city_and_state(F.col("x"))
    rows = spark.createDataFrame([("a, b, c",), ("b, c",), ("b",), (" , ",), (None,)], "x string").select(city, state).collect()
    assert [tuple(r) for r in rows] == [("b", "c"), ("b", "c"), ("b", None), (None, None), (None, None)]
    errors = spark.createDataFrame([(" ", None, "-5"), ("t", "s", "5")], "t string, s string, p string").select(parsing.record_errors(F.col("t"), F.col("s"), F.col("p"))).collect()
    assert len(errors[0][0]) == 3 and errors[1][0] == []
