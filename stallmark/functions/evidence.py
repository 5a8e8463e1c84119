"""Bands, tiers and rule sets over scores and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of bands and tiers.
OCR_HIGH, OCR_MEDIUM = 70, 40
AI_TIER, REAL_TIER, STABLE = 0.70, 0.30, 0.15

#: Patterns of complaint posts.
COMPLAINT_PATTERNS = {
    "advance_payment": r"\b(?:advance|token|deposit)\b", "wrong_item": r"\b(?:brick|instead of|different)\b", "no_reply": r"\b(?:silent|no reply|blocked|not responding)\b",
    "reused_photos": r"\b(?:same photos|stolen photos|photos were in)\b", "invoice_dispute": r"\b(?:invoice|bill)\b",
}
MONEY = r"\b(\d{3,7})\b"


def ocr_band(confidence: Column, chars: Column) -> Column:
    return F.when(F.coalesce(chars, F.lit(0)) == 0, "none").when(confidence >= OCR_HIGH, "high").when(confidence >= OCR_MEDIUM, "medium").otherwise("low")


def image_type(aspect: Column, chars: Column, density: Column) -> Column:
    """Struct ``kind``, ``confidence`` by the first rule that holds."""
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when((aspect <= 0.60) & (chars >= 8), kind("SCREENSHOT", 0.85)).when((chars >= 50) | (density >= 3), kind("TEXT_HEAVY", 0.80))
        .when(aspect.between(0.65, 0.85) & (chars >= 30), kind("DOCUMENT_LIKE", 0.75)).when(chars <= 5, kind("PHOTO", 0.90)).otherwise(kind("PHOTO", 0.70))
    )


def divergence(semantic: Column, perceptual: Column) -> tuple[Column, Column]:
    """Score and status of how far two similarities of an image to its nearest neighbour lie apart."""
    gap = F.abs(semantic - perceptual)
    status = F.when((semantic >= 0.85) & (perceptual >= 0.80), "REAL_IMAGE_CANDIDATE").when(gap > 0.35, "BORDERLINE").otherwise("NO_CONCLUSIVE_SIGNAL")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap)), 4), status


def forensic_agreement(a: Column, b: Column) -> Column:
    return F.when(a == b, "AGREE").when((a == "NO_CONCLUSIVE_SIGNAL") | (b == "NO_CONCLUSIVE_SIGNAL"), "ONE_INCONCLUSIVE").otherwise("DISAGREE")


def forensic_status(provenance: Column, a: Column, b: Column) -> Column:
    real = "REAL_IMAGE_CANDIDATE"
    return F.when(provenance, "PROVENANCE_INDICATED").when((a == real) & (b == real), real).when((a == "BORDERLINE") | (b == "BORDERLINE"), "BORDERLINE").otherwise("NO_CONCLUSIVE_SIGNAL")


#: Results of a detector and of two of them.
AI, REAL = "AI_GENERATION_CANDIDATE", "REAL_IMAGE_CANDIDATE"


def tier(score: Column) -> Column:
    return F.when(score.isNull(), "UNREADABLE").when(score >= AI_TIER, AI).when(score <= REAL_TIER, REAL).otherwise("BORDERLINE")


def agreement(a: Column, b: Column) -> Column:
    """How two tiers agree: both the same finding, contrary findings, one of them borderline, else nothing conclusive."""
    return (
        F.when((a == AI) & (b == AI), "AGREEMENT_AI").when((a == REAL) & (b == REAL), "AGREEMENT_REAL")
        .when(a.isin(AI, REAL) & b.isin(AI, REAL), "DETECTOR_DISAGREEMENT")
        .when((a == "BORDERLINE") | (b == "BORDERLINE"), "BORDERLINE").otherwise("NO_CONCLUSIVE_SIGNAL")
    )


def escalated(agreed: Column) -> Column:
    """Whether a second look is asked for: disagreement or a borderline score."""
    return agreed.isin("DETECTOR_DISAGREEMENT", "BORDERLINE")


def robustness(*changes: Column) -> Column:
    return F.when(F.greatest(*[F.abs(c) for c in changes]) < STABLE, "STABLE").otherwise("SENSITIVE")


def complaint_patterns(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in COMPLAINT_PATTERNS.items()]))


def largest_amount(text: Column) -> Column:
    """Largest number of three to seven digits in a text, null if there is none."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(1)), lambda x: x.cast("bigint")))
