"""What one or two readers of the same cell amount to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the decision rule.
MAX_SPLIT = 0.35
AGREED_CONFIDENCE = 0.99
SPLIT_CONFIDENCE = 0.17
TALLY_CAP = 0.97
DIGITS_CAP = 0.86
PREFILL_GATE = 0.2
REVIEW_THRESHOLD = 0.9

# Fixed values of the tally trust table.
EXPLAINED_BAR = 0.95
TRUST_LEFT_OVER = 0.6
TRUST_ONE = 0.95
TRUST_FEW = 0.8
TRUST_MANY = 0.75


def reconcile(
    tally: Column,
    tally_conf: Column,
    digits: Column,
    digit_conf: Column,
    *,
    max_split: float = MAX_SPLIT,
    agreed_confidence: float = AGREED_CONFIDENCE,
    split_confidence: float = SPLIT_CONFIDENCE,
    tally_cap: float = TALLY_CAP,
    digits_alone: bool = True,
    digits_cap: float = DIGITS_CAP,
) -> Column:
    """`struct(value, confidence, source)`; null where neither reader may answer."""

    def reading(value: Column, conf: Column, source: str) -> Column:
        return F.struct(
            value.cast("bigint").alias("value"),
            conf.cast("double").alias("confidence"),
            F.lit(source).alias("source"),
        )

    both = tally.isNotNull() & digits.isNotNull()
    near = F.abs(tally - digits) <= F.greatest(tally, digits) * F.lit(max_split)
    out = (
        F.when(both & (tally == digits), reading(tally, F.lit(agreed_confidence), "agreed"))
        .when(both & near, reading(F.ceil((tally + digits) / 2), F.lit(split_confidence), "split"))
        .when(
            tally.isNotNull() & digits.isNull(),
            reading(tally, F.least(tally_conf, F.lit(tally_cap)), "tally"),
        )
    )
    if digits_alone:
        out = out.when(
            digits.isNotNull() & tally.isNull(),
            reading(digits, F.least(digit_conf, F.lit(digits_cap)), "digits"),
        )
    return out


def prefill_tag(source: Column) -> Column:
    """What the reviewer is told beside a pre-filled value."""
    return (
        F.when(source == "digits", "read: check it")
        .when(source == "agreed", "counted twice: check it")
        .otherwise("counted: check it")
    )


def tally_confidence(count: Column, explained: Column) -> Column:
    """Trust in a tally by the shape of its answer."""
    return (
        F.when(explained < EXPLAINED_BAR, TRUST_LEFT_OVER)
        .when(count == 1, TRUST_ONE)
        .when(count <= 4, TRUST_FEW)
        .otherwise(TRUST_MANY)
    )


def tally_shape(count: Column, explained: Column) -> Column:
    """Bucket name used when accuracy is split by the shape of the answer."""
    size = (
        F.when(count <= 4, F.concat(F.lit("count "), count.cast("string")))
        .when(count <= 9, "count 5-9")
        .otherwise("count 10+")
    )
    rest = F.when(explained >= EXPLAINED_BAR, "fully explained").otherwise("some ink over")
    return F.concat(size, F.lit(", "), rest)


def needs_review(source: Column, confidence: Column, threshold: float = REVIEW_THRESHOLD) -> Column:
    """Nobody has touched the value and its confidence is low."""
    return ~source.isin("accepted", "corrected", "manual") & (confidence < threshold)
