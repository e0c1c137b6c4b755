"""Scalar expressions: sentinels, coercions, dates, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without(value: Column, *sentinels) -> Column:
    """null in place of a sentinel such as -999, an empty string or a marker text."""
    for s in sentinels:
        value = F.nullif(value, F.lit(s))
    return value


def number(text: Column) -> Column:
    """The number a text holds; null where it holds none."""
    return text.try_cast("double")


def compact_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyyMMdd")


def date_year(text: Column) -> Column:
    """The year of an ISO date text; null for an unknown date (0000-00-00)."""
    return F.substring_index(without(text, "0000-00-00"), "-", 1).try_cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weighted_blend(parts: list[tuple[Column, float]]) -> Column:
    """Sum of parts with weights scaled to 1."""
    scale = sum(w for _, w in parts)
    if scale <= 0:
        raise ValueError("weights must have a positive sum")
    out = F.lit(0.0)
    for column, w in parts:
        out = out + column * (w / scale)
    return out


def parse_weights(texts: list[str]) -> dict[str, float]:
    """``id:weight`` texts; a repeated id's weights add up, a malformed text raises."""
    out: dict[str, float] = {}
    for t in texts:
        name, colon, weight = t.rpartition(":")
        if not colon or not name:
            raise ValueError(f"expected id:weight, got {t!r}")
        out[name] = out.get(name, 0.0) + float(weight)
    return out


def round_scaled(x: Column, digits: int) -> Column:
    """A double rounded as databases and C do: times a power of ten, to the nearest integer, halves away from zero, and divided.

    A small negative number becomes -0.0, where Spark's ``round``, which goes by the number's decimal text, gives 0.0.
    From 2 ** 52 on a product has no fraction, so the number stays.
    """
    power = F.lit(float(10**digits))
    scaled = F.abs(x) * power
    # exact: a double below 2 ** 52 less its floor
    whole = F.floor(scaled).cast("double")
    rounded = F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / power
    return F.when(scaled < float(1 << 52), rounded).otherwise(x)
