"""Exact money: integer nanodollars, rates in thousandths of a dollar per million tokens (FN-1..6, PRC-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_CENT = 10_000_000
MAX_RATE = 1_000_000_000


def checked_product(tokens: Column, rate: Column) -> Column:
    """tokens * rate in nanodollars; null where tokens are negative, the rate is null or the product overflows (FN-1)."""
    return F.when(tokens >= 0, F.try_multiply(tokens.cast("long"), rate.cast("long")))


def cents(nanos: Column) -> Column:
    """Rounded to cents, half away from zero, in integers (FN-2)."""
    half = F.when(nanos < 0, -NANOS_PER_CENT // 2).otherwise(NANOS_PER_CENT // 2).cast("long")
    moved = nanos + half
    # `div` truncates towards zero, which is what rounding half away from zero needs after the shift
    return div(moved, F.lit(NANOS_PER_CENT))


def div(a: Column, b: Column) -> Column:
    """Integer division, truncated towards zero; null for a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, half up; 0 of nothing (FN-3)."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole * 1000) / 10)


def usd(nanos: Column) -> Column:
    """'1234.56', '-0.05' from integer cents (FN-4)."""
    c = cents(nanos)
    a = F.abs(c)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def thousands(n: Column) -> Column:
    """'1,234,567' (FN-4)."""
    return F.format_number(n.cast("decimal(38,0)"), 0)


def milli_rate(text: Column) -> Column:
    """A decimal text with at most three places, without sign or exponent, as thousandths; else null (FN-5)."""
    good = text.rlike(r"^[0-9]+(\.[0-9]{1,3})?$")
    value = F.when(good, text.cast("decimal(20,3)") * 1000)
    return value.cast("long")


def weighted_rate(cost: Column, tokens: Column) -> Column:
    """Average thousandths a million tokens over what is priced (FN-6)."""
    return div(cost, tokens)
