"""Exact arithmetic on money amounts held as DOUBLE.

Amounts are whole cents. Summing them as DOUBLE makes the last bits depend on
the order rows arrive in; summing integer cents (LONG) is exact and fast (plain
long adds inside whole-stage codegen, overflow checked in ANSI mode). For
amounts with at most two decimals the result is the DOUBLE next to the exact
sum, which is the sum itself to the cent below 2**53 cents (9e13); keep the
LONG (``cents_sum``) for totals beyond. Amounts with more decimals are first
rounded to the nearest cent, halves away from zero, like a cast to
DECIMAL(p, 2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    """Nearest whole number of cents, as LONG."""
    return F.round(amount * F.lit(100.0)).cast("long")


def cents_to_amount(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def cents_sum(amount: Column | str) -> Column:
    """Sum of amounts in whole cents, as LONG."""
    return F.sum(to_cents(F.col(amount) if isinstance(amount, str) else amount))


def exact_sum(amount: Column | str) -> Column:
    """Sum of cent amounts, exact, returned as DOUBLE."""
    return cents_to_amount(cents_sum(amount))
