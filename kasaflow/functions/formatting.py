"""Text formatting of amounts (report columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_text(c: Column) -> Column:
    """Grouped thousands, two decimals: 1234567.891 -> '1,234,567.89'; NULL stays NULL."""
    return F.format_number(F.round(c, 2), 2)


def whole_text(c: Column) -> Column:
    """Grouped thousands, no decimals, after a cast to 32-bit float.

    Kept for parity: above 2^24 the float cast drops units
    (16,777,217 -> '16,777,216'); NULL becomes '' (format_string never
    returns NULL).
    """
    return F.format_string("%,.0f", c.cast("float"))
