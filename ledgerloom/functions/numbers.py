"""Numbers from text, and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """A double from the digits, points and minus signs of a text; null if they make no number."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def parse_decimal(c: Column, default: str = "0") -> Column:
    """An exact decimal; null or empty gives the default, other bad text null."""
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(default).cast("decimal(38,10)")).otherwise(c.cast("string").try_cast("decimal(38,10)"))


def cents(c: Column) -> Column:
    """Two places, half to even."""
    return F.bround(c, 2).cast("decimal(20,2)")


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """Within an absolute tolerance or one in 10^9, whichever allows more."""
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def snap(c: Column, tolerance: float) -> Column:
    """The nearest multiple of the tolerance (half to even) as text of six places; null is empty."""
    value = F.rint(c / tolerance) * tolerance if tolerance > 0 else c
    return F.when(c.isNull(), "").otherwise(F.format_string("%.6f", value))
