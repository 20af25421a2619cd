"""Scalar helpers on columns and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """A text as double; 0.0 where it is empty or no number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole(c: Column | str) -> Column:
    """A text as bigint; 0 where it is empty or no number."""
    return F.floor(number(c)).cast("bigint")


def fixed(c: Column | str, digits: int = 4) -> Column:
    """Fixed digits, without group marks; what is no number stays as it is."""
    c = F.col(c) if isinstance(c, str) else c
    value = c.cast("string").try_cast("double")
    return F.when(value.isNull(), c.cast("string")).otherwise(F.format_string(f"%.{digits}f", value))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b, 0.0 unless b > 0."""
    return F.when(b > 0, F.lit(scale) * a / b).otherwise(0.0)


def percent_of(a: float, b: float) -> float:
    return 100.0 * a / b if b > 0 else 0.0


def stamp() -> Column:
    """Now, as in names of result files."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
