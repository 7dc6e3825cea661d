"""Rounding as the measured values were rounded: halves go up."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rec. 601 grey level, truncated."""
    return F.floor((r * 299 + g * 587 + b * 114) / F.lit(1000)).cast("bigint")
