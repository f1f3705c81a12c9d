"""Rounding and clamping that other engines reproduce bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Half up by floor, so that ties fall alike in every engine."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp01(x: Column) -> Column:
    """``x`` limited to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
