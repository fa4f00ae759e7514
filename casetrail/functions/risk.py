"""Severity and boost arithmetic shared by pattern reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_bucket(boost: Column) -> Column:
    # Lower bounds of the severity classes.
    return (
        F.when(boost >= 0.35, F.lit("critical"))
        .when(boost >= 0.20, F.lit("high"))
        .when(boost >= 0.10, F.lit("medium"))
        .when(boost > 0, F.lit("low"))
        .otherwise("info")
    )


def total_boost(boost: Column, max_boost: float = 0.4) -> Column:
    """Aggregate: sum of the boosts of a group, clamped to ``[0, max_boost]``."""
    total = F.coalesce(F.sum(F.coalesce(boost, F.lit(0.0))), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(max_boost))
