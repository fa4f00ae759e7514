"""Range-maximum over amount bands without enumerating pairs.

A probe ``[lo, hi]`` asks for the largest ``value`` among the targets that share its keys and
whose amount ``x`` falls inside the band. Amounts are cut into cells, logarithmic ones that are
narrower than any band, so a band crosses a cell border or holds its cell whole. Inside a single cell
the question is therefore one-sided (``x >= lo`` or ``x <= hi``) and a running maximum answers it.
Work and memory grow linearly with the distinct amounts, also for a hot account.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tolerance_ratio(tolerance: float | str) -> Fraction:
    """``0.05`` as the exact fraction 1/20; 0 asks for equal amounts."""
    ratio = Fraction(str(tolerance))
    if not 0 <= ratio < 1:
        raise ValueError("tolerance must lie between 0 and 1, which is excluded")
    return ratio


def minor_units(amount: Column) -> Column:
    """A DECIMAL(18,2) amount in integer hundredths."""
    return (amount * F.lit(100)).cast("bigint")


def band_around_credit(x: str, tolerance: float | str) -> tuple[Column, Column]:
    """Bounds of the debits within ``tolerance`` of the credit ``x`` (relative to the credit)."""
    t = tolerance_ratio(tolerance)
    p, q = t.numerator, t.denominator
    return (
        F.expr(f"({x} * {q - p}L + {q - 1}L) div {q}L"),
        F.expr(f"({x} * {q + p}L) div {q}L"),
    )


def band_around_debit(x: str, tolerance: float | str) -> tuple[Column, Column]:
    """Bounds of the credits from which the debit ``x`` is within ``tolerance``."""
    t = tolerance_ratio(tolerance)
    p, q = t.numerator, t.denominator
    return (
        F.expr(f"({x} * {q}L + {q + p - 1}L) div {q + p}L"),
        F.expr(f"({x} * {q}L) div {q - p}L"),
    )


def _cells(tolerance: float | str) -> Callable[[Column], Column]:
    """Cell of an amount, growing with it; a band that lies in one cell holds all of it.

    Small amounts, whose bands are changed much by rounding, are cells of their own; above them a cell is
    three quarters as wide as a band, which so lies in two or three.
    """
    ratio = tolerance_ratio(tolerance)
    if not ratio:
        return lambda amount: amount
    t = float(ratio)
    width = math.log((1 + t) / (1 - t)) * 3 / 4
    # From 4 / t on rounding takes less than a quarter off a band; twice that is safe.
    single = math.ceil(8 / t / (1 - t))
    above = lambda amount: F.floor(F.log(amount.cast("double") / F.lit(float(single))) / F.lit(width))
    return lambda amount: F.when(amount < single, amount).otherwise(F.lit(single).cast("bigint") + above(amount))


def band_max(
    probes: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    tolerance: float | str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Best target value per distinct probe.

    ``probes`` holds ``keys``, ``carry``, ``lo`` and ``hi`` (bigint, >= 0); ``targets`` holds
    ``keys``, ``x`` and ``value`` (bigint). Probes without a target are left out.
    """
    cell = _cells(tolerance)
    keys, carry = list(keys), list(carry)
    # Each side is a line of its own, so that one order serves both: the first cell of a band asks downwards.
    line = lambda below, pos: F.struct(F.lit(below).alias("_below"), (-pos if below else pos).alias("_pos"))
    distinct_targets = (
        targets.groupBy(*keys, "x")
        .agg(F.max("value").alias("value"))
        .select(*keys, cell(F.col("x")).alias("_cell"), F.inline(F.array(line(False, F.col("x")), line(True, F.col("x")))), "value")
    )
    first, last = cell(F.col("lo")), cell(F.col("hi"))
    # Equal probes meet in the last grouping.
    spread_probes = (
        probes.filter("lo <= hi")
        .select(*keys, *carry, "lo", "hi", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_cell"))
        .withColumn("_below", F.col("_cell") == F.col("_first"))
        .withColumn("_pos", F.when(F.col("_below"), -F.col("lo")).otherwise(F.col("hi")))
        .withColumn("_probe", F.lit(True))
        .drop("_first")
    )
    both = spread_probes.unionByName(
        distinct_targets.withColumn("_probe", F.lit(False)), allowMissingColumns=True
    )
    upto = (
        Window.partitionBy(*keys, "_cell", "_below")
        .orderBy("_pos", "_probe")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("_best", F.max("value").over(upto))
        .filter("_probe AND _best IS NOT NULL")
        .groupBy(*keys, *carry, "lo", "hi")
        .agg(F.max("_best").alias("best"))
    )
