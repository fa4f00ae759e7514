"""Burst and gap membership on account timelines.

Date-valued timelines are first reduced to one row per account and day, so a window never
holds more rows than the calendar has days, however many transactions the account has.
Timestamp timelines are cut into chunks with a halo, so one account spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def _daily(rows: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return (
        rows.filter(F.col(day).isNotNull())
        .groupBy(*keys, day)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_d", F.unix_date(day))
    )


def burst_days(
    rows: DataFrame, keys: Sequence[str], day: str, reach_days: int, min_count: int
) -> DataFrame:
    """Distinct (keys, day) covered by some anchor's window of ``min_count`` rows or more."""
    line = Window.partitionBy(*keys).orderBy("_d")
    return (
        _daily(rows, keys, day)
        .withColumn("_fwd", F.sum("_n").over(line.rangeBetween(0, reach_days)))
        .withColumn("_best", F.max("_fwd").over(line.rangeBetween(-reach_days, 0)))
        .filter(F.col("_best") >= min_count)
        .select(*keys, day)
    )


def burst_days_after_gap(
    rows: DataFrame,
    keys: Sequence[str],
    day: str,
    gap_days: int,
    reach_days: int,
    min_count: int,
) -> DataFrame:
    """Distinct (keys, day) inside a burst that starts right after a gap of ``gap_days`` or more."""
    line = Window.partitionBy(*keys).orderBy("_d")
    opens = (F.col("_d") - F.lag("_d").over(line)) >= gap_days
    return (
        _daily(rows, keys, day)
        .withColumn("_opens", opens)
        .withColumn("_fwd", F.sum("_n").over(line.rangeBetween(0, reach_days)))
        .withColumn("_start", (F.col("_opens") & (F.col("_fwd") >= min_count)).cast("int"))
        .withColumn("_in", F.max("_start").over(line.rangeBetween(-reach_days, 0)))
        .filter("_in = 1")
        .select(*keys, day)
    )


def burst_ids_by_time(
    rows: DataFrame, keys: Sequence[str], ts: str, id_col: str, reach_hours: int, min_count: int
) -> DataFrame:
    """Ids of rows inside a burst on a timestamp timeline (window bounds inclusive)."""
    reach = reach_hours * MICROS_PER_HOUR
    chunk = 2 * reach
    ticks = (
        rows.filter(F.col(ts).isNotNull())
        .select(*keys, id_col, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
        .withColumn("_home", F.expr(f"_t div {chunk}L"))
        .withColumn(
            "_chunk",
            F.explode(
                F.sequence(F.expr(f"(_t - {reach}L) div {chunk}L"), F.expr(f"(_t + {reach}L) div {chunk}L"))
            ),
        )
    )
    line = Window.partitionBy(*keys, "_chunk").orderBy("_t", id_col)
    sofar = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.lead("_t", min_count - 1).over(line) if min_count > 1 else F.col("_t")
    return (
        ticks.withColumn("_nth", nth)
        .withColumn("_hot", F.when(F.col("_nth") <= F.col("_t") + F.lit(reach), F.col("_t")))
        .withColumn("_last_hot", F.max("_hot").over(sofar))
        .filter((F.col("_chunk") == F.col("_home")) & (F.col("_t") - F.col("_last_hot") <= reach))
        .select(id_col)
    )
