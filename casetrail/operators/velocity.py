"""Velocity metrics of every address at once.

Transfers are ``(address, outgoing, value, ts, token, input_count)``: one row for each address that
a transfer touches. Values are decimals, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that come first as the primary one, in order.
PREFERRED = ("USDT", "USDC", "DAI", "BUSD")


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("value"))), F.lit(0)).cast("decimal(28,4)")


def _ratio(above: str, below: str) -> Column:
    share = F.col(above).cast("double") / F.nullif(F.col(below).cast("double"), F.lit(0.0))
    return F.coalesce(F.round(share, 4), F.lit(0.0))


def classified(transfers: DataFrame, addresses: DataFrame) -> DataFrame:
    """``(address, outgoing, ...)`` of transfers ``(from_address, to_address, ...)`` for the wanted
    addresses: outgoing if the sender is the address, else incoming."""
    rest = [c for c in transfers.columns if c not in ("from_address", "to_address")]
    sides = F.array_distinct(F.array("from_address", "to_address"))
    each = transfers.withColumn("address", F.explode(sides))
    kept = each.join(addresses.select("address").distinct(), "address", "left_semi")
    outgoing = F.coalesce(F.col("from_address") == F.col("address"), F.lit(False))
    return kept.select("address", outgoing.alias("outgoing"), *rest)


def token_breakdown(transfers: DataFrame) -> DataFrame:
    """Per address and token: inflow, outflow and the share that went through."""
    token = F.coalesce(F.nullif(F.col("token"), F.lit("")), F.lit("native"))
    sums = transfers.groupBy("address", token.alias("token")).agg(
        _sum(~F.col("outgoing")).alias("inflow"), _sum(F.col("outgoing")).alias("outflow")
    )
    return sums.withColumn("fund_through_rate", _ratio("outflow", "inflow"))


def primary_token(breakdown: DataFrame, preferred: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Per address the first preferred token with any volume, else the one with the most (ties by
    name), and the rate of it; without inflow of it, the rate over all tokens."""
    volume = F.col("inflow") + F.col("outflow")
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("token"))
    rank = F.when((place > 0) & (volume > 0), place).otherwise(len(preferred) + 1)
    best = F.min_by(F.struct("token", "inflow", "fund_through_rate"), F.struct(rank, -volume, "token"))
    rows = breakdown.groupBy("address").agg(
        best.alias("b"), F.sum("inflow").alias("all_in"), F.sum("outflow").alias("all_out")
    )
    rate = F.when(F.col("b.inflow") > 0, F.col("b.fund_through_rate")).otherwise(_ratio("all_out", "all_in"))
    return rows.select("address", F.col("b.token").alias("primary_token"), rate.alias("fund_through_rate"))


def dwell_hours(transfers: DataFrame) -> DataFrame:
    """Per address the median hours from each receipt to the next strictly later send.

    The next send is looked for within the day; the first send of a later day comes from a table
    with one row per address and day, so no window spans all rows of an address.
    """
    rows = transfers.filter("ts IS NOT NULL").select(
        "address", "outgoing", F.unix_micros("ts").alias("at"), F.to_date("ts").alias("day")
    )
    sent = F.when(F.col("outgoing"), F.col("at"))
    later = Window.partitionBy("address", "day").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    days = rows.groupBy("address", "day").agg(F.min(sent).alias("first_sent"))
    after = Window.partitionBy("address").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select("address", "day", F.first("first_sent", ignorenulls=True).over(after).alias("next_day"))
    gaps = rows.withColumn("same_day", F.min(sent).over(later)).join(days, ["address", "day"])
    hours = (F.coalesce("same_day", "next_day") - F.col("at")) / F.lit(3_600_000_000)
    return (
        gaps.filter(~F.col("outgoing"))
        .groupBy("address")
        .agg(F.round(F.median(hours), 2).alias("dwell_time_hours"))
    )


def daily_breakdown(transfers: DataFrame) -> DataFrame:
    """Per address and active day: transfers, inflow, outflow."""
    return (
        transfers.filter("ts IS NOT NULL")
        .groupBy("address", F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            _sum(~F.col("outgoing")).alias("inflow"),
            _sum(F.col("outgoing")).alias("outflow"),
        )
    )


def regularity(daily: DataFrame) -> DataFrame:
    """Over active days: coefficient of variation and peak of the daily counts; null below two."""
    mean, many = F.avg("tx_count"), F.count(F.lit(1)) >= 2
    return daily.groupBy("address").agg(
        F.when(many, F.round(F.stddev_pop("tx_count") / mean, 4)).alias("regularity_score"),
        F.when(many, F.round(F.max("tx_count") / mean, 2)).alias("burst_score"),
        F.datediff(F.max("day"), F.min("day")).alias("day_span"),
    )


def profile(rate: Column, dwell: Column, count: Column, span_days: Column) -> Column:
    """Name of the behaviour. A dwell of null is unknown."""
    return (
        F.when(count == 0, "Dormant")
        .when((span_days > 90) & (count < 5), "Dormant")
        .when((rate >= 0.90) & (dwell < 24), "Relay")
        .when(rate <= 0.20, "Accumulator")
        .when(rate >= 1.5, "Distributor")
        .otherwise("Mixed")
    )


def risk_score(
    rate: Column, consolidation: Column, amplification: Column, dwell: Column, regular: Column, burst: Column
) -> Column:
    """Weighted mean of the components that are known, at most 0.95."""
    through = F.when(rate <= 2.0, 1.0 - F.abs(rate - 1.0)).otherwise(F.least(0.5 + (rate - 2.0) / 20.0, F.lit(0.95)))
    even = (
        F.when(regular == 0, 0.3).when(regular < 0.3, 0.8).when(regular < 0.6, 0.5).when(regular.isNotNull(), 0.1)
    )
    held = F.when(dwell < 2, 0.9).when(dwell < 24, 0.5).when(dwell.isNotNull(), 0.1)
    parts = [
        (through, 0.25),
        (F.least(consolidation * 2, F.lit(1.0)), 0.10),
        (F.least(amplification / 100.0, F.lit(1.0)), 0.10),
        (even, 0.15),
        (F.least(burst / 10.0, F.lit(1.0)), 0.15),
        (held, 0.25),
    ]
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    score = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0)) / total
    return F.round(F.least(score, F.lit(0.95)), 3)


def analyze(transfers: DataFrame, addresses: DataFrame) -> DataFrame:
    """All metrics, one row for each of ``addresses``; without transfers it is dormant."""
    positive = F.when(F.col("value") > 0, F.col("value").cast("double"))
    amplified = F.when(F.count(positive) >= 2, F.round(F.max(positive) / F.median(positive), 2)).otherwise(0.0)
    merged = F.count_if(F.coalesce("input_count", F.lit(1)) >= 5) / F.count(F.lit(1))
    base = transfers.groupBy("address").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.round(merged, 4).alias("consolidation_ratio"),
        amplified.alias("value_amplification"),
        F.min("ts").alias("period_start"),
        F.max("ts").alias("period_end"),
        F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(86_400_000_000)).alias("span_days"),
    )
    rows = addresses.select("address").distinct()
    for part in (
        base,
        primary_token(token_breakdown(transfers)),
        dwell_hours(transfers),
        regularity(daily_breakdown(transfers)).drop("day_span"),
    ):
        rows = rows.join(part, "address", "left")
    filled = rows.na.fill(0, ["transaction_count"]).na.fill(
        0.0, ["consolidation_ratio", "value_amplification", "fund_through_rate"]
    )
    empty = F.col("transaction_count") == 0
    score = risk_score(
        *map(F.col, ("fund_through_rate", "consolidation_ratio", "value_amplification", "dwell_time_hours", "regularity_score", "burst_score"))
    )
    return filled.withColumns(
        {
            "velocity_profile": profile(F.col("fund_through_rate"), F.col("dwell_time_hours"), F.col("transaction_count"), F.col("span_days")),
            "velocity_risk_score": F.when(empty, F.lit(0.0)).otherwise(score),
        }
    )
