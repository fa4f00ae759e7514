"""Extraction scores, control totals and the escalation of risk signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["date", "amount", "type"]

# Signals that come with an accumulating address by itself.
ACCUMULATOR_SIGNALS = (
    "pattern_fan_in", "pattern_honeypot", "pattern_automated_cadence",
    "pattern_consolidate_disperse", "pattern_whale_alert",
    "many_counterparties", "large_graph", "high_tx_volume",
    "regular_cadence", "high_regularity", "high_burst",
    "counterparty_exchange", "counterparty_attributed",
    "known_exchange", "heuristic_exchange",
)


def _ratio(above: Column, below: Column) -> Column:
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def _rates() -> list[Column]:
    recall, precision = _ratio(F.col("hits"), F.col("expected")), _ratio(F.col("hits"), F.col("found"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [
        (F.col("expected") - F.col("hits")).alias("missed"),
        (F.col("found") - F.col("hits")).alias("spurious"),
        F.round(recall, 3).alias("recall"),
        F.round(precision, 3).alias("precision"),
        F.round(f1, 3).alias("f1"),
    ]


def extraction_scores(extracted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Scores per ``by``: rows match as multisets of date, amount and type."""
    count = lambda df, name: df.groupBy(*by, *KEY).agg(F.count(F.lit(1)).alias(name))
    both = count(extracted, "f").join(count(truth, "e"), [*by, *KEY], "full_outer").na.fill(0, ["f", "e"])
    sums = both.groupBy(*by).agg(
        F.sum("e").alias("expected"), F.sum("f").alias("found"), F.sum(F.least("e", "f")).alias("hits")
    )
    return sums.select(*by, "expected", "found", "hits", *_rates())


def leaderboard(scores: DataFrame) -> DataFrame:
    """Tools over all files, best first by F1, then by time; ``scores`` has ``tool, seconds`` and the
    three counts of each file."""
    sums = scores.groupBy("tool").agg(
        *[F.sum(c).alias(c) for c in ("expected", "found", "hits")], F.round(F.sum("seconds"), 2).alias("time_s")
    )
    return sums.select("tool", "expected", "found", "hits", *_rates(), "time_s").orderBy(F.desc("f1"), "time_s")


def control_totals(rows: DataFrame, declared: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Counts, sums and net change of each file against ``declared`` ones; files without declared
    totals are told as such, and declared files without rows count as empty."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount"))), F.lit(0)).cast("decimal(28,2)")
    found = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), total("Dr").alias("dr"), total("Cr").alias("cr")
    )
    near = lambda a, b: F.abs(a - b) < tolerance
    none = F.lit(0).cast("decimal(28,2)")
    told = found.join(declared, "file", "full_outer").withColumns(
        {"rows": F.coalesce("rows", F.lit(0)), "dr": F.coalesce("dr", none), "cr": F.coalesce("cr", none)}
    )
    return told.select(
        "file",
        "rows",
        "dr",
        "cr",
        (F.col("rows") == F.col("count")).alias("count_ok"),
        near(F.col("dr"), F.col("debits")).alias("debits_ok"),
        near(F.col("cr"), F.col("credits")).alias("credits_ok"),
        near(F.col("cr") - F.col("dr"), F.col("net_change")).alias("net_ok"),
        F.when(F.col("count").isNull(), "no-truth").otherwise("checked").alias("status"),
    )


def escalation(families: DataFrame) -> DataFrame:
    """What to do about each address.

    ``families`` is ``(address, family, triggered, signals, velocity_profile)``; ``triggered`` is
    null where a family was not tested. Signals that an accumulating address has anyway do not
    escalate it, unless the triggered families name none at all.
    """
    hit = F.coalesce(F.col("triggered"), F.lit(False))
    inherent = F.array(*map(F.lit, ACCUMULATOR_SIGNALS))
    signals = F.coalesce("signals", F.array().cast("array<string>"))
    rows = families.groupBy("address").agg(
        F.count_if(hit).alias("triggered"),
        F.count_if(F.col("triggered").isNotNull()).alias("tested"),
        F.count_if(F.col("triggered").isNull()).alias("not_available"),
        # Only signals that the gate does not know are gathered, as one boolean.
        F.bool_and(~hit | (F.size(F.array_except(signals, inherent)) == 0)).alias("_inherent"),
        F.bool_or(hit & (F.size(signals) > 0)).alias("_told"),
        F.bool_or(F.col("velocity_profile") == "Accumulator").alias("_accumulator"),
    )
    n = F.col("triggered")
    gate = F.coalesce(F.col("_accumulator"), F.lit(False)) & F.col("_inherent") & F.col("_told")
    decided = (
        F.when((n >= 3) & gate, "INVESTIGATE")
        .when(n >= 3, "ESCALATE")
        .when(n == 2, "INVESTIGATE")
        .when(n == 1, "MONITOR")
        .when(F.col("not_available") >= 3, "INSUFFICIENT_DATA")
        .otherwise("DEPRIORITIZE")
    )
    return rows.select("address", "triggered", "tested", "not_available", decided.alias("escalation"))


def temporal_anomaly(regularity: Column, burst: Column, cadence: Column) -> Column:
    """Signals of the rhythm of an address."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(cadence, F.lit(False)), "regular_cadence"),
            F.when(regularity < 0.4, "high_regularity"),
            F.when(burst > 3, "high_burst"),
        )
    )
