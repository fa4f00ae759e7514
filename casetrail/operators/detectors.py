"""The six pattern detectors and their merge onto the ledger.

Each detector maps a ledger to ``(id, flag)`` rows. The ledger needs ``id, seq, account_id,
txn_date, amount, direction`` and, for round trips, ``counterparty`` and ``raw_description``.
Every threshold is a parameter. Rows without a date take no part in date-based detectors.

``run_all`` runs all six in one plan: the ledger is read and saved once, one table of days serves the four
detectors that count, and each row meets what was found by joins on its own keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.text import strip
from casetrail.operators import bands, timeline
from casetrail.session import cut_lineage

# Flag names, in detector order.
PATTERN_FLAGS = (
    "STRUCTURING_SUSPECTED",
    "VELOCITY_SPIKE",
    "ROUND_AMOUNT_CLUSTER",
    "FUND_THROUGH_FLOW",
    "DORMANT_THEN_ACTIVE",
    "SAME_DAY_ROUND_TRIP",
)

Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the six detectors."""

    structuring_lower: float = 900_000
    structuring_upper: float = 1_000_000
    structuring_days: int = 30
    structuring_count: int = 3
    velocity_count: int = 10
    velocity_days: int = 1
    small_unit: int = 10_000
    big_unit: int = 50_000
    round_cluster: int = 5
    through_amount: float = 10_000
    through_days: int = 2
    through_tolerance: float = 0.05
    dormant_days: int = 60
    wake_count: int = 5
    wake_days: int = 7
    trip_amount: float = 5_000
    trip_tolerance: float = 0.05


def _flagged(ids: DataFrame, flag: str) -> DataFrame:
    return ids.select("id", F.lit(flag).alias("flag"))


def _is_round(amount: Column, small_unit: int, big_unit: int) -> Column:
    found = F.lit(False)
    for unit in (big_unit, small_unit):
        found = found | ((amount >= unit) & (amount % F.lit(unit) == 0))
    return found


def _party() -> Column:
    """The counterparty, else the start of the narration."""
    words = F.substring(strip(F.coalesce(F.col("raw_description"), F.lit(""))), 1, 20)
    return F.coalesce(F.nullif(F.col("counterparty"), F.lit("")), words)


def _rows_on(rows: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose (null-safe) keys occur in ``hits``, which has one row per key."""
    marked = hits.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    same = [rows[k].eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return rows.join(marked, condition, "left_semi")


def structuring(
    ledger: DataFrame,
    lower: float = 900_000,
    upper: float = 1_000_000,
    window_days: int = 30,
    min_count: int = 3,
) -> DataFrame:
    """Repeated amounts just under a reporting threshold."""
    rows = ledger.filter((F.col("amount") >= lower) & (F.col("amount") < upper)).select(
        "id", "account_id", "txn_date"
    )
    days = timeline.burst_days(rows, ["account_id"], "txn_date", window_days, min_count)
    return _flagged(_rows_on(rows, days, ["account_id", "txn_date"]), PATTERN_FLAGS[0])


def velocity_spike(ledger: DataFrame, min_count: int = 10, window_days: int = 1) -> DataFrame:
    """Many transactions within a day and the day after it (24 hours, inclusive, on dates)."""
    rows = ledger.select("id", "account_id", "txn_date")
    days = timeline.burst_days(rows, ["account_id"], "txn_date", window_days, min_count)
    return _flagged(_rows_on(rows, days, ["account_id", "txn_date"]), PATTERN_FLAGS[1])


def velocity_spike_by_time(
    ledger: DataFrame, ts: str = "txn_ts", min_count: int = 10, window_hours: int = 24
) -> DataFrame:
    """``velocity_spike`` for ledgers that carry a time of day."""
    ids = timeline.burst_ids_by_time(ledger, ["account_id"], ts, "id", window_hours, min_count)
    return _flagged(ids, PATTERN_FLAGS[1])


def round_amounts(
    ledger: DataFrame,
    small_unit: int = 10_000,
    big_unit: int = 50_000,
    min_cluster: int = 5,
) -> DataFrame:
    """Accounts that keep moving exact multiples of round units."""
    rows = ledger.filter(_is_round(F.col("amount"), small_unit, big_unit)).select("id", "account_id")
    clusters = (
        rows.groupBy("account_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_cluster)
    )
    return _flagged(_rows_on(rows, clusters, ["account_id"]), PATTERN_FLAGS[2])


def _match_back(rows: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = hits.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_later", "_same_day")
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(F.col(f"_h_{k}"))
    return rows.join(renamed, condition, "inner")


def fund_through(
    ledger: DataFrame,
    min_amount: float = 10_000,
    window_days: int = 2,
    tolerance: float = 0.05,
) -> DataFrame:
    """A credit followed, in ledger order, by a debit of similar size within a few days."""
    rows = ledger.filter(
        (F.col("amount") >= min_amount) & F.col("txn_date").isNotNull()
    ).select(
        "id", "seq", "account_id", "txn_date", "direction", bands.minor_units(F.col("amount")).alias("x")
    )
    credits, debits = rows.filter("direction = 'Cr'"), rows.filter("direction = 'Dr'")
    keys = ["account_id", "_day"]
    found = []
    for side, other, sign, bounds in (
        (credits, debits, 1, bands.band_around_credit("x", tolerance)),
        (debits, credits, -1, bands.band_around_debit("x", tolerance)),
    ):
        probes = (
            side.select("account_id", "txn_date", "x")
            .distinct()
            .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(window_days))))
            .withColumn("_day", F.expr(f"date_add(txn_date, {sign} * _k)"))
            .withColumn("lo", bounds[0])
            .withColumn("hi", bounds[1])
        )
        targets = other.select(
            "account_id", F.col("txn_date").alias("_day"), "x", (F.col("seq") * sign).alias("value")
        )
        best = bands.band_max(probes, targets, keys, tolerance, carry=["txn_date", "x", "_k"])
        per_amount = best.groupBy("account_id", "txn_date", "x").agg(
            F.max(F.col("_k") > 0).alias("_later"),
            F.max(F.when(F.col("_k") == 0, F.col("best"))).alias("_same_day"),
        )
        matched = _match_back(side, per_amount, ["account_id", "txn_date", "x"])
        in_order = F.coalesce(F.col("_same_day") > F.col("seq") * sign, F.lit(False))
        found.append(matched.filter(F.col("_later") | in_order).select("id"))
    return _flagged(found[0].unionByName(found[1]), PATTERN_FLAGS[3])


def dormant_active(
    ledger: DataFrame, dormant_days: int = 60, burst_count: int = 5, burst_days: int = 7
) -> DataFrame:
    """A quiet account that wakes up with a burst."""
    rows = ledger.select("id", "account_id", "txn_date")
    days = timeline.burst_days_after_gap(
        rows, ["account_id"], "txn_date", dormant_days, burst_days, burst_count
    )
    return _flagged(_rows_on(rows, days, ["account_id", "txn_date"]), PATTERN_FLAGS[4])


def round_trip(
    ledger: DataFrame, min_amount: float = 5_000, tolerance: float = 0.05
) -> DataFrame:
    """Credit and debit of similar size with one counterparty on one day."""
    keys = ["account_id", "txn_date", "_party"]
    rows = ledger.filter(F.col("amount") >= min_amount).select(
        "id", "account_id", "txn_date", _party().alias("_party"), "direction",
        bands.minor_units(F.col("amount")).alias("x"),
    )
    credits, debits = rows.filter("direction = 'Cr'"), rows.filter("direction = 'Dr'")
    found = []
    for side, other, bounds in (
        (credits, debits, bands.band_around_credit("x", tolerance)),
        (debits, credits, bands.band_around_debit("x", tolerance)),
    ):
        probes = side.select(*keys, "x").distinct().withColumn("lo", bounds[0]).withColumn("hi", bounds[1])
        targets = other.select(*keys, "x", F.lit(1).cast("bigint").alias("value"))
        hits = bands.band_max(probes, targets, keys, tolerance, carry=["x"])
        found.append(_rows_on(side, hits, [*keys, "x"]).select("id"))
    return _flagged(found[0].unionByName(found[1]), PATTERN_FLAGS[5])


def _day_flags(rows: DataFrame, limits: Limits) -> DataFrame:
    """``(account_id, txn_date, structuring, spike, cluster, woken)``, one row per account and day.

    Windows run over days, so an account has no more rows than the calendar has days.
    """
    reach = lambda line, days: line.rangeBetween(0, days)
    back = lambda line, days: line.rangeBetween(-days, 0)
    account = Window.partitionBy("account_id")
    line = account.orderBy("_d")
    days = rows.groupBy("account_id", "txn_date").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_near").alias("_near"), F.count_if("_round").alias("_round")
    )
    first = F.when(F.col("_d") - F.lag("_d").over(line) >= limits.dormant_days, F.col("_waking"))
    counted = days.withColumn("_d", F.unix_date("txn_date")).withColumns(
        {
            "_near": F.sum("_near").over(reach(line, limits.structuring_days)),
            "_fast": F.sum("_n").over(reach(line, limits.velocity_days)),
            "_waking": F.sum("_n").over(reach(line, limits.wake_days)),
            "_round": F.sum("_round").over(account),
        }
    )
    best = counted.withColumn("_first", first).withColumns(
        {
            "_near": F.max("_near").over(back(line, limits.structuring_days)),
            "_fast": F.max("_fast").over(back(line, limits.velocity_days)),
            "_first": F.max("_first").over(back(line, limits.wake_days)),
        }
    )
    dated = F.col("txn_date").isNotNull()
    told = lambda c, least: dated & F.coalesce(F.col(c) >= least, F.lit(False))
    return best.select(
        "account_id",
        "txn_date",
        told("_near", limits.structuring_count).alias("structuring"),
        told("_fast", limits.velocity_count).alias("spike"),
        (F.col("_round") >= limits.round_cluster).alias("cluster"),
        told("_first", limits.wake_count).alias("woken"),
    )


def _two_sided(moves: DataFrame, keys: Sequence[str], tolerance: float) -> tuple[DataFrame, Column, Column]:
    """Distinct amounts of both directions with the bounds of their partners, which are credits for debits."""
    probes = moves.select(*keys, "direction", "x").distinct()
    credit = F.col("direction") == "Cr"
    around_credit, around_debit = bands.band_around_credit("x", tolerance), bands.band_around_debit("x", tolerance)
    bounds = [F.when(credit, c).otherwise(d) for c, d in zip(around_credit, around_debit, strict=True)]
    other = F.when(credit, F.lit("Dr")).otherwise("Cr")
    sign = F.when(credit, F.lit(1)).otherwise(-1)
    return probes.withColumns({"lo": bounds[0], "hi": bounds[1]}), other, sign


def _through_days(rows: DataFrame, limits: Limits) -> DataFrame:
    """``(account_id, txn_date, direction, x, later, same_day)`` of amounts with a partner on another day
    of the reach, or on the same one, of which the farthest in ledger order is kept."""
    moves = rows.filter(
        (F.col("amount") >= limits.through_amount) & F.col("txn_date").isNotNull() & F.col("direction").isin("Cr", "Dr")
    )
    probes, other, sign = _two_sided(moves, ["account_id", "txn_date"], limits.through_tolerance)
    probes = (
        probes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(limits.through_days))))
        .withColumn("_day", F.date_add("txn_date", (sign * F.col("_k")).cast("int")))
    )
    # A target takes the direction of the probes that ask for it.
    targets = moves.select(
        "account_id", F.col("txn_date").alias("_day"), other.alias("direction"), "x", (-sign * F.col("seq")).alias("value")
    )
    best = bands.band_max(
        probes, targets, ["account_id", "_day", "direction"], limits.through_tolerance, carry=["txn_date", "x", "_k"]
    )
    return best.groupBy("account_id", "txn_date", "direction", "x").agg(
        F.max(F.col("_k") > 0).alias("later"), F.max(F.when(F.col("_k") == 0, F.col("best"))).alias("same_day")
    )


def _trip_amounts(rows: DataFrame, limits: Limits) -> DataFrame:
    """``(account_id, txn_date, _party, direction, x)`` of amounts with a partner on the same day."""
    keys = ["account_id", "txn_date", "_party"]
    moves = rows.filter((F.col("amount") >= limits.trip_amount) & F.col("direction").isin("Cr", "Dr"))
    probes, other, _ = _two_sided(moves, keys, limits.trip_tolerance)
    targets = moves.select(*keys, other.alias("direction"), "x", F.lit(1).cast("bigint").alias("value"))
    hits = bands.band_max(probes, targets, [*keys, "direction"], limits.trip_tolerance, carry=["x"])
    return hits.select(*keys, "direction", "x").distinct()


def _left(rows: DataFrame, found: DataFrame, keys: Sequence[str], mark: str) -> DataFrame:
    """Left join on null-safe keys; ``mark`` is true where a row was found."""
    other = found.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[c for c in found.columns if c not in keys], F.lit(True).alias(mark))
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(other[f"_h_{k}"])
    return rows.join(other, condition, "left").drop(*[f"_h_{k}" for k in keys])


def run_all(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(id, new_flags)`` for every flagged row, flags in detector order; ids are unique."""
    amount = F.col("amount")
    near = (amount >= limits.structuring_lower) & (amount < limits.structuring_upper)
    rows = cut_lineage(
        ledger.select(
            "id", "seq", "account_id", "txn_date", "direction", "amount", bands.minor_units(amount).alias("x"),
            _party().alias("_party"), F.coalesce(near, F.lit(False)).alias("_near"),
            F.coalesce(_is_round(amount, limits.small_unit, limits.big_unit), F.lit(False)).alias("_round"),
        )
    )
    told = _left(rows, _day_flags(rows, limits), ["account_id", "txn_date"], "_counted")
    told = _left(told, _through_days(rows, limits), ["account_id", "txn_date", "direction", "x"], "_through")
    told = _left(told, _trip_amounts(rows, limits), ["account_id", "txn_date", "_party", "direction", "x"], "_trip")
    sign = F.when(F.col("direction") == "Cr", F.lit(1)).otherwise(-1)
    in_order = F.col("later") | F.coalesce(F.col("same_day") > F.col("seq") * sign, F.lit(False))
    hits = [
        F.col("_near") & F.col("structuring"),
        F.col("spike"),
        F.col("_round") & F.col("cluster"),
        F.col("_through") & (amount >= limits.through_amount) & in_order,
        F.col("woken"),
        F.col("_trip") & (amount >= limits.trip_amount),
    ]
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(flag)) for hit, flag in zip(hits, PATTERN_FLAGS, strict=True)]))
    return told.select("id", flags.alias("new_flags")).filter(F.size("new_flags") > 0)


def run_each(ledger: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """As ``run_all`` for any detectors, each of which reads the ledger by itself."""
    frames = [
        detector(ledger).select("id", F.struct(F.lit(i).alias("ord"), "flag").alias("hit"))
        for i, detector in enumerate(detectors)
    ]
    hits = frames[0]
    for frame in frames[1:]:
        hits = hits.unionByName(frame)
    return hits.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_set("hit")), lambda h: h["flag"]).alias("new_flags")
    )


def merge_flags(ledger: DataFrame, found: DataFrame) -> DataFrame:
    """Replace pattern flags by the newly found ones and keep all other flags."""
    own = F.array(*[F.lit(f) for f in PATTERN_FLAGS])
    empty = F.array().cast("array<string>")
    kept = F.filter(
        F.coalesce(F.col("flags"), empty), lambda flag: ~F.array_contains(own, flag)
    )
    return (
        ledger.join(found, "id", "left")
        .withColumn("flags", F.concat(kept, F.coalesce(F.col("new_flags"), empty)))
        .drop("new_flags")
    )


def refresh_flags(ledger: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Re-run all detectors; running it twice gives the same flags."""
    return merge_flags(ledger, run_all(ledger, limits))


def count_flags(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Hits per case and flag."""
    return (
        found.withColumn("flag", F.explode("new_flags"))
        .join(ledger.select("id", "case_id"), "id")
        .groupBy("case_id", "flag")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
