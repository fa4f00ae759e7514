"""The detectors by themselves, in one plan, and against plain loops over all pairs."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casetrail.operators import detectors as D

SCHEMA = (
    "id int, seq int, account_id int, txn_date date, amount decimal(18,2), direction string, counterparty string, "
    "raw_description string, case_id int, flags array<string>"
)
TUNED = D.Limits(velocity_count=3, dormant_days=4, wake_count=2, wake_days=2, round_cluster=3, structuring_count=2, structuring_days=3)


def made(seed, n=160):
    """A few accounts and days, so that ties, nulls and repeated amounts meet."""
    draw = random.Random(seed)
    amounts = [5000, 10000, 10400, 10500, 50000, 905000, 999999, 1000000, 4999]
    rows = []
    for k in range(n):
        day = None if draw.random() < 0.05 else date(2024, 1, 1) + timedelta(days=draw.choice([0, 1, 2, 3, 8, 9, 20, 21, 40]))
        party = draw.choice(["shop", "bank", "", None])
        rows.append(
            (k, draw.randrange(1000), draw.choice([1, 2, 3, 4, None]), day, Decimal(draw.choice(amounts)) + Decimal(draw.randrange(3)),
             draw.choice(["Cr", "Dr", "Dr", "??"]), party, draw.choice([" Shop one ", None]), 1, ["OTHER"])
        )
    return rows


def plain(rows, lim):
    """Every rule as it is told, by comparing all rows of an account."""
    flags = {r[0]: set() for r in rows}
    party = lambda r: r[6] or (r[7] or "").strip()[:20]
    for r in rows:
        mine = [o for o in rows if o[2] == r[2]]
        dated = [o for o in mine if o[3] is not None]
        near = [o for o in dated if lim.structuring_lower <= o[4] < lim.structuring_upper]
        in_burst = lambda some, reach, least: any(
            a[3] <= r[3] <= a[3] + timedelta(reach) and sum(a[3] <= o[3] <= a[3] + timedelta(reach) for o in some) >= least for a in some
        )
        if r[3] is not None:
            if r in near and in_burst(near, lim.structuring_days, lim.structuring_count):
                flags[r[0]].add(0)
            if in_burst(dated, lim.velocity_days, lim.velocity_count):
                flags[r[0]].add(1)
            for a in dated:
                before = [o[3] for o in dated if o[3] < a[3]]
                opens = before and (a[3] - max(before)).days >= lim.dormant_days
                size = sum(a[3] <= o[3] <= a[3] + timedelta(lim.wake_days) for o in dated)
                if opens and size >= lim.wake_count and a[3] <= r[3] <= a[3] + timedelta(lim.wake_days):
                    flags[r[0]].add(4)
        whole = lambda o: (o[4] >= lim.small_unit and o[4] % lim.small_unit == 0)
        if whole(r) and sum(map(whole, mine)) >= lim.round_cluster:
            flags[r[0]].add(2)
        for o in mine:
            if (r[5], o[5]) != ("Cr", "Dr"):
                continue
            close = lambda t: abs(o[4] - r[4]) <= r[4] * Decimal(str(t))
            if r[3] and o[3] and min(r[4], o[4]) >= lim.through_amount and close(lim.through_tolerance):
                if r[3] < o[3] <= r[3] + timedelta(lim.through_days) or (r[3] == o[3] and o[1] > r[1]):
                    flags[r[0]].add(3), flags[o[0]].add(3)
            if r[3] == o[3] and party(r) == party(o) and min(r[4], o[4]) >= lim.trip_amount and close(lim.trip_tolerance):
                flags[r[0]].add(5), flags[o[0]].add(5)
    return {k: [D.PATTERN_FLAGS[i] for i in sorted(v)] for k, v in flags.items() if v}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_plan_equals_plain_loops(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    told = {r["id"]: r["new_flags"] for r in D.run_all(df, TUNED).collect()}
    assert told == plain(rows, TUNED)
    assert set(D.PATTERN_FLAGS) == {f for flags in told.values() for f in flags}


def test_one_plan_equals_single_detectors(spark):
    df = spark.createDataFrame(made(3, 120), SCHEMA)
    single = [D.structuring, D.velocity_spike, D.round_amounts, D.fund_through, D.dormant_active, D.round_trip]
    told = {r["id"]: r["new_flags"] for r in D.run_all(df).collect()}
    assert told == {r["id"]: r["new_flags"] for r in D.run_each(df, single).collect()}


def test_refresh_keeps_other_flags_and_settles(spark):
    df = spark.createDataFrame(made(4, 60), SCHEMA)
    once = D.refresh_flags(df, TUNED)
    twice = {r["id"]: r["flags"] for r in D.refresh_flags(once.select(df.columns), TUNED).collect()}
    first = {r["id"]: r["flags"] for r in once.collect()}
    assert first == twice and all(f[0] == "OTHER" for f in first.values())


def test_empty_ledger(spark):
    assert D.run_all(spark.createDataFrame([], SCHEMA)).count() == 0
    assert D.refresh_flags(spark.createDataFrame([], SCHEMA)).filter(F.size("flags") > 0).count() == 0
