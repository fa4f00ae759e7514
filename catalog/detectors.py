"""Detector queries (D1-D8) and their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import detectors as D
from casetrail.sources import shared_tables as T


def _days_sql(where: str, reach: int, n: int, account: str) -> str:
    return f"""
      WITH l AS ({T.ledger_sql(account)}), r AS (SELECT * FROM l WHERE {where}),
      f AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY txn_date
              RANGE BETWEEN CURRENT ROW AND INTERVAL {reach} DAY FOLLOWING) AS c FROM r),
      m AS (SELECT *, max(c) OVER (PARTITION BY account_id ORDER BY txn_date
              RANGE BETWEEN INTERVAL {reach} DAY PRECEDING AND CURRENT ROW) AS b FROM f)"""


_D1 = _days_sql("amount >= 900000 AND amount < 1000000", 30, 3, "customer") + (
    " SELECT id, 'STRUCTURING_SUSPECTED' AS flag FROM m WHERE b >= 3"
)
_D1N = _days_sql("amount >= 900000 AND amount < 1000000", 30, 3, "nation") + (
    " SELECT id, 'STRUCTURING_SUSPECTED' AS flag FROM m WHERE b >= 3"
)
_D2 = _days_sql("true", 1, 4, "nation") + (
    " SELECT id, 'VELOCITY_SPIKE' AS flag FROM m WHERE b >= 4"
)
_D2T = """
  WITH a AS (SELECT user_id, ts FROM events),
  hot AS (SELECT x.user_id, x.ts FROM (
     SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
       RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING) AS c FROM a) x WHERE c >= 6)
  SELECT DISTINCT event_id AS id, 'VELOCITY_SPIKE' AS flag
  FROM events e WHERE EXISTS (SELECT 1 FROM hot h WHERE h.user_id = e.user_id
    AND h.ts <= e.ts AND e.ts <= h.ts + INTERVAL 24 HOUR)"""


def _d3_sql(account: str) -> str:
    return f"""
      WITH l AS ({T.ledger_sql(account, True)}), r AS (SELECT id, account_id FROM l
        WHERE (amount >= 50000 AND amount % 50000 = 0) OR (amount >= 10000 AND amount % 10000 = 0))
      SELECT id, 'ROUND_AMOUNT_CLUSTER' AS flag FROM r
      WHERE account_id IN (SELECT account_id FROM r GROUP BY 1 HAVING count(*) >= 5)"""


def _d4_sql(account: str) -> str:
    return f"""
      WITH l AS ({T.ledger_sql(account)}), r AS (SELECT * FROM l WHERE amount >= 10000),
      p AS (SELECT c.id AS c_id, d.id AS d_id FROM r c JOIN r d ON c.account_id = d.account_id
        AND c.direction = 'Cr' AND d.direction = 'Dr'
        AND (d.txn_date > c.txn_date OR (d.txn_date = c.txn_date AND d.seq > c.seq))
        AND d.txn_date <= c.txn_date + INTERVAL 2 DAY
        AND abs(d.amount - c.amount) <= c.amount * 0.05)
      SELECT DISTINCT id, 'FUND_THROUGH_FLOW' AS flag
      FROM (SELECT c_id AS id FROM p UNION ALL SELECT d_id FROM p) u"""


def _d5_sql(account: str, gap: int, n: int, burst: int) -> str:
    return f"""
      WITH l AS ({T.ledger_sql(account)}),
      g AS (SELECT id, account_id, txn_date, txn_date - lag(txn_date) OVER (
              PARTITION BY account_id ORDER BY txn_date, id) AS gap,
            count(*) OVER (PARTITION BY account_id ORDER BY txn_date
              RANGE BETWEEN CURRENT ROW AND INTERVAL {burst} DAY FOLLOWING) AS c FROM l),
      s AS (SELECT *, CASE WHEN gap >= {gap} AND c >= {n} THEN 1 ELSE 0 END AS st FROM g),
      m AS (SELECT *, max(st) OVER (PARTITION BY account_id ORDER BY txn_date
              RANGE BETWEEN INTERVAL {burst} DAY PRECEDING AND CURRENT ROW) AS b FROM s)
      SELECT id, 'DORMANT_THEN_ACTIVE' AS flag FROM m WHERE b = 1"""


_D6 = f"""
  WITH l AS ({T.ledger_sql("nation", True)}), r AS (SELECT * FROM l WHERE amount >= 5000),
  p AS (SELECT c.id AS c_id, d.id AS d_id FROM r c JOIN r d ON c.account_id = d.account_id
    AND c.txn_date = d.txn_date AND c.counterparty = d.counterparty
    AND c.direction = 'Cr' AND d.direction = 'Dr'
    AND abs(d.amount - c.amount) <= c.amount * 0.25)
  SELECT DISTINCT id, 'SAME_DAY_ROUND_TRIP' AS flag
  FROM (SELECT c_id AS id FROM p UNION ALL SELECT d_id FROM p) u"""


# Detector settings with hits on the shared tables, for the merged runs.
TUNED = D.Limits(velocity_count=4, dormant_days=5, wake_count=2, trip_tolerance=0.25)


_ALL = f"""
  WITH l0 AS ({T.ledger_sql("nation", True)}),
  r1 AS (SELECT * FROM l0 WHERE amount >= 900000 AND amount < 1000000),
  f1 AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING) AS c FROM r1),
  m1 AS (SELECT *, max(c) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS b FROM f1),
  f2 AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING) AS c FROM l0),
  m2 AS (SELECT *, max(c) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS b FROM f2),
  r3 AS (SELECT * FROM l0 WHERE amount >= 10000 AND amount % 10000 = 0),
  p4 AS (SELECT c.id AS c_id, d.id AS d_id FROM l0 c JOIN l0 d ON c.account_id = d.account_id
    AND c.amount >= 10000 AND d.amount >= 10000 AND c.direction = 'Cr' AND d.direction = 'Dr'
    AND (d.txn_date > c.txn_date OR (d.txn_date = c.txn_date AND d.seq > c.seq))
    AND d.txn_date <= c.txn_date + INTERVAL 2 DAY AND abs(d.amount - c.amount) <= c.amount * 0.05),
  g5 AS (SELECT id, account_id, txn_date, txn_date - lag(txn_date) OVER (PARTITION BY account_id ORDER BY txn_date, id) AS gap,
    count(*) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAY FOLLOWING) AS c FROM l0),
  s5 AS (SELECT *, CASE WHEN gap >= 5 AND c >= 2 THEN 1 ELSE 0 END AS st FROM g5),
  m5 AS (SELECT *, max(st) OVER (PARTITION BY account_id ORDER BY txn_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS b FROM s5),
  p6 AS (SELECT c.id AS c_id, d.id AS d_id FROM l0 c JOIN l0 d ON c.account_id = d.account_id AND c.txn_date = d.txn_date
    AND c.counterparty = d.counterparty AND c.direction = 'Cr' AND d.direction = 'Dr' AND c.amount >= 5000 AND d.amount >= 5000
    AND abs(d.amount - c.amount) <= c.amount * 0.25),
  hits AS (
    SELECT id, 1 AS o, 'STRUCTURING_SUSPECTED' AS flag FROM m1 WHERE b >= 3
    UNION SELECT id, 2, 'VELOCITY_SPIKE' FROM m2 WHERE b >= 4
    UNION SELECT id, 3, 'ROUND_AMOUNT_CLUSTER' FROM r3 WHERE account_id IN (SELECT account_id FROM r3 GROUP BY 1 HAVING count(*) >= 5)
    UNION SELECT c_id, 4, 'FUND_THROUGH_FLOW' FROM p4 UNION SELECT d_id, 4, 'FUND_THROUGH_FLOW' FROM p4
    UNION SELECT id, 5, 'DORMANT_THEN_ACTIVE' FROM m5 WHERE b = 1
    UNION SELECT c_id, 6, 'SAME_DAY_ROUND_TRIP' FROM p6 UNION SELECT d_id, 6, 'SAME_DAY_ROUND_TRIP' FROM p6)"""


def _flagged_ledger(spark, sf):
    """Dense rounded ledger with earlier flags, one of them from the pattern namespace."""
    return T.ledger(spark, sf, "nation", True).withColumn(
        "flags",
        F.when(F.col("id") % 3 == 0, F.array(F.lit("NEEDS_REVIEW"), F.lit("VELOCITY_SPIKE")))
        .when(F.col("id") % 3 == 1, F.array(F.lit("SELF_TRANSFER")))
        .otherwise(F.array().cast("array<string>")),
    )


def _events_ledger(spark, sf):
    return T.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("txn_ts")
    )


QUERIES = {
    "d1_structuring": lambda s, d: D.structuring(T.ledger(s, d)),
    "d1_structuring_dense": lambda s, d: D.structuring(T.ledger(s, d, "nation")),
    "d2_velocity_spike": lambda s, d: D.velocity_spike(T.ledger(s, d, "nation"), min_count=4),
    "w1_burst_membership_by_time": lambda s, d: D.velocity_spike_by_time(
        _events_ledger(s, d), min_count=6
    ),
    "d3_round_amounts": lambda s, d: D.round_amounts(T.ledger(s, d, "customer", True)),
    "w3_cluster_size": lambda s, d: D.round_amounts(T.ledger(s, d, "nation", True)),
    "d4_fund_through": lambda s, d: D.fund_through(T.ledger(s, d)),
    "j4_credit_to_debit_dense": lambda s, d: D.fund_through(T.ledger(s, d, "nation")),
    "d5_dormant_active": lambda s, d: D.dormant_active(
        T.ledger(s, d), dormant_days=60, burst_count=2, burst_days=30
    ),
    "w2_gap_then_burst": lambda s, d: D.dormant_active(
        T.ledger(s, d, "nation"), dormant_days=5, burst_count=2
    ),
    "d6_round_trip": lambda s, d: D.round_trip(T.ledger(s, d, "nation", True), tolerance=0.25),
    "d7_run_all": lambda s, d: D.run_all(T.ledger(s, d, "nation", True), TUNED).select(
        "id", F.array_join("new_flags", ",").alias("flags")
    ),
    "d8_refresh_flags": lambda s, d: D.refresh_flags(_flagged_ledger(s, d), TUNED).select(
        "id", F.array_join("flags", ",").alias("flags")
    ),
    "d8_flag_counts": lambda s, d: D.count_flags(
        D.run_all(T.ledger(s, d, "nation", True), TUNED), T.ledger(s, d, "nation", True)
    ),
}

ORACLES = {
    "d1_structuring": _D1,
    "d1_structuring_dense": _D1N,
    "d2_velocity_spike": _D2,
    "w1_burst_membership_by_time": _D2T,
    "d3_round_amounts": _d3_sql("customer"),
    "w3_cluster_size": _d3_sql("nation"),
    "d4_fund_through": _d4_sql("customer"),
    "j4_credit_to_debit_dense": _d4_sql("nation"),
    "d5_dormant_active": _d5_sql("customer", 60, 2, 30),
    "w2_gap_then_burst": _d5_sql("nation", 5, 2, 7),
    "d6_round_trip": _D6,
    "d7_run_all": _ALL + " SELECT id, string_agg(flag, ',' ORDER BY o) AS flags FROM hits GROUP BY id",
    "d8_refresh_flags": _ALL
    + """, x AS (SELECT id, string_agg(flag, ',' ORDER BY o) AS nf FROM hits GROUP BY id)
      SELECT l0.id, concat_ws(',', CASE l0.id % 3 WHEN 0 THEN 'NEEDS_REVIEW' WHEN 1 THEN 'SELF_TRANSFER' END, x.nf) AS flags
      FROM l0 LEFT JOIN x ON l0.id = x.id""",
    "d8_flag_counts": _ALL
    + " SELECT l0.case_id, hits.flag, count(*) AS hits FROM hits JOIN l0 ON l0.id = hits.id GROUP BY 1, 2",
}
