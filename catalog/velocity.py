"""Velocity metrics over the events table with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import scores
from casetrail.operators import velocity as V
from casetrail.sources import shared_tables as T

_OUT = "event_type IN ('purchase', 'error')"


def transfers(spark, sf):
    return T.table(spark, sf, "events").selectExpr(
        "user_id AS address", f"{_OUT} AS outgoing", "CAST(value AS DECIMAL(18,4)) AS value", "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS token", "CAST(event_id % 8 AS INT) AS input_count",
    )


def addresses(spark, sf):
    """All users and as many addresses again that have no transfer."""
    users = T.table(spark, sf, "events").select(F.col("user_id").alias("address")).distinct()
    return users.union(users.select(-F.col("address") - 1))


EV = f"""WITH E AS (SELECT user_id AS address, {_OUT} AS outgoing, CAST(value AS DECIMAL(18,4)) AS value, ts, event_type AS token, event_id % 8 AS inputs,
    CAST(ts AS DATE) AS day FROM events),
  B AS (SELECT address, token, CAST(coalesce(sum(value) FILTER (NOT outgoing), 0) AS DECIMAL(28,4)) AS inflow,
    CAST(coalesce(sum(value) FILTER (outgoing), 0) AS DECIMAL(28,4)) AS outflow FROM E GROUP BY 1, 2),
  T AS (SELECT *, coalesce(round(CAST(outflow AS DOUBLE) / nullif(CAST(inflow AS DOUBLE), 0), 4), 0) AS fund_through_rate FROM B),
  P AS (SELECT address, token AS primary_token, CASE WHEN inflow > 0 THEN fund_through_rate ELSE coalesce(round(CAST(o AS DOUBLE) / nullif(CAST(i AS DOUBLE), 0), 4), 0) END AS fund_through_rate
    FROM (SELECT *, sum(inflow) OVER (PARTITION BY address) AS i, sum(outflow) OVER (PARTITION BY address) AS o,
      row_number() OVER (PARTITION BY address ORDER BY inflow + outflow DESC, token) AS r FROM T) WHERE r = 1),
  D AS (SELECT address, day, count(*) AS tx_count, CAST(coalesce(sum(value) FILTER (NOT outgoing), 0) AS DECIMAL(28,4)) AS inflow,
    CAST(coalesce(sum(value) FILTER (outgoing), 0) AS DECIMAL(28,4)) AS outflow FROM E GROUP BY 1, 2),
  R AS (SELECT address, CASE WHEN count(*) >= 2 THEN round(stddev_pop(tx_count) / avg(tx_count), 4) END AS regularity_score,
    CASE WHEN count(*) >= 2 THEN round(max(tx_count) / avg(tx_count), 2) END AS burst_score FROM D GROUP BY 1),
  S AS (SELECT DISTINCT address, ts FROM E WHERE outgoing),
  N AS (SELECT e.address, e.ts, (SELECT min(s.ts) FROM S s WHERE s.address = e.address AND s.ts > e.ts) AS nxt FROM E e WHERE NOT outgoing),
  W AS (SELECT address, round(median((epoch_us(nxt) - epoch_us(ts)) / 3600000000.0::DOUBLE), 2) AS dwell_time_hours FROM N GROUP BY 1)"""

QUERIES = {
    "v2_token_breakdown": lambda s, d: V.token_breakdown(transfers(s, d)),
    "v3_primary_token": lambda s, d: V.primary_token(V.token_breakdown(transfers(s, d)), ()),
    "v6_dwell_time": lambda s, d: V.dwell_hours(transfers(s, d)),
    "v10_daily_breakdown": lambda s, d: V.daily_breakdown(transfers(s, d)),
    "v7_regularity": lambda s, d: V.regularity(V.daily_breakdown(transfers(s, d))).drop("day_span"),
    "v11_empty_addresses": lambda s, d: V.analyze(transfers(s, d), addresses(s, d)).filter("address < 0").select(
        "address", "transaction_count", "velocity_profile", "velocity_risk_score"),
    "v9_velocity": lambda s, d: V.analyze(transfers(s, d), addresses(s, d)).select(
        "address", "transaction_count", "consolidation_ratio", "fund_through_rate", "velocity_profile", "velocity_risk_score"),
}

ORACLES = {
    "v2_token_breakdown": f"{EV} SELECT * FROM T",
    "v3_primary_token": f"{EV} SELECT * FROM P",
    "v6_dwell_time": f"{EV} SELECT * FROM W",
    "v10_daily_breakdown": f"{EV} SELECT * FROM D",
    "v7_regularity": f"{EV} SELECT * FROM R",
    "v11_empty_addresses": "SELECT DISTINCT -user_id - 1 AS address, 0 AS transaction_count, 'Dormant' AS velocity_profile, 0.0::DOUBLE AS velocity_risk_score FROM events",
    "v9_velocity": f"""{EV}, A AS (SELECT address, count(*) AS transaction_count, round(count(*) FILTER (inputs >= 5) / count(*), 4) AS consolidation_ratio,
      CASE WHEN count(*) FILTER (value > 0) >= 2 THEN round(max(value::DOUBLE) FILTER (value > 0) / median(value::DOUBLE) FILTER (value > 0), 2) ELSE 0 END AS amp,
      floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS span FROM E GROUP BY 1),
      J AS (SELECT A.*, P.fund_through_rate AS f, W.dwell_time_hours AS w, R.regularity_score AS g, R.burst_score AS b FROM A JOIN P USING (address) LEFT JOIN W USING (address) LEFT JOIN R USING (address)),
      K AS (SELECT *, CASE WHEN f <= 2 THEN 1 - abs(f - 1) ELSE least(0.5 + (f - 2) / 20.0, 0.95) END AS p1, least(consolidation_ratio * 2, 1) AS p2, least(amp / 100.0, 1) AS p3,
        CASE WHEN g IS NULL THEN NULL WHEN g = 0 THEN 0.3 WHEN g < 0.3 THEN 0.8 WHEN g < 0.6 THEN 0.5 ELSE 0.1 END AS p4, least(b / 10.0, 1) AS p5,
        CASE WHEN w IS NULL THEN NULL WHEN w < 2 THEN 0.9 WHEN w < 24 THEN 0.5 ELSE 0.1 END AS p6 FROM J)
      SELECT address, transaction_count, consolidation_ratio, f AS fund_through_rate,
        CASE WHEN span > 90 AND transaction_count < 5 THEN 'Dormant' WHEN f >= 0.9 AND w < 24 THEN 'Relay' WHEN f <= 0.2 THEN 'Accumulator' WHEN f >= 1.5 THEN 'Distributor' ELSE 'Mixed' END AS velocity_profile,
        round(least((p1 * 0.25 + p2 * 0.1 + p3 * 0.1 + coalesce(p4 * 0.15, 0) + CASE WHEN b IS NULL THEN 0 ELSE p5 * 0.15 END + coalesce(p6 * 0.25, 0))
          / (0.45 + CASE WHEN p4 IS NULL THEN 0 ELSE 0.15 END + CASE WHEN b IS NULL THEN 0 ELSE 0.15 END + CASE WHEN p6 IS NULL THEN 0 ELSE 0.25 END), 0.95)::DOUBLE, 3) AS velocity_risk_score FROM K
      UNION ALL SELECT DISTINCT -user_id - 1, 0, 0.0, 0.0, 'Dormant', 0.0 FROM events""",
}


def _classified(spark, sf):
    """Customers and suppliers by equal numbers; every hundredth order goes to its own sender."""
    lines = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    moves = lines.selectExpr("o_custkey AS from_address", "CASE WHEN l_orderkey % 100 = 0 THEN o_custkey ELSE l_suppkey END AS to_address", "l_orderkey * 10 + l_linenumber AS seq")
    return V.classified(moves, T.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("address")))


def _rhythm(spark, sf):
    daily = V.daily_breakdown(transfers(spark, sf))
    told = scores.temporal_anomaly(F.col("regularity_score"), F.col("burst_score"), F.expr("address % 5 = 0"))
    return V.regularity(daily).select("address", F.array_join(told, ",").alias("signals"))


QUERIES |= {"v1_classified": _classified, "z5_temporal_anomaly": _rhythm}
ORACLES |= {
    "v1_classified": """WITH M AS (SELECT o_custkey AS f, CASE WHEN l_orderkey % 100 = 0 THEN o_custkey ELSE l_suppkey END AS t, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      S AS (SELECT f AS address, true AS outgoing, seq FROM M UNION ALL SELECT t, false, seq FROM M WHERE t <> f) SELECT * FROM S WHERE address IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""",
    "z5_temporal_anomaly": f"""{EV} SELECT address, concat_ws(',', CASE WHEN address % 5 = 0 THEN 'regular_cadence' END, CASE WHEN regularity_score < 0.4 THEN 'high_regularity' END, CASE WHEN burst_score > 3 THEN 'high_burst' END) AS signals FROM R""",
}
