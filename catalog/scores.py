"""Scores and control totals over derived tables, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import scores as S
from casetrail.sources import shared_tables as T


def _truth(spark, sf):
    return T.ledger(spark, sf).select(
        F.col("case_id").alias("file"), F.col("txn_date").alias("date"), "amount", F.col("direction").alias("type"), "id"
    )


def _found(spark, sf):
    """Some rows missing, some twice, some with another type."""
    rows = _truth(spark, sf).filter("id % 7 <> 0")
    twice = rows.filter("id % 11 = 0")
    kind = F.when(F.col("id") % 5 == 0, F.lit("Cr")).otherwise(F.col("type"))
    return rows.union(twice).withColumn("type", kind)


_SETS = f"""WITH L AS ({T.ledger_sql()}), R AS (SELECT case_id AS file, txn_date AS date, amount, direction AS type, id FROM L),
  F0 AS (SELECT * FROM R WHERE id % 7 <> 0), F1 AS (SELECT * FROM F0 UNION ALL SELECT * FROM F0 WHERE id % 11 = 0),
  F AS (SELECT file, date, amount, CASE WHEN id % 5 = 0 THEN 'Cr' ELSE type END AS type, count(*) AS f FROM F1 GROUP BY ALL),
  E AS (SELECT file, date, amount, type, count(*) AS e FROM R GROUP BY ALL),
  C AS (SELECT file, CAST(sum(coalesce(e, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(f, 0)) AS BIGINT) AS found, CAST(sum(least(coalesce(e, 0), coalesce(f, 0))) AS BIGINT) AS hits
    FROM E FULL JOIN F USING (file, date, amount, type) GROUP BY file)"""
_RATES = """expected - hits AS missed, found - hits AS spurious, round(hits / expected, 3) AS recall, round(hits / found, 3) AS precision,
  round(2 * (hits / found) * (hits / expected) / (hits / found + hits / expected), 3) AS f1"""


def _board(spark, sf):
    scores = S.extraction_scores(_found(spark, sf), _truth(spark, sf), ["file"])
    tools = scores.withColumns({"tool": F.concat(F.lit("tool"), F.col("file") % 3), "seconds": F.col("file") * F.lit(0.5)})
    return S.leaderboard(tools)


def _totals(spark, sf):
    total = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("amount"))).cast("decimal(28,2)")
    declared = _truth(spark, sf).filter("file % 4 <> 0").groupBy("file").agg(
        total("Dr").alias("debits"), total("Cr").alias("credits"), F.count(F.lit(1)).alias("count")
    )
    declared = declared.withColumn("net_change", F.when(F.col("file") % 2 == 0, F.col("credits") - F.col("debits")))
    rows = _truth(spark, sf).filter("NOT (file % 3 = 0 AND id % 10 = 0) AND file <> 7")
    told = S.control_totals(rows, declared)
    return told.select("file", "rows", "dr", "cr", "status", "count_ok", "debits_ok", "credits_ok", F.coalesce("net_ok", F.lit(False)).alias("net_ok"))


QUERIES = {
    "a13_extraction_scores": lambda s, d: S.extraction_scores(_found(s, d), _truth(s, d), ["file"]),
    "a14_leaderboard": _board,
    "a12_control_totals": _totals,
}

ORACLES = {
    "a13_extraction_scores": f"{_SETS} SELECT file, expected, found, hits, {_RATES} FROM C",
    "a14_leaderboard": f"""{_SETS}, B AS (SELECT 'tool' || (file % 3) AS tool, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(hits) AS BIGINT) AS hits,
      round(sum(file * 0.5::DOUBLE), 2) AS time_s FROM C GROUP BY 1) SELECT tool, expected, found, hits, {_RATES}, time_s FROM B""",
    "a12_control_totals": f"""{_SETS}, V AS (SELECT *, NOT (file % 3 = 0 AND id % 10 = 0) AND file <> 7 AS seen FROM R),
      H AS (SELECT file, count(*) FILTER (seen) AS rows, count(*) AS n,
        CAST(coalesce(sum(amount) FILTER (seen AND type = 'Dr'), 0) AS DECIMAL(28,2)) AS dr, CAST(coalesce(sum(amount) FILTER (seen AND type = 'Cr'), 0) AS DECIMAL(28,2)) AS cr,
        sum(amount) FILTER (type = 'Dr') AS all_dr, sum(amount) FILTER (type = 'Cr') AS all_cr FROM V GROUP BY file)
      SELECT file, rows, dr, cr, CASE WHEN file % 4 = 0 THEN 'no-truth' ELSE 'checked' END AS status, CASE WHEN file % 4 <> 0 THEN rows = n END AS count_ok,
        CASE WHEN file % 4 <> 0 THEN dr = all_dr END AS debits_ok, CASE WHEN file % 4 <> 0 THEN cr = all_cr END AS credits_ok,
        file % 4 <> 0 AND file % 2 = 0 AND cr - dr = all_cr - all_dr AS net_ok FROM H""",
}
