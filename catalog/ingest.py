"""Batches of statements into stored tables, with SQL checks.

A statement is a customer's year of orders. Nation 24 is no case and every tenth customer no person; the accounts of
even customers and their statements of 1995 are stored already.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import ingest as I
from casetrail.sources import shared_tables as T

_ORDERS = """o_orderkey AS seq, o_custkey AS person_id, o_custkey || '-' || year(o_orderdate) AS statement_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Dr' ELSE 'Cr' END AS type, CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey AS DECIMAL(18,2)) END AS balance_after,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'UPI/' || o_orderkey || '/' || o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'Rent of ' || o_orderkey END AS description,
  CASE o_orderstatus WHEN 'F' THEN ' Shop ' WHEN 'P' THEN ' ' END AS counterparty, CASE WHEN o_orderstatus = 'P' THEN 'CARD' END AS channel, o_orderkey % 10 = 3 AS is_self_transfer"""
_UPLOAD = """statement_id, person_id, CAST(c_nationkey AS BIGINT) AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'ICICI' END AS bank, '90' || c_custkey AS account_number,
  CASE WHEN statement_id LIKE '%1996' THEN 'savings' ELSE 'current' END AS account_type, c_name AS holder_name, CAST(c_acctbal AS DECIMAL(18,2)) AS opening_balance,
  CASE WHEN c_custkey % 4 = 1 THEN dr + 1 WHEN c_custkey % 4 = 2 THEN dr END AS declared_dr, CASE WHEN c_custkey % 4 <> 3 THEN cr ELSE 0 END AS declared_cr,
  statement_id || 'T' AS uploaded_at, 'h' || right(statement_id, 4) || c_nationkey AS file_hash, statement_id || '.pdf' AS source_file_name"""


def _rows(spark, sf):
    orders = T.table(spark, sf, "orders")
    return orders.selectExpr(*[p.strip() for p in _split(_ORDERS)], "date_format(o_orderdate, 'dd/MM/yyyy') AS date")


def _split(columns: str) -> list[str]:
    """The columns of a list; commas in brackets part nothing."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _batch(spark, sf):
    rows = _rows(spark, sf)
    of = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("amount"))).cast("decimal(18,2)")
    sums = rows.groupBy("statement_id", "person_id").agg(of("Dr").alias("dr"), of("Cr").alias("cr"))
    people = T.table(spark, sf, "customer")
    uploads = sums.join(people, F.col("person_id") == F.col("c_custkey")).selectExpr(*_split(_UPLOAD))
    accounts = uploads.filter("person_id % 2 = 0").selectExpr(
        "'A' || person_id AS account_id", "person_id", "bank", "account_number", "'old' AS account_type", "holder_name", "7 AS transaction_count", "person_id % 8 = 0 AS has_warnings").distinct()
    stored = {
        "cases": T.table(spark, sf, "nation").filter("n_nationkey < 24").selectExpr("CAST(n_nationkey AS BIGINT) AS case_id", "'1990' AS updated_at"),
        "persons": people.filter("c_custkey % 10 <> 0").selectExpr("c_custkey AS person_id", "CAST(c_nationkey AS BIGINT) AS case_id", "c_name AS name"),
        "accounts": accounts,
        "statements": uploads.filter("person_id % 2 = 0 AND statement_id LIKE '%1995'").selectExpr(
            "statement_id", "'A' || person_id AS account_id", "file_hash", "uploaded_at", "source_file_name", "1 AS extracted_txn_count"),
    }
    return stored, I.ingest_batch(stored, uploads, rows.drop("person_id"))


def _export(spark, sf):
    stored, new = _batch(spark, sf)
    lines = new["transactions"].select("statement_id", "row_index", "account_id", "case_id", "amount", "counterparty")
    statements = new["statements"].select("statement_id", "account_id", "source_file_name")
    accounts = new["accounts"].select("account_id", "person_id", "bank", "account_number", "holder_name")
    return I.export_rows(stored["cases"], stored["persons"], accounts, statements, lines)


_ID = """'a-' || md5('{"person_id":' || person_id || CASE WHEN bank IS NULL THEN '' ELSE ',"bank":"' || bank || '"' END || ',"account_number":"' || account_number || '"}')"""
_B = f"""WITH O AS (SELECT {_ORDERS}, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
  S AS (SELECT statement_id, person_id, CAST(sum(amount) FILTER (type = 'Dr') AS DECIMAL(18,2)) AS dr, CAST(sum(amount) FILTER (type = 'Cr') AS DECIMAL(18,2)) AS cr, count(*) AS n FROM O GROUP BY 1, 2),
  U AS (SELECT {_UPLOAD}, dr, cr, n FROM S JOIN customer ON c_custkey = person_id),
  M AS (SELECT *, CASE WHEN person_id % 2 = 0 AND statement_id LIKE '%1995' THEN 'stored before' WHEN case_id = 24 THEN 'no case' WHEN person_id % 10 = 0 THEN 'no person' ELSE 'new' END AS outcome FROM U),
  N AS (SELECT *, CASE WHEN person_id % 2 = 0 THEN 'A' || person_id ELSE {_ID} END AS account_id, CASE WHEN coalesce(declared_dr, 0) = 0 THEN 100 ELSE coalesce(dr, 0)::DOUBLE / declared_dr::DOUBLE * 100 END AS dp,
    CASE WHEN coalesce(declared_cr, 0) = 0 THEN 100 ELSE coalesce(cr, 0)::DOUBLE / declared_cr::DOUBLE * 100 END AS cp FROM M WHERE outcome = 'new'),
  A AS (SELECT account_id, sum(n) AS more, bool_or(abs(dp - 100) > 0.01 OR abs(cp - 100) > 0.01) AS warned, min(person_id) AS person_id, min_by(account_type, uploaded_at) AS kind FROM N GROUP BY 1),
  D AS (SELECT DISTINCT person_id FROM U WHERE person_id % 2 = 0),
  G AS (SELECT O.*, N.account_id, N.case_id, N.opening_balance, CAST(row_number() OVER w AS INTEGER) AS row_index, count(balance_after) OVER w AS seg, CASE WHEN type = 'Cr' THEN amount ELSE -amount END AS moved FROM O JOIN N USING (statement_id) WINDOW w AS (PARTITION BY statement_id ORDER BY seq)),
  H AS (SELECT *, CAST(coalesce(max(balance_after) OVER (PARTITION BY statement_id, seg), opening_balance) + sum(CASE WHEN balance_after IS NULL THEN moved ELSE 0 END) OVER (PARTITION BY statement_id, seg ORDER BY seq) AS DECIMAL(28,2)) AS running_balance,
    coalesce(channel, CASE WHEN description LIKE 'UPI%' THEN 'UPI' ELSE 'OTHER' END) AS way, CASE WHEN description LIKE 'UPI%' THEN 'Transfer' WHEN description LIKE 'Rent%' THEN 'Rent' ELSE 'Other' END AS sort,
    CASE WHEN counterparty = ' Shop ' THEN 'Shop' WHEN description LIKE 'UPI%' THEN CAST(seq AS VARCHAR) WHEN description IS NULL THEN '(unknown)' ELSE description END AS party FROM G)"""

QUERIES = {
    "s8_screened_uploads": lambda s, d: _batch(s, d)[1]["uploads"].select("statement_id", "outcome", "duplicate_of"),
    "s8_ingested_statements": lambda s, d: _batch(s, d)[1]["statements"].select(
        "statement_id", "account_id", "opening_balance", "file_hash", "extracted_txn_count", "sum_check_debits_pct", "sum_check_credits_pct"),
    "s8_ingested_accounts": lambda s, d: _batch(s, d)[1]["accounts"].select("account_id", "person_id", "account_type", "transaction_count", "has_warnings"),
    "s8_ingested_rows": lambda s, d: _batch(s, d)[1]["transactions"].select(
        "case_id", "account_id", "statement_id", "row_index", "txn_date", "amount", "direction", "running_balance", "channel", "category", "counterparty", "confidence", F.array_join("flags", ",").alias("flags"),
        F.col("entities")["counterparty"]["confidence"].alias("party_confidence")),
    "s8_updated_cases": lambda s, d: _batch(s, d)[1]["cases"],
    "s9_export": _export,
}

ORACLES = {
    "s8_screened_uploads": f"""{_B} SELECT statement_id, outcome, CASE WHEN right(statement_id, 4) = '1995' THEN k END AS duplicate_of FROM M LEFT JOIN
      (SELECT case_id, max_by(statement_id, uploaded_at) AS k FROM U WHERE person_id % 2 = 0 AND person_id % 10 <> 0 AND statement_id LIKE '%1995' GROUP BY 1) USING (case_id)""",
    "s8_ingested_statements": f"""{_B} SELECT statement_id, account_id, opening_balance, file_hash, CAST(n AS INTEGER) AS extracted_txn_count, round(dp, 2) AS sum_check_debits_pct, round(cp, 2) AS sum_check_credits_pct FROM N""",
    "s8_ingested_accounts": f"""{_B} SELECT 'A' || D.person_id AS account_id, D.person_id, 'old' AS account_type, CAST(7 + coalesce(more, 0) AS INTEGER) AS transaction_count, D.person_id % 8 = 0 OR coalesce(warned, false) AS has_warnings
      FROM D LEFT JOIN A ON A.account_id = 'A' || D.person_id UNION ALL SELECT account_id, person_id, kind, CAST(more AS INTEGER), warned FROM A WHERE person_id % 2 = 1""",
    "s8_ingested_rows": f"""{_B}, J AS (SELECT *, length(party) < 3 OR party = '(unknown)' AS low FROM H)
      SELECT case_id, account_id, statement_id, row_index, day AS txn_date, amount, type AS direction, running_balance, way AS channel, sort AS category, party AS counterparty, CASE WHEN low THEN 'low' WHEN way = 'OTHER' THEN 'medium' ELSE 'high' END AS confidence,
      concat_ws(',', CASE WHEN low THEN 'NEEDS_REVIEW' END, CASE WHEN is_self_transfer THEN 'SELF_TRANSFER' END) AS flags, CASE WHEN party = 'Shop' THEN 0.95 WHEN low THEN 0.25 WHEN way = 'OTHER' THEN 0.5 ELSE 0.9 END::DOUBLE AS party_confidence FROM J""",
    "s8_updated_cases": f"{_B} SELECT CAST(n_nationkey AS BIGINT) AS case_id, coalesce(max(uploaded_at), '1990') AS updated_at FROM nation LEFT JOIN N ON case_id = n_nationkey WHERE n_nationkey < 24 GROUP BY 1",
    "s9_export": f"""{_B}, PE AS (SELECT c_custkey AS person_id, CAST(c_nationkey AS BIGINT) AS case_id, c_name FROM customer WHERE c_custkey % 10 <> 0),
      AC AS (SELECT 'A' || person_id AS account_id, person_id, any_value(bank) AS bank, any_value(account_number) AS account_number, any_value(holder_name) AS holder_name FROM U WHERE person_id % 2 = 0 GROUP BY 2
        UNION ALL SELECT DISTINCT account_id, person_id, bank, account_number, holder_name FROM N WHERE person_id % 2 = 1),
      OW AS (SELECT AC.*, case_id, c_name, '"account_id":"' || account_id || '","account_number":"' || account_number || '"' AS a, CASE WHEN bank IS NULL THEN '' ELSE ',"bank":"' || bank || '"' END || ',"case_id":' || case_id AS b,
        ',"holder_name":"' || holder_name || '","person_id":' || person_id || ',"person_name":"' || c_name || '"' AS h FROM AC JOIN PE USING (person_id))
      SELECT CAST(n_nationkey AS BIGINT) AS case_id, 'case' AS kind, CAST(n_nationkey AS VARCHAR) AS key, '{{"case_id":' || n_nationkey || ',"updated_at":"1990"}}' AS body FROM nation WHERE n_nationkey < 24
      UNION ALL SELECT case_id, 'person', CAST(person_id AS VARCHAR), '{{"case_id":' || case_id || ',"name":"' || c_name || '","person_id":' || person_id || '}}' FROM PE
      UNION ALL SELECT case_id, 'account', account_id, '{{' || a || b || h || '}}' FROM OW
      UNION ALL SELECT OW.case_id, 'statement', statement_id, '{{' || a || b || h || ',"source_file_name":"' || source_file_name || '","statement_id":"' || statement_id || '"}}' FROM N JOIN OW USING (account_id)
      UNION ALL SELECT OW.case_id, 'transaction', H.statement_id || '#' || printf('%06d', row_index), '{{' || a || ',"amount":' || amount || b || ',"counterparty":"' || party || '"' || h || ',"row_index":' || row_index || ',"source_file_name":"' || H.statement_id || '.pdf","statement_id":"' || H.statement_id || '"}}' FROM H JOIN OW USING (account_id)""",
}
