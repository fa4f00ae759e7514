"""Changes across tables over the ledger, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import entities as N
from casetrail.operators import responses as R
from casetrail.operators import tables as U
from casetrail.sources import shared_tables as T
from catalog import entities, responses, traversal


def _tables(spark, sf):
    ledger = entities.rows(spark, sf)
    statements = ledger.groupBy("statement_id", "account_id", "case_id").agg(
        F.count(F.lit(1)).cast("int").alias("extracted_txn_count"), F.max("txn_date").alias("uploaded_at"), F.md5(F.max("txn_date").cast("string").cast("binary")).alias("file_hash"))
    return {
        "accounts": ledger.groupBy("account_id", F.col("person_id")).agg(F.count(F.lit(1)).cast("int").alias("transaction_count")),
        "statements": statements.withColumn("source_file_name", F.concat("statement_id", F.lit(".pdf"))),
        "transactions": ledger.select("id", "statement_id", "amount"),
        "links": N.links(ledger),
        "edits": T.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("amount").alias("field")),
    }


def _deleted(spark, sf):
    """The statements of 1996 and of customers in debt go."""
    tables = _tables(spark, sf)
    poor = T.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("account_id"))
    old = tables["statements"].filter("statement_id LIKE '%-1996'").select("statement_id")
    wanted = old.unionByName(tables["statements"].join(poor, "account_id", "left_semi").select("statement_id"))
    return U.delete_statements(tables, wanted)


def _duplicates(spark, sf):
    tables = _tables(spark, sf)
    persons = T.ledger(spark, sf).select("person_id", (F.col("case_id") % 3).alias("case_id")).distinct()
    accounts = tables["accounts"].select("account_id", "person_id")
    uploads = tables["statements"].select("case_id", "file_hash")
    return U.duplicate_statements(tables["statements"].drop("case_id"), accounts, persons, uploads)


def _upserted(spark, sf):
    """Suppliers as stored nodes, the transfers' sides as fresh ones; the stored chain stays."""
    stored = T.table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("address"), F.lit("first").alias("chain"), F.col("s_name").alias("name"))
    rows = traversal.transfers(spark, sf, traversal.LEAST)
    fresh = rows.select(F.col("target").alias("address"), F.lit("second").alias("chain"), "value", "seq")
    return U.upsert(stored, fresh, ["address"], "seq", ("chain",))


_T = f"""{entities._ROWS}, SS AS (SELECT statement_id, account_id, case_id, count(*) AS n, max(txn_date) AS up, md5(CAST(max(txn_date) AS VARCHAR)) AS h FROM Q GROUP BY 1, 2, 3),
  GO AS (SELECT * FROM SS WHERE statement_id LIKE '%-1996' OR account_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
  LE AS (SELECT account_id, count(*) AS left_over FROM SS WHERE statement_id NOT IN (SELECT statement_id FROM GO) GROUP BY 1)"""

QUERIES = {
    "s13_delete_report": lambda s, d: _deleted(s, d)[1],
    "s13_accounts_left": lambda s, d: _deleted(s, d)[0]["accounts"].select("account_id", "transaction_count"),
    "s13_rows_left": lambda s, d: U.table_counts({k: v for k, v in _deleted(s, d)[0].items()}),
    "s14_table_counts": lambda s, d: U.table_counts({n: T.table(s, d, n) for n in ("customer", "orders", "lineitem", "events")}),
    "j3_duplicate_statements": _duplicates,
    "g10_upserted_nodes": _upserted,
    "l2_attempt_page": lambda s, d: U.newest_page(
        R.attempt_list(responses._read(s, d)).withColumn("key", F.col("extraction_id") * 10 + F.col("seq")), "created_at", "key", 60, 20).select("extraction_id", "slot", "created_at", "total"),
    "l4_latest_attempt": lambda s, d: U.latest(responses.attempts(s, d).select("extraction_id", "created_at", "slot"), "extraction_id", "created_at"),
}

ORACLES = {
    "s13_delete_report": f"""{_T}, TX AS (SELECT Q.id, Q.statement_id FROM Q JOIN GO USING (statement_id)),
      TE AS (SELECT statement_id, count(*) AS e FROM TX JOIN orders ON o_orderkey = id AND o_orderstatus = 'P' GROUP BY 1), TL AS (SELECT statement_id, count(*) AS l FROM TX JOIN K USING (id) WHERE key <> '' GROUP BY 1)
      SELECT GO.statement_id, GO.account_id, n AS transactions_deleted, coalesce(e, 0) AS audit_events_deleted, coalesce(l, 0) AS entity_links_deleted, left_over IS NULL AS account_deleted
      FROM GO LEFT JOIN TE USING (statement_id) LEFT JOIN TL USING (statement_id) LEFT JOIN LE ON LE.account_id = GO.account_id""".replace("JOIN K USING (id)", "JOIN (SELECT id, key FROM K) K USING (id)"),
    "s13_accounts_left": f"""{_T}, AC AS (SELECT account_id, count(*) AS n FROM Q GROUP BY 1), GN AS (SELECT account_id, sum(n) AS g FROM GO GROUP BY 1)
      SELECT account_id, CAST(AC.n - coalesce(g, 0) AS INTEGER) AS transaction_count FROM AC LEFT JOIN GN USING (account_id) WHERE account_id IN (SELECT account_id FROM LE)""",
    "s13_rows_left": f"""{_T}, KE AS (SELECT id, account_id FROM Q WHERE statement_id NOT IN (SELECT statement_id FROM GO))
      SELECT 'statements' AS "table", (SELECT count(*) FROM SS) - (SELECT count(*) FROM GO) AS rows UNION ALL SELECT 'transactions', count(*) FROM KE
      UNION ALL SELECT 'edits', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT id FROM Q JOIN GO USING (statement_id)))
      UNION ALL SELECT 'links', (SELECT count(*) FROM K WHERE key <> '' AND id IN (SELECT id FROM KE)) UNION ALL SELECT 'accounts', (SELECT count(*) FROM LE)""",
    "s14_table_counts": " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("customer", "orders", "lineitem", "events")),
    "j3_duplicate_statements": f"""{_T}, R AS (SELECT *, row_number() OVER (PARTITION BY case_id, h ORDER BY up DESC, statement_id DESC) AS r FROM SS)
      SELECT case_id, h AS file_hash, statement_id, statement_id || '.pdf' AS source_file_name, up AS uploaded_at, CAST(n AS INTEGER) AS extracted_txn_count, account_id FROM R WHERE r = 1""",
    "g10_upserted_nodes": f"""WITH {traversal._sql(traversal.LEAST)}, F AS (SELECT upper(target) AS address, max(ROW(seq, 'second', value)) AS v FROM E GROUP BY 1), S AS (SELECT 'S:' || s_suppkey AS address, s_name FROM supplier)
      SELECT coalesce(F.address, S.address) AS address, CASE WHEN S.address IS NULL THEN 'second' ELSE 'first' END AS chain, s_name AS name, v[3] AS value, v[1] AS seq FROM F FULL JOIN S ON S.address = F.address""",
    "l2_attempt_page": f"{responses._A} SELECT extraction_id, slot, created_at, count(*) OVER () AS total FROM A ORDER BY created_at DESC, extraction_id * 10 + seq DESC LIMIT 60 OFFSET 20",
    "l4_latest_attempt": f"{responses._A} SELECT extraction_id, created_at, slot FROM A WHERE seq = 2",
}
