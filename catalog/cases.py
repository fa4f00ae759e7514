"""Case summaries, filters, balances, edits and ingest with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import balances, summary
from casetrail.sources import rendered as R
from casetrail.sources import shared_tables as T
from catalog import text

# The ledger with flags, tags, category and channel derived from the order key; the same in SQL.
_FLAGS = (
    ("VELOCITY_SPIKE", "id % 7 = 0"),
    ("ROUND_AMOUNT_CLUSTER", "id % 11 = 0"),
    ("NEEDS_REVIEW", "id % 13 = 0"),
    ("ODD_HOURS", "id % 97 = 0"),
)
_SHAPE = (
    "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'Food' WHEN id % 5 = 2 THEN '' ELSE 'Bills' END AS category",
    "CASE WHEN id % 3 = 0 THEN 'UPI' ELSE 'OTHER' END AS channel",
)


def rows(spark, sf, account="customer"):
    base = T.ledger(spark, sf, account)
    flags = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c} THEN '{n}' END") for n, c in _FLAGS]))
    tags = F.array_compact(F.array(F.expr("CASE WHEN id % 4 = 0 THEN 'seen' END"), F.expr("CASE WHEN id % 6 = 0 THEN 'cash' END")))
    shaped = base.withColumns({"flags": flags, "tags": tags})
    dated = F.when(F.col("id") % 50 != 0, F.col("txn_date"))
    return shaped.selectExpr("*", *_SHAPE).withColumn("txn_date", dated)


def rows_sql(account="customer"):
    flags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS)
    return f"""L AS ({T.ledger_sql(account)}),
  X AS (SELECT * REPLACE (CASE WHEN id % 50 <> 0 THEN txn_date END AS txn_date), {', '.join(_SHAPE)},
    list_filter([{flags}], lambda f: f IS NOT NULL) AS flags,
    list_filter([CASE WHEN id % 4 = 0 THEN 'seen' END, CASE WHEN id % 6 = 0 THEN 'cash' END], lambda f: f IS NOT NULL) AS tags,
    CASE WHEN direction = 'Dr' THEN amount ELSE 0 END AS dr, CASE WHEN direction = 'Dr' THEN 0 ELSE amount END AS cr FROM L)"""


X = "WITH " + rows_sql()
_SUMS = "count(*) AS count, CAST(sum(dr) AS DECIMAL(28,2)) AS total_dr, CAST(sum(cr) AS DECIMAL(28,2)) AS total_cr"


def _case_counts(spark, sf):
    cases = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("case_id"))
    ledger = rows(spark, sf)
    told = ledger.select("case_id", "statement_id").distinct()
    return summary.case_counts(cases, told, ledger)


def _scoreboard(spark, sf):
    board = summary.pattern_scoreboard(rows(spark, sf))
    return board.withColumn("sample_txn_ids", F.array_join("sample_txn_ids", ","))


_KNOWN = ", ".join(f"('{n}', '{label}', '{severity}')" for n, label, severity in (
    ("STRUCTURING_SUSPECTED", "Structuring suspected", "high"), ("FUND_THROUGH_FLOW", "Fund-through flow", "high"),
    ("SAME_DAY_ROUND_TRIP", "Same-day round trip", "high"), ("DORMANT_THEN_ACTIVE", "Dormant-then-active", "medium"),
    ("VELOCITY_SPIKE", "Velocity spike", "medium"), ("ROUND_AMOUNT_CLUSTER", "Round-amount cluster", "medium"),
    ("SUM_CHECK_CONTRIBUTOR", "Sum-check contributor", "low"), ("NEEDS_REVIEW", "Needs manual review", "low"),
))
_BOARD = f"""{X}, K(name, label, severity) AS (VALUES {_KNOWN}),
  E AS (SELECT case_id, id, seq, unnest(flags) AS name FROM X),
  H AS (SELECT case_id, name, count(*) AS c, array_to_string(list(id ORDER BY seq)[1:5], ',') AS s FROM E GROUP BY ALL),
  B AS (SELECT case_id, name, coalesce(label, 'Odd Hours') AS label, coalesce(severity, 'low') AS severity, coalesce(c, 0) AS count,
    coalesce(s, '') AS sample_txn_ids FROM (SELECT DISTINCT case_id, K.name FROM X, K) AS z FULL JOIN H USING (case_id, name) LEFT JOIN K USING (name))"""


def _declared(spark, sf):
    ledger = T.ledger(spark, sf)
    part = F.col("statement_id").substr(-1, 1).cast("int")
    wanted = ledger.groupBy("statement_id").agg(
        F.min("account_id").alias("account_id"),
        F.sum(F.when(F.col("direction") == "Dr", F.col("amount"))).alias("d"),
        F.sum(F.when(F.col("direction") == "Cr", F.col("amount"))).alias("c"),
    )
    declared = wanted.select(
        "statement_id",
        "account_id",
        F.when(part % 3 == 0, F.col("d")).when(part % 3 == 1, F.col("d") * 2).alias("declared_dr"),
        F.when(part % 2 == 0, F.col("c")).alias("declared_cr"),
    )
    return summary.sum_check(ledger, declared)


_CHECKED = f"""WITH L AS ({T.ledger_sql()}),
  S AS (SELECT statement_id, min(account_id) AS account_id, count(*) AS extracted, sum(CASE WHEN direction = 'Dr' THEN amount END) AS d,
    sum(CASE WHEN direction = 'Cr' THEN amount END) AS c FROM L GROUP BY statement_id),
  P AS (SELECT *, CAST(right(statement_id, 1) AS INT) AS p FROM S),
  C AS (SELECT statement_id, account_id, extracted, CASE WHEN d IS NOT NULL AND p % 3 = 1 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS debits_pct,
    100.0::DOUBLE AS credits_pct, d IS NOT NULL AND p % 3 = 1 AS has_warnings FROM P)"""


def _filtered(spark, sf):
    return summary.workbench_filter(
        rows(spark, sf), direction="Dr", counterparties=["1-URGENT", "2-HIGH", "5-LOW"], categories=["Food", "Bills"],
        tags=["seen", "cash"], needs_review=True, flagged=True, search=" Upi ",
    )


_FILTERED = f"""{X}, Y AS (SELECT * FROM X WHERE direction = 'Dr' AND counterparty IN ('1-URGENT', '2-HIGH', '5-LOW') AND category IN ('Food', 'Bills')
  AND len(tags) > 0 AND review_status <> 'reviewed' AND (review_status = 'flagged' OR len(flags) > 0))"""


def _balanced(spark, sf):
    base = rows(spark, sf).withColumns(
        {
            "opening_balance": F.when(F.col("account_id") % 2 == 0, F.lit(1000)).cast("decimal(18,2)"),
            "balance_after": F.when(F.col("id") % 9 == 0, F.col("id") % 1000).cast("decimal(18,2)"),
        }
    )
    return balances.running_balance(balances.with_row_index(base))


_BALANCED = X + """, I AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS row_index,
    CASE WHEN account_id % 2 = 0 THEN 1000 ELSE 0 END AS opening, CASE WHEN id % 9 = 0 THEN id % 1000 END AS after FROM X),
  G AS (SELECT *, count(after) OVER (PARTITION BY statement_id ORDER BY row_index) AS g FROM I),
  B AS (SELECT *, CAST(coalesce(max(after) OVER (PARTITION BY statement_id, g), opening) + sum(CASE WHEN after IS NOT NULL THEN 0
    WHEN direction = 'Cr' THEN amount ELSE -amount END) OVER (PARTITION BY statement_id, g ORDER BY row_index) AS DECIMAL(28,2)) AS running_balance FROM G)"""


def _patches(spark, sf):
    """Edits of every seventh transaction, some fields twice, and of unknown ids and fields."""
    ids = T.ledger(spark, sf).filter("id % 7 = 0").select("id")
    edit = lambda n, field, value: F.struct(F.lit(n).alias("patch_seq"), F.lit(field).alias("field"), value.alias("value"))
    edits = F.array(
        edit(1, "amount", (F.col("id") % 500 + 1).cast("string")),
        F.when(F.col("id") % 14 == 0, edit(2, "amount", (F.col("id") % 300 + 2).cast("string"))),
        F.when(F.col("id") % 21 == 0, edit(2, "direction", F.lit("Cr"))),
        F.when(F.col("id") % 35 == 0, edit(3, "review_status", F.lit("reviewed"))),
        F.when(F.col("id") % 35 == 0, edit(3, "unknown_field", F.lit("x"))),
        F.when(F.col("id") % 28 == 0, edit(4, "tags", F.lit('["typed","seen"]'))),
        F.when(F.col("id") % 49 == 0, edit(4, "txn_date", F.lit(None).cast("string"))),
        F.when(F.col("id") % 49 == 0, edit(4, "direction", F.lit(None).cast("string"))),
        F.when(F.col("id") % 63 == 0, edit(5, "entities", F.lit('{"counterparty":{"value":"Typed","source":"user_edited"}}'))),
    )
    return ids.select("id", F.inline(F.array_compact(edits)))


def _ledger_with_balance(spark, sf):
    found = F.struct(F.col("counterparty").alias("value"), F.lit("extracted").alias("source"))
    return _balanced(spark, sf).withColumns(
        {"edit_count": F.lit(0), "entities": F.create_map(F.lit("counterparty"), found)}
    )


_PATCHED = _BALANCED + """, P AS (SELECT *, CASE WHEN id % 14 = 0 THEN id % 300 + 2 WHEN id % 7 = 0 THEN id % 500 + 1 ELSE amount END AS new_amount,
    CASE WHEN id % 21 = 0 THEN 'Cr' ELSE direction END AS new_direction FROM B),
  D AS (SELECT *, (CASE WHEN new_direction = 'Cr' THEN new_amount ELSE -new_amount END) - (CASE WHEN direction = 'Cr' THEN amount ELSE -amount END) AS delta FROM P)"""

QUERIES = {
    "a1_case_counts": _case_counts,
    "a2_case_summary": lambda s, d: summary.case_summary(rows(s, d)),
    "a3_monthly_series": lambda s, d: summary.monthly_series(rows(s, d)),
    "a4_top_counterparties": lambda s, d: summary.top_counterparties(rows(s, d), 3),
    "a5_category_breakdown": lambda s, d: summary.category_breakdown(rows(s, d)),
    "a6_pattern_scoreboard": _scoreboard,
    "a22_scoreboard_split": lambda s, d: summary.scoreboard_split(summary.pattern_scoreboard(rows(s, d))),
    "a11_sum_check": _declared,
    "a20_account_counters": lambda s, d: summary.account_counters(_declared(s, d)),
    "a15_workbench_totals": lambda s, d: summary.workbench_totals(_filtered(s, d)),
    "a16_filter_options": lambda s, d: summary.filter_options(rows(s, d)),
    "f1_workbench_filter": lambda s, d: _filtered(s, d).select("id", "case_id", "amount"),
    "f2_flagged": lambda s, d: rows(s, d).filter(summary.is_flagged()).select("id"),
    "f3_case_rows": lambda s, d: summary.workbench_filter(rows(s, d), case_id=3).select("id"),
    "w8_statement_islands": lambda s, d: summary.statement_islands(rows(s, d)).select("id", "island"),
    "l1_transaction_page": lambda s, d: summary.transaction_page(balances.with_row_index(rows(s, d)), 50, 40).select("id", "statement_id", "row_index"),
    "w4_running_balance": lambda s, d: _balanced(s, d).select("id", "running_balance"),
    "w6_row_index": lambda s, d: balances.with_row_index(rows(s, d)).select("id", "row_index"),
    "m1_patch_transactions": lambda s, d: balances.patch_transactions(_ledger_with_balance(s, d), _patches(s, d)).select(
        "id", F.col("amount").cast("decimal(28,2)").alias("amount"), "direction", "review_status", "running_balance", "edit_count", "txn_date",
        F.array_join("tags", ",").alias("tags"), F.col("entities")["counterparty"]["value"].alias("party")),
    "m2_closing_balances": lambda s, d: balances.closing_balances(
        rows(s, d).groupBy("statement_id").agg(F.lit(0).cast("decimal(28,2)").alias("closing_balance")), _ledger_with_balance(s, d), _patches(s, d)),
    "m3_audit_events": lambda s, d: balances.audit_events(_ledger_with_balance(s, d), _patches(s, d)).filter("field <> 'amount' OR patch_seq = 2"),
    "m4_bulk_status": lambda s, d: balances.set_status(rows(s, d), rows(s, d).filter("id % 6 = 0"), "reviewed").select("id", "review_status"),
    "s8_ingest": lambda s, d: _ingest(s, d),
}


def _ingest(spark, sf):
    """From rendered statement texts to shaped ledger rows."""
    from casetrail.operators import parsing

    texts = R.statement_texts(spark, sf)
    statements = texts.select(
        "statement_id", F.col("statement_id").alias("account_id"), F.lit(1).alias("case_id"), F.lit(0).cast("decimal(18,2)").alias("opening_balance")
    )
    return balances.ingest(statements, parsing.parse_text(texts)).drop("flags")


ORACLES = {
    "a1_case_counts": f"""{X} SELECT CAST(n_nationkey AS BIGINT) AS case_id, count(DISTINCT statement_id) AS statements, count(id) AS transactions,
      CAST(coalesce(sum(len(flags)), 0) AS BIGINT) AS flags FROM nation LEFT JOIN X ON case_id = n_nationkey GROUP BY n_nationkey""",
    "a2_case_summary": f"""{X} SELECT case_id, CAST(sum(dr) AS DECIMAL(28,2)) AS total_dr, CAST(sum(cr) AS DECIMAL(28,2)) AS total_cr,
      CAST(sum(cr) - sum(dr) AS DECIMAL(28,2)) AS net, count(*) AS txn_count, CAST(sum(len(flags)) AS BIGINT) AS flag_count,
      count(*) FILTER (review_status = 'reviewed') AS reviewed_count, count(*) FILTER (review_status = 'unreviewed') AS unreviewed_count,
      count(*) FILTER (review_status = 'flagged') AS flagged_count FROM X GROUP BY case_id""",
    "a3_monthly_series": f"{X} SELECT case_id, coalesce(strftime(txn_date, '%Y-%m'), 'unknown') AS month, {_SUMS} FROM X GROUP BY 1, 2",
    "a4_top_counterparties": f"""{X}, R AS (SELECT case_id, counterparty AS name, {_SUMS}, min(seq) AS f FROM X GROUP BY 1, 2)
      SELECT * EXCLUDE (f) FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY count DESC, f) AS place FROM R) WHERE place <= 3""",
    "a5_category_breakdown": f"""{X}, R AS (SELECT case_id, coalesce(nullif(category, ''), 'Other') AS name, {_SUMS}, min(seq) AS f FROM X GROUP BY 1, 2)
      SELECT * EXCLUDE (f), row_number() OVER (PARTITION BY case_id ORDER BY count DESC, f) AS place FROM R""",
    "a6_pattern_scoreboard": f"{_BOARD} SELECT * FROM B",
    "a22_scoreboard_split": f"{_BOARD} SELECT case_id, count(*) FILTER (count > 0) AS hit, count(*) FILTER (count = 0) AS quiet, CAST(sum(count) AS BIGINT) AS total_hits FROM B GROUP BY case_id",
    "a11_sum_check": f"{_CHECKED} SELECT * FROM C",
    "a20_account_counters": f"{_CHECKED} SELECT account_id, CAST(sum(extracted) AS BIGINT) AS transaction_count, bool_or(has_warnings) AS has_warnings FROM C GROUP BY account_id",
    "a15_workbench_totals": f"{_FILTERED} SELECT case_id, CAST(sum(dr) AS DECIMAL(28,2)) AS debits, CAST(sum(cr) AS DECIMAL(28,2)) AS credits, count(*) AS flagged FROM Y GROUP BY case_id",
    "a16_filter_options": f"""{X} SELECT DISTINCT case_id, 'counterparty' AS kind, counterparty AS value FROM X UNION SELECT case_id, 'category', category FROM X WHERE category <> ''
      UNION SELECT case_id, 'tag', unnest(tags) FROM X""",
    "f1_workbench_filter": f"{_FILTERED} SELECT id, case_id, amount FROM Y",
    "f2_flagged": f"{X} SELECT id FROM X WHERE review_status = 'flagged' OR id % 7 = 0 OR id % 11 = 0 OR id % 13 = 0 OR id % 97 = 0",
    "f3_case_rows": f"{X} SELECT id FROM X WHERE case_id = 3",
    "w8_statement_islands": f"""{X}, Y AS (SELECT *, CASE WHEN lag(statement_id) OVER (PARTITION BY case_id ORDER BY seq) IS DISTINCT FROM statement_id THEN 1 ELSE 0 END AS b FROM X)
      SELECT id, CAST(sum(b) OVER (PARTITION BY case_id ORDER BY seq) AS BIGINT) AS island FROM Y""",
    "l1_transaction_page": f"""{X}, I AS (SELECT id, statement_id, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS row_index FROM X)
      SELECT * FROM I ORDER BY statement_id, row_index LIMIT 40 OFFSET 50""",
    "w4_running_balance": f"{_BALANCED} SELECT id, running_balance FROM B",
    "w6_row_index": f"{_BALANCED} SELECT id, row_index FROM B",
    "m1_patch_transactions": f"""{_PATCHED} SELECT id, CAST(new_amount AS DECIMAL(28,2)) AS amount, new_direction AS direction,
      CASE WHEN id % 35 = 0 THEN 'reviewed' ELSE review_status END AS review_status,
      CAST(running_balance + sum(delta) OVER (PARTITION BY statement_id ORDER BY row_index) AS DECIMAL(28,2)) AS running_balance,
      CASE WHEN id % 7 <> 0 THEN 0 ELSE 1 + CASE WHEN id % 14 = 0 OR id % 21 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 35 = 0 THEN 1 ELSE 0 END
        + CASE WHEN id % 28 = 0 OR id % 49 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 63 = 0 THEN 1 ELSE 0 END END AS edit_count,
      CASE WHEN id % 49 <> 0 THEN txn_date END AS txn_date, CASE WHEN id % 28 = 0 THEN 'typed,seen' ELSE coalesce(array_to_string(tags, ','), '') END AS tags,
      CASE WHEN id % 63 = 0 THEN 'Typed' ELSE counterparty END AS party FROM D""",
    "m2_closing_balances": f"{_PATCHED} SELECT statement_id, CAST(sum(delta) AS DECIMAL(28,2)) AS closing_balance FROM D GROUP BY statement_id",
    "m3_audit_events": f"""{X} SELECT id, 2 AS patch_seq, 'amount' AS field, CAST(id % 500 + 1 AS VARCHAR) AS old_value, CAST(id % 300 + 2 AS VARCHAR) AS new_value FROM X WHERE id % 14 = 0
      UNION ALL SELECT id, 2, 'direction', direction, 'Cr' FROM X WHERE id % 21 = 0
      UNION ALL SELECT id, 3, 'review_status', review_status, 'reviewed' FROM X WHERE id % 35 = 0
      UNION ALL SELECT id, 4, 'tags', '[' || array_to_string(list_transform(tags, lambda t: '"' || t || '"'), ',') || ']', '["typed","seen"]' FROM X WHERE id % 28 = 0
      UNION ALL SELECT id, 4, 'txn_date', CAST(txn_date AS VARCHAR), NULL FROM X WHERE id % 49 = 0
      UNION ALL SELECT id, 5, 'entities', '{{"counterparty":{{"value":"' || counterparty || '","source":"extracted"}}}}', '{{"counterparty":{{"value":"Typed","source":"user_edited"}}}}' FROM X WHERE id % 63 = 0""",
    "m4_bulk_status": f"{X} SELECT id, CASE WHEN id % 6 = 0 THEN 'reviewed' ELSE review_status END AS review_status FROM X",
}

# Layout 2 prints the balance after every row; the others start from the opening balance, which is 0 here.
ORACLES["s8_ingest"] = f"""WITH R AS (SELECT *, {text._DESC} AS x, sum(CASE type WHEN 'Cr' THEN amount ELSE -amount END) OVER (PARTITION BY statement_id ORDER BY j) AS moved FROM ({R.EXPECTED_SQL})),
  S AS (SELECT *, {text._CHANNEL} AS channel, {text._CATEGORY} AS category, {text._PARTY} AS counterparty FROM R)
  SELECT 1 AS case_id, statement_id AS account_id, statement_id, CAST(j + 1 AS INTEGER) AS row_index, strftime(txn_day, '%Y-%m-%d') AS txn_date, amount, type AS direction,
    CAST(CASE WHEN layout = 2 THEN {R.OPENING} ELSE 0 END + moved AS DECIMAL(28,2)) AS running_balance, x AS raw_description, channel, category, counterparty,
    CASE WHEN starts_with(counterparty, '(unknown') OR length(counterparty) < 3 THEN 'low' WHEN channel = 'OTHER' THEN 'medium' ELSE 'high' END AS confidence, 'unreviewed' AS review_status, 0 AS edit_count FROM S"""
