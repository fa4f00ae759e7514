"""Model responses rendered from the customers' orders, with SQL checks against the orders themselves.

An extraction is a customer. Three slots answer: one in plain JSON; one in a code fence, without urgent
orders; one with prose around it, cut off for customers of BUILDING, failed for those of MACHINERY.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casetrail.operators import responses as R
from casetrail.sources import shared_tables as T

_PARTY = "CASE WHEN o_orderpriority = '5-LOW' THEN ' Unknown' WHEN o_orderpriority = '1-URGENT' THEN 'Unknown' WHEN o_orderstatus = 'P' THEN ' ' ELSE ' Shop ' || o_orderpriority END"
_SLOTS = (("claude", "claude", "claude-sonnet-4-5-20260101"), ("gemini:gemini-2.5-pro", "gemini", "Gemini-2.5-Pro"), ("gemini:gemini-2.5-flash", "gemini", "gemini-2.5-flash"))


def _orders(spark, sf):
    return T.table(spark, sf, "orders").selectExpr(
        "o_custkey AS extraction_id", "o_orderkey", "o_orderpriority AS p", "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'debit' ELSE 'Credit' END AS direction", f"{_PARTY} AS counterparty", "CASE WHEN o_orderstatus = 'O' THEN 'upi' END AS channel", "o_orderstatus = 'F' AS is_self_transfer",
    )


def attempts(spark, sf):
    """One row for each customer and slot."""
    row = F.struct("o_orderkey", "p", F.struct("date", "amount", "direction", "counterparty", "channel", "is_self_transfer").alias("t"))
    told = _orders(spark, sf).groupBy("extraction_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    people = T.table(spark, sf, "customer").selectExpr("c_custkey AS extraction_id", "c_name", "c_mktsegment AS segment", "CAST(c_acctbal AS DECIMAL(18,2)) AS balance", "c_nationkey")
    slots = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(s).alias("slot"), F.lit(p).alias("provider"), F.lit(m).alias("model")) for k, (s, p, m) in enumerate(_SLOTS)])
    base = people.join(told, "extraction_id", "left").select("*", F.inline(slots))
    rows = F.coalesce(F.col("rows"), F.array().cast("array<struct<o_orderkey:bigint,p:string,t:struct<date:string,amount:decimal(18,2),direction:string,counterparty:string,channel:string,is_self_transfer:boolean>>>"))
    some = F.transform(F.when(F.col("seq") == 1, F.filter(rows, lambda r: r["p"] != "1-URGENT")).otherwise(rows), lambda r: r["t"])
    body = F.to_json(
        F.struct(
            F.struct(F.when(F.col("seq") == 0, F.lit("hdfc")).when(F.col("c_nationkey") > 9, F.lit("icici")).alias("key")).alias("bank"),
            F.struct(F.when(F.col("seq") == 2, F.upper("c_name")).otherwise(F.col("c_name")).alias("holder_name")).alias("account"),
            F.struct(F.col("balance").alias("opening")).alias("balance"),
            F.when(F.col("seq") < 2, F.array(F.struct(F.lit("gap").alias("type")))).alias("anomalies"),
            some.alias("transactions"),
        )
    )
    failed = (F.col("seq") == 2) & (F.col("segment") == "MACHINERY")
    raw = (
        F.when(F.col("seq") == 0, body)
        .when(F.col("seq") == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone {ok}.")))
        .when(F.col("segment") == "BUILDING", F.concat(F.lit("Result: "), F.substring(body, 1, 40), F.lit("}")))
        .otherwise(F.concat(F.lit("Result: "), body, F.lit(" That is all.")))
    )
    return base.select(
        "extraction_id", "seq", "slot", "provider", "model", F.when(~failed, raw).alias("raw"), F.when(failed, "429").alias("provider_error"),
        F.when(~failed, F.col("extraction_id") * 10 + 100).alias("prompt_tokens"), F.when(~failed, F.col("extraction_id") + F.col("seq")).alias("completion_tokens"),
        (F.col("extraction_id") % 100 + 5).alias("latency_ms"), F.format_string("2026-%02d-01T00:00:0%d", F.col("c_nationkey") % 12 + 1, F.col("seq")).alias("created_at"),
    )


def _read(spark, sf):
    return R.read_responses(attempts(spark, sf))


def _primary_rows(spark, sf):
    """Rows of the first Gemini response that could be read."""
    read = _read(spark, sf).filter("parsed IS NOT NULL")
    return R.response_rows(R.primary_slots(read, ("gemini-2.5-flash", "gemini"), "parsed"), "extraction_id")


def _overlay(spark, sf):
    ours = _orders(spark, sf).select(
        "extraction_id", "o_orderkey", "date", "amount", F.lower("direction").alias("direction"), F.lit("ours").alias("counterparty"), F.lit("OTHER").alias("channel"))
    placed = ours.withColumn("row_index", F.row_number().over(Window.partitionBy("extraction_id").orderBy("o_orderkey")))
    return R.overlay(placed, _primary_rows(spark, sf)).select("extraction_id", "o_orderkey", "counterparty", "channel", "is_self_transfer", "overlaid", "count_match")


_A = f"""WITH S(seq, slot, provider, model) AS (VALUES {", ".join(f"({k}, '{s}', '{p}', '{m}')" for k, (s, p, m) in enumerate(_SLOTS))}),
  A AS (SELECT c_custkey AS extraction_id, S.*, c_name, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_nationkey, seq = 2 AND c_mktsegment = 'MACHINERY' AS failed, seq = 2 AND c_mktsegment = 'BUILDING' AS broken,
    CASE WHEN NOT (seq = 2 AND c_mktsegment = 'MACHINERY') THEN c_custkey * 10 + 100 END AS pt, CASE WHEN NOT (seq = 2 AND c_mktsegment = 'MACHINERY') THEN c_custkey + seq END AS ct, c_custkey % 100 + 5 AS ms,
    printf('2026-%02d-01T00:00:0%d', c_nationkey % 12 + 1, seq) AS created_at FROM customer, S),
  P AS (SELECT *, CAST(round(CAST(pt * CASE seq WHEN 0 THEN 3.00 WHEN 1 THEN 1.25 ELSE 0.30 END + ct * CASE seq WHEN 0 THEN 15.00 WHEN 1 THEN 10.00 ELSE 2.50 END AS DECIMAL(28,2)), 0) AS BIGINT) AS micro,
    CAST(micro * 0.000001::DECIMAL(8,6) AS DECIMAL(18,6)) AS cost FROM A),
  O AS (SELECT o_custkey AS extraction_id, o_orderkey, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderkey % 2 = 0 AS debit, {_PARTY} AS counterparty,
    CASE WHEN o_orderstatus = 'O' THEN 'upi' END AS channel, o_orderstatus = 'F' AS own FROM orders),
  R AS (SELECT A.extraction_id, seq, O.* EXCLUDE (extraction_id) FROM A JOIN O USING (extraction_id) WHERE NOT failed AND NOT broken AND (seq <> 1 OR p <> '1-URGENT'))"""

QUERIES = {
    "e20_parse_responses": lambda s, d: _read(s, d).select("extraction_id", "slot", F.col("parsed").isNotNull().alias("read"), "parse_error"),
    "e21_normalised_responses": lambda s, d: R.normalised(_read(s, d), "extraction_id", "slot").select(
        "extraction_id", "slot", "bank_key", "bank_label", "holder_name", "opening", "closing", "currency", "transaction_count", "total_debit", "total_credit", "net_change", "anomaly_count"),
    "s5_response_rows": lambda s, d: R.response_rows(_read(s, d), "extraction_id", "slot").select("extraction_id", "slot", "pos", "date", "amount", "direction", "counterparty", "channel", "is_self_transfer"),
    "e22_attempt_costs": lambda s, d: R.attempts_of(attempts(s, d)).select("extraction_id", "slot", "place", "cost_usd", "total_cost_usd"),
    "a17_cost_summary": lambda s, d: R.cost_summary(_read(s, d), "2026-02-01", "2026-11-01"),
    "a18_provider_agreement": lambda s, d: R.agreement(_read(s, d)).select("extraction_id", "field", "distinct_count", "unanimous",
        F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit("="), F.array_join(v["reporters"], "+"))), ";").alias("values")),
    "j6_model_overlay": _overlay,
    "m7_primary_response": lambda s, d: R.primary_slots(_read(s, d).filter("parsed IS NOT NULL"), ("gemini-2.5-flash", "gemini", "claude")),
    "m8_final_choice": lambda s, d: R.final_choice(
        T.table(s, d, "customer").select(F.col("c_custkey").alias("extraction_id")).join(_orders(s, d).filter("amount > 400000").groupBy("extraction_id").agg(F.count(F.lit(1)).alias("parsed_rows")), "extraction_id", "left"),
        R.primary_slots(_read(s, d).filter("parsed IS NOT NULL AND slot <> 'claude'"), ("gemini:gemini-2.5-flash",))),
    "f7_failed_attempts": lambda s, d: R.attempt_list(_read(s, d), "gemini", None, True).select("extraction_id", "slot", "provider_error", "parse_error"),
    "f8_slot_filter": lambda s, d: attempts(s, d).filter(R.slot_matches(F.col("slot"), [" Gemini-2.5-P ", "clau"])).select("extraction_id", "slot"),
}

_FLASH = "CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN 1 ELSE 2 END"
ORACLES = {
    "e20_parse_responses": f"{_A} SELECT extraction_id, slot, NOT failed AND NOT broken AS read, CASE WHEN broken THEN 'invalid JSON' END AS parse_error FROM A",
    "e21_normalised_responses": f"""{_A}, T AS (SELECT extraction_id, seq, count(*) AS n, coalesce(sum(amount) FILTER (debit), 0) AS dr, coalesce(sum(amount) FILTER (NOT debit), 0) AS cr FROM R GROUP BY ALL)
      SELECT extraction_id, slot, CASE WHEN seq = 0 THEN 'hdfc' WHEN c_nationkey > 9 THEN 'icici' ELSE 'unknown' END AS bank_key, 'Unknown' AS bank_label, CASE WHEN seq = 2 THEN upper(c_name) ELSE c_name END AS holder_name, balance AS opening,
        CAST(NULL AS DECIMAL(18,2)) AS closing, 'INR' AS currency, CAST(coalesce(n, 0) AS INTEGER) AS transaction_count, CAST(coalesce(dr, 0) AS DECIMAL(28,2)) AS total_debit, CAST(coalesce(cr, 0) AS DECIMAL(28,2)) AS total_credit,
        CAST(coalesce(cr - dr, 0) AS DECIMAL(28,2)) AS net_change, CASE WHEN seq < 2 THEN 1 ELSE 0 END AS anomaly_count FROM A LEFT JOIN T USING (extraction_id, seq) WHERE NOT failed AND NOT broken""",
    "s5_response_rows": f"""{_A} SELECT extraction_id, slot, CAST(row_number() OVER (PARTITION BY extraction_id, seq ORDER BY o_orderkey) AS INTEGER) AS pos, date, amount, CASE WHEN debit THEN 'debit' ELSE 'Credit' END AS direction, counterparty, channel,
      own AS is_self_transfer FROM R JOIN S USING (seq)""",
    "e22_attempt_costs": f"{_A} SELECT extraction_id, slot, CAST(seq + 1 AS INTEGER) AS place, cost AS cost_usd, CAST(sum(cost) OVER (PARTITION BY extraction_id) AS DECIMAL(18,6)) AS total_cost_usd FROM P",
    "a17_cost_summary": f"""{_A} SELECT CASE WHEN GROUPING(provider) = 0 THEN 'provider' WHEN GROUPING(model) = 0 THEN 'model' ELSE 'total' END AS level, coalesce(provider, model) AS key, count(*) AS calls,
      count(*) FILTER (NOT failed AND NOT broken) AS successes, count(*) FILTER (failed OR broken) AS errors, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens, CAST(sum(ms) AS BIGINT) AS total_latency_ms,
      CAST(coalesce(sum(cost), 0) AS DECIMAL(28,6)) AS cost_usd, round(sum(ms) / count(*), 1) AS avg_latency_ms, CAST(CAST(round(sum(micro) / count(*)) AS BIGINT) * 0.000001::DECIMAL(8,6) AS DECIMAL(18,6)) AS avg_cost_usd
      FROM P WHERE created_at >= '2026-02-01' AND created_at < '2026-11-01' GROUP BY GROUPING SETS ((provider), (model), ())""",
    "a18_provider_agreement": f"""{_A}, T AS (SELECT extraction_id, seq, count(*) AS n, count(*) FILTER (own) AS own FROM R GROUP BY ALL), V AS (SELECT A.*, n, own FROM A LEFT JOIN T USING (extraction_id, seq) WHERE NOT failed AND NOT broken),
      L AS (SELECT extraction_id, seq, provider || ':' || model AS who, unnest([ROW('txn_count', CAST(coalesce(n, 0) AS VARCHAR)), ROW('bank_key', CASE WHEN seq = 0 THEN 'hdfc' WHEN c_nationkey > 9 THEN 'icici' END),
        ROW('holder_name', CASE WHEN seq = 2 THEN upper(c_name) ELSE c_name END), ROW('opening_balance', CAST(balance AS VARCHAR)), ROW('anomaly_count', CASE WHEN seq < 2 THEN '1' END), ROW('self_transfer_rows', CAST(CASE WHEN n > 0 THEN own END AS VARCHAR))]) AS f FROM V),
      G AS (SELECT extraction_id, f[1] AS field, f[2] AS value, min(seq) AS first, count(*) AS n, string_agg(who, '+' ORDER BY seq) AS who FROM L WHERE f[2] IS NOT NULL GROUP BY ALL)
      SELECT extraction_id, field, CAST(count(*) AS INTEGER) AS distinct_count, count(*) = 1 AND max(n) > 1 AS unanimous, string_agg(value || '=' || who, ';' ORDER BY first) AS "values" FROM G GROUP BY ALL""",
    "j6_model_overlay": f"""{_A}, F AS (SELECT R.* FROM R JOIN customer ON c_custkey = extraction_id WHERE seq = CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 1 ELSE 2 END),
      N AS (SELECT extraction_id, count(*) AS m FROM F GROUP BY 1), D AS (SELECT extraction_id, count(*) AS d FROM O GROUP BY 1),
      I AS (SELECT extraction_id, date, amount, debit, min(o_orderkey) AS k FROM F GROUP BY ALL)
      SELECT O.extraction_id, O.o_orderkey, CASE WHEN trim(F.counterparty) <> '' AND lower(F.counterparty) <> 'unknown' THEN trim(F.counterparty) ELSE 'ours' END AS counterparty, coalesce(F.channel, 'OTHER') AS channel,
        F.own AS is_self_transfer, F.o_orderkey IS NOT NULL AS overlaid, CASE WHEN m IS NOT NULL THEN m = d END AS count_match
      FROM O JOIN D USING (extraction_id) LEFT JOIN N USING (extraction_id) LEFT JOIN I ON I.extraction_id = O.extraction_id AND I.date = O.date AND I.amount = O.amount AND I.debit = O.debit
      LEFT JOIN F ON F.extraction_id = O.extraction_id AND F.o_orderkey = CASE WHEN m = d THEN O.o_orderkey ELSE I.k END""",
    "m7_primary_response": f"{_A} SELECT extraction_id, slot FROM A WHERE seq = {_FLASH}",
    "m8_final_choice": f"""{_A}, B AS (SELECT extraction_id, count(*) AS n FROM O WHERE amount > 400000 GROUP BY 1)
      SELECT extraction_id, CASE WHEN n > 0 OR segment IN ('MACHINERY', 'BUILDING') THEN 'deterministic' ELSE 'model' END AS choice,
        CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN 'deterministic' WHEN n > 0 THEN 'deterministic+gemini:gemini-2.5-flash' ELSE 'llm-gemini:gemini-2.5-flash' END AS source FROM A LEFT JOIN B USING (extraction_id) WHERE seq = 0""",
    "f7_failed_attempts": f"{_A} SELECT extraction_id, slot, CASE WHEN failed THEN '429' END AS provider_error, CASE WHEN broken THEN 'invalid JSON' END AS parse_error FROM A WHERE failed OR broken",
    "f8_slot_filter": f"{_A} SELECT extraction_id, slot FROM A WHERE seq < 2",
}
