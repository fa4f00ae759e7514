"""Intake of pages as files and logs of calls that tell of customers and their orders, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import extractions as X
from casetrail.operators import graph as G
from casetrail.operators import responses as R
from casetrail.operators import tables as U
from casetrail.sources import shared_tables as T
from catalog import responses, traversal

_FILE = """page_id, CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'notes.txt' ELSE 'P' || page_id || '.PDF' END AS filename, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'Application/PDF' WHEN 2 THEN '' END AS content_type,
  CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 3 = 0 THEN html ELSE '%PDF-' || html END AS content"""


def _files(spark, sf):
    files = T.table(spark, sf, "pages").selectExpr(f"struct({_FILE}) AS f").select("f.*")
    return X.checked_files(files.withColumn("content", F.encode("content", "UTF-8")), 20_000)


# The log of one call a customer: every fifth call failed, every seventh response is broken.
_CALL = (
    "c_custkey AS extraction_id", "c_custkey % 5 <> 0 AS success", "c_mktsegment AS submitter_label", "'Agent ' || repeat(c_name, 40) AS user_agent",
    "'T' || c_custkey AS received_at", "'x' AS stored_path",
)


def _log(spark, sf):
    found = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("o_orderstatus").alias("kinds"))
    calls = T.table(spark, sf, "customer").join(found, "c_custkey", "left")
    body = F.to_json(F.struct(
        F.struct((F.col("c_custkey") % 9).alias("page_count"), F.array_sort("kinds").alias("issues")).alias("meta"),
        F.when(F.col("c_nationkey") > 9, F.struct(F.when(F.col("c_nationkey") > 12, F.lit("icici")).otherwise(F.lit("hdfc")).alias("key"))).alias("bank"),
        F.struct(F.col("n").alias("transaction_count")).alias("summary")))
    response = F.when(F.expr("c_custkey % 7 = 0"), F.lit('{"meta":')).when(F.expr("c_custkey % 5 <> 0"), body)
    return X.log_rows(calls.select("*", response.alias("response")).selectExpr(*_CALL, "response"))


def _trace(spark, sf):
    """Documents as the texts of traces, every sixth without one, their labels as the rows."""
    texts = T.table(spark, sf, "documents").select("doc_id", F.when(F.expr("doc_id % 6 <> 5"), F.col("text")).alias("text"))
    rows = T.table(spark, sf, "labels").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("quality", "toxic"))).alias("raw_rows"))
    return X.trace_rows(texts.join(rows, "doc_id", "left"))


def _page(spark, sf):
    return U.newest_page(X.log_list(X.filter_log(_log(spark, sf), True, "icici", "BUILDING")), "received_at", "extraction_id", 15, 5).withColumn("issues", F.array_join("issues", ","))


_CONTEXT = """o_custkey AS statement_id, o_orderkey AS seq, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'debit' WHEN o_orderkey % 3 = 1 THEN '' END AS direction,
  'Dr' AS type, repeat(o_orderpriority, 30) AS description"""


def _context(spark, sf):
    rows = T.table(spark, sf, "orders").selectExpr(f"struct({_CONTEXT}, o_orderstatus AS st) AS r").select("r.*")
    rule = F.when(F.col("st") == "F", "upi").when(F.col("st") == "O", "unmatched")
    none = F.lit(None).cast("string")
    return R.contexts(rows.withColumn("decoded", F.create_map(F.lit("matched_rule"), rule, F.lit("party"), F.col("date"), F.lit("ref"), F.lit(""), F.lit("vpa"), none)))


_F = f"WITH F AS (SELECT {_FILE} FROM pages)"
_CHECK = """SELECT page_id, coalesce(octet_length(encode(content)), 0) AS file_size, CASE WHEN filename IS NULL THEN 'MISSING_FILE' WHEN filename = 'notes.txt' OR content_type = 'text/html' THEN 'INVALID_FILE_TYPE'
  WHEN coalesce(content, '') = '' THEN 'EMPTY_FILE' WHEN octet_length(encode(content)) > 20000 THEN 'FILE_TOO_LARGE' WHEN NOT starts_with(content, '%PDF-') THEN 'INVALID_PDF_SIGNATURE' END AS error_code, content FROM F"""
_C = f"""WITH N AS (SELECT o_custkey, CAST(count(*) AS INTEGER) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY 1),
  C AS (SELECT {", ".join(_CALL)}, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AS told, c_nationkey, n, kinds FROM customer LEFT JOIN N ON o_custkey = c_custkey),
  G AS (SELECT *, CASE WHEN told AND c_nationkey > 12 THEN 'icici' WHEN told AND c_nationkey > 9 THEN 'hdfc' END AS bank_key_detected FROM C)"""

QUERIES = {
    "s2_checked_files": lambda s, d: _files(s, d).select("page_id", "file_size", "error_code", "http_status"),
    "s3_new_archive": lambda s, d: X.new_archive(_files(s, d), _files(s, d).filter("page_id % 4 = 0")).select("file_hash", "stored_path", F.octet_length("content").alias("n_bytes")),
    "s10_log_rows": lambda s, d: _log(s, d).select("extraction_id", "bank_key_detected", "page_count", "transaction_count", F.array_join("issues", ",").alias("issues"), F.length("user_agent").alias("agent_chars")),
    "s11_trace_rows": lambda s, d: _trace(s, d).select("doc_id", "text_char_count", "raw_rows"),
    "s12_attempt_facts": lambda s, d: X.attempt_facts(responses._read(s, d)).select("extraction_id", "slot", "extracted_txn_count", "extracted_bank_key", "extracted_holder_name", "confidence"),
    "f6_filtered_log": lambda s, d: X.filter_log(_log(s, d), False, "", "MACHINERY").select("extraction_id"),
    "f12_log_page": _page,
    "m9_model_context": _context,
    "f9_transfer_sides": lambda s, d: G.sides(traversal.transfers(s, d, traversal.LEAST)).select("address", "side", "value", "seq"),
    "f13_lookup": lambda s, d: X.lookup(_log(s, d).select("extraction_id", "submitter_label", "response"), "extraction_id", 13, response="summary struct<transaction_count:int>").select(
        "extraction_id", "submitter_label", F.col("response.summary.transaction_count").alias("n")),
}

ORACLES = {
    "s2_checked_files": f"""{_F}, K AS ({_CHECK}) SELECT page_id, CAST(file_size AS INTEGER) AS file_size, error_code, CASE WHEN error_code IS NULL THEN 200 WHEN error_code IN ('MISSING_FILE', 'EMPTY_FILE') THEN 400 WHEN error_code = 'FILE_TOO_LARGE' THEN 413 ELSE 415 END AS http_status FROM K""",
    "s3_new_archive": f"""{_F}, K AS ({_CHECK}), H AS (SELECT page_id, sha256(content) AS h, file_size FROM K WHERE error_code IS NULL)
      SELECT DISTINCT h AS file_hash, h[1:2] || '/' || h[3:4] || '/' || h || '.pdf' AS stored_path, CAST(file_size AS INTEGER) AS n_bytes FROM H WHERE h NOT IN (SELECT h FROM H WHERE page_id % 4 = 0)""",
    "s10_log_rows": f"""{_C} SELECT extraction_id, bank_key_detected, CASE WHEN told THEN CAST(extraction_id % 9 AS INTEGER) END AS page_count, CASE WHEN told THEN n END AS transaction_count, CASE WHEN told THEN coalesce(kinds, '') ELSE '' END AS issues,
      CAST(least(500, length(user_agent)) AS INTEGER) AS agent_chars FROM G""",
    "s11_trace_rows": """WITH R AS (SELECT doc_id, '[' || string_agg('{"quality":' || quality || ',"toxic":' || toxic || '}', ',' ORDER BY quality, toxic) || ']' AS raw_rows FROM labels GROUP BY 1)
      SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE CAST(coalesce(length(text), 0) AS INTEGER) END AS text_char_count, raw_rows FROM documents LEFT JOIN R USING (doc_id)""",
    "s12_attempt_facts": f"""{responses._A}, T AS (SELECT extraction_id, seq, count(*) AS n FROM R GROUP BY ALL)
      SELECT extraction_id, slot, CASE WHEN NOT failed AND NOT broken THEN CAST(coalesce(n, 0) AS INTEGER) END AS extracted_txn_count, CASE WHEN failed OR broken THEN NULL WHEN seq = 0 THEN 'hdfc' WHEN c_nationkey > 9 THEN 'icici' END AS extracted_bank_key,
        CASE WHEN failed OR broken THEN NULL WHEN seq = 2 THEN upper(c_name) ELSE c_name END AS extracted_holder_name, CAST(NULL AS VARCHAR) AS confidence FROM A LEFT JOIN T USING (extraction_id, seq)""",
    "f6_filtered_log": f"{_C} SELECT extraction_id FROM C WHERE NOT success AND submitter_label = 'MACHINERY'",
    "f12_log_page": f"""{_C} SELECT extraction_id, success, submitter_label, received_at, bank_key_detected, CAST(extraction_id % 9 AS INTEGER) AS page_count, n AS transaction_count, coalesce(kinds, '') AS issues, count(*) OVER () AS total
      FROM G WHERE success AND bank_key_detected = 'icici' AND submitter_label = 'BUILDING' ORDER BY received_at DESC, extraction_id DESC LIMIT 15 OFFSET 5""",
    "m9_model_context": f"""WITH X AS (SELECT {_CONTEXT}, o_orderstatus AS st FROM orders) SELECT statement_id, CAST(count(*) AS INTEGER) AS row_count, '[' || string_agg('{{"date":' || coalesce('"' || date || '"', 'null') || ',"amount":' || amount || ',"direction":"' ||
      CASE WHEN direction <> '' THEN direction ELSE 'Dr' END || '","description":"' || description[1:200] || '"' || CASE WHEN st = 'F' THEN ',"decoded":{{"party":"' || date || '"}}' ELSE '' END || '}}', ',' ORDER BY seq) || ']' AS context FROM X GROUP BY 1""",
    "f9_transfer_sides": f"WITH {traversal._sql(traversal.LEAST)} SELECT lower(source) AS address, 'out' AS side, value, seq FROM E UNION ALL SELECT lower(target), 'in', value, seq FROM E",
    "f13_lookup": f"{_C} SELECT extraction_id, submitter_label, CASE WHEN told THEN n END AS n FROM C WHERE extraction_id = 13",
}
