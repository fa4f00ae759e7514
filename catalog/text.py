"""Scalar functions (E1-E19, E23-E26) and statement text (P1-P20) with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import dates, display, enrich, headers, names, risk
from casetrail.operators import containment, parsing, preview
from casetrail.sources import rendered as R
from casetrail.sources import shared_tables as T
from catalog import narrations as NAR

doc = lambda s, d: T.table(s, d, "documents")


def _alternation(words) -> str:
    return "|".join(words)


def _contains_case(column: str, cases, default: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'"
        for label, words in cases
    )
    return f"CASE {whens} ELSE {default} END"


_CATEGORY = _contains_case("upper(x)", enrich.CATEGORY_KEYWORDS, "'Other'")
_CHANNEL = f"coalesce(nullif(upper(regexp_extract(x, '(?i)\\b({_alternation(enrich.CHANNEL_TOKENS)})\\b', 1)), ''), 'OTHER')"
_PARTY = (
    "coalesce(nullif(left(trim(regexp_extract(trim(regexp_replace(regexp_replace(regexp_replace(x, "
    "'(?i)^(UPI|NEFT|IMPS|RTGS|POS|ATM)[-/\\s]*', ''), '[-/]\\d{6,}.*$', ''), '-\\d{4}-\\d{10,}', '', 'g')), "
    "'^[^-/@]*')), 50), ''), '(unknown)')"
)
_LETTERS = "length(regexp_replace({p}, '[^\\p{{L}}]', '', 'g'))"
_DIGITS = "length(regexp_replace({p}, '[^\\p{{Nd}}]', '', 'g'))"
_NAMELIKE = (
    "list_filter(list_transform(string_split_regex(regexp_replace(trim(x), "
    "'(?i)^(UPI|NEFT|IMPS|RTGS|POS|ATM|ECS|NACH|CHQ|CHEQUE)[\\s\\-/:]*', ''), '[/|]'), lambda p: trim(p)), lambda p: "
    f"NOT regexp_matches(p, '(?i)^({_alternation(enrich.NOISE_WORDS)})$') AND {_LETTERS.format(p='p')} >= 3 "
    f"AND {_DIGITS.format(p='p')} <= {_LETTERS.format(p='p')})[1]"
)
_PARTY2 = (
    f"CASE WHEN {_NAMELIKE} IS NOT NULL THEN left(coalesce(nullif(trim(regexp_replace({_NAMELIKE}, '[-\\s]+\\d{{6,}}.*$', '')), ''), {_NAMELIKE}), 80) "
    f"WHEN {_PARTY} <> '(unknown)' THEN {_PARTY} ELSE coalesce(nullif(left(x, 60), ''), '(unknown)') END"
)
_STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)
KEY_SQL = (
    "array_to_string(list_sort(list_transform(list_sort(list_transform(list_filter(string_split_regex("
    "regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+$') "
    f"AND w NOT IN ({_STOP})), lambda w: lpad(CAST(100000 - length(w) AS VARCHAR), 6, '0') || w))[1:3], lambda w: substr(w, 7))), ' ')"
)
_VOCAB = list(names.ENTITY_TYPE_KEYWORDS.items())
_TYPE = _contains_case("lower(x)", _VOCAB, "NULL")


def _narr(select: str) -> str:
    return NAR.SQL + f", n AS (SELECT *, description AS x FROM x) SELECT id, ln, {select} FROM n"




X = lambda: F.col("description")  # noqa: E731 - a Column needs a session

_DATE_FORMS = (
    "CASE o_orderkey % 8 WHEN 0 THEN {f0} WHEN 1 THEN {f1} WHEN 2 THEN {f2} WHEN 3 THEN {f3} WHEN 4 THEN {f4} "
    "WHEN 5 THEN {f5} WHEN 6 THEN 'not a date' ELSE '' END"
)
_PY = ("%d/%m/%Y", "%d/%m/%y", "%d-%m-%Y", "%d-%m-%y", "%d %b %y", "%d %b %Y")
_JV = ("dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd-MM-yy", "dd MMM yy", "dd MMM yyyy")
_SPARK_DATES = _DATE_FORMS.format(**{f"f{i}": f"date_format(d, '{f}')" for i, f in enumerate(_JV)})
_DUCK_DATES = _DATE_FORMS.format(**{f"f{i}": f"strftime(d, '{f}')" for i, f in enumerate(_PY)})


def _dates(spark, sf):
    return T.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "to_date(o_orderdate) AS d"
    ).selectExpr("o_orderkey AS id", f"{_SPARK_DATES} AS raw")


def _dates_sql(good: tuple[int, ...], fmt: str) -> str:
    picks = ", ".join(map(str, good))
    return f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 IN ({picks}) THEN strftime(d, '{fmt}') ELSE {_DUCK_DATES} END AS value
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def _moments(spark, sf):
    raw = (
        "CASE event_id % 7 WHEN 0 THEN CAST(unix_seconds(t) AS STRING) WHEN 1 THEN CAST(unix_millis(t) AS STRING) "
        "WHEN 2 THEN date_format(t, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 3 THEN date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") "
        "WHEN 4 THEN date_format(t, 'yyyy-MM-dd HH:mm:ss') WHEN 5 THEN date_format(t, \"yyyy-MM-dd'T'HH:mm:ss\") || '+0530' "
        "ELSE 'soon' END"
    )
    rows = T.table(spark, sf, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS t").selectExpr(
        "event_id AS id", f"{raw} AS raw"
    )
    return rows.select("id", F.unix_micros(dates.parse_moment(F.col("raw"))).alias("micros"))


_MOMENTS = """SELECT event_id AS id, CASE event_id % 7 WHEN 1 THEN epoch_us(date_trunc('millisecond', ts))
   WHEN 3 THEN epoch_us(ts) WHEN 5 THEN epoch_us(date_trunc('second', ts)) - 19800000000 WHEN 6 THEN NULL
   ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events"""


def _flags(spark, sf):
    rows = NAR.narrations(spark, sf).withColumn("party", enrich.infer_counterparty(X())).withColumn(
        "channel", enrich.infer_channel(X())
    )
    own = F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False)
    return rows.select(
        "id", "ln", enrich.confidence(F.col("party"), F.col("channel")).alias("confidence"),
        F.array_join(enrich.intake_flags(F.col("party"), own), ",").alias("flags"),
    )


def _entities(spark, sf):
    given = F.when(F.col("id") % 2 == 0, F.col("nm"))
    rows = NAR.narrations(spark, sf).withColumn("channel", enrich.infer_channel(X())).withColumn(
        "party", enrich.prefer(given, enrich.infer_counterparty(X()))
    )
    level = enrich.confidence(F.col("party"), F.col("channel"))
    built = rows.withColumn(
        "m",
        enrich.entities_map(
            F.col("channel"), F.col("party"), enrich.infer_category(X()), F.col("id") % 2 == 0, level
        ),
    )
    flat = built.select("id", "ln", F.explode("m").alias("name", "v"))
    return flat.select("id", "ln", "name", "v.value", "v.source", "v.confidence")


_ENTITIES = NAR.SQL + f""",
  n AS (SELECT *, description AS x FROM x),
  b AS (SELECT id, ln, {_CHANNEL} AS channel, {_CATEGORY} AS category, id % 2 = 0 AS g,
        CASE WHEN id % 2 = 0 THEN nm ELSE {_PARTY} END AS party FROM n),
  c AS (SELECT *, CASE WHEN starts_with(party, '(unknown') OR length(party) < 3 THEN 'low' WHEN channel = 'OTHER' THEN 'medium' ELSE 'high' END AS level FROM b)
  SELECT id, ln, 'channel' AS name, channel AS value, 'extracted' AS source, CASE WHEN channel <> 'OTHER' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM c
  UNION ALL SELECT id, ln, 'category', category, 'auto_resolved', 0.7::DOUBLE FROM c
  UNION ALL SELECT id, ln, 'counterparty', party, CASE WHEN g THEN 'llm_overlay' ELSE 'extracted' END,
    CASE WHEN g THEN 0.95::DOUBLE WHEN level = 'high' THEN 0.9::DOUBLE WHEN level = 'medium' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END FROM c"""


def _parsed(bank):
    def run(spark, sf):
        rows = parsing.parse_text(R.statement_texts(spark, sf))
        if bank:
            rows = rows.filter(F.col("bank") == bank)
        return rows.select(
            "statement_id", "date", "description", F.col("amount").cast("double").alias("amount"), "type",
            F.col("balance").cast("double").alias("balance"),
        )

    return run


_DESC = """CASE layout WHEN 0 THEN 'SHOP ' || st || ' ITEM' || j
   WHEN 1 THEN 'UPI/' || upper(type) || '/' || k12 || '/SHOP ' || st || '/HDFC' WHEN 2 THEN k12 || '-TPT-SHOP ' || st || ' BRANCH COPY'
   WHEN 3 THEN 'BIL/INFT/' || k12 || '/SHOP ' || st || '/' WHEN 4 THEN 'UPI/SHOP ' || st || '/' || j || ' MORE TEXT'
   ELSE 'SHOP ' || st || ' ITEM' || j END"""
_BAL = """CASE WHEN layout = 2 THEN CAST(9000000 + sum(CASE type WHEN 'Cr' THEN amount ELSE -amount END)
   OVER (PARTITION BY statement_id ORDER BY j) AS DOUBLE) END"""


def _parsed_sql(layout: int | None) -> str:
    where = "" if layout is None else f" WHERE layout = {layout}"
    return f"""SELECT statement_id, strftime(txn_day, '%d/%m/%Y') AS date, {_DESC} AS description,
      CAST(amount AS DOUBLE) AS amount, type, {_BAL} AS balance FROM ({R.EXPECTED_SQL}){where}"""


_NAME = "'RAVI KUMAR ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"
_L = "o_orderkey % 6"
_LASTJ = "(o_orderkey % 4)"


def _header(*columns):
    return lambda s, d: R.statement_texts(s, d).select("statement_id", *[c() for c in columns])


TEXT = lambda: F.col("text")
_HOLDER = f"CASE {_L} WHEN 2 THEN 'STATEMENTSUMMARY' WHEN 5 THEN 'SOME OTHER LENDER' ELSE {_NAME} END"
_PERSONS_SQL = (
    "SELECT c_custkey AS person_id, c_custkey % 25 AS case_id, "
    "lower('Ravi Kumar ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS n FROM customer"
)


def _persons(spark, sf):
    code = F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    return T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_custkey").alias("seq"),
        (F.col("c_custkey") % 25).alias("case_id"), F.concat(F.lit("Ravi Kumar "), code).alias("name"),
    )


def _match(spark, sf):
    texts = R.statement_texts(spark, sf).select(
        "statement_id", "case_id", headers.guess_holder_name(TEXT()).alias("holder")
    )
    return preview.suggest_person(texts, _persons(spark, sf)).select("statement_id", "person_id")


_MATCH = f"""WITH h AS (SELECT o_orderkey AS statement_id, o_custkey % 25 AS case_id, lower({_HOLDER}) AS h FROM orders),
  p AS ({_PERSONS_SQL}),
  m AS (SELECT statement_id, person_id, row_number() OVER (PARTITION BY statement_id ORDER BY (n = h) DESC,
     least(length(n), length(h)) DESC, person_id) AS r FROM h JOIN p ON h.case_id = p.case_id AND (contains(h, n) OR contains(n, h)))
  SELECT h.statement_id, m.person_id FROM h LEFT JOIN m ON h.statement_id = m.statement_id AND r = 1"""

_DAY0 = "CAST(o_orderdate AS DATE)"
_PSTART = f"CASE WHEN {_L} IN (2, 3, 4) THEN '1995-01-01' ELSE strftime({_DAY0}, '%Y-%m-%d') END"
_PEND = f"CASE WHEN {_L} IN (2, 3, 4) THEN '2001-12-31' ELSE strftime({_DAY0} + CAST({_LASTJ} AS INTEGER), '%Y-%m-%d') END"
_ACCT = f"CASE WHEN {_L} IN (1, 2, 3, 4) THEN '****' || right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) END"
_BANK = f"CASE {_L} WHEN 0 THEN 'hdfc_cc' WHEN 1 THEN 'idfc' WHEN 2 THEN 'hdfc_savings' WHEN 3 THEN 'icici' WHEN 4 THEN 'kotak' ELSE 'unknown' END"
_LABEL = f"CASE {_L} WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'IDFC First Bank' WHEN 2 THEN 'HDFC Bank' WHEN 3 THEN 'ICICI Bank' WHEN 4 THEN 'Kotak Mahindra' ELSE 'Unknown' END"
_KIND = f"CASE {_L} WHEN 0 THEN 'CC' WHEN 1 THEN 'CA' WHEN 2 THEN 'SA' WHEN 3 THEN 'CA' ELSE 'SA' END"


def _balances(spark, sf):
    opening, closing = headers.guess_balances(TEXT())
    return R.statement_texts(spark, sf).select(
        "statement_id", opening.cast("double").alias("opening"), closing.cast("double").alias("closing")
    )


_CLOSE_SQL = f"""CASE WHEN {_L} = 4 THEN CAST(9000000 + (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) *
   (CASE WHEN {_LASTJ} % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + CAST({_LASTJ} / 2 AS DECIMAL(18,2)) ELSE CAST(-({_LASTJ} + 1) / 2 AS DECIMAL(18,2)) END) AS DOUBLE) END"""


def _envelope(spark, sf):
    texts = R.statement_texts(spark, sf)
    out = preview.extraction_envelope(texts)
    money = [F.col(f"summary.{c}").cast("double").alias(c) for c in ("total_debit", "total_credit", "net_change")]
    return out.select(
        "statement_id", F.col("bank.key").alias("bank"), F.col("account.number_masked").alias("account"),
        F.col("period.start").alias("p_start"), F.col("period.end").alias("p_end"),
        F.col("summary.transaction_count").alias("n"), *money, F.array_join("issues", ",").alias("issues"),
    )


_ENVELOPE = f"""WITH e AS ({R.EXPECTED_SQL}), s AS (SELECT statement_id, count(*) AS n,
    sum(CASE type WHEN 'Dr' THEN amount ELSE 0 END) AS dr, sum(CASE type WHEN 'Cr' THEN amount ELSE 0 END) AS cr FROM e GROUP BY 1)
  SELECT statement_id, {_BANK} AS bank, {_ACCT} AS account, {_PSTART} AS p_start, {_PEND} AS p_end, n,
    CAST(dr AS DOUBLE) AS total_debit, CAST(cr AS DOUBLE) AS total_credit, CAST(cr - dr AS DOUBLE) AS net_change,
    CASE WHEN {_L} = 5 THEN 'unknown_bank_format' ELSE '' END AS issues FROM s JOIN orders ON o_orderkey = statement_id"""


def _ocr(spark, sf):
    """Words on pages: one page per order, heights four apart, so every fourth word opens a line."""
    words = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 97).alias("y"),
        F.col("l_suppkey").alias("x"), F.col("l_returnflag").alias("text"),
    )
    return parsing.lines_from_detections(words, 12)


_OCR = """WITH RECURSIVE w AS (SELECT l_orderkey AS page_id, l_partkey % 97 AS y, l_suppkey AS x, l_returnflag AS text FROM lineitem),
  ys AS (SELECT page_id, y, row_number() OVER (PARTITION BY page_id ORDER BY y) AS i FROM (SELECT DISTINCT page_id, y FROM w)),
  f AS (SELECT page_id, y, i, y AS a, 1 AS n FROM ys WHERE i = 1
    UNION ALL SELECT ys.page_id, ys.y, ys.i, CASE WHEN ys.y - f.a > 12 THEN ys.y ELSE f.a END, CASE WHEN ys.y - f.a > 12 THEN f.n + 1 ELSE f.n END
    FROM f JOIN ys ON ys.page_id = f.page_id AND ys.i = f.i + 1)
  SELECT w.page_id, CAST(f.n AS INTEGER) AS line_no, string_agg(w.text, ' ' ORDER BY w.x, w.text) AS line
  FROM w JOIN f ON w.page_id = f.page_id AND w.y = f.y GROUP BY 1, 2"""


QUERIES = {
    "e1_infer_channel": lambda s, d: doc(s, d).select("doc_id", enrich.infer_channel(F.col("text")).alias("channel")),
    "e1_infer_channel_narrations": lambda s, d: NAR.narrations(s, d).select("id", "ln", enrich.infer_channel(X()).alias("channel")),
    "e2_infer_category": lambda s, d: NAR.narrations(s, d).select("id", "ln", enrich.infer_category(X()).alias("category")),
    "e2_infer_category_documents": lambda s, d: doc(s, d).select("doc_id", enrich.infer_category(F.col("text")).alias("category")),
    "e3_infer_counterparty": lambda s, d: NAR.narrations(s, d).select("id", "ln", enrich.infer_counterparty(X()).alias("party")),
    "e4_counterparty_from_description": lambda s, d: NAR.narrations(s, d).select("id", "ln", enrich.counterparty_from_description(X()).alias("party")),
    "e7_confidence_and_flags": _flags,
    "e8_entities_map": _entities,
    "e6_iso_date": lambda s, d: _dates(s, d).select("id", dates.iso_date(F.col("raw")).alias("value")),
    "p3_normalize_date": lambda s, d: _dates(s, d).select("id", dates.normalize_date(F.col("raw")).alias("value")),
    "p13_header_iso_date": lambda s, d: _dates(s, d).select("id", dates.header_iso_date(F.col("raw")).alias("value")),
    "e9_canonical_key": lambda s, d: doc(s, d).select("doc_id", names.canonical_key(F.col("text")).alias("key")),
    "e10_category_from_name": lambda s, d: doc(s, d).select("doc_id", names.category_from_name(F.col("text"), names.ENTITY_TYPE_KEYWORDS).alias("category")),
    "e11_name_matches_keywords": lambda s, d: doc(s, d).select("doc_id", names.name_matches(F.col("text"), ("sbi", "emi", "oyo")).alias("hit")),
    "e12_resolve_entity_type": lambda s, d: doc(s, d).select(
        "doc_id", names.resolve_type(F.when(F.col("doc_id") % 3 == 0, "exchange").when(F.col("doc_id") % 3 == 1, "Unknown"), F.col("text"), names.ENTITY_TYPE_KEYWORDS).alias("entity_type")),
    "e13_classify_entity_type": lambda s, d: doc(s, d).select("doc_id", names.classify_type(F.col("text")).alias("entity_type")),
    "e14_parse_datetime": _moments,
    "e15_severity_bucket": lambda s, d: T.table(s, d, "events").select(F.col("event_id").alias("id"), risk.severity_bucket(F.round(F.col("value") / 200, 4)).alias("severity")),
    "e16_total_boost": lambda s, d: T.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.round(risk.total_boost((F.col("event_id") % 7 - 3).cast("double") / 8), 6).alias("boost")),
    "e17_signed": lambda s, d: T.ledger(s, d).select("id", enrich.signed(F.col("amount"), F.col("direction")).cast("double").alias("signed")),
    "e18_rupee_text": lambda s, d: T.ledger(s, d).select("id", display.rupees(F.col("amount") * F.pow(F.lit(10), F.col("id") % 4 - 2).cast("decimal(10,2)")).alias("label")),
    "e19_edge_weight": lambda s, d: T.ledger(s, d).select("id", F.round(display.edge_weight(F.when(F.col("id") % 3 == 0, "owns").otherwise("flow_in"), F.col("amount")), 6).alias("weight")),
    "e23_short_bank_label": lambda s, d: doc(s, d).select("doc_id", display.short_bank_label(F.col("text"), F.col("lang")).alias("label")),
    "e24_sparse_text": lambda s, d: doc(s, d).select("doc_id", enrich.sparse_text(F.when(F.col("doc_id") % 4 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), F.col("source"), F.lit("\n")))).alias("value")),
    "e25_to_dr_cr": lambda s, d: doc(s, d).select("doc_id", enrich.to_dr_cr(F.element_at(F.array(*[F.lit(x) for x in ("Dr", "Cr", "debit", "credit", "x")]), (F.col("doc_id") % 5 + 1).cast("int"))).alias("direction")),
    "e26_node_sublabel": lambda s, d: T.table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), display.node_sublabel(F.element_at(F.array(F.lit("person"), F.lit("account"), F.lit("entity")), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.lit("ABCDE"))).alias("label")),
    "p1_detect_bank": _header(lambda: parsing.detect_bank(TEXT()).alias("bank")),
    "p2_clean_amount": lambda s, d: T.ledger(s, d).select("id", dates.clean_amount(F.concat(F.lit(" "), F.format_number("amount", 2))).cast("double").alias("amount")),
    "p4_hdfc_card": _parsed("hdfc_cc"),
    "p5_idfc": _parsed("idfc"),
    "p6_hdfc_savings": _parsed("hdfc_savings"),
    "p7_icici": _parsed("icici"),
    "p8_kotak": _parsed("kotak"),
    "p10_parse_text": _parsed(None),
    "p11_guess_period": lambda s, d: R.statement_texts(s, d).select("statement_id", headers.guess_period(TEXT())[0].alias("p_start"), headers.guess_period(TEXT())[1].alias("p_end")),
    "p12_period": lambda s, d: preview.statement_preview(R.statement_texts(s, d)).select("statement_id", "period_start", "period_end"),
    "p14_guess_account_number": _header(lambda: headers.guess_account_number(TEXT()).alias("account")),
    "p15_guess_balances": _balances,
    "p16_guess_holder_name": _header(lambda: headers.guess_holder_name(TEXT()).alias("holder")),
    "p17_suggest_person": _match,
    "p18_statement_preview": lambda s, d: preview.statement_preview(R.statement_texts(s, d), _persons(s, d)),
    "p19_extraction_envelope": _envelope,
    "p20_lines_from_detections": _ocr,
    "e5_shape_transaction": lambda s, d: parsing.parse_text(R.statement_texts(s, d)).select(
        "statement_id", *enrich.shape_transaction(F.col("date"), F.col("description"), F.col("amount").cast("double"), F.col("type"), F.col("balance").cast("double"))),
}

ORACLES = {
    "e1_infer_channel": f"SELECT doc_id, {_CHANNEL} AS channel FROM (SELECT doc_id, text AS x FROM documents)",
    "e1_infer_channel_narrations": _narr(f"{_CHANNEL} AS channel"),
    "e2_infer_category": _narr(f"{_CATEGORY} AS category"),
    "e2_infer_category_documents": f"SELECT doc_id, {_CATEGORY} AS category FROM (SELECT doc_id, text AS x FROM documents)",
    "e3_infer_counterparty": _narr(f"{_PARTY} AS party"),
    "e4_counterparty_from_description": _narr(f"{_PARTY2} AS party"),
    "e7_confidence_and_flags": NAR.SQL + f""", n AS (SELECT *, description AS x FROM x), b AS (SELECT id, ln, {_PARTY} AS party, {_CHANNEL} AS channel FROM n),
       c AS (SELECT *, starts_with(party, '(unknown') OR length(party) < 3 AS low FROM b)
       SELECT id, ln, CASE WHEN low THEN 'low' WHEN channel = 'OTHER' THEN 'medium' ELSE 'high' END AS confidence,
       concat_ws(',', CASE WHEN low THEN 'NEEDS_REVIEW' END, CASE WHEN id % 3 = 0 THEN 'SELF_TRANSFER' END) AS flags FROM c""",
    "e8_entities_map": _ENTITIES,
    "e6_iso_date": _dates_sql((0,), "%Y-%m-%d"),
    "p3_normalize_date": _dates_sql((0, 1, 2, 3, 4, 5), "%d/%m/%Y"),
    "p13_header_iso_date": _dates_sql((0, 1, 2, 3), "%Y-%m-%d"),
    "e9_canonical_key": f"SELECT doc_id, {KEY_SQL.format(x='text')} AS key FROM documents",
    "e10_category_from_name": f"SELECT doc_id, {_TYPE} AS category FROM (SELECT doc_id, text AS x FROM documents)",
    "e11_name_matches_keywords": "SELECT doc_id, contains(lower(text), 'sbi') OR contains(lower(text), 'emi') OR contains(lower(text), 'oyo') AS hit FROM documents",
    "e12_resolve_entity_type": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exchange' ELSE coalesce({_TYPE}, CASE WHEN doc_id % 3 = 1 THEN 'Unknown' END) END AS entity_type FROM (SELECT doc_id, text AS x FROM documents)",
    "e13_classify_entity_type": f"SELECT doc_id, coalesce({_TYPE}, 'counterparty') AS entity_type FROM (SELECT doc_id, text AS x FROM documents)",
    "e14_parse_datetime": _MOMENTS,
    "e15_severity_bucket": "SELECT event_id AS id, CASE WHEN b >= 0.35 THEN 'critical' WHEN b >= 0.20 THEN 'high' WHEN b >= 0.10 THEN 'medium' WHEN b > 0 THEN 'low' ELSE 'info' END AS severity FROM (SELECT event_id, round(value / 200, 4) AS b FROM events)",
    "e16_total_boost": "SELECT user_id AS id, round(least(greatest(sum(CAST(event_id % 7 - 3 AS DOUBLE) / 8), 0), 0.4), 6) AS boost FROM events GROUP BY 1",
    "e17_signed": f"SELECT id, CAST(CASE direction WHEN 'Cr' THEN amount ELSE -amount END AS DOUBLE) AS signed FROM ({T.ledger_sql()})",
    "e18_rupee_text": f"""WITH l AS (SELECT id, CAST(amount * CASE id % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.10 WHEN 2 THEN 1 ELSE 10 END AS DECIMAL(28,4)) AS a FROM ({T.ledger_sql()}))
       SELECT id, '₹' || CASE WHEN a >= 10000000 THEN CAST(CAST(round(CAST(a / 10000000 AS DECIMAL(28,10)), 1) AS DECIMAL(28,1)) AS VARCHAR) || 'Cr'
         WHEN a >= 100000 THEN CAST(CAST(round(CAST(a / 100000 AS DECIMAL(28,10)), 1) AS DECIMAL(28,1)) AS VARCHAR) || 'L'
         WHEN a >= 1000 THEN CAST(CAST(round(CAST(a / 1000 AS DECIMAL(28,10)), 0) AS BIGINT) AS VARCHAR) || 'k'
         ELSE CAST(CAST(round(a, 0) AS BIGINT) AS VARCHAR) END AS label FROM l""",
    "e19_edge_weight": f"SELECT id, round(CASE WHEN id % 3 = 0 THEN 1.0::DOUBLE ELSE least(6.0, 1 + log10(greatest(1.0, CAST(amount AS DOUBLE)) / 1000)) END, 6) AS weight FROM ({T.ledger_sql()})",
    "e23_short_bank_label": f"SELECT doc_id, {_contains_case('lower(text)', [(label, (key,)) for key, label in display.SHORT_BANKS], 'string_split(text, {q} {q})[1]'.format(q=chr(39)))} || ' ' || lang AS label FROM documents",
    "e24_sparse_text": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS value FROM documents",
    "e25_to_dr_cr": "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 2) THEN 'Dr' ELSE 'Cr' END AS direction FROM documents",
    "e26_node_sublabel": """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey || ' account' || CASE WHEN c_nationkey = 1 THEN '' ELSE 's' END ||
        CASE WHEN c_custkey % 2 = 0 THEN ' · PAN ABCDE' ELSE '' END ELSE c_nationkey || ' txn' || CASE WHEN c_nationkey = 1 THEN '' ELSE 's' END END AS label FROM customer""",
    "p1_detect_bank": f"SELECT o_orderkey AS statement_id, {_BANK} AS bank FROM orders",
    "p2_clean_amount": f"SELECT id, CAST(amount AS DOUBLE) AS amount FROM ({T.ledger_sql()})",
    "p4_hdfc_card": _parsed_sql(0),
    "p5_idfc": _parsed_sql(1),
    "p6_hdfc_savings": _parsed_sql(2),
    "p7_icici": _parsed_sql(3),
    "p8_kotak": _parsed_sql(4),
    "p10_parse_text": _parsed_sql(None),
    "p11_guess_period": f"SELECT o_orderkey AS statement_id, CASE WHEN {_L} IN (2, 3, 4) THEN '1995-01-01' END AS p_start, CASE WHEN {_L} IN (2, 3, 4) THEN '2001-12-31' END AS p_end FROM orders",
    "p12_period": f"SELECT o_orderkey AS statement_id, {_PSTART} AS period_start, {_PEND} AS period_end FROM orders",
    "p14_guess_account_number": f"SELECT o_orderkey AS statement_id, {_ACCT} AS account FROM orders",
    "p15_guess_balances": f"SELECT o_orderkey AS statement_id, CASE WHEN {_L} IN (1, 2, 3, 4) THEN 9000000.0::DOUBLE END AS opening, {_CLOSE_SQL} AS closing FROM orders",
    "p16_guess_holder_name": f"SELECT o_orderkey AS statement_id, {_HOLDER} AS holder FROM orders",
    "p17_suggest_person": _MATCH,
    "p18_statement_preview": _MATCH.replace("SELECT h.statement_id, m.person_id FROM", "SELECT h.statement_id, m.person_id AS suggested_person_id FROM").join(
        ["WITH sp AS (", f""") SELECT sp.statement_id, {_BANK} AS bank_detected, {_LABEL} AS bank_label, {_KIND} AS account_type, {_ACCT} AS account_number_guess,
        {_HOLDER} AS holder_name_guess, suggested_person_id, {_PSTART} AS period_start, {_PEND} AS period_end, o_orderkey % 4 + 1 AS transaction_count
        FROM sp JOIN orders ON o_orderkey = sp.statement_id"""]),
    "p19_extraction_envelope": _ENVELOPE,
    "p20_lines_from_detections": _OCR,
    "e5_shape_transaction": f"""WITH p AS ({_parsed_sql(None)}), n AS (SELECT *, description AS x FROM p)
        SELECT statement_id, strftime(strptime(date, '%d/%m/%Y'), '%Y-%m-%d') AS date, amount, CASE type WHEN 'Dr' THEN 'debit' ELSE 'credit' END AS direction,
        description, {_PARTY2} AS counterparty, {_CHANNEL} AS channel, {_CATEGORY} AS category, balance AS balance_after,
        NULL AS entity_type, NULL AS is_self_transfer, NULL AS notable_reason, NULL AS card_last4, NULL AS ref_number, NULL AS counterparty_bank FROM n""",
}
