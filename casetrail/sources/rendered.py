"""Statement texts rendered from ``orders``, one statement per order, in the known layouts.

Every statement has one to four transactions whose values follow from the order row, so the
rendering is row-local and the expected transactions are plain expressions on ``orders``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.functions.logic import first_match
from casetrail.sources.shared_tables import spread, table

LAYOUTS = ("hdfc_cc", "idfc", "hdfc_savings", "icici", "kotak", "unknown")
MAX_ROWS = 4

HEADERS = {
    "hdfc_cc": "HDFC Bank Credit Cards GSTIN\nMR {name}\nStatement Date 01/01/2002",
    "idfc": "IDFC FIRST Bank\nCustomer Name : {name}\nAccount Number {acct}\nOpening Balance : {open}",
    "hdfc_savings": "Date Narration Chq./Ref.No. ValueDt WithdrawalAmt. DepositAmt. ClosingBalance\n"
    "From : 01/01/1995 To : 31/12/2001\nA/C No {acct}\nSTATEMENTSUMMARY\nOpeningBalance DrCount CrCount\n{open}",
    "icici": "Particulars Chq.No. Withdrawals Deposits Autosweep Balance\nMR. {name}\nA/C NO: {acct}\n"
    "Period From 01/01/1995 To 31/12/2001\nB/F Balance {open}",
    "kotak": "Sl. No. Date Description Chq / Ref number Amount Dr / Cr Balance Dr / Cr\n{name}\n"
    "Account No. {acct}\nStatement 01-01-1995 To 31-12-2001\nOpening Balance {open}\nClosing Balance {close}",
    "unknown": "SOME OTHER LENDER\n{name}\n12 STATION ROAD",
}


def rows_in(key: Column) -> Column:
    return (key % MAX_ROWS + 1).cast("int")


def _transaction(j: Column) -> Column:
    """Values of transaction ``j``; directions alternate, so the balance has a closed form."""
    key, price = F.col("o_orderkey"), F.col("price")
    kind = F.when((key + j) % 2 == 0, F.lit("Dr")).otherwise("Cr")
    moved = F.when(j % 2 == 0, price + F.expr("0.5") * j).otherwise(F.expr("-0.5") * (j + 1))
    signed = F.when(key % 2 == 0, -moved).otherwise(moved)
    return F.struct(
        j.alias("j"),
        F.date_add(F.col("first_day"), j).alias("day"),
        kind.alias("type"),
        F.trim(F.format_number(price + j, 2)).alias("amount"),
        F.trim(F.format_number(F.lit(OPENING) + signed, 2)).alias("balance"),
    )


def _line(layout: str, t: Column) -> Column:
    number = F.col("o_orderkey").cast("string")
    key12 = F.lpad(number, 12, "0")
    shop = F.concat(F.lit("SHOP "), F.col("o_orderstatus"))
    way = F.upper(t["type"])
    day = lambda fmt: F.date_format(t["day"], fmt)
    words = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    j = t["j"].cast("string")
    if layout == "idfc":
        text = F.concat(F.lit("UPI/"), way, F.lit("/"), key12, F.lit("/"), shop, F.lit("/HDFC"))
        row = words(day("dd MMM yy"), day("dd MMM yy"), t["amount"], t["balance"], "CR")
        return F.concat(F.lit("\n"), text, F.lit("\n"), row, F.lit("\n\n"))
    if layout == "hdfc_savings":
        ref = F.lpad(F.concat(number, j), 15, "0")
        text = F.concat(key12, F.lit("-TPT-"), shop)
        row = words(day("dd/MM/yy"), text, ref, day("dd/MM/yy"), t["amount"], t["balance"])
        return F.concat(row, F.lit("\nBRANCH COPY"))
    if layout == "icici":
        out = F.when(t["type"] == "Dr", t["amount"]).otherwise("0.00")
        inn = F.when(t["type"] == "Cr", t["amount"]).otherwise("0.00")
        text = F.concat(F.lit("BIL/INFT/"), key12, F.lit("/"), shop, F.lit("/"))
        return words(day("dd-MM-yyyy"), text, out, inn, t["balance"], "Cr")
    if layout == "kotak":
        text = F.concat(F.lit("UPI/"), shop, F.lit("/"), j)
        row = words(text, F.concat(F.lit("UPI-"), key12), t["amount"], way, t["balance"], "CR")
        return F.concat(row, F.lit("\n"), (t["j"] + 1).cast("string"), F.lit(" "), day("dd/MM/yyyy"), F.lit("\nMORE TEXT"))
    text = F.concat(shop, F.lit(" ITEM"), j)
    return words(day("dd/MM/yyyy"), text, "12", t["amount"], F.when(t["type"] == "Cr", F.lit("Cr")))


OPENING = 9_000_000


def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(statement_id, case_id, person_id, holder, text)``, one row per order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.to_date("o_orderdate").alias("first_day"),
        F.concat(
            F.lit("RAVI KUMAR "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "ABCDEFGHIJ")
        ).alias("holder"),
    )
    last = F.sequence(F.lit(0), rows_in(F.col("o_orderkey")) - 1)
    valued = spread(orders).withColumn("rows", F.transform(last, _transaction))
    marks = {
        "{name}": F.col("holder"),
        "{acct}": F.concat(F.lit("9000"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")),
        "{open}": F.trim(F.format_number(F.lit(OPENING), 2)),
        "{close}": F.get(F.col("rows"), F.size("rows") - 1)["balance"],
    }
    layout = F.col("o_orderkey") % len(LAYOUTS)
    header = F.get(F.array(*[F.lit(HEADERS[name]) for name in LAYOUTS]), layout.cast("int"))
    for mark, value in marks.items():
        header = F.replace(header, F.lit(mark), value)
    lines = first_match(
        [(layout == i, F.transform("rows", partial(_line, name))) for i, name in enumerate(LAYOUTS)],
        F.array().cast("array<string>"),
    )
    return valued.select(
        F.col("o_orderkey").alias("statement_id"),
        F.col("o_custkey").alias("person_id"),
        (F.col("o_custkey") % 25).alias("case_id"),
        "holder",
        F.concat(header, F.lit("\n"), F.array_join(lines, "\n")).alias("text"),
    )


# Expected transactions: ``r(statement_id, layout, j, txn_day, amount, type)``.
EXPECTED_SQL = f"""
  SELECT o_orderkey AS statement_id, o_orderkey % {len(LAYOUTS)} AS layout, j,
         CAST(o_orderdate AS DATE) + CAST(j AS INTEGER) AS txn_day,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) + j AS DECIMAL(18,2)) AS amount,
         CASE WHEN (o_orderkey + j) % 2 = 0 THEN 'Dr' ELSE 'Cr' END AS type,
         o_orderstatus AS st, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k12, o_custkey
  FROM orders, range(0, {MAX_ROWS}) t(j) WHERE j < o_orderkey % {MAX_ROWS} + 1"""
