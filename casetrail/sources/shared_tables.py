"""Ledger-shaped views over the shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a file with few row groups on all cores, for work that costs more than moving its input."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def ledger(
    spark: SparkSession, sf_dir: str, account: str = "customer", rounded: bool = False
) -> DataFrame:
    """``orders`` joined with ``customer`` as a bank ledger.

    ``account`` picks sparse (customer) or dense (nation) accounts; ``rounded`` turns every
    fifth amount into a multiple of 10 000.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    amount = (F.lit(2) * F.col("o_totalprice")).cast("decimal(18,2)")
    if rounded:
        whole = (F.greatest(F.lit(1), F.floor(F.col("o_totalprice") / 10000)) * 10000).cast(
            "decimal(18,2)"
        )
        amount = F.when(F.col("o_orderkey") % 5 == 0, whole).otherwise(amount)
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("id"),
        key.alias("seq"),
        F.to_date("o_orderdate").alias("txn_date"),
        amount.cast("decimal(18,2)").alias("amount"),
        F.when(key % 2 == 0, "Dr").otherwise("Cr").alias("direction"),
        (F.col("o_custkey") if account == "customer" else F.col("c_nationkey").cast("bigint")).alias(
            "account_id"
        ),
        F.col("c_nationkey").cast("bigint").alias("case_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("c_name").alias("holder_name"),
        F.concat_ws(
            "-", F.col("o_custkey").cast("string"), F.year(F.to_date("o_orderdate")).cast("string")
        ).alias("statement_id"),
        F.col("o_orderpriority").alias("counterparty"),
        F.concat(F.lit("UPI/"), key.cast("string"), F.lit("/"), F.col("o_orderpriority")).alias(
            "raw_description"
        ),
        F.when(F.col("o_orderstatus") == "F", "reviewed")
        .when(F.col("o_orderstatus") == "P", "flagged")
        .otherwise("unreviewed")
        .alias("review_status"),
    )


# The same view for the SQL side of the checks.
def ledger_sql(account: str = "customer", rounded: bool = False) -> str:
    amount = "CAST(2*o_totalprice AS DECIMAL(18,2))"
    if rounded:
        amount = (
            "CASE WHEN o_orderkey % 5 = 0 THEN CAST(greatest(1, floor(o_totalprice/10000))*10000 "
            f"AS DECIMAL(18,2)) ELSE {amount} END"
        )
    acct = "o_custkey" if account == "customer" else "CAST(c_nationkey AS BIGINT)"
    return f"""
      SELECT o_orderkey AS id, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS txn_date,
             {amount} AS amount,
             CASE WHEN o_orderkey % 2 = 0 THEN 'Dr' ELSE 'Cr' END AS direction,
             {acct} AS account_id, CAST(c_nationkey AS BIGINT) AS case_id, o_custkey AS person_id,
             c_name AS holder_name,
             o_custkey || '-' || year(o_orderdate) AS statement_id,
             o_orderpriority AS counterparty,
             'UPI/' || o_orderkey || '/' || o_orderpriority AS raw_description,
             CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'P' THEN 'flagged'
                  ELSE 'unreviewed' END AS review_status
      FROM orders JOIN customer ON o_custkey = c_custkey"""
