"""Case summaries: counts, totals, series, rankings and the pattern scoreboard of all cases at once.

A ledger has ``case_id, id, seq, txn_date, amount, direction, counterparty, category, channel, tags,
flags, review_status``; ``seq`` is the order of insertion, which decides ties. Amounts are decimals,
so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Known patterns with label and severity.
PATTERNS = (
    ("STRUCTURING_SUSPECTED", "Structuring suspected", "high"),
    ("FUND_THROUGH_FLOW", "Fund-through flow", "high"),
    ("SAME_DAY_ROUND_TRIP", "Same-day round trip", "high"),
    ("DORMANT_THEN_ACTIVE", "Dormant-then-active", "medium"),
    ("VELOCITY_SPIKE", "Velocity spike", "medium"),
    ("ROUND_AMOUNT_CLUSTER", "Round-amount cluster", "medium"),
    ("SUM_CHECK_CONTRIBUTOR", "Sum-check contributor", "low"),
    ("NEEDS_REVIEW", "Needs manual review", "low"),
)
MONEY = "decimal(28,2)"


def debit(amount: str = "amount") -> Column:
    return F.when(F.col("direction") == "Dr", F.col(amount)).otherwise(0).cast(MONEY)


def credit(amount: str = "amount") -> Column:
    """Everything that is not a debit counts as credit."""
    return F.when(F.col("direction") == "Dr", 0).otherwise(F.col(amount)).cast(MONEY)


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum(debit()).cast(MONEY).alias("total_dr"),
        F.sum(credit()).cast(MONEY).alias("total_cr"),
    ]


def case_counts(cases: DataFrame, statements: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per case: statements, transactions and flags (a transaction counts once for each flag)."""
    told = statements.groupBy("case_id").agg(F.count(F.lit(1)).alias("statements"))
    rows = ledger.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(F.size("flags")).alias("flags")
    )
    zero = {"statements": 0, "transactions": 0, "flags": 0}
    return cases.select("case_id").join(told, "case_id", "left").join(rows, "case_id", "left").na.fill(zero)


def case_summary(ledger: DataFrame) -> DataFrame:
    """Per case: totals, net, number of rows and flags, rows by review status."""
    status = F.col("review_status")
    flagged = F.coalesce(status == "flagged", F.lit(False))
    reviewed = F.coalesce(status == "reviewed", F.lit(False))
    return ledger.groupBy("case_id").agg(
        F.sum(debit()).cast(MONEY).alias("total_dr"),
        F.sum(credit()).cast(MONEY).alias("total_cr"),
        (F.sum(credit()) - F.sum(debit())).cast(MONEY).alias("net"),
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(F.size("flags")).cast("long").alias("flag_count"),
        F.count_if(reviewed).alias("reviewed_count"),
        F.count_if(~reviewed & ~flagged).alias("unreviewed_count"),
        F.count_if(flagged).alias("flagged_count"),
    )


def monthly_series(ledger: DataFrame) -> DataFrame:
    """Per case and month ``yyyy-MM``, rows without a date under ``unknown``."""
    month = F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("unknown"))
    return ledger.groupBy("case_id", month.alias("month")).agg(*_totals())


def ranked(ledger: DataFrame, name: Column, k: int | None) -> DataFrame:
    """Names of each case by number of rows, first seen first among equals; ``k`` at most."""
    rows = ledger.groupBy("case_id", name.alias("name")).agg(*_totals(), F.min("seq").alias("_first"))
    order = Window.partitionBy("case_id").orderBy(F.desc("count"), "_first")
    placed = rows.withColumn("place", F.row_number().over(order)).drop("_first")
    return placed if k is None else placed.filter(F.col("place") <= k)


def _named(column: str, missing: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing))


def top_counterparties(ledger: DataFrame, k: int = 15) -> DataFrame:
    return ranked(ledger, _named("counterparty", "(unknown)"), k)


def category_breakdown(ledger: DataFrame) -> DataFrame:
    return ranked(ledger, _named("category", "Other"), None)


def pattern_scoreboard(ledger: DataFrame, samples: int = 5) -> DataFrame:
    """All known patterns of each case, hit or not, then unknown flags; ``samples`` are the first
    transactions with the flag."""
    spark = ledger.sparkSession
    known = spark.createDataFrame(PATTERNS, "name string, known_label string, known_severity string")
    flags = ledger.select("case_id", "id", "seq", F.explode("flags").alias("name"))
    order = Window.partitionBy("case_id", "name").orderBy("seq")
    # Count and sample apart: the sample never gathers more than its size.
    counts = flags.groupBy("case_id", "name").agg(F.count(F.lit(1)).alias("count"))
    firsts = (
        flags.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= samples)
        .groupBy("case_id", "name")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "id"))).alias("_s"))
        .select("case_id", "name", F.col("_s.id").alias("sample_txn_ids"))
    )
    hits = counts.join(firsts, ["case_id", "name"])
    # The eight known patterns times the cases: bounded by the number of cases.
    every = ledger.select("case_id").distinct().select(
        "case_id", F.explode(F.array(*[F.lit(n) for n, *_ in PATTERNS])).alias("name")
    )
    id_type = dict(ledger.dtypes)["id"]
    return (
        every.join(hits, ["case_id", "name"], "full_outer")
        .join(F.broadcast(known), "name", "left")  # eight rows
        .select(
            "case_id",
            "name",
            F.coalesce("known_label", F.initcap(F.lower(F.replace("name", F.lit("_"), F.lit(" "))))).alias("label"),
            F.coalesce("known_severity", F.lit("low")).alias("severity"),
            F.coalesce("count", F.lit(0)).alias("count"),
            F.coalesce("sample_txn_ids", F.array().cast(f"array<{id_type}>")).alias("sample_txn_ids"),
        )
    )


def scoreboard_split(scoreboard: DataFrame) -> DataFrame:
    """Per case: patterns with and without hits and the number of all hits."""
    return scoreboard.groupBy("case_id").agg(
        F.count_if(F.col("count") > 0).alias("hit"),
        F.count_if(F.col("count") == 0).alias("quiet"),
        F.sum("count").alias("total_hits"),
    )


def sum_check(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Extracted totals of a statement as percentages of ``declared_dr`` and ``declared_cr``; 100
    where nothing, or zero, is declared. ``has_warnings`` if one is off by more than 0.01."""
    total = lambda kind: F.sum(F.when(F.col("direction") == kind, F.col("amount")))
    sums = rows.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("extracted"), total("Dr").alias("_dr"), total("Cr").alias("_cr")
    )

    def percent(found: str, wanted: str) -> Column:
        share = F.coalesce(F.col(found), F.lit(0)).cast("double") / F.col(wanted).cast("double") * 100
        return F.when(F.coalesce(F.col(wanted), F.lit(0)) == 0, F.lit(100.0)).otherwise(share)

    joined = declared.join(sums, "statement_id", "left").withColumns(
        {"_d": percent("_dr", "declared_dr"), "_c": percent("_cr", "declared_cr")}
    )
    off = (F.abs(F.col("_d") - 100) > 0.01) | (F.abs(F.col("_c") - 100) > 0.01)
    return joined.select(
        "statement_id",
        *[c for c in declared.columns if c not in ("statement_id", "declared_dr", "declared_cr")],
        F.coalesce("extracted", F.lit(0)).alias("extracted"),
        F.round("_d", 2).alias("debits_pct"),
        F.round("_c", 2).alias("credits_pct"),
        off.alias("has_warnings"),
    )


def account_counters(checked: DataFrame) -> DataFrame:
    """Per account: extracted rows of all statements and whether any of them had a warning."""
    return checked.groupBy("account_id").agg(
        F.sum("extracted").alias("transaction_count"), F.bool_or("has_warnings").alias("has_warnings")
    )


def is_flagged() -> Column:
    status = F.coalesce(F.col("review_status") == "flagged", F.lit(False))
    return status | (F.size("flags") > 0)


def workbench_filter(
    ledger: DataFrame,
    case_id=None,
    account_id=None,
    direction: str | None = None,
    counterparties: list[str] | None = None,
    categories: list[str] | None = None,
    tags: list[str] | None = None,
    needs_review: bool = False,
    flagged: bool = False,
    search: str | None = None,
) -> DataFrame:
    """Rows that fit every given condition; the search looks at description, counterparty, category,
    channel and tags."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    fits = []
    if case_id is not None:
        fits.append(F.col("case_id") == case_id)
    if account_id is not None:
        fits.append(F.col("account_id") == account_id)
    if direction:
        fits.append(F.col("direction") == direction)
    if counterparties:
        fits.append(empty("counterparty").isin(counterparties))
    if categories:
        fits.append(empty("category").isin(categories))
    if tags:
        fits.append(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if needs_review:
        fits.append(~F.coalesce(F.col("review_status") == "reviewed", F.lit(False)))
    if flagged:
        fits.append(is_flagged())
    if search and search.strip():
        text = F.concat_ws(" ", empty("raw_description"), empty("counterparty"), empty("category"), empty("channel"), F.array_join("tags", " "))
        fits.append(F.contains(F.lower(text), F.lit(search.strip().lower())))
    for condition in fits:
        ledger = ledger.filter(condition)
    return ledger


def workbench_totals(rows: DataFrame) -> DataFrame:
    """Debits, credits and flagged rows of what a filter left, per case."""
    return rows.groupBy("case_id").agg(
        F.sum(debit()).cast(MONEY).alias("debits"),
        F.sum(credit()).cast(MONEY).alias("credits"),
        F.count_if(is_flagged()).alias("flagged"),
    )


def filter_options(ledger: DataFrame) -> DataFrame:
    """Distinct counterparties, categories and tags of each case, as ``(case_id, kind, value)``."""
    kinds = F.array(
        F.struct(F.lit("counterparty").alias("kind"), F.array("counterparty").alias("all")),
        F.struct(F.lit("category").alias("kind"), F.array("category").alias("all")),
        F.struct(F.lit("tag").alias("kind"), F.col("tags").alias("all")),
    )
    long = ledger.select("case_id", F.explode(kinds).alias("k")).select(
        "case_id", F.col("k.kind").alias("kind"), F.explode("k.all").alias("value")
    )
    return long.filter(F.col("value") != "").distinct()


def transaction_page(rows: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """One page in the order of statements and their rows, 1 to 2000 of them."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit must lie between 1 and 2000")
    return rows.orderBy("statement_id", "row_index").offset(offset).limit(limit)


def statement_islands(rows: DataFrame) -> DataFrame:
    """Runs of rows of one statement in display order (``seq``), numbered within each case."""
    order = Window.partitionBy("case_id").orderBy("seq")
    before = F.lag("statement_id").over(order)
    begins = (before.isNull() | (before != F.col("statement_id"))).cast("int")
    return rows.withColumn("_b", begins).withColumn("island", F.sum("_b").over(order)).drop("_b")
