"""Running balances, edits with their audit, and statement ingest.

A statement's rows are one window: a printed statement has at most some hundred thousand lines, and
the windows below keep one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"
# Fields that an edit may set.
EDITABLE = ("entities", "tags", "amount", "direction", "txn_date", "review_status")
# Fields that an edit may clear; a null for any other field is no edit of it.
CLEARABLE = ("txn_date", "review_status")


def signed(amount: str = "amount", direction: str = "direction") -> Column:
    return F.when(F.col(direction) == "Cr", F.col(amount)).otherwise(-F.col(amount)).cast(MONEY)


def with_row_index(rows: DataFrame, order: str = "seq") -> DataFrame:
    """1-based position in the statement."""
    place = Window.partitionBy("statement_id").orderBy(order)
    return rows.withColumn("row_index", F.row_number().over(place))


def running_balance(rows: DataFrame) -> DataFrame:
    """Add ``running_balance``: the opening balance plus all signed amounts so far, starting anew
    from each ``balance_after`` that the bank printed.

    ``rows`` has ``statement_id, row_index, amount, direction, balance_after, opening_balance``.
    """
    order = Window.partitionBy("statement_id").orderBy("row_index")
    segment = Window.partitionBy("statement_id", "_segment").orderBy("row_index")
    moved = F.when(F.col("balance_after").isNull(), signed()).otherwise(0).cast(MONEY)
    start = F.coalesce(F.first("balance_after").over(segment), F.coalesce("opening_balance", F.lit(0)))
    return (
        rows.withColumn("_segment", F.count("balance_after").over(order))
        .withColumn("running_balance", (start + F.sum(moved).over(segment)).cast(MONEY))
        .drop("_segment")
    )


def _edits(patches: DataFrame) -> DataFrame:
    """Patches of fields that can be edited, with values that the field can take."""
    fits = F.col("value").isNotNull() | F.col("field").isin(*CLEARABLE)
    return patches.filter(F.col("field").isin(*EDITABLE) & fits)


def latest_patches(patches: DataFrame) -> DataFrame:
    """The last value for each transaction and field, by ``patch_seq``."""
    order = Window.partitionBy("id", "field").orderBy(F.desc("patch_seq"))
    return (
        _edits(patches)
        .withColumn("_n", F.row_number().over(order))
        .filter("_n = 1")
        .drop("_n")
    )


def _patched(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """Old and new values side by side; one row per transaction, untouched ones with nulls.

    ``_txn_date`` and ``_review_status`` are structs, so that a cleared field differs from an untouched one.
    """
    value = lambda field: F.max(F.when(F.col("field") == field, F.col("value")))
    cleared = lambda field: F.max(F.when(F.col("field") == field, F.struct("value")))
    given = [
        value("amount").cast("decimal(18,2)").alias("_amount"),
        value("direction").alias("_direction"),
        cleared("txn_date").alias("_txn_date"),
        cleared("review_status").alias("_review_status"),
    ]
    for name in ("tags", "entities"):
        if name in ledger.columns:
            kind = ledger.schema[name].dataType.simpleString()
            given.append(F.from_json(value(name), kind).alias("_" + name))
    edits = latest_patches(patches).groupBy("id").agg(*given)
    times = patches.groupBy("id").agg(F.countDistinct("patch_seq").cast("int").alias("_edits"))
    return ledger.join(edits, "id", "left").join(times, "id", "left")


def patch_transactions(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """The ledger after a batch of edits, with balances moved along.

    ``patches`` is ``(id, patch_seq, field, value)``; rows with one ``patch_seq`` are one edit. Values are
    texts: ``tags`` and ``entities`` as JSON of the ledger's columns, which replaces all of the old value. A
    null clears a date or a status. The change of a signed amount moves the running balance of that row
    and of all later rows of the statement; unknown ids and fields change nothing.
    """
    both = _patched(ledger, patches)
    new_amount = F.coalesce("_amount", "amount")
    new_direction = F.coalesce("_direction", "direction")
    fresh = F.when(new_direction == "Cr", new_amount).otherwise(-new_amount).cast(MONEY)
    later = Window.partitionBy("statement_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    moved = both.withColumn("_delta", fresh - signed()).withColumn("_shift", F.sum("_delta").over(later))
    set_or_old = lambda name, new: F.when(F.col("_" + name).isNull(), F.col(name)).otherwise(new)
    replaced = {
        "amount": new_amount,
        "direction": new_direction,
        "txn_date": set_or_old("txn_date", F.col("_txn_date.value").cast("date")),
        "review_status": set_or_old("review_status", F.col("_review_status.value")),
        "running_balance": (F.col("running_balance") + F.col("_shift")).cast(MONEY),
        "edit_count": (F.col("edit_count") + F.coalesce("_edits", F.lit(0))).cast("int"),
    }
    replaced |= {c: F.coalesce("_" + c, c) for c in ("tags", "entities") if c in ledger.columns}
    return moved.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in ledger.columns])


def closing_balances(statements: DataFrame, ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """Statements whose closing balance follows the edits of their rows."""
    both = _patched(ledger, patches)
    amount, direction = F.coalesce("_amount", "amount"), F.coalesce("_direction", "direction")
    fresh = F.when(direction == "Cr", amount).otherwise(-amount).cast(MONEY)
    moved = both.groupBy("statement_id").agg(F.sum(fresh - signed()).cast(MONEY).alias("_delta"))
    closing = (F.col("closing_balance") + F.coalesce("_delta", F.lit(0))).cast(MONEY)
    return statements.join(moved, "statement_id", "left").withColumn("closing_balance", closing).drop("_delta")


def audit_events(ledger: DataFrame, patches: DataFrame, limit: int = 500) -> DataFrame:
    """One event for each edited field, oldest first within a transaction: what it was, what it is.

    An edit that comes after another one of the same field starts from the other one's value. Old
    ``tags`` and ``entities`` are shown as JSON, a cleared or missing value as null.
    """
    shown = {"txn_date": F.col("txn_date").cast("string"), "amount": F.col("amount").cast("string")}
    shown |= {c: F.to_json(c) for c in ("entities", "tags")}
    fields = [c for c in EDITABLE if c in ledger.columns]
    base = ledger.select("id", *[shown.get(c, F.col(c)).alias(c) for c in fields])
    old = F.coalesce(*[F.when(F.col("field") == c, F.col(c)) for c in fields])
    order = Window.partitionBy("id", "field").orderBy("patch_seq")
    before = F.when(F.row_number().over(order) == 1, old).otherwise(F.lag("value").over(order))
    events = _edits(patches).filter(F.col("field").isin(*fields)).join(base, "id")
    return events.select(
        "id",
        "patch_seq",
        "field",
        F.substring(before, 1, limit).alias("old_value"),
        F.substring("value", 1, limit).alias("new_value"),
    )


def set_status(ledger: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Set the review status of the transactions in ``ids``."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("review_status"))
    joined = ledger.join(marked, "id", "left")
    return joined.select(*[new.alias(c) if c == "review_status" else F.col(c) for c in ledger.columns])


def set_entity(entities: Column, key: str, value: Column) -> Column:
    """An entities map with one key replaced by what a user typed."""
    typed = F.struct(value.alias("value"), F.lit("user_edited").alias("source"), F.lit(1.0).alias("confidence"))
    return F.map_concat(F.map_filter(entities, lambda k, _: k != key), F.create_map(F.lit(key), typed))


def ingest(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger rows of new statements: positions, running balances, confidence and flags.

    ``statements`` is ``(statement_id, account_id, case_id, opening_balance)``; ``rows`` is
    ``(statement_id, parser, pos, date, description, amount, type, balance)`` as the parser gives
    them. Everything stays one plan from text to ledger.
    """
    from casetrail.functions import enrich
    from casetrail.functions.dates import header_iso_date

    given = rows.select(
        "statement_id",
        F.struct("parser", "pos").alias("seq"),
        header_iso_date(F.col("date")).alias("txn_date"),
        "amount",
        F.col("type").alias("direction"),
        F.col("balance").alias("balance_after"),
        F.col("description").alias("raw_description"),
    )
    placed = with_row_index(given).drop("seq").join(
        statements.select("statement_id", "account_id", "case_id", "opening_balance"), "statement_id"
    )
    party = enrich.infer_counterparty(F.col("raw_description"))
    told = running_balance(placed).withColumns(
        {
            "channel": enrich.infer_channel(F.col("raw_description")),
            "category": enrich.infer_category(F.col("raw_description")),
            "counterparty": party,
        }
    )
    return told.select(
        "case_id", "account_id", "statement_id", "row_index", "txn_date", "amount", "direction",
        "running_balance", "raw_description", "channel", "category", "counterparty",
        enrich.confidence(F.col("counterparty"), F.col("channel")).alias("confidence"),
        enrich.intake_flags(F.col("counterparty"), F.lit(None).cast("boolean")).alias("flags"),
        F.lit("unreviewed").alias("review_status"),
        F.lit(0).alias("edit_count"),
    )
