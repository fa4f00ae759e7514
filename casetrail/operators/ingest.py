"""Uploads of parsed statements into stored tables: accounts found or made, sums checked, rows enriched.

Tables are DataFrames by name; ``ingest_batch`` gives new rows and changed accounts and cases for a
whole batch of uploads at once. Identifiers of accounts and statements are texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import enrich
from casetrail.functions.text import blank_to_null
from casetrail.operators import balances, summary, tables
from casetrail.session import cut_lineage

# What tells accounts apart.
ACCOUNT_KEY = ("person_id", "bank", "account_number")
# Columns of an upload that are the account's, not the statement's.
_OF_ACCOUNT = ("person_id", "bank", "account_number", "account_type", "holder_name", "declared_dr", "declared_cr", "case_id")
# What a model may have said about a row, with the types.
GIVEN = {
    "channel": "string", "category": "string", "counterparty": "string", "entity_type": "string",
    "is_self_transfer": "boolean", "notable_reason": "string", "balance_after": "decimal(18,2)",
}


def screened(stored: dict[str, DataFrame], uploads: DataFrame) -> DataFrame:
    """``uploads``, one row for each ``statement_id``, with ``outcome`` and ``duplicate_of``.

    ``outcome`` is ``stored before`` where a statement of that id exists, else ``no case`` or ``no person``
    where the upload names one that does not exist, else ``new``; a batch that is sent twice so adds nothing.
    Of several uploads of one id the first by ``uploaded_at`` counts, of equal times the least. A null id
    is no upload. ``duplicate_of`` is the latest stored statement of the case with the same file, if any;
    it is a warning and refuses nothing.
    """
    rest = [c for c in uploads.columns if c not in ("statement_id", "uploaded_at")]
    first = uploads.filter("statement_id IS NOT NULL").groupBy("statement_id").agg(F.min(F.struct("uploaded_at", *rest)).alias("u"))
    once = first.select("statement_id", "u.*").select(*uploads.columns)
    marks = {
        "_before": (stored["statements"], "statement_id"),
        "_case": (stored["cases"], "case_id"),
        "_person": (stored["persons"], "person_id"),
    }
    for mark, (table, key) in marks.items():
        once = once.join(table.select(key).distinct().withColumn(mark, F.lit(True)), key, "left")
    outcome = (
        F.when(F.col("_before"), "stored before")
        .when(F.col("_case").isNull(), "no case")
        .when(F.col("_person").isNull(), "no person")
        .otherwise("new")
    )
    told = once.select(*uploads.columns, outcome.alias("outcome"))
    if "file_hash" not in uploads.columns:
        return told.withColumn("duplicate_of", F.lit(None).cast("string"))
    twin = tables.duplicate_statements(stored["statements"], stored["accounts"], stored["persons"], told)
    return told.join(twin.select("case_id", "file_hash", F.col("statement_id").alias("duplicate_of")), ["case_id", "file_hash"], "left").select(*told.columns, "duplicate_of")


def find_or_make_accounts(accounts: DataFrame, uploads: DataFrame) -> DataFrame:
    """``(person_id, bank, account_number, account_id, is_new, account_type, holder_name)`` of the accounts of uploads.

    An account is found by person, bank and number, nulls being equal; of several stored ones the least
    id counts. A new account takes its id from a digest of these three, so that every run gives the same
    one, and type and holder from its first upload by ``uploaded_at``, of equal times by id.
    """
    known = accounts.groupBy(*ACCOUNT_KEY).agg(F.min("account_id").alias("_found"))
    known = known.select(*[F.col(k).alias("_" + k) for k in ACCOUNT_KEY], "_found")
    first = F.struct("uploaded_at", "statement_id")
    asked = uploads.groupBy(*ACCOUNT_KEY).agg(*[F.min_by(c, first).alias(c) for c in ("account_type", "holder_name")])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col("_" + k)) for k in ACCOUNT_KEY])
    made = F.concat(F.lit("a-"), F.md5(F.to_json(F.struct(*ACCOUNT_KEY)).cast("binary")))
    return asked.join(known, same, "left").select(
        *ACCOUNT_KEY, F.coalesce("_found", made).alias("account_id"), F.col("_found").isNull().alias("is_new"), "account_type", "holder_name"
    )


def enriched_rows(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Ledger rows of ``statements`` (statement_id, account_id, case_id, opening_balance).

    ``rows`` has ``statement_id, seq, date, description, amount, type`` and any of ``GIVEN``. What is
    given and not blank counts; else channel, category and counterparty are read from the description. A
    printed ``balance_after`` restarts the running balance.
    """
    missing = {c: F.lit(None).cast(kind) for c, kind in GIVEN.items() if c not in rows.columns}
    full = rows.withColumns({**missing, "amount": F.col("amount").cast("decimal(18,2)")})
    full = full.withColumns({"direction": F.col("type"), "raw_description": F.coalesce("description", F.lit(""))})
    placed = balances.with_row_index(full).join(statements.select("statement_id", "account_id", "case_id", "opening_balance"), "statement_id")
    raw = F.col("raw_description")
    given = blank_to_null(F.col("counterparty"))
    told = balances.running_balance(placed).withColumns(
        {
            "channel": enrich.prefer(F.col("channel"), enrich.infer_channel(raw)),
            "category": enrich.prefer(F.col("category"), enrich.infer_category(raw)),
            "counterparty": F.coalesce(given, enrich.infer_counterparty(raw)),
            "_given": given.isNotNull(),
        }
    )
    told = told.withColumn("confidence", enrich.confidence(F.col("counterparty"), F.col("channel")))
    return told.select(
        "case_id", "account_id", "statement_id", "row_index",
        enrich.iso_date(F.coalesce("date", F.lit(""))).alias("txn_date"),
        "amount", "direction", "running_balance", "raw_description", "channel", "category", "counterparty",
        enrich.entities_map(F.col("channel"), F.col("counterparty"), F.col("category"), F.col("_given"), F.col("confidence")).alias("entities"),
        "confidence",
        enrich.intake_flags(F.col("counterparty"), F.col("is_self_transfer")).alias("flags"),
        F.lit("unreviewed").alias("review_status"),
        F.lit(0).alias("edit_count"),
        blank_to_null(F.col("entity_type")).alias("llm_entity_type"),
        "is_self_transfer",
        blank_to_null(F.col("notable_reason")).alias("notable_reason"),
    )


def ingest_batch(stored: dict[str, DataFrame], uploads: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """New rows and changed tables of a batch.

    ``stored`` holds ``cases`` (case_id, updated_at), ``persons`` (person_id, case_id), ``accounts`` (account_id, person_id, bank,
    account_number, account_type, holder_name, transaction_count, has_warnings) and ``statements`` (statement_id, account_id,
    file_hash, uploaded_at, source_file_name, extracted_txn_count). An upload has ``statement_id,
    case_id``, the account's key, type and holder, ``opening_balance, declared_dr, declared_cr, uploaded_at`` and what
    else its statement shall keep; ``rows`` are as in ``enriched_rows``.

    Returns ``uploads`` (see ``screened``), ``statements`` and ``transactions`` to be appended, and whole new ``accounts`` and ``cases``:
    an account counts the rows of its new statements and has warnings if it had some or a sum is off; a case is
    updated at the last of its uploads. Statements without rows are stored with none.
    """
    # All results read the judged uploads and their accounts; both are saved once.
    marked = cut_lineage(screened(stored, uploads))
    fresh = marked.filter("outcome = 'new'").drop("outcome", "duplicate_of")
    found = find_or_make_accounts(stored["accounts"], fresh)
    on = reduce(Column.__and__, [F.col("f." + k).eqNullSafe(F.col("a." + k)) for k in ACCOUNT_KEY])
    owned = cut_lineage(fresh.alias("f").join(found.alias("a"), on).select("f.*", "a.account_id"))
    checked = summary.sum_check(rows.withColumn("direction", F.col("type")), owned.select("statement_id", "account_id", "declared_dr", "declared_cr"))
    kept = [c for c in owned.columns if c not in (*_OF_ACCOUNT, "statement_id", "account_id")]
    statements = owned.join(checked.drop("account_id"), "statement_id").select(
        "statement_id", "account_id", *kept,
        F.col("extracted").cast("int").alias("extracted_txn_count"),
        F.col("debits_pct").alias("sum_check_debits_pct"),
        F.col("credits_pct").alias("sum_check_credits_pct"),
    )
    more = summary.account_counters(checked).select("account_id", F.col("transaction_count").alias("_more"), F.col("has_warnings").alias("_warned"))
    made = found.filter("is_new").drop("is_new").withColumns({"transaction_count": F.lit(0), "has_warnings": F.lit(False)})
    accounts = stored["accounts"].unionByName(made, allowMissingColumns=True).join(more, "account_id", "left")
    kind = stored["accounts"].schema["transaction_count"].dataType
    accounts = accounts.withColumns(
        {
            "transaction_count": (F.col("transaction_count") + F.coalesce("_more", F.lit(0))).cast(kind),
            "has_warnings": F.col("has_warnings") | F.coalesce("_warned", F.lit(False)),
        }
    ).select(*stored["accounts"].columns)
    last = fresh.groupBy("case_id").agg(F.max("uploaded_at").alias("_last"))
    cases = stored["cases"].join(last, "case_id", "left").withColumn("updated_at", F.coalesce("_last", "updated_at"))
    return {
        "uploads": marked,
        "statements": statements,
        "transactions": enriched_rows(owned, rows),
        "accounts": accounts,
        "cases": cases.select(*stored["cases"].columns),
    }


def export_rows(cases: DataFrame, persons: DataFrame, accounts: DataFrame, statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """Everything of every case as ``(case_id, kind, key, body)``, to be written partitioned by case and kind.

    ``body`` is the row as JSON; statements and transactions carry bank, number and holder of their
    account and the person's name. Rows whose owner is missing are left out.
    """
    people = persons.select("case_id", "person_id", F.col("name").alias("person_name"))
    owned = accounts.join(people, "person_id")
    owner = owned.select("account_id", "case_id", "person_id", "person_name", "bank", "account_number", "holder_name")
    papers = statements.join(owner, "account_id")
    lines = transactions.drop("account_id", "case_id").join(papers.select("statement_id", "source_file_name", *owner.columns), "statement_id")
    parts = {
        "case": (cases, "case_id"), "person": (persons, "person_id"), "account": (owned, "account_id"),
        "statement": (papers, "statement_id"), "transaction": (lines, None),
    }
    place = F.concat_ws("#", F.col("statement_id").cast("string"), F.format_string("%06d", "row_index"))
    each = [
        df.select("case_id", F.lit(kind).alias("kind"), (F.col(key).cast("string") if key else place).alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("body"))
        for kind, (df, key) in parts.items()
    ]
    return reduce(DataFrame.unionByName, each)
