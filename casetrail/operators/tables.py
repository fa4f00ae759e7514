"""Changes across several tables at once: upserts, cascading deletes, duplicates and lookups.

Tables are DataFrames; a change gives new ones, which the caller writes. Nothing is collected: what
was changed is told by small DataFrames of counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with the rows of ``fresh`` put in: one row for each ``key``.

    Of several fresh rows of a key the last by ``order`` counts, of equal ones that whose other columns
    are greatest. A fresh row replaces the stored one, except for its columns ``keep``: where the stored row has a
    value there, it stays. Stored rows without a fresh one stay as they are. Keys compare nulls as
    equal. Columns that only one side has are null for rows of the other.
    """
    names = list(dict.fromkeys([*stored.columns, *fresh.columns]))
    rest = [c for c in fresh.columns if c not in key and c != order]
    latest = fresh.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_new"))
    old = stored.select(*[F.col(k).alias("_" + k) for k in key], F.struct(*[c for c in stored.columns if c not in key]).alias("_old"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col("_" + k)) for k in key])
    both = latest.join(old, same, "full_outer")
    is_new = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        if name in key:
            return F.when(is_new, F.col(name)).otherwise(F.col("_" + name))
        new = F.col("_new")[name] if name in fresh.columns else None
        was = F.col("_old")[name] if name in stored.columns else None
        if new is None:
            return was
        if was is None:
            return new
        return F.coalesce(was, new) if name in keep else F.when(is_new, new).otherwise(was)

    return both.select(*[value(c).alias(c) for c in names])


def _hit(rows: DataFrame, marked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the marked ones, and the others."""
    ids = marked.select(key).distinct()
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def delete_statements(tables: dict[str, DataFrame], wanted: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete statements with all that hangs on them.

    ``tables`` holds ``accounts`` (account_id, transaction_count, ...), ``statements`` (statement_id, account_id,
    ...), ``transactions`` (id, statement_id, ...), ``links`` and ``edits`` (id, ...); ``wanted`` has ``statement_id``. Edits
    and links of the statements' transactions go, the transactions and the statements, then accounts
    that are left without a statement; other accounts count as many transactions less, 0 at least.

    Returns the new tables and one row for each statement that was there: ``statement_id, account_id,
    transactions_deleted, audit_events_deleted, entity_links_deleted, account_deleted``.
    """
    gone, statements = _hit(tables["statements"], wanted, "statement_id")
    rows, transactions = _hit(tables["transactions"], gone, "statement_id")
    owner = rows.select("id", "statement_id")
    kept = {"statements": statements, "transactions": transactions}
    count = lambda df, name: df.groupBy("statement_id").agg(F.count(F.lit(1)).alias(name))
    counts = [count(owner, "transactions_deleted")]
    for name, told in (("edits", "audit_events_deleted"), ("links", "entity_links_deleted")):
        dropped, kept[name] = _hit(tables[name], owner, "id")
        counts.append(count(dropped.select("id").join(owner, "id"), told))
    left = statements.select("account_id").distinct().withColumn("_left", F.lit(True))
    fewer = owner.join(gone.select("statement_id", "account_id"), "statement_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("_fewer"))
    touched = gone.select("account_id").distinct().withColumn("_touched", F.lit(True))
    accounts = tables["accounts"].join(touched, "account_id", "left").join(left, "account_id", "left").join(fewer, "account_id", "left")
    accounts = accounts.filter(F.col("_touched").isNull() | F.col("_left"))
    lowered = F.greatest(F.col("transaction_count") - F.coalesce("_fewer", F.lit(0)), F.lit(0))
    columns = tables["accounts"].columns
    kind = tables["accounts"].schema["transaction_count"].dataType
    kept["accounts"] = accounts.select(*[lowered.cast(kind).alias(c) if c == "transaction_count" else F.col(c) for c in columns])
    known = tables["accounts"].select("account_id", F.lit(True).alias("_known"))
    told = gone.select("statement_id", "account_id").join(left, "account_id", "left").join(known, "account_id", "left")
    for c in counts:
        told = told.join(c, "statement_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = told.select(
        "statement_id", "account_id", number("transactions_deleted"), number("audit_events_deleted"), number("entity_links_deleted"),
        (F.col("_left").isNull() & F.col("_known").isNotNull()).alias("account_deleted"),
    )
    return kept, report


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` of each table."""
    each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def duplicate_statements(statements: DataFrame, accounts: DataFrame, persons: DataFrame, uploads: DataFrame) -> DataFrame:
    """For each of ``uploads`` (case_id, file_hash) the latest statement of its case with the same file: ``case_id,
    file_hash, statement_id, source_file_name, uploaded_at, extracted_txn_count, account_id``. Uploads without
    one, or without a hash, are left out; of equal times the greatest id counts."""
    owned = statements.join(accounts.select("account_id", "person_id"), "account_id").join(persons.select("person_id", "case_id"), "person_id")
    asked = uploads.select("case_id", "file_hash").filter("file_hash <> ''").distinct()
    facts = F.struct("uploaded_at", "statement_id", "source_file_name", "extracted_txn_count", "account_id")
    found = owned.join(asked, ["case_id", "file_hash"]).groupBy("case_id", "file_hash").agg(F.max(facts).alias("s"))
    return found.select("case_id", "file_hash", "s.statement_id", "s.source_file_name", "s.uploaded_at", "s.extracted_txn_count", "s.account_id")


def append_persons(persons: DataFrame, cases: DataFrame, fresh: DataFrame) -> DataFrame:
    """``persons`` and those of ``fresh`` whose case exists."""
    known = fresh.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    return persons.unionByName(known, allowMissingColumns=True)


def newest_page(rows: DataFrame, at: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of log rows, newest first, with the number of all rows as ``total``; a page has 1 to 500 rows."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a page has 1 to 500 rows and a start from 0")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc(at), F.desc(key)).offset(offset).limit(limit)
    # One row.
    return page.join(F.broadcast(total))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key by ``at``, whole; of equal times the greatest."""
    rest = [c for c in rows.columns if c not in (key, at)]
    best = rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in (at, *rest)]).select(*rows.columns)
