"""Batches of uploads on hand-made rows."""

from decimal import Decimal as D

import pytest

from casetrail.operators import ingest as I

UPLOAD = (
    "statement_id string, case_id int, person_id int, bank string, account_number string, account_type string, holder_name string, opening_balance decimal(18,2), "
    "declared_dr decimal(18,2), declared_cr decimal(18,2), uploaded_at string, file_hash string, source_file_name string, extra string"
)
ROW = "statement_id string, seq int, date string, description string, amount decimal(18,2), type string"


def stored(spark):
    return {
        "cases": spark.createDataFrame([(1, "2020"), (2, None)], "case_id int, updated_at string"),
        "persons": spark.createDataFrame([(10, 1, "P"), (11, 1, "Q")], "person_id int, case_id int, name string"),
        "accounts": spark.createDataFrame(
            [("b", 10, None, "77", "savings", "P", 3, False), ("a", 10, None, "77", "savings", "P", 5, False), ("c", 11, "X", "1", None, None, 2, True)],
            "account_id string, person_id int, bank string, account_number string, account_type string, holder_name string, transaction_count long, has_warnings boolean",
        ),
        "statements": spark.createDataFrame(
            [("s0", "c", "h", "2021", "f.pdf", 2)], "statement_id string, account_id string, file_hash string, uploaded_at string, source_file_name string, extracted_txn_count int"
        ),
    }


def upload(sid, case=1, person=10, bank=None, number="77", dr=None, at="2024", mark=None, kind="current"):
    return (sid, case, person, bank, number, kind, "H", D(100), dr, None, at, mark, "f.pdf", "kept")


@pytest.fixture(scope="module")
def batch(spark):
    uploads = [
        upload("s1", dr=D(30)),
        upload("s1", at="2025", number="wrong"),
        upload("s2", bank="X", number="9", at="2023", kind="first"),
        upload("s3", bank="X", number="9", at="2022", mark="h", kind="earlier"),
        upload("s0", person=11), upload("s4", case=3), upload("s5", person=99), upload(None),
    ]
    rows = [
        ("s1", 2, "01/02/2024", "UPI/AMAZON/1", D(10), "Dr"), ("s1", 1, "x", None, D(5), "Cr"), ("s1", 3, None, "ATM", D(10), "Dr"),
        ("s2", 1, "1/2/2024", "NEFT-SHOP", D(1), "Cr"), ("s4", 1, "01/02/2024", "lost", D(1), "Dr"), (None, 1, "01/02/2024", "nobody", D(1), "Dr"),
    ]
    return I.ingest_batch(stored(spark), spark.createDataFrame(uploads, UPLOAD), spark.createDataFrame(rows, ROW))


def test_outcomes(batch):
    told = {r["statement_id"]: (r["outcome"], r["duplicate_of"]) for r in batch["uploads"].collect()}
    assert told == {"s1": ("new", None), "s2": ("new", None), "s3": ("new", "s0"), "s0": ("stored before", None), "s4": ("no case", None), "s5": ("no person", None)}


def test_accounts_are_found_or_made(batch):
    papers = {r["statement_id"]: r for r in batch["statements"].collect()}
    assert papers["s1"]["account_id"] == "a" and papers["s2"]["account_id"] == papers["s3"]["account_id"]
    assert (papers["s1"]["sum_check_debits_pct"], papers["s1"]["extra"], papers["s3"]["extracted_txn_count"]) == (66.67, "kept", 0)
    accounts = {r["account_id"]: r for r in batch["accounts"].collect()}
    assert (accounts["a"]["transaction_count"], accounts["a"]["has_warnings"]) == (8, True)
    assert (accounts["b"]["transaction_count"], accounts["c"]["transaction_count"], accounts["c"]["has_warnings"]) == (3, 2, True)
    made = accounts[papers["s2"]["account_id"]]
    assert (made["account_type"], made["transaction_count"], made["has_warnings"], len(accounts)) == ("earlier", 1, False, 4)


def test_rows_are_enriched(batch):
    rows = {(r["statement_id"], r["row_index"]): r for r in batch["transactions"].collect()}
    assert sorted(rows) == [("s1", 1), ("s1", 2), ("s1", 3), ("s2", 1)]
    first, second = rows["s1", 1], rows["s1", 2]
    assert (first["running_balance"], first["counterparty"], first["flags"], first["txn_date"]) == (D(105), "(unknown)", ["NEEDS_REVIEW"], "x")
    assert (second["running_balance"], second["channel"], second["category"], second["txn_date"]) == (D(95), "UPI", "Shopping", "2024-02-01")
    assert rows["s1", 3]["txn_date"] == "" and rows["s1", 3]["llm_entity_type"] is None and second["entities"]["counterparty"]["source"] == "extracted"


def test_what_is_given_counts(spark):
    papers = spark.createDataFrame([("s", "a", 1, D(0))], "statement_id string, account_id string, case_id int, opening_balance decimal(18,2)")
    rows = spark.createDataFrame(
        [("s", 1, "01/02/2024", "UPI/X/1", D(1), "Dr", " ", " Shop ", " bank ", True, D(50)), ("s", 2, "01/02/2024", "UPI/X/1", D(1), "Dr", "CARD", "", "", None, None)],
        ROW + ", channel string, counterparty string, entity_type string, is_self_transfer boolean, balance_after decimal(18,2)",
    )
    one, two = sorted(I.enriched_rows(papers, rows).collect(), key=lambda r: r["row_index"])
    assert (one["channel"], one["counterparty"], one["llm_entity_type"], one["flags"], one["running_balance"]) == ("UPI", "Shop", "bank", ["SELF_TRANSFER"], D(50))
    assert (two["channel"], two["counterparty"], two["llm_entity_type"], two["running_balance"]) == ("CARD", "X", None, D(49))
    assert one["entities"]["counterparty"].asDict() == {"value": "Shop", "source": "llm_overlay", "confidence": 0.95}


def test_a_batch_sent_twice_adds_nothing(spark, batch):
    first = stored(spark)
    first["statements"] = first["statements"].unionByName(batch["statements"], allowMissingColumns=True)
    again = I.ingest_batch(first | {"accounts": batch["accounts"]}, spark.createDataFrame([upload("s1"), upload("s2")], UPLOAD), spark.createDataFrame([("s1", 1, "", "", D(1), "Dr")], ROW))
    assert again["statements"].count() == again["transactions"].count() == 0
    assert sorted(map(tuple, again["accounts"].collect())) == sorted(map(tuple, batch["accounts"].collect()))


def test_empty_tables(spark):
    none = {k: v.limit(0) for k, v in stored(spark).items()}
    got = I.ingest_batch(none, spark.createDataFrame([upload("s1")], UPLOAD), spark.createDataFrame([], ROW))
    assert got["uploads"].collect()[0]["outcome"] == "no case" and got["accounts"].count() == got["transactions"].count() == 0
