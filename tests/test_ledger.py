"""Parser, summaries, balances, edits and velocity on hand-made rows."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casetrail.functions.text import extract, strip
from casetrail.operators import balances, parsing, scores, summary, velocity

SAVINGS = "withdrawalamt closingbalance\nOpeningBalance x\n1,000.00\n"


def parsed(spark, text):
    df = spark.createDataFrame([(1, text)], "statement_id int, text string")
    rows = parsing.parse_text(df).orderBy("pos").collect()
    return [(r["date"], r["description"], r["amount"], r["type"]) for r in rows]


def savings_line(day, words, amount, balance):
    return f"{day:02d}/01/24 {words} {'9' * 14} {day:02d}/01/24 {amount} {balance}"


def test_strip_and_extract(spark):
    row = spark.range(1).select(
        strip(F.lit("  a b\t ")).alias("s"),
        extract(F.lit("x1 x2"), r"x(\d)").alias("e"),
        extract(F.lit("y"), r"x(\d)").alias("n"),
    ).first()
    assert (row["s"], row["e"], row["n"]) == ("a b", "1", None)


def test_savings_direction_follows_balance(spark):
    text = SAVINGS + "\n".join(
        [
            savings_line(1, "REFUND SHOP", "100.00", "900.00"),  # the balance fell: a debit despite the word
            savings_line(2, "PAYMENT", "50.00", "950.00"),
            savings_line(3, "NEGATIVE", "-5.00", "945.00"),
            savings_line(4, "SALARY MAY", "70.00", "5,000.00"),  # the change fits nothing: by wording
        ]
    )
    assert [(d, t) for _, d, _, t in parsed(spark, text)] == [
        ("REFUND SHOP", "Dr"), ("PAYMENT", "Cr"), ("SALARY MAY", "Cr"),
    ]


def test_no_break_spaces_are_blanks(spark):
    plain = SAVINGS + savings_line(1, "PAYMENT", "50.00", "950.00")
    assert len(parsed(spark, plain)) == len(parsed(spark, plain.replace(" 01/01/24 50", " 01/01/24 50"))) == 1


def test_kotak_needs_its_date_line(spark):
    head = "Sl. No. Date Description\n"
    line = "UPI/SHOP X 50.00 DR 950.00 CR\n"
    assert len(parsed(spark, head + line + "1 02/01/2024\n")) == 1
    assert parsed(spark, head + line + "no date\n") == []


def test_idfc_needs_a_direction(spark):
    head = "IDFC FIRST Bank\n"
    row = "01 Jan 24 01 Jan 24 UPI/{}/1234/SHOP 50.00 950.00 CR"
    assert len(parsed(spark, head + row.format("DR"))) == 1 and parsed(spark, head + row.format("XX")) == []


def test_long_statement(spark):
    """The work is linear in the lines of one text."""
    lines = [savings_line(1 + k % 28, f"PAYMENT {k}", "1.00", f"{100000 - k}.00") for k in range(100_000)]
    df = spark.createDataFrame([(1, SAVINGS + "\n".join(lines))], "statement_id int, text string")
    assert parsing.parse_text(df).count() == 100_000


LEDGER = "case_id int, id int, seq int, statement_id string, row_index int, txn_date date, amount decimal(18,2), direction string, counterparty string, category string, flags array<string>, tags array<string>, review_status string"


def ledger(spark):
    d = datetime(2024, 1, 5).date()
    rows = [
        (1, 10, 1, "a", 1, d, Decimal("5.00"), "Dr", "x", None, ["VELOCITY_SPIKE", "NEW_ONE"], [], "reviewed"),
        (1, 11, 2, "a", 2, None, Decimal("7.00"), "Cr", "", "Food", [], ["t"], "flagged"),
        (1, 12, 3, "b", 1, d, Decimal("9.00"), "??", "y", "Food", ["VELOCITY_SPIKE"], [], None),
        (1, 13, 4, "b", 2, d, Decimal("1.00"), "Dr", "x", "", [], [], "unreviewed"),
    ]
    return spark.createDataFrame(rows, LEDGER)


def test_summary(spark):
    r = summary.case_summary(ledger(spark)).first()
    assert (r["total_dr"], r["total_cr"], r["net"], r["flag_count"]) == (Decimal("6.00"), Decimal("16.00"), Decimal("10.00"), 3)
    assert (r["reviewed_count"], r["flagged_count"], r["unreviewed_count"]) == (1, 1, 2)
    top = summary.top_counterparties(ledger(spark)).orderBy("place").collect()
    assert [(t["name"], t["count"]) for t in top] == [("x", 2), ("(unknown)", 1), ("y", 1)]
    months = {m["month"]: m["count"] for m in summary.monthly_series(ledger(spark)).collect()}
    assert months == {"2024-01": 3, "unknown": 1}


def test_scoreboard_lists_every_pattern(spark):
    board = {b["name"]: b for b in summary.pattern_scoreboard(ledger(spark)).collect()}
    assert len(board) == 9 and board["VELOCITY_SPIKE"]["sample_txn_ids"] == [10, 12]
    assert (board["NEW_ONE"]["label"], board["NEW_ONE"]["severity"]) == ("New One", "low")
    assert board["STRUCTURING_SUSPECTED"]["count"] == 0


def test_running_balance_starts_anew(spark):
    rows = [("a", 1, 10, "Cr", None), ("a", 2, 4, "Dr", None), ("a", 3, 1, "Cr", 50), ("a", 4, 5, "Dr", None)]
    df = spark.createDataFrame(
        [(s, k, Decimal(a), d, None if b is None else Decimal(b), Decimal(100)) for s, k, a, d, b in rows],
        "statement_id string, row_index int, amount decimal(18,2), direction string, balance_after decimal(18,2), opening_balance decimal(18,2)",
    )
    told = [int(r["running_balance"]) for r in balances.running_balance(df).orderBy("row_index").collect()]
    assert told == [110, 106, 50, 45]


def test_edits_move_later_balances(spark):
    base = ledger(spark).withColumns({"running_balance": F.lit(100).cast("decimal(28,2)"), "edit_count": F.lit(0)})
    patches = spark.createDataFrame(
        [(10, 1, "amount", "8"), (10, 2, "amount", "6"), (10, 2, "review_status", "flagged"), (99, 3, "amount", "1"), (11, 4, "colour", "x")],
        "id int, patch_seq int, field string, value string",
    )
    rows = {r["id"]: r for r in balances.patch_transactions(base, patches).collect()}
    assert (rows[10]["amount"], rows[10]["running_balance"], rows[10]["edit_count"]) == (Decimal("6.00"), Decimal("99.00"), 2)
    assert rows[11]["running_balance"] == Decimal("99.00") and rows[12]["running_balance"] == Decimal("100.00")
    events = balances.audit_events(base, patches).orderBy("patch_seq", "field").collect()
    assert [(e["old_value"], e["new_value"]) for e in events] == [("5.00", "8"), ("8", "6"), ("reviewed", "flagged")]


def test_edits_of_lists_maps_and_cleared_fields(spark):
    party = F.create_map(F.lit("party"), F.struct(F.lit("x").alias("value"), F.lit(0.5).alias("confidence")))
    base = ledger(spark).withColumns({"running_balance": F.lit(0).cast("decimal(28,2)"), "edit_count": F.lit(0), "entities": party})
    typed = '{"party":{"value":"y","confidence":1.0}}'
    patches = spark.createDataFrame(
        [(10, 1, "tags", '["a"]'), (10, 2, "tags", '["b","c"]'), (10, 2, "entities", typed), (13, 1, "txn_date", None),
         (13, 2, "txn_date", "2024-02-01"), (12, 1, "txn_date", None), (12, 1, "amount", None), (11, 1, "review_status", None)],
        "id int, patch_seq int, field string, value string",
    )
    rows = {r["id"]: r for r in balances.patch_transactions(base, patches).collect()}
    assert rows[10]["tags"] == ["b", "c"] and rows[10]["entities"]["party"]["value"] == "y" and rows[11]["tags"] == ["t"]
    assert rows[12]["txn_date"] is None and rows[12]["amount"] == Decimal("9.00") and rows[11]["review_status"] is None
    assert str(rows[13]["txn_date"]) == "2024-02-01" and rows[13]["edit_count"] == 2
    events = {(e["id"], e["patch_seq"], e["field"]): (e["old_value"], e["new_value"]) for e in balances.audit_events(base, patches).collect()}
    assert len(events) == 7 and events[10, 1, "tags"] == ("[]", '["a"]') and events[10, 2, "tags"] == ('["a"]', '["b","c"]')
    assert events[13, 2, "txn_date"] == (None, "2024-02-01") and events[10, 2, "entities"] == ('{"party":{"value":"x","confidence":0.5}}', typed)


def test_declared_files_without_rows(spark):
    rows = spark.createDataFrame([("a", Decimal("5.00"), "Dr"), ("c", Decimal("1.00"), "Cr")], "file string, amount decimal(18,2), type string")
    declared = spark.createDataFrame([("a", 1, 5.0, 0.0, -5.0), ("b", 2, 1.0, 1.0, 0.0)], "file string, count int, debits double, credits double, net_change double")
    told = {r["file"]: r for r in scores.control_totals(rows, declared).collect()}
    assert told["a"]["count_ok"] and told["a"]["debits_ok"] and told["a"]["credits_ok"] and told["a"]["net_ok"]
    assert (told["b"]["rows"], told["b"]["count_ok"], told["b"]["debits_ok"], told["b"]["status"]) == (0, False, False, "checked")
    assert told["c"]["status"] == "no-truth" and told["c"]["count_ok"] is None


def test_workbench_filter(spark):
    fit = lambda **k: sorted(r["id"] for r in summary.workbench_filter(ledger(spark).withColumns({"raw_description": F.lit("UPI Pay"), "channel": F.lit("UPI")}), **k).collect())
    assert fit(flagged=True) == [10, 11, 12]
    assert fit(needs_review=True, direction="Dr") == [13]
    assert fit(search="food", tags=["t", "u"]) == [11]


def test_velocity(spark):
    at = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [
        ("p", "q", Decimal(10), at(1), "USDT", 1),
        ("q", "r", Decimal(9), at(3), "USDT", 6),
        ("r", "q", Decimal(1), at(30), None, 1),
        ("q", "q", Decimal(2), at(40), "", 1),
    ]
    df = spark.createDataFrame(rows, "from_address string, to_address string, value decimal(18,4), ts timestamp, token string, input_count int")
    wanted = spark.createDataFrame([("q",), ("none",)], "address string")
    found = {r["address"]: r for r in velocity.analyze(velocity.classified(df, wanted), wanted).collect()}
    q = found["q"]
    assert (q["transaction_count"], q["primary_token"], q["fund_through_rate"], q["consolidation_ratio"]) == (4, "USDT", 0.9, 0.25)
    assert q["dwell_time_hours"] == pytest.approx(6.0)  # 2 and 10 hours
    assert q["velocity_profile"] == "Relay" and 0 < q["velocity_risk_score"] <= 0.95
    assert (found["none"]["velocity_profile"], found["none"]["velocity_risk_score"]) == ("Dormant", 0.0)
