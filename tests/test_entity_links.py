"""Entities and links by hand, on small rows and against plain loops."""

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from casetrail.operators import entities as N
from casetrail.operators import entity_links as L

ENTITY = "case_id int, key string, name string, aliases array<string>, entity_type string, auto_created boolean"
LEDGER = "case_id int, id int, row_index int, seq int, txn_date date, amount decimal(18,2), direction string, counterparty string"


def ledger(spark):
    rows = [
        (1, 1, 2, 1, date(2024, 1, 1), D(5), "Dr", "Acme Tools"), (1, 2, 1, 2, date(2024, 1, 1), D(6), "Cr", " ACME tools "),
        (1, 3, 1, 3, None, D(7), "Dr", None), (1, 4, 1, 4, date(2024, 2, 1), None, None, "upi"), (2, 5, 1, 5, date(2024, 1, 1), D(1), "Dr", "Acme Tools"),
    ]
    return spark.createDataFrame(rows, LEDGER)


def found(spark):
    return spark.createDataFrame([(1, "acme tools", "Acme", ["acme tools"], "merchant", True), (1, "b", "ACME", None, "bank", True)], ENTITY)


def test_create(spark):
    fresh = spark.createDataFrame(
        [(1, "Tools of Acme 7", "vendor", 1, "123"), (1, "ACME TOOLS", "shop", 2, None), (1, "UPI", "x", 1, None), (1, None, "x", 1, None), (9, "Nobody", "x", 1, None)],
        "case_id int, name string, entity_type string, created_at int, pan string",
    )
    cases = spark.createDataFrame([(1,)], "case_id int")
    rows = {(r["case_id"], r["key"]): r for r in L.create_entities(found(spark), cases, fresh).collect()}
    assert sorted(rows) == [(1, '"upi"'), (1, "acme of tools"), (1, "acme tools"), (1, "b")]
    taken = rows[1, "acme tools"]
    assert (taken["name"], taken["aliases"], taken["auto_created"], taken["entity_type"]) == ("ACME TOOLS", ["Acme", "acme tools"], False, "shop")
    assert (rows[1, "acme of tools"]["pan"], rows[1, "acme of tools"]["aliases"], rows[1, "b"]["pan"]) == ("123", [], None)
    assert L.create_entities(found(spark), cases, fresh.limit(0)).count() == 2
    assert L.create_entities(found(spark).limit(0), cases, fresh).count() == 3


def test_links_are_idempotent(spark):
    linked = spark.createDataFrame([(1, 1, "b", "counterparty", 1)], "case_id int, id int, key string, role string, link_seq int")
    wanted = [(1, 1, "b", None, 8), (1, 1, "b", "owner", 9), (1, 1, "b", "owner", 7), (1, 99, "b", None, 1), (1, 2, "none", None, 1), (2, 5, "b", None, 1), (None, 1, "b", None, 1)]
    got = L.link(linked, spark.createDataFrame(wanted, linked.schema), ledger(spark), found(spark))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "b", "counterparty", 1), (1, 1, "b", "owner", 7)]
    again = L.link(got, spark.createDataFrame(wanted, linked.schema), ledger(spark), found(spark))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert N.unlink(got.drop("link_seq"), got.limit(1)).count() == 0


def test_rows_of_entities_in_order(spark):
    linked = spark.createDataFrame([(1, i, "b", role) for i in (1, 2, 3, 4) for role in ("counterparty", "owner")] + [(1, 1, "a", "x"), (2, 5, "b", "x")], "case_id int, id int, key string, role string")
    rows = [(r["case_id"], r["key"], r["id"]) for r in L.entity_rows(linked, ledger(spark)).collect()]
    assert rows == [(1, "a", 1), (1, "b", 4), (1, "b", 2), (1, "b", 1), (1, "b", 3), (2, "b", 5)]
    one = L.entity_rows(linked, ledger(spark), spark.createDataFrame([(1, "a"), (1, "a")], "case_id int, key string"))
    assert [r["id"] for r in one.collect()] == [1]
    newest = sorted((r["case_id"], r["key"], r["place"], r["id"]) for r in L.newest_rows(linked, ledger(spark), 2).collect())
    assert newest == [(1, "a", 1, 1), (1, "b", 1, 4), (1, "b", 2, 2), (2, "b", 1, 5)]


def test_entities_of_rows_and_their_order(spark):
    linked = spark.createDataFrame([(1, 1, "b", "counterparty"), (1, 1, "b", "owner"), (1, 1, "acme tools", "owner"), (1, 2, "b", "owner")], "case_id int, id int, key string, role string")
    stats = N.entity_stats(found(spark), linked, ledger(spark))
    got = L.entities_of(linked, stats, ledger(spark).filter("id = 1"))
    assert sorted((r["id"], r["key"], r["txn_count"], r["total_cr"]) for r in got.collect()) == [(1, "acme tools", 1, D(0)), (1, "b", 2, D(6))]
    assert [r["key"] for r in L.by_use(stats).collect()] == ["b", "acme tools"]


def test_suggestions_against_a_loop(spark):
    known = found(spark).withColumn("entity_seq", F.when(F.col("key") == "b", 1).otherwise(2))
    entities = [r.asDict() for r in known.collect()]
    for table, order in ((known, "entity_seq"), (known.drop("entity_seq"), "key")):
        for row in L.suggestions(ledger(spark).withColumn("counterparty", F.when(F.col("id") == 5, "x").when(F.col("id") == 4, "acme").otherwise(F.col("counterparty"))), table).collect():
            party = {1: "acme tools", 2: "acme tools", 4: "acme"}.get(row["id"])
            fits = [e for e in sorted(entities, key=lambda e: e[order]) if party in [e["name"].lower(), *map(str.lower, e["aliases"] or [])]]
            assert row["key"] == (fits[0]["key"] if fits else None)


def test_counts_of_a_resolution(spark):
    moves = spark.createDataFrame([(1, "x", "y")], "case_id int, key string, into string")
    got = {r["case_id"]: tuple(r)[1:] for r in L.resolution_counts(ledger(spark), found(spark), moves).collect()}
    assert got == {1: (0, 1, 1, 1), 2: (1, 0, 0, 1)}
    assert L.resolution_counts(ledger(spark).limit(0), found(spark), moves).count() == 0
