"""Queries that go through the resolved ledger several times read its tables once."""

from pyspark.sql import functions as F

from casetrail.operators import entities as N
from catalog import canvas, entities, entity_links

SF = "/root/testdata/sf0.001"


def test_the_tables_are_read_before_the_plan(spark):
    wide = (entities._merged, entities._stats, entity_links._counts, canvas._inspected, canvas._compared, canvas._nodes, canvas._edges)
    for query in wide:
        assert not query(spark, SF).inputFiles(), query.__name__


def test_keys_told_before_are_the_same(spark):
    rows = [(1, 1, "Acme Shop Ltd"), (1, 2, "shop ACME"), (1, 3, "UPI 12"), (1, 4, None)]
    ledger = spark.createDataFrame(rows, "case_id int, id int, counterparty string").withColumn("seq", F.col("id"))
    told = N.with_keys(ledger)
    assert N.keyed(told).select(*ledger.columns, "key").collect() == N.keyed(ledger).select(*ledger.columns, "key").collect()
    assert N.keyed(told.withColumn("counterparty", F.lit("x"))).select("key").distinct().collect() == [("acme shop",)]


def test_unread_samples_are_not_gathered(spark):
    found = canvas._edges(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan(found) and "Window" not in plan(found.select("case_id", "source", "target", "total_amount"))


def test_spellings_and_name_come_from_one_grouping(spark):
    rows = [(1, 1, "acme shop"), (1, 2, "Acme Shop"), (1, 3, "Acme Shop"), (2, 4, "ACME SHOP")]
    ledger = spark.createDataFrame(rows, "case_id int, seq int, counterparty string").withColumn("id", F.col("seq"))
    found = {r.case_id: (r["name"], r.aliases) for r in N.resolve(ledger).collect()}
    assert found == {1: ("Acme Shop", ["acme shop"]), 2: ("ACME SHOP", [])}
    assert "Join" not in N.resolve(ledger)._jdf.queryExecution().optimizedPlan().toString()
