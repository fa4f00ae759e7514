"""The canvas and changes across tables on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from casetrail.operators import canvas as C
from casetrail.operators import tables as U

LEDGER = (
    "case_id int, id int, person_id int, holder_name string, account_id int, row_index int, txn_date date, amount decimal(18,2), direction string, "
    "flags array<string>, review_status string, raw_description string"
)


@pytest.fixture(scope="module")
def case(spark):
    from decimal import Decimal as D

    rows = [
        (1, 1, 7, "P", 70, 1, date(2024, 1, 1), D(5), "Dr", ["VELOCITY_SPIKE", "ODD"], None, "x" * 200),
        (1, 2, 7, "P", 70, 2, date(2024, 1, 2), D(6), "Dr", None, "flagged", None),
        (1, 3, 7, "P", 71, 1, None, D(1_000_000), "Cr", ["NEEDS_REVIEW"], "unreviewed", "c"),
        (1, 4, 8, None, 80, 1, date(2024, 3, 1), D(1), None, [], "reviewed", "d"),
    ]
    ledger = spark.createDataFrame(rows, LEDGER)
    entities = spark.createDataFrame([(1, "shop", "The Shop"), (1, "bank", "Bank"), (1, "none", "Unused")], "case_id int, key string, name string")
    links = spark.createDataFrame([(1, 1, "shop", 2), (1, 1, "bank", 1), (1, 2, "shop", 3), (1, 3, "shop", 4), (1, 4, "bank", 5)], "case_id int, id int, key string, link_seq int")
    found, lines = C.nodes(ledger, entities, links), C.edges(ledger, links, samples=1)
    return ledger, found.cache(), lines.cache()


def test_nodes(case):
    rows = {r["node"]: r for r in case[1].collect()}
    assert rows["person:7"]["size"] == 2 and rows["person:7"]["flagged"] is None and rows["person:7"]["flagged_txn_ids"] is None
    account = rows["account:70"]
    assert (account["flagged"], account["flagged_txn_ids"], account["pattern_hits"]) == (True, [1, 2], {"VELOCITY_SPIKE": 1})
    assert rows["account:71"]["high_value"] and rows["account:71"]["needs_review_txn_ids"] == [3] and not rows["account:71"]["flagged"]
    shop = rows["entity:shop"]
    assert (shop["size"], shop["flagged_txn_ids"], shop["high_value"]) == (3, [1, 2], True)
    assert (rows["entity:none"]["size"], rows["entity:none"]["flagged"], rows["entity:none"]["pattern_hits"]) == (0, False, {})


def test_edges_take_the_first_link_and_newest_sample(case):
    rows = {r["edge"]: r for r in case[2].collect()}
    # Transaction 1 was linked to the bank first.
    assert rows["out:70:bank"]["txn_count"] == 1 and rows["out:70:shop"]["sample_txn_ids"] == [2]
    assert len(rows["out:70:bank"]["sample_txns"][0]["raw_description"]) == 140
    assert rows["in:bank:80"]["kind"] == "flow_in" and rows["in:shop:71"]["date_min"] is None
    assert rows["owns:7:70"]["txn_count"] == 2 and rows["owns:7:70"]["sample_txns"] is None


def test_filters(case):
    _, found, lines = case
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    nodes, edges, hidden = C.filter_graph(found, lines, flagged_only=True, hide_orphans=True)
    assert ids(nodes, "node") == ["account:70", "entity:bank", "entity:shop", "person:7"] and hidden.collect()[0]["hidden"] == 1
    assert ids(edges, "edge") == ["out:70:bank", "out:70:shop", "owns:7:70"]
    assert ids(C.filter_graph(found, lines, least_amount=6)[1], "kind") == ["flow_in", "flow_out", "owns", "owns", "owns"]
    late = C.filter_graph(found, lines, ("account", "entity"), first_month="2024-02")[1]
    assert ids(late, "edge") == ["in:bank:80", "in:shop:71"]
    assert ids(C.filter_graph(found, lines, ("account", "entity"), last_month="2023-12")[1], "edge") == ["in:shop:71"]
    assert C.filter_graph(found, lines)[2].collect()[0]["hidden"] == 0
    assert ids(C.label_matches(found, " SHOP "), "node") == ["entity:shop"] and C.label_matches(found, " ").count() == 0


def test_focus_inspector_and_comparison(case, spark):
    ledger, found, lines = case
    chosen = spark.createDataFrame([(1, "account:80")], "case_id int, node string")
    nodes, edges = C.focus(lines, chosen)
    assert sorted(r["node"] for r in nodes.collect()) == ["account:80", "entity:bank", "person:8"] and edges.count() == 2
    told = {r["node"]: r for r in C.inspect(found, lines).collect()}
    assert (float(told["account:70"]["total_out"]), float(told["entity:shop"]["total_in"]), told["entity:shop"]["incident_txns"]) == (11.0, 6.0, 2)
    assert [tuple(p) for p in told["account:70"]["patterns"]] == [("VELOCITY_SPIKE", 1)] and tuple(told["account:70"]["partners"]) == (1, 0, 2)
    plain = {r["node"]: r for r in C.inspect(found, lines, relative=False).collect()}
    assert float(plain["entity:shop"]["total_in"]) == 0.0 and float(plain["account:70"]["total_out"]) == 11.0
    assert told["entity:none"]["incident_txns"] == 0
    pairs = spark.createDataFrame([(1, "entity:shop", "entity:bank"), (1, "entity:none", "account:70")], "case_id int, one string, two string")
    sides = {r["one"]: r for r in C.compare(C.inspect(found, lines), lines, pairs).collect()}
    assert sides["entity:shop"]["shared"] == 1 and sides["entity:none"]["shared"] == 0 and sides["entity:shop"]["one_flagged_txns"] == 2
    assert [r["edge"] for r in C.ranked_incident(lines).filter("node = 'account:70'").orderBy("place").collect()] == ["owns:7:70", "out:70:shop", "out:70:bank"]
    samples = [(r["id"], r["place"]) for r in C.flagged_samples(found, lines).filter("node = 'account:70'").orderBy("place").collect()]
    assert samples == [(2, 1), (1, 2)]
    cleared = C.unflag(ledger, found, spark.createDataFrame([(1, "account:70")], "case_id int, node string"))
    assert {r["id"]: r["review_status"] for r in cleared.collect()} == {1: "unreviewed", 2: "unreviewed", 3: "unreviewed", 4: "reviewed"}
    counts = {r["type"]: (r["nodes"], r["flagged"]) for r in C.node_counts(found).collect()}
    assert counts == {"person": (2, 0), "account": (3, 1), "entity": (3, 2)}


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "eth", 1), ("b", None, 2), (None, "x", 3)], "k string, chain string, v int")
    fresh = spark.createDataFrame([("a", "btc", 9, 1), ("a", "btc", 5, 2), ("b", "trx", 7, 1), ("c", "new", 8, 1), (None, "y", 4, 1)], "k string, chain string, w int, at int")
    made = sorted(map(tuple, U.upsert(stored, fresh, ["k"], "at", ("chain",)).select("k", "chain", "v", "w", "at").collect()), key=str)
    assert made == sorted([("a", "eth", 1, 5, 2), ("b", "trx", 2, 7, 1), ("c", "new", None, 8, 1), (None, "x", 3, 4, 1)], key=str)
    replaced = {r["k"]: r["chain"] for r in U.upsert(stored, fresh, ["k"], "at").collect()}
    assert replaced == {"a": "btc", "b": "trx", "c": "new", None: "y"}
    assert U.upsert(stored, fresh.limit(0), ["k"], "at").count() == 3


def test_delete(spark):
    tables = {
        "accounts": spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, 5)], "account_id int, transaction_count int"),
        "statements": spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 2), ("s4", 3), ("s5", 3)], "statement_id string, account_id int"),
        "transactions": spark.createDataFrame([(1, "s1"), (2, "s1"), (3, "s2"), (4, "s3"), (5, "s4")], "id int, statement_id string"),
        "links": spark.createDataFrame([(1, "x"), (1, "y"), (4, "x")], "id int, key string"),
        "edits": spark.createDataFrame([(2, "f"), (3, "f")], "id int, field string"),
    }
    kept, report = U.delete_statements(tables, spark.createDataFrame([("s1",), ("s3",), ("s4",), ("s1",), ("zz",), (None,)], "statement_id string"))
    told = {r["statement_id"]: tuple(r)[1:] for r in report.collect()}
    assert told == {"s1": (1, 2, 1, 2, False), "s3": (2, 1, 0, 1, True), "s4": (3, 1, 0, 0, False)}
    # A counter never falls below zero; an account without statements that nobody touched stays.
    assert sorted(map(tuple, kept["accounts"].select("account_id", "transaction_count").collect())) == [(1, 1), (3, 0), (4, 5)]
    assert {r["table"]: r["rows"] for r in U.table_counts(kept).collect()} == {"accounts": 3, "statements": 2, "transactions": 1, "links": 0, "edits": 1}


def test_lookups_and_pages(spark):
    rows = spark.createDataFrame([(1, "2024", "a"), (1, "2025", "b"), (2, "2020", "c"), (3, None, "d")], "k int, at string, v string")
    assert sorted(map(tuple, U.latest(rows, "k", "at").collect())) == [(1, "2025", "b"), (2, "2020", "c"), (3, None, "d")]
    page = [(r["v"], r["total"]) for r in U.newest_page(rows, "at", "k", 2, 1).collect()]
    assert page == [("a", 4), ("c", 4)]
    for bad in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            U.newest_page(rows, "at", "k", *bad)
    cases = spark.createDataFrame([(1,)], "case_id int")
    people = spark.createDataFrame([(1, 1, "x")], "person_id int, case_id int, name string")
    fresh = spark.createDataFrame([(2, 1, "y"), (3, 9, "z")], "person_id int, case_id int, name string")
    assert sorted(r["person_id"] for r in U.append_persons(people, cases, fresh).collect()) == [1, 2]
