"""Entity resolution and the substring merge against a plain greedy version."""

import random

from casetrail.operators import entities as N


def greedy(entities, counts, least=5):
    """Most-linked first; each winner absorbs later automatic entities whose keys match."""
    order = sorted(entities, key=lambda e: (-counts.get(e[0], 0), e[0]))
    gone = {}
    for i, (key, _) in enumerate(order):
        own = key.replace(" ", "")
        if key in gone or len(own) < least:
            continue
        for other, auto in order[i + 1 :]:
            its = other.replace(" ", "")
            if other not in gone and auto and len(its) >= least and (its in own or own in its):
                gone[other] = key
    return gone


def test_merge_is_the_greedy_one(spark):
    rng = random.Random(4)
    for _ in range(2):
        base = "abcdefghijklmnop"
        keys = {base[a : a + rng.randint(3, 9)] for a in [rng.randint(0, 8) for _ in range(60)]}
        rows = [(k, rng.random() < 0.8) for k in sorted(keys)]
        counts = {k: rng.randint(1, 5) for k, _ in rows}
        ents = spark.createDataFrame([(1, k, k, [], "x", auto) for k, auto in rows], "case_id int, key string, name string, aliases array<string>, entity_type string, auto_created boolean")
        linked = spark.createDataFrame([(1, n, k, "counterparty") for k, _ in rows for n in range(counts[k])], "case_id int, id int, key string, role string")
        found = {r["key"]: r["into"] for r in N.merges(ents, linked).collect()}
        assert found == greedy(rows, counts)


def test_manual_entities_keep_name_and_type(spark):
    ledger = spark.createDataFrame([(1, k, k, "Acme Shop", "bank" if k else None) for k in range(3)], "case_id int, id int, seq int, counterparty string, llm_entity_type string")
    fresh = N.resolve(ledger).first()
    assert (fresh["name"], fresh["entity_type"], fresh["auto_created"]) == ("Acme Shop", "bank", True)
    old = spark.createDataFrame([(1, fresh["key"], "Mine", ["a"], "merchant", False), (1, "zz other", "Z", [], "bank", True)], "case_id int, key string, name string, aliases array<string>, entity_type string, auto_created boolean")
    both = {r["key"]: r for r in N.resolve(ledger, old).collect()}
    assert (both[fresh["key"]]["name"], both[fresh["key"]]["entity_type"], both[fresh["key"]]["aliases"]) == ("Mine", "merchant", [])
    assert both["zz other"]["name"] == "Z"
