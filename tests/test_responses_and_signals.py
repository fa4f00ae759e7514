"""Model responses, their overlay and cost, and risk families on hand-made rows."""

import json
import re
from decimal import Decimal

from pyspark.sql import functions as F

from casetrail.operators import responses as R
from casetrail.operators import scores as S
from casetrail.operators import signals as G

ATTEMPT = (
    "extraction_id int, seq int, slot string, provider string, model string, raw string, provider_error string, prompt_tokens long, "
    "completion_tokens long, latency_ms long, created_at string"
)


def attempt(raw, extraction=1, seq=0, provider="claude", model="claude-haiku-4-5", error=None, pt=10, ct=5, at="2026-01-01"):
    return extraction, seq, provider if provider == "claude" else f"{provider}:{model}", provider, model, raw, error, pt, ct, 100, at


def plain_parse(raw):
    if not raw:
        return None, "empty response"
    fence = re.search(r"```(?:json)?\s*(.*?)```", raw, re.DOTALL)
    try:
        return json.loads((fence.group(1) if fence else raw).strip()), None
    except json.JSONDecodeError:
        pass
    braces = re.search(r"\{[\s\S]*\}", raw)
    if not braces:
        return None, "no JSON object found in response"
    try:
        return json.loads(braces.group(0)), None
    except json.JSONDecodeError:
        return None, "invalid JSON"


def test_parsing(spark):
    raws = [
        None, "", "   ", "{}", ' {"a": 1}\n', '```json\n{"a": [1, {"b": null}]}\n```', '```\n{"a": 2}```tail', 'so: {"a": {"b": "}"}} ok', "no braces",
        "{broken}", '```json\n{bad\n``` but {"a": 3}', '{"a": 1} and {"b": 2}', "[1, 2]", '"text"', '```json {"x": "é字"} ```',
    ]
    df = R.read_responses(spark.createDataFrame([attempt(r, k) for k, r in enumerate(raws)] + [attempt("{}", 99, error="429")], ATTEMPT))
    for r in df.select("extraction_id", F.to_json("parsed").alias("j"), "parse_error").collect():
        if r["extraction_id"] == 99:
            assert (r["j"], r["parse_error"]) == (None, None)
            continue
        value, problem = plain_parse(raws[r["extraction_id"]])
        assert (r["j"] and json.loads(r["j"]), r["parse_error"]) == (value, problem), raws[r["extraction_id"]]


def test_normalised_defaults(spark):
    raws = [
        "{}", '{"bank": {"key": ""}, "transactions": [{"amount": "12.5", "direction": "DEBIT"}, {"amount": null, "direction": "credit"}, {"amount": 3, "direction": "Credit"}, 7]}',
        '{"bank": 5, "account": {"joint_holders": ["x", "y"], "holder_name": "N"}, "balance": {"opening": "1.50", "currency": "USD"}, "anomalies": [1, 2], "transactions": "none"}',
    ]
    read = R.read_responses(spark.createDataFrame([attempt(r, k) for k, r in enumerate(raws)], ATTEMPT))
    a, b, c = R.normalised(read, "extraction_id").orderBy("extraction_id").collect()
    assert (a["bank_key"], a["bank_label"], a["currency"], a["transaction_count"], a["joint_holders"], a["net_change"]) == ("unknown", "Unknown", "INR", 0, [], Decimal("0.00"))
    assert (b["bank_key"], b["transaction_count"], b["total_debit"], b["total_credit"]) == ("unknown", 4, Decimal("12.50"), Decimal("3.00"))
    assert (c["joint_holders"], c["holder_name"], c["opening"], c["currency"], c["anomaly_count"], c["transaction_count"]) == (["x", "y"], "N", Decimal("1.50"), "USD", 2, 0)


def test_cost(spark):
    rows = [("claude-haiku-4-5", 1000, 10), ("Claude-Haiku-4-5-2026", 1, None), ("other", 5, 5), (None, 5, 5), ("gemini-2.5-pro", None, None), ("", 1, 1), ("gemini-2.5-flash-x", None, 2)]
    df = spark.createDataFrame(rows, "model string, p long, c long")
    found = [r[0] for r in df.select(R.cost_usd(F.col("model"), F.col("p"), F.col("c"))).collect()]
    assert found == [Decimal("0.001050"), Decimal("0.000001"), None, None, None, None, Decimal("0.000005")]


def test_cost_summary_of_nothing(spark):
    df = R.read_responses(spark.createDataFrame([], ATTEMPT))
    assert [r.asDict() for r in R.cost_summary(df).collect() if r["calls"]] == []


def test_primary_and_choice(spark):
    rows = [(1, "gemini:gemini-2.5-flash", 0), (1, "gemini:gemini-2.5-pro", 1), (2, "claude", 5), (2, "gemini:x", 1), (3, "other", 0), (4, "gemini:b", 2), (4, "gemini:a", 3)]
    df = spark.createDataFrame(rows, "extraction_id int, slot string, seq int")
    found = dict(map(tuple, R.primary_slots(df).collect()))
    assert found == {1: "gemini:gemini-2.5-pro", 2: "claude", 4: "gemini:b"}
    extractions = spark.createDataFrame([(1, 3), (2, 0), (3, 0), (4, None), (5, 2)], "extraction_id int, parsed_rows int")
    chosen = {r["extraction_id"]: (r["choice"], r["source"]) for r in R.final_choice(extractions, R.primary_slots(df)).collect()}
    assert chosen == {1: ("deterministic", "deterministic+gemini:gemini-2.5-pro"), 2: ("model", "llm-claude"), 3: ("deterministic", "deterministic"), 4: ("model", "llm-gemini:b"), 5: ("deterministic", "deterministic")}


def plain_overlay(ours, said):
    """(date, amount, direction, counterparty) of both sides, in order."""
    if not said:
        return [(r[3], None) for r in ours]
    if len(ours) == len(said):
        pairs = list(zip(ours, said))
    else:
        index = {}
        for r in said:
            index.setdefault((r[0], round(float(r[1] or 0), 2), (r[2] or "").lower()), r)
        pairs = [(r, index.get((r[0], round(float(r[1] or 0), 2), (r[2] or "").lower()))) for r in ours]
    good = lambda c: c is not None and c.strip() and c.lower() not in ("unknown", "(unknown)")
    return [(m[3].strip() if m and good(m[3]) else r[3], m[4] if m else None) for r, m in pairs]


def test_overlay(spark):
    D = Decimal
    cases = {
        1: ([("d1", D("5.00"), "debit", "x"), ("d1", D("5.00"), "debit", "y")], [("d9", D("1.00"), "Credit", " Shop ", True), ("d1", D("5.00"), "Debit", "UNKNOWN", False)]),
        2: ([("d1", D("5.00"), "debit", "x"), ("d1", D("5.00"), "debit", "y"), ("d2", D("7.00"), "credit", "z")], [("d1", D("5.00"), "DEBIT", "First", True), ("d1", D("5.00"), "debit", "Second", False), ("d3", D("1.00"), "debit", "No", None), (None, None, None, "(Unknown)", True)]),
        3: ([("d1", D("5.00"), "debit", "x")], []),
        4: ([(None, None, None, "x"), ("d1", D("5.00"), "debit", None)], [(None, None, None, "Null", None)]),
        5: ([], [("d1", D("5.00"), "debit", "x", True)]),
    }
    ours = [(k, n, *r) for k, (o, _) in cases.items() for n, r in enumerate(o, 1)]
    said = [(k, n, *r) for k, (_, m) in cases.items() for n, r in enumerate(m, 1)]
    left = spark.createDataFrame(ours, "extraction_id int, row_index int, date string, amount decimal(18,2), direction string, counterparty string")
    right = spark.createDataFrame(said, "extraction_id int, pos int, date string, amount decimal(18,2), direction string, counterparty string, is_self_transfer boolean")
    made = R.overlay(left, right).orderBy("extraction_id", "row_index").collect()
    wanted = [w for o, m in cases.values() for w in plain_overlay(o, m)]
    assert [(r["counterparty"], r["is_self_transfer"]) for r in made] == wanted
    assert {r["extraction_id"]: r["count_match"] for r in made} == {1: True, 2: False, 3: None, 4: False}


def test_overlay_headers(spark):
    kinds = "extraction_id int, holder_name string, customer_id string, pan_hint string, phone_hint string, email_hint string, branch string, opening decimal(18,2), closing decimal(18,2)"
    said = spark.createDataFrame([(1, " Said ", "c", "p", None, "", "b", Decimal("1.00"), None)], kinds)
    ours = spark.createDataFrame([(1, "", None, Decimal("9.00")), (2, "Ours", None, None)], "extraction_id int, holder_name string, opening decimal(18,2), closing decimal(18,2)")
    one, two = R.overlay_headers(ours, said).orderBy("extraction_id").collect()
    assert (one["holder_name"], one["opening"], one["closing"], one["customer_id"], one["email_hint"]) == ("Said", Decimal("1.00"), Decimal("9.00"), "c", None)
    assert (two["holder_name"], two["branch"]) == ("Ours", None)


def test_agreement(spark):
    rows = [
        attempt('{"bank": {"key": "a"}, "balance": {"opening": 5}, "transactions": [{"is_self_transfer": true}, {}], "anomalies": []}', at="2"),
        attempt('{"bank": {"key": "a"}, "balance": {"opening": "5.00"}, "transactions": []}', seq=1, provider="g", model="m", at="1"),
        attempt("oops", seq=2, provider="g", model="n"),
    ]
    made = {r["field"]: r for r in R.agreement(R.read_responses(spark.createDataFrame(rows, ATTEMPT))).collect()}
    shown = lambda f: [(v["value"], v["reporters"]) for v in made[f]["values"]]
    claude = "claude:claude-haiku-4-5"
    assert shown("bank_key") == [("a", ["g:m", claude])] and made["bank_key"]["unanimous"]
    assert shown("opening_balance") == [("5.00", ["g:m", claude])]
    assert shown("txn_count") == [("0", ["g:m"]), ("2", [claude])] and not made["txn_count"]["unanimous"]
    assert shown("self_transfer_rows") == [("1", [claude])] and not made["self_transfer_rows"]["unanimous"]
    assert shown("anomaly_count") == [("0", [claude])] and "risk_level" not in made


def test_slots_and_lists(spark):
    rows = [attempt("{}", k, 0, p, m) for k, (p, m) in enumerate([("claude", "c"), ("gemini", "gemini-2.5-pro"), ("gemini", "x")])]
    df = R.read_responses(spark.createDataFrame(rows, ATTEMPT)).withColumn("bank_key", F.lit("hdfc"))
    hit = lambda *w: [r[0] for r in df.filter(R.slot_matches(F.col("slot"), list(w))).select("extraction_id").collect()]
    assert (hit("CLAUDE"), hit("gemini"), hit("gemini-2.5"), hit(""), hit("x", "cl")) == ([0], [1, 2], [1], [], [0, 2])
    light = R.attempt_list(df, has_error=False)
    assert "raw" not in light.columns and light.count() == 3
    assert R.attempt_list(df, provider="gemini", bank="hdfc").count() == 2 and R.attempt_list(df, has_error=True).count() == 0


# --- risk families --------------------------------------------------------------------------------


def of(found, address):
    return {r["family"]: (r["triggered"], r["signals"]) for r in found.collect() if r["address"] == address}


def test_nothing_given(spark):
    found = G.families(spark.createDataFrame([("a",), ("a",), (None,)], "address string"))
    told = of(found, "a")
    assert len(told) == 8 and found.count() == 8
    assert told.pop("behavioral_pattern") == (False, [])
    assert all(t == (None, []) for t in told.values())
    assert S.escalation(found).collect()[0]["escalation"] == "INSUFFICIENT_DATA"


def test_attribution_and_reports(spark):
    addresses = spark.createDataFrame([(k,) for k in "abcdef"], "address string")
    known = spark.createDataFrame(
        [("a", "A", "scam", "chainabuse+reddit", None, None), ("b", "B", "exchange", "heuristic", "low", 0.5), ("c", "C", "exchange", "heuristic", "low", 0.4),
         ("d", "D", "high_risk_exchange", None, "high", None), ("d", "D0", "x", "y", "low", None)],
        "address string, name string, category string, source string, risk_level string, confidence double",
    )
    remembered = spark.createDataFrame([("a", "A", 0.9), ("e", "E", 0.6), ("f", "F", 0.59)], "address string, name string, risk_score double")
    sanctions = spark.createDataFrame([("f",), ("f",)], "address string")
    parties = spark.createDataFrame(
        [("e", "My EXCHANGE", "low"), ("f", "X", "low"), ("f", "Y", None), ("f", "Unknown", "severe"), ("b", "Z", "severe"), ("c", "One", "low")],
        "address string, entity string, risk_tier string",
    )
    found = G.families(addresses, known, remembered, sanctions, parties)
    told = {a: of(found, a) for a in "abcdef"}
    assert {a: t["entity_attribution"][1] for a, t in told.items()} == {
        "a": ["chainabuse_scraped", "known_entity"], "b": ["heuristic_exchange", "counterparty_high_risk"], "c": [],
        "d": ["known_entity", "known_exchange"], "e": ["known_entity", "counterparty_exchange"], "f": ["sanctions_hit", "counterparty_attributed"],
    }
    assert told["c"]["entity_attribution"][0] is False
    assert told["a"]["external_intelligence"] == (True, ["chainabuse_reports", "reddit_reports"])
    assert told["e"]["external_intelligence"] == (False, []) and told["a"]["p2p_behavioral"][0] is None


def test_exposure_and_graph(spark):
    addresses = spark.createDataFrame([("a",), ("b",), ("c",)], "address string")
    exposure = spark.createDataFrame([("a", 0.5, 0.0, 3), ("b", 0.4, None, 0)], "address string, source_risk_score double, destination_risk_score double, risky_counterparties int")
    shares = spark.createDataFrame(
        [("a", "destination_exposure", "Unknown", 60.1), ("a", "source_exposure", "Unknown", 60.0), ("a", "source_exposure", "Darknet Market", 5.1), ("b", "source_exposure", "Scam", 5.0), ("b", "source_exposure", None, 99.0)],
        "address string, direction string, category string, pct double",
    )
    velocity = spark.createDataFrame(
        [("b", 101, 0.95, "Relay", 0.8, 0.3, 3.1), ("c", 4, 0.95, "Relay", 0.9, 0.1, 9.0)],
        "address string, transaction_count int, fund_through_rate double, velocity_profile string, velocity_risk_score double, regularity_score double, burst_score double",
    )
    graphs = spark.createDataFrame([("a", 51, 30)], "address string, node_count int, unique_counterparties int")
    patterns = spark.createDataFrame([("c", "automated_cadence"), ("c", "fan_in"), ("c", "fan_in")], "address string, pattern string")
    found = G.families(addresses, exposure=exposure, exposure_shares=shares, velocity=velocity, graphs=graphs, patterns=patterns)
    a, b, c = of(found, "a"), of(found, "b"), of(found, "c")
    assert a["exposure_composition"] == (True, ["high_risk_exposure", "risky_counterparties_3", "high_unknown_destination_pct", "exposure_darknet_market_source"])
    assert b["exposure_composition"] == (False, []) and c["exposure_composition"] == (None, [])
    assert (a["graph_topology"], b["graph_topology"], c["graph_topology"]) == ((True, ["large_graph"]), (True, ["high_tx_volume", "relay_topology"]), (None, []))
    assert b["behavioral_pattern"] == (True, ["velocity_profile_relay", "high_fund_through_rate"])
    assert c["behavioral_pattern"] == (True, ["pattern_automated_cadence", "pattern_fan_in"])
    assert (b["temporal_anomaly"], c["temporal_anomaly"], a["temporal_anomaly"]) == ((True, ["high_regularity", "high_burst"]), (True, ["regular_cadence"]), (None, []))
    messages = {r["address"]: r["message"] for r in G.contradictions(found).collect()}
    assert list(messages) == ["b"] and messages["b"].startswith("Velocity risk (0.80) is elevated")


def test_contradiction_of_destinations(spark):
    rows = [("a", "f1", True, ["high_unknown_destination_pct"], 0.1), ("a", "f2", None, ["destination_entity:Y", "destination_entity:X"], 0.1), ("b", "f1", True, ["destination_entity:Z"], 0.7), ("b", "f2", False, ["known_entity"], 0.7)]
    df = spark.createDataFrame(rows, "address string, family string, triggered boolean, signals array<string>, velocity_risk_score double")
    found = [tuple(r) for r in G.contradictions(df).collect()]
    assert [a for a, _ in found] == ["a"] and "deeper hops: X, Y — funds" in found[0][1]


def test_accumulator_gate(spark):
    def decided(signals, profile="Accumulator"):
        rows = [("a", f"f{k}", True, s, profile) for k, s in enumerate(signals)]
        df = spark.createDataFrame(rows, "address string, family string, triggered boolean, signals array<string>, velocity_profile string")
        return S.escalation(df).collect()[0]["escalation"]

    assert decided([["high_burst"], ["large_graph"], ["known_exchange"]]) == "INVESTIGATE"
    assert decided([["high_burst"], ["large_graph"], ["sanctions_hit"]]) == "ESCALATE"
    assert decided([[], [], []]) == "ESCALATE" and decided([None, None, None]) == "ESCALATE"
    assert decided([["high_burst"], [], None]) == "INVESTIGATE"
    assert decided([["high_burst"]] * 3, "Mixed") == "ESCALATE"
