"""Risk families of the users in ``events``, with reference lists taken from the other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import scores as S
from casetrail.operators import signals as G
from casetrail.operators import velocity as V
from casetrail.sources import shared_tables as T
from catalog import velocity

# The same expressions in Spark and in SQL.
_KNOWN = (
    "c_custkey AS address",
    "c_name AS name",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'exchange' WHEN 'MACHINERY' THEN 'scam' WHEN 'AUTOMOBILE' THEN 'high_risk_exchange' ELSE 'merchant' END AS category",
    "CASE c_nationkey % 5 WHEN 0 THEN 'chainabuse,reddit' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'bitcointalk' ELSE 'manual' END AS source",
    "CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 2000 THEN 'low' END AS risk_level",
    "CASE WHEN c_acctbal > 3000 THEN 0.9 ELSE 0.3 END AS confidence",
)
_FEEDS = ("p_partkey AS address", "CASE p_size % 4 WHEN 0 THEN 'goplus' WHEN 1 THEN 'etherscan,scraped' ELSE 'other' END AS source")
_PARTY = (
    "o_custkey AS address",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'My Exchange' WHEN o_orderpriority = '5-LOW' THEN 'Unknown' ELSE o_orderpriority END AS entity",
    "CASE WHEN o_totalprice > 200000 THEN 'severe' ELSE 'low' END AS risk_tier",
)
_PATTERN = "CASE WHEN hour(ts) < 2 THEN 'automated_cadence' WHEN hour(ts) < 4 THEN 'fan_in' ELSE 'mixer_hop' END"
_list = ", ".join
_SHARE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Unknown' WHEN '2-HIGH' THEN 'Darknet Market' WHEN '3-MEDIUM' THEN 'Scam' ELSE 'Shop' END"
_SIDE = "CASE WHEN o_orderkey % 2 = 0 THEN 'destination_exposure' ELSE 'source_exposure' END"


def tables(spark, sf):
    """Lists for a part of the addresses each; what they hold depends on the given tables."""
    t = lambda name: T.table(spark, sf, name)
    orders = t("orders").selectExpr("o_custkey AS address", f"{_SHARE} AS category", f"{_SIDE} AS direction", "o_totalprice")
    sides = orders.groupBy("address", "direction").agg(F.count(F.lit(1)).alias("all"))
    shares = orders.groupBy("address", "direction", "category").agg(F.count(F.lit(1)).alias("n")).join(sides, ["address", "direction"])
    return {
        "known": t("customer").filter("c_acctbal < 6000").selectExpr(*_KNOWN),
        "remembered": t("supplier").selectExpr("s_suppkey AS address", "s_name AS name", "s_acctbal / 10000 AS risk_score"),
        "sanctions": t("supplier").filter("s_acctbal < 500").selectExpr("s_suppkey AS address"),
        "counterparties": t("orders").filter("o_orderstatus <> 'F'").selectExpr(*_PARTY),
        "patterns": t("events").filter("event_type = 'error' AND value < 30").selectExpr("user_id AS address", f"{_PATTERN} AS pattern"),
        "velocity": V.analyze(velocity.transfers(spark, sf), velocity.addresses(spark, sf)),
        "exposure": orders.groupBy("address").agg(
            (F.count_if(F.col("category") == "Scam") / F.count(F.lit(1))).alias("source_risk_score"), F.lit(0.1).alias("destination_risk_score"),
            F.count_if((F.col("category") == "Scam") & (F.col("o_totalprice") > 200000)).alias("risky_counterparties")),
        "exposure_shares": shares.select("address", "direction", "category", (F.lit(100.0) * F.col("n") / F.col("all")).alias("pct")),
        "graphs": t("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("address")).agg(F.countDistinct("l_orderkey").alias("node_count"), F.countDistinct("l_partkey").alias("unique_counterparties")),
        "feeds": t("part").selectExpr(*_FEEDS),
        "ads": t("orders").filter("o_orderstatus = 'P'").selectExpr("o_custkey AS address", "o_orderpriority AS platform"),
    }


def _families(spark, sf, *without):
    given = {k: v for k, v in tables(spark, sf).items() if k not in without}
    return G.families(velocity.addresses(spark, sf), **given)


def _flat(found):
    return found.select("address", "family", "triggered", F.array_join("signals", ",").alias("signals"))


_V9 = velocity.ORACLES["v9_velocity"]
_LISTED = lambda *pairs: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {s} END" for c, s in pairs) + "], lambda s: s IS NOT NULL)"
_FAMILIES = f"""WITH VV AS ({_V9}),
  RB AS ({velocity.ORACLES["v7_regularity"]}),
  AD AS (SELECT DISTINCT user_id AS address FROM events UNION SELECT DISTINCT -user_id - 1 FROM events),
  KN AS (SELECT {_list(_KNOWN)} FROM customer WHERE c_acctbal < 6000),
  CP AS (SELECT address, count(*) AS named, bool_or(contains(lower(entity), 'exchange')) AS ex, bool_or(risk_tier = 'severe') AS risky
    FROM (SELECT {_list(_PARTY)} FROM orders WHERE o_orderstatus <> 'F') WHERE entity <> 'Unknown' GROUP BY address),
  PT AS (SELECT user_id AS address, list_sort(list(DISTINCT {_PATTERN})) AS pats
    FROM events WHERE event_type = 'error' AND value < 30 GROUP BY 1),
  OX AS (SELECT o_custkey AS address, {_SHARE} AS category, {_SIDE} AS direction, o_totalprice FROM orders),
  EX AS (SELECT address, count(*) FILTER (category = 'Scam') / count(*) AS src, count(*) FILTER (category = 'Scam' AND o_totalprice > 200000) AS risky FROM OX GROUP BY 1),
  SH AS (SELECT address, direction, category, 100.0 * count(*) / any_value(n) AS pct FROM OX JOIN (SELECT address, direction, count(*) AS n FROM OX GROUP BY ALL) USING (address, direction) GROUP BY ALL),
  SS AS (SELECT address, list(s ORDER BY g, p, s) AS shares FROM (SELECT DISTINCT address, CASE WHEN direction = 'source_exposure' THEN 0 ELSE 1 END AS p, CASE WHEN category = 'Unknown' THEN 0 ELSE 1 END AS g,
      CASE WHEN category = 'Unknown' THEN 'high_unknown_' || replace(direction, '_exposure', '') || '_pct' ELSE 'exposure_' || CASE category WHEN 'Scam' THEN 'scam' ELSE 'darknet_market' END || '_' || replace(direction, '_exposure', '') END AS s
    FROM SH WHERE (category = 'Unknown' AND pct > 60) OR (category IN ('Scam', 'Darknet Market') AND pct > 5)) GROUP BY address),
  GR AS (SELECT l_suppkey AS address, count(DISTINCT l_orderkey) AS nodes, count(DISTINCT l_partkey) AS partners FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  FD AS (SELECT address, CASE source WHEN 'goplus' THEN ['goplus_flags'] WHEN 'etherscan,scraped' THEN ['etherscan_label', 'scraped_intelligence'] ELSE [] END AS feeds FROM (SELECT {_list(_FEEDS)} FROM part)),
  AS1 AS (SELECT o_custkey AS address, count(*) AS ads FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
  J AS (SELECT AD.address, KN.name, coalesce(KN.category, '') AS category, coalesce(KN.source, '') AS source, KN.risk_level, KN.confidence, s_acctbal, CP.*, PT.pats, EX.src, EX.risky AS xr, EX.address IS NOT NULL AS exposed,
      coalesce(SS.shares, []) AS shares, GR.nodes, GR.partners, coalesce(FD.feeds, []) AS feeds, ads, CASE WHEN VV.transaction_count >= 5 THEN VV.transaction_count END AS n,
      CASE WHEN VV.transaction_count >= 5 THEN VV.fund_through_rate END AS rate, CASE WHEN VV.transaction_count >= 5 THEN VV.velocity_profile END AS profile,
      CASE WHEN VV.transaction_count >= 5 THEN VV.velocity_risk_score END AS score, CASE WHEN VV.transaction_count >= 5 THEN RB.regularity_score END AS reg, CASE WHEN VV.transaction_count >= 5 THEN RB.burst_score END AS burst
    FROM AD LEFT JOIN KN USING (address) LEFT JOIN supplier ON s_suppkey = AD.address LEFT JOIN (SELECT address AS ca, named, ex, risky FROM CP) CP ON ca = AD.address LEFT JOIN PT ON PT.address = AD.address
      LEFT JOIN EX ON EX.address = AD.address LEFT JOIN SS ON SS.address = AD.address LEFT JOIN GR ON GR.address = AD.address LEFT JOIN FD ON FD.address = AD.address LEFT JOIN AS1 ON AS1.address = AD.address
      LEFT JOIN VV ON VV.address = AD.address LEFT JOIN RB ON RB.address = AD.address),
  U AS (SELECT address, score, profile, 'entity_attribution' AS family, true AS tested, {_LISTED(
      ("contains(source, 'chainabuse')", "'chainabuse_scraped'"), ("risk_level = 'critical' OR category = 'scam' OR (name IS NULL AND s_acctbal / 10000 >= 0.6)", "'known_entity'"),
      ("category IN ('exchange', 'high_risk_exchange') AND source <> 'heuristic'", "'known_exchange'"), ("category IN ('exchange', 'high_risk_exchange') AND source = 'heuristic' AND confidence >= 0.5", "'heuristic_exchange'"),
      ("s_acctbal < 500", "'sanctions_hit'"), ("ex", "'counterparty_exchange'"), ("risky", "'counterparty_high_risk'"), ("named >= 2 AND NOT ex AND NOT risky", "'counterparty_attributed'"))} AS s FROM J
    UNION ALL SELECT address, score, profile, 'behavioral_pattern', true, list_concat(list_transform(coalesce(pats, []), lambda p: 'pattern_' || p),
      {_LISTED(("profile IN ('Relay', 'Distributor')", "'velocity_profile_' || lower(profile)"), ("rate >= 0.9", "'high_fund_through_rate'"))}) FROM J
    UNION ALL SELECT address, score, profile, 'exposure_composition', exposed, list_concat({_LISTED(("src > 0.4", "'high_risk_exposure'"), ("xr > 0", "'risky_counterparties_' || xr"))}, shares) FROM J
    UNION ALL SELECT address, score, profile, 'graph_topology', nodes IS NOT NULL OR n IS NOT NULL, CASE WHEN nodes IS NOT NULL THEN {_LISTED(("nodes > 50", "'large_graph'"), ("partners > 30", "'many_counterparties'"))}
      ELSE {_LISTED(("n > 100", "'high_tx_volume'"), ("rate >= 0.9", "'relay_topology'"))} END FROM J
    UNION ALL SELECT address, score, profile, 'temporal_anomaly', n IS NOT NULL OR pats IS NOT NULL, {_LISTED(("list_contains(pats, 'automated_cadence')", "'regular_cadence'"), ("reg < 0.4", "'high_regularity'"), ("burst > 3", "'high_burst'"))} FROM J
    UNION ALL SELECT address, score, profile, 'external_intelligence', true, list_concat({_LISTED(("contains(source, 'chainabuse')", "'chainabuse_reports'"), ("contains(source, 'reddit')", "'reddit_reports'"), ("contains(source, 'bitcointalk')", "'bitcointalk_reports'"))}, feeds) FROM J
    UNION ALL SELECT address, score, profile, 'p2p_behavioral', true, CASE WHEN ads > 0 THEN ['active_p2p_trader'] ELSE [] END FROM J
    UNION ALL SELECT address, score, profile, 'osint_social', false, [] FROM J),
  W AS (SELECT address, family, CASE WHEN tested THEN len(s) > 0 END AS triggered, CASE WHEN tested THEN s ELSE [] END AS s, score, profile FROM U)"""

_INHERENT = ", ".join(f"'{s}'" for s in (
    "pattern_fan_in", "pattern_honeypot", "pattern_automated_cadence", "pattern_consolidate_disperse", "pattern_whale_alert", "many_counterparties", "large_graph", "high_tx_volume",
    "regular_cadence", "high_regularity", "high_burst", "counterparty_exchange", "counterparty_attributed", "known_exchange", "heuristic_exchange"))

QUERIES = {
    "z1_z8_families": lambda s, d: _flat(_families(s, d)),
    "z_untested_families": lambda s, d: _flat(_families(s, d, "known", "remembered", "sanctions", "feeds", "ads", "exposure", "graphs")),
    "z9_escalation": lambda s, d: S.escalation(_families(s, d)),
    "z11_contradictions": lambda s, d: G.contradictions(_families(s, d, "known", "remembered")),
}

_NOT_GIVEN = "'entity_attribution', 'external_intelligence', 'p2p_behavioral', 'exposure_composition'"
ORACLES = {
    "z1_z8_families": f"{_FAMILIES} SELECT address, family, triggered, array_to_string(s, ',') AS signals FROM W",
    "z_untested_families": f"""{_FAMILIES.replace("CASE WHEN nodes IS NOT NULL THEN", "CASE WHEN false THEN").replace("nodes IS NOT NULL OR n IS NOT NULL", "n IS NOT NULL")}
      SELECT address, family, CASE WHEN family NOT IN ({_NOT_GIVEN}) THEN triggered END AS triggered, CASE WHEN family NOT IN ({_NOT_GIVEN}) THEN array_to_string(s, ',') ELSE '' END AS signals FROM W""",
    "z9_escalation": f"""{_FAMILIES}, C AS (SELECT address, count(*) FILTER (triggered) AS triggered, count(*) FILTER (triggered IS NOT NULL) AS tested, count(*) FILTER (triggered IS NULL) AS not_available,
      bool_and(coalesce(NOT triggered, true) OR len(list_filter(s, lambda x: x NOT IN ({_INHERENT}))) = 0) AND any_value(profile) = 'Accumulator' AS inherent FROM W GROUP BY 1)
      SELECT address, triggered, tested, not_available, CASE WHEN triggered >= 3 AND inherent THEN 'INVESTIGATE' WHEN triggered >= 3 THEN 'ESCALATE' WHEN triggered = 2 THEN 'INVESTIGATE'
        WHEN triggered = 1 THEN 'MONITOR' WHEN not_available >= 3 THEN 'INSUFFICIENT_DATA' ELSE 'DEPRIORITIZE' END AS escalation FROM C""",
    # Here 'sanctions' stays, as one of the tables that attribution needs.
    "z11_contradictions": f"""{_FAMILIES}, X AS (SELECT address, any_value(score) AS score, bool_or(len(list_filter(s, lambda x: x IN ('sanctions_hit'))) > 0) AS entity FROM W WHERE family = 'entity_attribution' GROUP BY 1)
      SELECT address, 'Velocity risk (' || CAST(CAST(CAST(score AS DECIMAL(6,3)) AS DECIMAL(6,2)) AS VARCHAR) || ') is elevated but no known-entity match — behavioral signals outweigh attribution factors' AS message
      FROM X WHERE score >= 0.5 AND NOT entity""",
}
