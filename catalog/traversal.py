"""Walks over transfers between customers and suppliers, with SQL checks.

A line item is a transfer from the customer to the supplier, a returned one a transfer back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import traverse as W
from casetrail.session import cut_lineage
from casetrail.sources import shared_tables as T


def transfers(spark, sf, least=0):
    """Transfers of at least an amount, in the order of order and line number."""
    lines = T.table(spark, sf, "lineitem").filter(F.col("l_extendedprice") >= least)
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    back = F.col("l_returnflag") == "R"
    one, two = F.concat(F.lit("C:"), "o_custkey"), F.concat(F.lit("S:"), "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(back, two).otherwise(one).alias("source"),
        F.when(back, one).otherwise(two).alias("target"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
        F.to_date("l_shipdate").alias("day"),
        F.when(F.col("l_linestatus") == "O", F.lit(None)).otherwise(F.concat(F.lit("T"), F.col("l_quantity").cast("int") % 4)).alias("token_symbol"),
        (F.col("l_discount") == 0).alias("is_spam"),
    )


def _sql(least=0):
    return f"""E AS (SELECT lower(CASE WHEN l_returnflag = 'R' THEN 'S:' || l_suppkey ELSE 'C:' || o_custkey END) AS source,
    lower(CASE WHEN l_returnflag = 'R' THEN 'C:' || o_custkey ELSE 'S:' || l_suppkey END) AS target, l_orderkey * 10 + l_linenumber AS seq,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l_shipdate AS DATE) AS day,
    CASE WHEN l_linestatus = 'O' THEN 'native' ELSE 'T' || (CAST(l_quantity AS INTEGER) % 4) END AS token, l_discount = 0 AS is_spam
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= {least}),
  A AS (SELECT node, other, min(seq) AS seq FROM (SELECT source AS node, target AS other, seq FROM E UNION ALL SELECT target, source, seq FROM E) GROUP BY ALL),
  O AS (SELECT DISTINCT source AS node, target AS other FROM E)"""


LEAST = 100_000  # only large transfers are followed


def suppliers(spark, sf):
    return T.table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("seed"))


def _entities(spark, sf):
    """Every node with a type and a name."""
    one = T.table(spark, sf, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"))
    two = T.table(spark, sf, "supplier").select(
        F.concat(F.lit("S:"), "s_suppkey"), F.when(F.col("s_acctbal") < 0, "High_Risk").otherwise("other"), F.col("s_name"))
    return one.union(two)


def _stops(spark, sf):
    by_name = F.lower("name").rlike("000[0-9]*7$")
    return _entities(spark, sf).filter(W.stops_at(F.col("kind"), F.col("name"), ["high_risk", "Building"], by_name)).select("node")


_STOPS = """Z AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE lower(c_mktsegment) = 'building' OR regexp_matches(lower(c_name), '000[0-9]*7$')
    UNION ALL SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal < 0 OR regexp_matches(lower(s_name), '000[0-9]*7$'))"""

HOPS, CAP = 3, 20


def _trace(spark, sf):
    return W.trace(suppliers(spark, sf), transfers(spark, sf, LEAST), HOPS, CAP, _stops(spark, sf))


_TRACE = f"""WITH RECURSIVE {_sql(LEAST)}, {_STOPS},
  R AS (SELECT 's:' || s_suppkey AS seed, 0 AS hop, [ROW('s:' || s_suppkey, 0, '', 's:' || s_suppkey IN (SELECT node FROM Z))] AS level, ['s:' || s_suppkey] AS seen FROM supplier
    UNION ALL SELECT seed, hop + 1 AS hop, list(ROW(other, came[1], came[3], other IN (SELECT node FROM Z)) ORDER BY came[1], came[2], other)[1:{CAP}] AS level,
      list_concat(any_value(seen), list(other ORDER BY came[1], came[2], other)[1:{CAP}]) AS seen
    FROM (SELECT seed, hop, any_value(seen) AS seen, other, min(ROW(k, A.seq, A.node)) AS came
      FROM (SELECT seed, hop, seen, level, unnest(range(1, len(level) + 1)) AS k FROM R WHERE hop < {HOPS}) JOIN A ON A.node = level[k][1]
      WHERE NOT level[k][4] AND NOT list_contains(seen, other) GROUP BY seed, hop, other) GROUP BY seed, hop),
  V AS (SELECT seed, hop, unnest(range(1, len(level) + 1)) AS place, level FROM R),
  F AS (SELECT seed, level[place][1] AS node, hop, place, CASE WHEN hop > 0 THEN level[place][3] END AS parent, CASE WHEN hop > 0 THEN level[place][2] END AS parent_place, level[place][4] AS stopped FROM V)"""


def _pairs(spark, sf):
    """Each customer and the supplier of the same number, modulo their count."""
    many = T.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("many"))
    return T.table(spark, sf, "customer").join(F.broadcast(many)).select(
        F.col("c_custkey").alias("pair"), F.concat(F.lit("C:"), "c_custkey").alias("source"),
        F.concat(F.lit("S:"), F.col("c_custkey") % F.col("many") + 1).alias("target"))


def _shortest(spark, sf):
    """Lengths, and whether the steps given are transfers that lead from one end to the other."""
    edges = cut_lineage(transfers(spark, sf, LEAST).select("source", "target", "seq"))
    found = W.shortest_paths(_pairs(spark, sf), edges)
    real = edges.select(F.lower("source").alias("source"), F.lower("target").alias("target"), "seq", F.lit(True).alias("real"))
    steps = found.select("pair", F.posexplode("path").alias("k", "step")).select("pair", "k", "step.*")
    good = steps.join(real, ["source", "target", "seq"], "left").groupBy("pair").agg(F.count_if("real").alias("real"))
    ends = F.concat_ws(">", F.array_append(F.transform("path", lambda s: s["source"]), F.element_at("path", -1)["target"]))
    chain = F.concat_ws(">", F.array_insert(F.transform("path", lambda s: s["target"]), 1, F.col("source")))
    whole = (F.size("path") == F.col("length")) & (F.coalesce("real", F.lit(0)) == F.col("length"))
    linked = (F.col("length") == 0) | ((ends == chain) & (F.element_at("path", -1)["target"] == F.col("target")))
    return found.join(good, "pair", "left").select("pair", "length", F.when(F.col("length").isNull(), F.size("path") == 0).otherwise(whole & linked).alias("valid"))


_SHORTEST = f"""WITH RECURSIVE {_sql(LEAST)}, P AS (SELECT c_custkey AS pair, 'c:' || c_custkey AS source, 's:' || (c_custkey % (SELECT count(*) FROM supplier) + 1) AS target FROM customer),
  B AS (SELECT source AS start, source AS node, 0 AS hop FROM P UNION SELECT start, other, hop + 1 FROM B JOIN O USING (node) WHERE hop < 5),
  M AS (SELECT start, node, min(hop) AS length FROM B GROUP BY ALL)
SELECT pair, length, true AS valid FROM P LEFT JOIN M ON start = source AND node = target"""


def _typed(spark, sf):
    sources = T.table(spark, sf, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("source"))
    risky = _entities(spark, sf).filter("kind = 'High_Risk'")
    return W.typed_paths(sources, transfers(spark, sf, LEAST), risky).withColumn("path", F.array_join("path", ">"))


_TYPED = f"""WITH RECURSIVE {_sql(LEAST)}, Z AS (SELECT 's:' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0),
  B AS (SELECT 'c:' || c_custkey AS source, 'c:' || c_custkey AS node, ['c:' || c_custkey] AS path, false AS ended FROM customer
    UNION ALL SELECT source, other, list_append(path, other), other IN (SELECT node FROM Z) FROM B JOIN O USING (node) WHERE NOT ended AND len(path) <= 4 AND NOT list_contains(path, other)),
  N AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len(path), path) AS place FROM B WHERE ended)
SELECT source, place, len(path) - 1 AS length, node AS target, array_to_string(path, '>') AS path FROM N WHERE place <= 10"""

PREFERRED = ("T1", "T3")


def _enriched(spark, sf):
    """Every edge, also those of single transfers."""
    made = W.enriched_edges(transfers(spark, sf), PREFERRED)
    other = F.transform("secondary_tokens", lambda t: F.concat_ws(":", t["token_symbol"], t["total_value"].cast("string"), t["tx_count"].cast("string")))
    return made.select("source", "target", "seq", "value", "day", "token_symbol", "total_value", "tx_count", F.array_join(other, ",").alias("secondary"))


_ENRICHED = f"""WITH {_sql()}, G AS (SELECT source, target, token, CAST(sum(value) AS DECIMAL(28,2)) AS total, count(*) AS n, min(seq) AS first, max(ROW(value, -seq, day)) AS top FROM E GROUP BY ALL),
  H AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY total * CASE WHEN token IN ('T1', 'T3') THEN 1.01 ELSE 1.00 END DESC, first, token) AS r FROM G)
SELECT upper(source) AS source, upper(target) AS target, any_value(-top[2]) FILTER (r = 1) AS seq, any_value(top[1]) FILTER (r = 1) AS value, any_value(top[3]) FILTER (r = 1) AS day,
  any_value(token) FILTER (r = 1) AS token_symbol, any_value(total) FILTER (r = 1) AS total_value, CAST(sum(n) AS BIGINT) AS tx_count,
  coalesce(string_agg(token || ':' || total || ':' || n, ',' ORDER BY first, token) FILTER (r > 1), '') AS secondary FROM H GROUP BY source, target"""

QUERIES = {
    "g4_frontier_expansion": _trace,
    "g4_hop_counts": lambda s, d: W.hop_counts(_trace(s, d), CAP),
    "g5_stop_nodes": lambda s, d: _stops(s, d),
    "g6_neighbours": lambda s, d: W.neighbours(transfers(s, d), "all"),
    "g7_shortest_paths": _shortest,
    "g8_typed_paths": _typed,
    "g9_edges_between": lambda s, d: W.between(transfers(s, d), _pairs(s, d)).select("source", "target", "seq", "value"),
    "a19_edge_enrichment": _enriched,
}

ORACLES = {
    "g4_frontier_expansion": f"{_TRACE} SELECT * FROM F",
    "g4_hop_counts": f"""{_TRACE}, L AS (SELECT seed, hop, count(*) AS found, count(*) FILTER (stopped) AS stopped, CASE WHEN count(*) >= {CAP} THEN max(parent_place) END AS last FROM F WHERE hop > 0 GROUP BY ALL)
      SELECT L.seed, L.hop, found, L.stopped, count(*) FILTER (NOT F.stopped AND (last IS NULL OR place <= last)) AS fetched FROM L JOIN F ON F.seed = L.seed AND F.hop = L.hop - 1 GROUP BY ALL""",
    "g5_stop_nodes": f"WITH {_STOPS} SELECT upper(left(node, 1)) || substr(node, 2) AS node FROM Z",
    "g6_neighbours": f"WITH {_sql()} SELECT node, other, seq FROM A",
    "g7_shortest_paths": _SHORTEST,
    "g8_typed_paths": _TYPED,
    "g9_edges_between": f"""WITH {_sql()} SELECT source, target, seq, value FROM E WHERE NOT is_spam AND (source, target) IN
      (SELECT ('c:' || c_custkey, 's:' || (c_custkey % (SELECT count(*) FROM supplier) + 1)) FROM customer)""",
    "a19_edge_enrichment": _ENRICHED,
}
