"""The case graph over the ledger with resolved entities, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import entities as N
from casetrail.operators import graph as G
from catalog import cases, entities


def _ledger(spark, sf):
    flags = cases.rows(spark, sf).select("id", "flags")
    return entities.rows(spark, sf).join(flags, "id")


def _edges(spark, sf):
    """Every tenth transaction has a second link, which sorts first by key and came later."""
    ledger = entities.rows(spark, sf)
    links = N.links(ledger).withColumn("link_seq", F.col("id"))
    later = links.filter("id % 10 = 0").withColumns({"key": F.lit("!"), "link_seq": F.col("id") + 1})
    return G.flow_edges(ledger, links.unionByName(later), 3)


_G = entities._ROWS + """,
  X AS (SELECT *, CASE WHEN direction = 'Dr' THEN 'out' ELSE 'in' END AS way, 'a:' || account_id AS a, 'e:' || key AS e FROM K WHERE key <> ''),
  Y AS (SELECT case_id, CASE WHEN way = 'out' THEN a ELSE e END AS source, CASE WHEN way = 'out' THEN e ELSE a END AS target, way, id, seq, txn_date, amount FROM X),
  D AS (SELECT case_id, source, target, way, CAST(sum(amount) AS DECIMAL(28,2)) AS amount, count(*) AS count, min(txn_date) AS first_date, max(txn_date) AS last_date,
    array_to_string(list(id ORDER BY txn_date DESC, seq DESC)[1:3], ',') AS samples FROM Y GROUP BY ALL),
  I AS (SELECT case_id, target AS node, source AS other, true AS inward, amount, count FROM D UNION ALL SELECT case_id, source, target, false, amount, count FROM D),
  P AS (SELECT case_id, node, other, CAST(coalesce(sum(amount) FILTER (inward), 0) AS DECIMAL(28,2)) AS came, CAST(coalesce(sum(amount) FILTER (NOT inward), 0) AS DECIMAL(28,2)) AS went FROM I GROUP BY ALL)"""

QUERIES = {
    "g1_nodes": lambda s, d: G.nodes(entities.rows(s, d), N.links(entities.rows(s, d))),
    "g2_flow_edges": lambda s, d: _edges(s, d).withColumn("samples", F.array_join(F.transform("samples", lambda x: x["id"].cast("string")), ",")),
    "g2_owns_edges": lambda s, d: G.owns_edges(entities.rows(s, d)),
    "g12_partner_ranking": lambda s, d: G.partner_ranking(_edges(s, d)).select("case_id", "node", "other", "column", "amount", "place"),
    "g13_node_totals": lambda s, d: G.node_totals(_edges(s, d)),
    "a8_node_badges": lambda s, d: G.badges(_ledger(s, d)),
    "a10_monthly_activity": lambda s, d: G.monthly_activity(cases.rows(s, d)),
    "f10_edge_filter": lambda s, d: G.filter_edges(_edges(s, d), 300000, "1997-01-01", "1999-12-31").select("case_id", "source", "target"),
}

ORACLES = {
    "g1_nodes": f"""{_G} SELECT case_id, 'p:' || person_id AS node, 'person' AS type, count(DISTINCT account_id) AS size FROM Q GROUP BY ALL
      UNION ALL SELECT case_id, 'a:' || account_id, 'account', count(*) FROM Q GROUP BY ALL UNION ALL SELECT case_id, e, 'entity', count(*) FROM X GROUP BY ALL""",
    "g2_flow_edges": f"{_G} SELECT * FROM D",
    "g2_owns_edges": f"{_G} SELECT DISTINCT case_id, 'p:' || person_id AS source, 'a:' || account_id AS target FROM Q",
    "g12_partner_ranking": f"""{_G}, R AS (SELECT case_id, node, other, CASE WHEN came >= went THEN 'in' ELSE 'out' END AS "column", greatest(came, went) AS amount FROM P)
      SELECT *, row_number() OVER (PARTITION BY case_id, node, "column" ORDER BY amount DESC, other) AS place FROM R""",
    "g13_node_totals": f"{_G} SELECT case_id, node, CAST(sum(came) AS DECIMAL(28,2)) AS total_in, CAST(sum(went) AS DECIMAL(28,2)) AS total_out, t.c AS transactions FROM P JOIN (SELECT case_id, node, CAST(sum(count) AS BIGINT) AS c FROM I GROUP BY ALL) t USING (case_id, node) GROUP BY case_id, node, t.c",
    "a8_node_badges": f"""{_G} SELECT case_id, 'a:' || account_id AS node, bool_or(review_status = 'flagged' OR id % 7 = 0 OR id % 11 = 0) AS flagged, bool_or(id % 13 = 0) AS needs_review,
      sum(amount) >= 1000000 AS high_value, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM Q GROUP BY ALL""",
    "a10_monthly_activity": f"{cases.X} SELECT case_id, strftime(txn_date, '%Y-%m') AS month, count(*) AS count FROM X WHERE txn_date IS NOT NULL GROUP BY ALL",
    "f10_edge_filter": f"{_G} SELECT case_id, source, target FROM D WHERE amount >= 300000 AND last_date >= DATE '1997-01-01' AND first_date <= DATE '1999-12-31'",
}
