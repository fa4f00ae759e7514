"""The canvas of every case over the ledger with resolved entities, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import balances as B
from casetrail.operators import canvas as C
from casetrail.operators import entities as N
from casetrail.session import cut_lineage
from casetrail.sources import shared_tables as T
from catalog import cases, entities


def _ledger(spark, sf):
    """Saved with the keys: nodes and edges go through it several times."""
    flags = cases.rows(spark, sf).select("id", "flags")
    return cut_lineage(N.with_keys(B.with_row_index(entities.rows(spark, sf)).join(flags, "id")))


def _graph(ledger):
    linked = N.links(ledger)
    return C.nodes(ledger, N.resolve(ledger), linked), C.edges(ledger, linked)


def _shown(spark, sf):
    """The graph as the inspector reads it, without the samples of its edges."""
    found, lines = _graph(_ledger(spark, sf))
    return found, lines.drop("sample_txns", "sample_txn_ids")


def _nodes(spark, sf):
    return _graph(_ledger(spark, sf))[0]


def _edges(spark, sf):
    return _graph(_ledger(spark, sf))[1]


def _flat_nodes(found):
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda i: i.cast("string")), ","), F.lit("")).alias(c)
    hits = F.array_join(F.transform(F.map_entries("pattern_hits"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return found.select(
        "case_id", "node", "type", "label", "size", "flagged", "needs_review", "high_value", "total_amount",
        joined("flagged_txn_ids"), joined("needs_review_txn_ids"), F.coalesce(hits, F.lit("")).alias("pattern_hits"),
    )


_EDGE = ["case_id", "edge", "source", "target", "kind", "total_amount", "txn_count", "date_min", "date_max"]


def _flat_edges(lines):
    ids = F.coalesce(F.array_join(F.transform("sample_txn_ids", lambda i: i.cast("string")), ","), F.lit(""))
    return lines.select(*_EDGE, ids.alias("sample_txn_ids"))


def _filtered(spark, sf):
    return C.filter_graph(*_graph(_ledger(spark, sf)), ("account", "entity"), True, 300_000, "1996-03", "1998-09", True)


def _chosen(spark, sf):
    """Accounts of customers in debt."""
    return T.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        (F.col("c_nationkey").cast("bigint") % 3).alias("case_id"), F.concat(F.lit("account:"), "c_custkey").alias("node"))


def _compared(spark, sf):
    """Every entity beside the first one of its case."""
    found, lines = map(cut_lineage, _shown(spark, sf))
    parties = found.filter("type = 'entity'").select("case_id", F.col("node").alias("two"))
    first = parties.groupBy("case_id").agg(F.min("two").alias("one"))
    return C.compare(C.inspect(found, lines), lines, parties.join(first, "case_id"))


_C = f"""{entities._ROWS},
  LD AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seq) AS row_index, review_status = 'flagged' OR id % 7 = 0 OR id % 11 = 0 AS fl, id % 13 = 0 AS nr FROM Q),
  LK AS (SELECT LD.*, K.key FROM LD JOIN (SELECT id, key FROM K WHERE key <> '') K USING (id)),
  ST AS (SELECT case_id, node, bool_or(fl) AS flagged, bool_or(nr) AS needs_review, sum(amount) >= 1000000 AS high_value, CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount,
      list(id ORDER BY id) FILTER (fl) AS fids, list(id ORDER BY id) FILTER (nr) AS rids, count(*) FILTER (id % 11 = 0) AS ro, count(*) FILTER (id % 7 = 0) AS ve
    FROM (SELECT 'account:' || account_id AS node, * EXCLUDE (key) FROM (SELECT *, '' AS key FROM LD) UNION ALL SELECT 'entity:' || key, * EXCLUDE (key) FROM LK) GROUP BY ALL),
  ND AS (SELECT case_id, 'person:' || person_id AS node, 'person' AS type, min(holder_name) AS label, count(DISTINCT account_id) AS size FROM LD GROUP BY case_id, person_id
    UNION ALL SELECT case_id, 'account:' || account_id, 'account', CAST(account_id AS VARCHAR), count(*) FROM LD GROUP BY case_id, account_id
    UNION ALL SELECT case_id, 'entity:' || key, 'entity', any_value(name), any_value(n) FROM E JOIN (SELECT case_id, key, count(*) AS n FROM LK GROUP BY ALL) USING (case_id, key) GROUP BY case_id, key),
  NX AS (SELECT ND.*, flagged, needs_review, high_value, total_amount, fids, rids, ro, ve FROM ND LEFT JOIN ST USING (case_id, node)),
  FL AS (SELECT case_id, CASE WHEN direction = 'Dr' THEN 'out:' || account_id || ':' || key ELSE 'in:' || key || ':' || account_id END AS edge,
      CASE WHEN direction = 'Dr' THEN 'account:' || account_id ELSE 'entity:' || key END AS source, CASE WHEN direction = 'Dr' THEN 'entity:' || key ELSE 'account:' || account_id END AS target,
      CASE WHEN direction = 'Dr' THEN 'flow_out' ELSE 'flow_in' END AS kind, id, txn_date, row_index, amount, direction, left(raw_description, 140) AS raw_description FROM LK),
  ED AS (SELECT case_id, 'owns:' || person_id || ':' || account_id AS edge, 'person:' || person_id AS source, 'account:' || account_id AS target, 'owns' AS kind, CAST(0 AS DECIMAL(28,2)) AS total_amount,
      count(*) AS txn_count, CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_max, [] AS ids FROM LD GROUP BY case_id, person_id, account_id
    UNION ALL SELECT case_id, edge, source, target, kind, CAST(sum(amount) AS DECIMAL(28,2)), count(*), min(txn_date), max(txn_date), list(id ORDER BY txn_date DESC NULLS LAST, row_index DESC, id DESC) FROM FL GROUP BY ALL),
  IC AS (SELECT case_id, source AS node, target AS other, true AS is_out, * EXCLUDE (case_id) FROM ED UNION ALL SELECT case_id, target, source, false, * EXCLUDE (case_id) FROM ED),
  SU AS (SELECT case_id, node, CAST(coalesce(sum(total_amount) FILTER (NOT is_out AND kind <> 'owns'), 0) AS DECIMAL(28,2)) AS total_in, CAST(coalesce(sum(total_amount) FILTER (is_out AND kind <> 'owns'), 0) AS DECIMAL(28,2)) AS total_out,
      CAST(coalesce(sum(txn_count) FILTER (kind <> 'owns'), 0) AS BIGINT) AS incident_txns, count(DISTINCT other) FILTER (starts_with(other, 'person')) || '/' || count(DISTINCT other) FILTER (starts_with(other, 'account')) || '/' || count(DISTINCT other) FILTER (starts_with(other, 'entity')) AS partners
    FROM IC GROUP BY ALL)"""
_FN = "SELECT * FROM NX WHERE type <> 'person' AND flagged"
_F10 = f"""{_C}, FN AS ({_FN}), FE AS (SELECT ED.* FROM ED JOIN FN a ON a.case_id = ED.case_id AND a.node = source JOIN FN b ON b.case_id = ED.case_id AND b.node = target
    WHERE ED.total_amount >= 300000 AND coalesce(CAST(date_min AS VARCHAR) <= '1998-09-31', true) AND coalesce(CAST(date_max AS VARCHAR) >= '1996-03-01', true)),
  US AS (SELECT case_id, source AS node FROM FE UNION SELECT case_id, target FROM FE)"""
_CH = "CH AS (SELECT CAST(c_nationkey % 3 AS BIGINT) AS case_id, 'account:' || c_custkey AS node FROM customer WHERE c_acctbal < 0)"
_PATTERNS = "array_to_string(list_transform(list_sort(list_filter([ROW(-ro, 'ROUND_AMOUNT_CLUSTER'), ROW(-ve, 'VELOCITY_SPIKE')], lambda x: x[1] < 0)), lambda x: x[2] || ':' || -x[1]), ',')"


def _inspected(spark, sf):
    found, lines = _shown(spark, sf)
    found = C.inspect(found, cut_lineage(lines))
    patterns = F.array_join(F.transform("patterns", lambda p: F.concat_ws(":", p["name"], p["hits"].cast("string"))), ",")
    partners = F.concat_ws("/", "partners.person", "partners.account", "partners.entity")
    return found.select("case_id", "node", "total_in", "total_out", "incident_txns", F.coalesce(patterns, F.lit("")).alias("patterns"), partners.alias("partners"))


QUERIES = {
    "g3_canvas_nodes": lambda s, d: _flat_nodes(_nodes(s, d)),
    "g3_canvas_edges": lambda s, d: _flat_edges(_edges(s, d)),
    "g3_edge_samples": lambda s, d: _edges(s, d).filter("kind <> 'owns'").select("case_id", "edge", F.posexplode("sample_txns").alias("place", "t")).select("case_id", "edge", "place", "t.id", "t.txn_date", "t.amount", "t.direction", "t.raw_description"),
    "f10_filtered_nodes": lambda s, d: _filtered(s, d)[0].select("case_id", "node"),
    "f10_filtered_edges": lambda s, d: _filtered(s, d)[1].select("case_id", "edge"),
    "f10_hidden_nodes": lambda s, d: _filtered(s, d)[2],
    "f11_label_matches": lambda s, d: C.touching(_edges(s, d), C.label_matches(_nodes(s, d), " BLUE ")).select("case_id", "edge"),
    "a23_node_counts": lambda s, d: C.node_counts(_nodes(s, d)),
    "l7_incident_edges": lambda s, d: C.ranked_incident(_edges(s, d), 10).select("case_id", "node", "edge", "place"),
    "g11_focus_nodes": lambda s, d: C.focus(_edges(s, d), _chosen(s, d))[0],
    "g11_focus_edges": lambda s, d: C.focus(_edges(s, d), _chosen(s, d))[1].select("case_id", "edge"),
    "g13_inspector": _inspected,
    "g13_flagged_samples": lambda s, d: C.flagged_samples(*_graph(_ledger(s, d))).select("case_id", "node", "id", "place"),
    "g14_compared_nodes": _compared,
    "m6_unflagged": lambda s, d: C.unflag(_ledger(s, d), _nodes(s, d), _chosen(s, d)).select("case_id", "id", "review_status"),
}

ORACLES = {
    "g3_canvas_nodes": f"""{_C} SELECT case_id, node, type, label, size, flagged, needs_review, high_value, total_amount, coalesce(array_to_string(fids, ','), '') AS flagged_txn_ids, coalesce(array_to_string(rids, ','), '') AS needs_review_txn_ids,
      concat_ws(',', CASE WHEN ro > 0 THEN 'ROUND_AMOUNT_CLUSTER:' || ro END, CASE WHEN ve > 0 THEN 'VELOCITY_SPIKE:' || ve END) AS pattern_hits FROM NX""",
    "g3_canvas_edges": f"{_C} SELECT {', '.join(_EDGE)}, coalesce(array_to_string(ids[1:5], ','), '') AS sample_txn_ids FROM ED",
    "g3_edge_samples": f"""{_C}, R AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, edge ORDER BY txn_date DESC NULLS LAST, row_index DESC, id DESC) - 1 AS INTEGER) AS place FROM FL)
      SELECT case_id, edge, place, id, txn_date, amount, direction, raw_description FROM R WHERE place < 20""",
    "f10_filtered_nodes": f"{_F10} SELECT case_id, node FROM FN JOIN US USING (case_id, node)",
    "f10_filtered_edges": f"{_F10} SELECT case_id, edge FROM FE",
    "f10_hidden_nodes": f"{_F10} SELECT FN.case_id, count(*) FILTER (US.node IS NULL) AS hidden FROM FN LEFT JOIN US USING (case_id, node) GROUP BY 1",
    "f11_label_matches": f"""{_C}, MA AS (SELECT case_id, node FROM NX WHERE contains(lower(label), 'blue'))
      SELECT case_id, edge FROM ED WHERE (case_id, source) IN (SELECT (case_id, node) FROM MA) OR (case_id, target) IN (SELECT (case_id, node) FROM MA)""",
    "a23_node_counts": f"{_C} SELECT case_id, type, count(*) AS nodes, count(*) FILTER (flagged) AS flagged FROM NX GROUP BY ALL",
    "l7_incident_edges": f"""{_C}, R AS (SELECT case_id, node, edge, CAST(row_number() OVER (PARTITION BY case_id, node ORDER BY CASE kind WHEN 'owns' THEN 0 ELSE 1 END, total_amount DESC, edge) AS INTEGER) AS place FROM IC)
      SELECT * FROM R WHERE place <= 10""",
    "g11_focus_nodes": f"{_C}, {_CH} SELECT case_id, node FROM CH UNION SELECT case_id, other FROM IC JOIN CH USING (case_id, node)",
    "g11_focus_edges": f"{_C}, {_CH} SELECT DISTINCT case_id, edge FROM IC JOIN CH USING (case_id, node)",
    "g13_inspector": f"{_C} SELECT case_id, node, total_in, total_out, incident_txns, coalesce({_PATTERNS}, '') AS patterns, partners FROM NX JOIN SU USING (case_id, node)",
    "g13_flagged_samples": f"""{_C}, S AS (SELECT case_id, edge, unnest(ids[1:20]) AS id FROM ED), R AS (SELECT DISTINCT IC.case_id, IC.node, S.id, LD.txn_date FROM IC JOIN S USING (case_id, edge) JOIN LD USING (id)
        JOIN NX ON NX.case_id = IC.case_id AND NX.node = IC.node AND list_contains(fids, S.id))
      SELECT case_id, node, id, CAST(row_number() OVER (PARTITION BY case_id, node ORDER BY txn_date DESC NULLS LAST, id) AS INTEGER) AS place FROM R""",
    "g14_compared_nodes": f"""{_C}, A1 AS (SELECT case_id, min(node) AS one FROM ND WHERE type = 'entity' GROUP BY 1), PR AS (SELECT A1.case_id, one, node AS two FROM A1 JOIN ND ON ND.case_id = A1.case_id AND type = 'entity'),
      SH AS (SELECT PR.case_id, one, two, count(DISTINCT a.other) AS shared FROM PR JOIN IC a ON a.case_id = PR.case_id AND a.node = one JOIN IC b ON b.case_id = PR.case_id AND b.node = two AND a.other = b.other GROUP BY ALL),
      X AS (SELECT NX.case_id, NX.node, total_in, total_out, incident_txns, flagged, CAST(coalesce(len(fids), 0) AS INTEGER) AS n FROM NX JOIN SU USING (case_id, node))
      SELECT PR.case_id, PR.one, PR.two, a.total_in AS one_total_in, a.total_out AS one_total_out, a.incident_txns AS one_incident_txns, a.flagged AS one_flagged, a.n AS one_flagged_txns,
        b.total_in AS two_total_in, b.total_out AS two_total_out, b.incident_txns AS two_incident_txns, b.flagged AS two_flagged, b.n AS two_flagged_txns, coalesce(shared, 0) AS shared
      FROM PR JOIN X a ON a.case_id = PR.case_id AND a.node = PR.one JOIN X b ON b.case_id = PR.case_id AND b.node = PR.two LEFT JOIN SH ON SH.case_id = PR.case_id AND SH.one = PR.one AND SH.two = PR.two""",
    "m6_unflagged": f"{_C}, {_CH} SELECT case_id, id, CASE WHEN fl AND (case_id, 'account:' || account_id) IN (SELECT (case_id, node) FROM CH) THEN 'unreviewed' ELSE review_status END AS review_status FROM LD",
}
