"""Entity resolution over part names as counterparties, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.operators import entities as N
from casetrail.session import cut_lineage
from casetrail.sources import shared_tables as T
from catalog.text import KEY_SQL


def rows(spark, sf):
    """The ledger with the name of the first part by key as the counterparty."""
    first = T.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("k"))
    parts = T.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    named = first.join(parts, "k").select(F.col("l_orderkey").alias("id"), "p_name")
    party = F.when(F.col("id") % 3 == 0, F.initcap("p_name")).when(F.col("id") % 5 == 0, F.concat("p_name", F.lit(" LTD"))).otherwise(F.col("p_name"))
    base = T.ledger(spark, sf).drop("counterparty").join(named, "id")
    return base.withColumn("counterparty", F.when(F.col("id") % 17 != 0, party)).withColumn("case_id", F.col("case_id") % 3)


def saved(spark, sf):
    """The same rows with their keys, read and told once for queries that use them more than once."""
    return cut_lineage(N.with_keys(rows(spark, sf)))


_ROWS = f"""WITH L AS ({T.ledger_sql()}), F AS (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1),
  Q AS (SELECT L.* EXCLUDE (counterparty) REPLACE (case_id % 3 AS case_id), CASE WHEN id % 17 = 0 THEN NULL WHEN id % 3 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
    WHEN id % 5 = 0 THEN p_name || ' LTD' ELSE p_name END AS counterparty FROM L JOIN F ON l_orderkey = id JOIN part ON p_partkey = k),
  K AS (SELECT *, {KEY_SQL.format(x="counterparty")} AS key FROM Q WHERE counterparty IS NOT NULL),
  C AS (SELECT case_id, key, counterparty, count(*) AS n, min(seq) AS f FROM K WHERE key <> '' GROUP BY ALL),
  N AS (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY n DESC, f) AS r FROM C),
  E AS (SELECT case_id, key, max(counterparty) FILTER (r = 1) AS name, list_sort(list(counterparty) FILTER (r > 1)) AS aliases FROM N GROUP BY ALL)"""


def _stats(spark, sf):
    ledger = saved(spark, sf)
    return N.entity_stats(N.resolve(ledger), N.links(ledger), ledger).select("case_id", "key", "txn_count", "total_dr", "total_cr")


def _merged(spark, sf):
    ledger = saved(spark, sf)
    found, linked = cut_lineage(N.resolve(ledger)), N.links(ledger)
    kept, _ = N.merged(found, linked, N.merges(found, linked))
    return kept.select("case_id", "key", "name", F.array_join("aliases", "|").alias("aliases"))


QUERIES = {
    "r1_resolve": lambda s, d: N.resolve(rows(s, d)).select("case_id", "key", "name", F.array_join("aliases", "|").alias("aliases")),
    "r3_links": lambda s, d: N.links(rows(s, d)).select("case_id", "id", "key"),
    "a7_entity_stats": _stats,
    "j8_containments": lambda s, d: N.containments(N.resolve(rows(s, d))),
    "r4_resolve_entities": _merged,
    "f5_entity_search": lambda s, d: N.search_entities(N.resolve(rows(s, d)), " Blue ").select("case_id", "key"),
}
ORACLES = {
    "r1_resolve": f"{_ROWS} SELECT case_id, key, name, coalesce(array_to_string(aliases, '|'), '') AS aliases FROM E",
    "r3_links": f"{_ROWS} SELECT case_id, id, key FROM K WHERE key <> ''",
    "a7_entity_stats": f"""{_ROWS} SELECT case_id, key, count(*) AS txn_count, CAST(coalesce(sum(amount) FILTER (direction = 'Dr'), 0) AS DECIMAL(28,2)) AS total_dr,
      CAST(coalesce(sum(amount) FILTER (direction = 'Cr'), 0) AS DECIMAL(28,2)) AS total_cr FROM K WHERE key <> '' GROUP BY 1, 2""",
    "j8_containments": f"""{_ROWS}, Z AS (SELECT case_id, key, replace(key, ' ', '') AS k FROM E)
      SELECT a.case_id, a.key AS long, b.key AS short FROM Z a JOIN Z b ON a.case_id = b.case_id AND a.key <> b.key AND length(a.k) >= 5 AND length(b.k) >= 5 AND contains(a.k, b.k)""",
    "f5_entity_search": f"{_ROWS} SELECT case_id, key FROM E WHERE contains(lower(name), 'blue') OR contains(lower(coalesce(array_to_string(aliases, '|'), '')), 'blue')",
}
