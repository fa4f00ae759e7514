"""Entities and links by hand over the entities of part names, with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from casetrail.functions import enrich
from casetrail.operators import balances
from casetrail.operators import entities as N
from casetrail.operators import entity_links as L
from casetrail.sources import shared_tables as T
from catalog import entities
from catalog.text import KEY_SQL


def _existing(ledger):
    """Entities of half of the rows, every other one made by hand, and one a case that no row has."""
    half = N.keyed(ledger).filter("id % 2 = 0").select("case_id", "key").distinct()
    gone = ledger.select("case_id", F.lit("gone").alias("key")).distinct()
    return half.unionByName(gone).selectExpr(
        "case_id", "key", "'OLD ' || key AS name", "array('old') AS aliases", "'kept' AS entity_type", "length(key) % 2 = 0 AS auto_created"
    )


def _upserted(spark, sf):
    ledger = entities.saved(spark, sf)
    return N.resolve(ledger, _existing(ledger))


def _used(spark, sf):
    ledger = entities.saved(spark, sf)
    some = ledger.filter("id % 5 = 1")
    return N.used_entities(N.entity_stats(N.resolve(ledger, _existing(ledger)), N.links(some), some)).select("case_id", "key", "txn_count", "auto_created")


def _created(spark, sf):
    """Every tenth part's name, written large, as an entity of one of four cases, of which three exist."""
    ledger = entities.saved(spark, sf)
    fresh = T.table(spark, sf, "part").filter("p_partkey % 10 = 0").selectExpr(
        "p_partkey % 4 AS case_id", "CASE WHEN p_partkey % 100 = 0 THEN 'UPI 12' ELSE upper(p_name) END AS name", "'vendor' AS entity_type", "p_partkey AS created_at")
    made = L.create_entities(N.resolve(ledger), ledger.select("case_id").distinct(), fresh)
    return made.select("case_id", "key", "name", F.array_join("aliases", "|").alias("aliases"), "auto_created", "created_at")


def _linked(spark, sf):
    """Rows under review are linked with the first entity of their case, and rows that do not exist."""
    ledger = entities.saved(spark, sf)
    found, linked = N.resolve(ledger), N.links(ledger)
    first = found.groupBy("case_id").agg(F.min("key").alias("key"))
    asked = ledger.filter("review_status = 'flagged'").join(first, "case_id")
    role = F.when(F.col("id") % 2 == 0, "owner").alias("role")
    wanted = asked.select("case_id", "id", "key", role).union(asked.select("case_id", -F.col("id"), "key", role)).union(asked.select("case_id", "id", F.lit("none"), role))
    return L.link(linked, wanted.unionAll(wanted), ledger, found)


def _unlinked(spark, sf):
    linked = _linked(spark, sf)
    return N.unlink(linked, linked.filter("role = 'owner' OR id % 7 = 0"))


def _of_rows(spark, sf):
    ledger = entities.saved(spark, sf)
    stats = N.entity_stats(N.resolve(ledger), N.links(ledger), ledger)
    return L.entities_of(_linked(spark, sf), stats, ledger.filter("id % 10 = 0")).select("case_id", "id", "key", "name", "txn_count", "total_dr", "total_cr")


def _counts(spark, sf):
    ledger = entities.saved(spark, sf)
    found = N.resolve(ledger)
    return L.resolution_counts(ledger, _existing(ledger), N.merges(found, N.links(ledger)))


def _edited(spark, sf):
    rows = T.ledger(spark, sf)
    raw = F.col("raw_description")
    told = enrich.entities_map(enrich.infer_channel(raw), enrich.infer_counterparty(raw), enrich.infer_category(raw), F.lit(False), F.lit("high"))
    new = balances.set_entity(told, "counterparty", F.col("counterparty"))
    return rows.select("id", F.explode(new).alias("entity", "e")).select("id", "entity", "e.value", "e.source", "e.confidence")


_R = entities._ROWS
_WANT = "W AS (SELECT Q.case_id, id, m.key, CASE WHEN id % 2 = 0 THEN 'owner' ELSE 'counterparty' END AS role FROM Q JOIN (SELECT case_id, min(key) AS key FROM E GROUP BY 1) m USING (case_id) WHERE review_status = 'flagged'), LK AS (SELECT case_id, id, key, 'counterparty' AS role FROM K WHERE key <> '' UNION SELECT * FROM W)"
_ROWS_OF = "D AS (SELECT case_id, key, id, txn_date, amount, direction, CAST(row_number() OVER (PARTITION BY case_id, key ORDER BY txn_date DESC, seq) AS INTEGER) AS place FROM K WHERE key <> '')"
_STATS = """TS AS (SELECT case_id, key, count(*) AS txn_count, CAST(coalesce(sum(amount) FILTER (direction = 'Dr'), 0) AS DECIMAL(28,2)) AS total_dr, CAST(coalesce(sum(amount) FILTER (direction = 'Cr'), 0) AS DECIMAL(28,2)) AS total_cr FROM K WHERE key <> '' GROUP BY 1, 2)"""
_OLD = "EX AS (SELECT DISTINCT case_id, key FROM K WHERE key <> '' AND id % 2 = 0 UNION SELECT DISTINCT case_id, 'gone' FROM Q)"
# Keys by rank, one after the other, against the list of those that stay.
_MERGES = """RK AS (SELECT case_id, key, replace(key, ' ', '') AS k, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, key) AS r FROM K WHERE key <> '' GROUP BY 1, 2),
  ST AS (SELECT DISTINCT case_id, 0::BIGINT AS r, []::STRUCT(key VARCHAR, k VARCHAR)[] AS alive, NULL::VARCHAR AS key, NULL::VARCHAR AS into_key FROM RK
    UNION ALL SELECT case_id, r, CASE WHEN hit IS NULL THEN list_append(alive, {'key': key, 'k': k}) ELSE alive END, key, hit
      FROM (SELECT RK.*, ST.alive, list_filter(ST.alive, lambda a: length(a.k) >= 5 AND length(RK.k) >= 5 AND (contains(a.k, RK.k) OR contains(RK.k, a.k)))[1].key AS hit FROM ST JOIN RK ON RK.case_id = ST.case_id AND RK.r = ST.r + 1))"""
_RECURSIVE = _R.replace("WITH L", "WITH RECURSIVE L", 1)

QUERIES = {
    "r2_upsert": lambda s, d: _upserted(s, d).select("case_id", "key", "name", F.array_join("aliases", "|").alias("aliases"), "auto_created"),
    "f4_used_entities": _used,
    "l6_entities_by_use": lambda s, d: L.by_use(entities._stats(s, d)),
    "r5_entity_rows": lambda s, d: L.entity_rows(N.links(entities.rows(s, d)), entities.rows(s, d), order="seq").select("case_id", "key", "id", "txn_date", "amount", "direction"),
    "l5_newest_rows": lambda s, d: L.newest_rows(N.links(entities.rows(s, d)), entities.rows(s, d), 3, "seq").select("case_id", "key", "id", "place"),
    "r6_create_entities": _created,
    "r7_link": _linked,
    "r7_unlink": _unlinked,
    "r8_entities_of_rows": _of_rows,
    "r9_resolution_counts": _counts,
    "j7_suggestions": lambda s, d: L.suggestions(entities.rows(s, d), N.resolve(entities.rows(s, d))),
    "m5_inline_edit": _edited,
}

ORACLES = {
    "r2_upsert": f"""{_R}, {_OLD} SELECT case_id, key, CASE WHEN EX.key IS NOT NULL AND (length(key) % 2 = 1 OR E.key IS NULL) THEN 'OLD ' || key ELSE E.name END AS name,
      CASE WHEN E.key IS NULL THEN 'old' ELSE coalesce(array_to_string(E.aliases, '|'), '') END AS aliases, EX.key IS NULL OR length(key) % 2 = 0 AS auto_created FROM E FULL JOIN EX USING (case_id, key)""",
    "f4_used_entities": f"""{_R}, {_OLD}, TC AS (SELECT case_id, key, count(*) AS n FROM K WHERE key <> '' AND id % 5 = 1 GROUP BY 1, 2)
      SELECT case_id, key, coalesce(n, 0) AS txn_count, EX.key IS NULL OR length(key) % 2 = 0 AS auto_created FROM E FULL JOIN EX USING (case_id, key) LEFT JOIN TC USING (case_id, key) WHERE n > 0 OR EX.key IS NOT NULL AND length(key) % 2 = 1""",
    "l6_entities_by_use": f"{_R}, {_STATS} SELECT * FROM TS",
    "r5_entity_rows": f"{_R}, {_ROWS_OF} SELECT * EXCLUDE (place) FROM D",
    "l5_newest_rows": f"{_R}, {_ROWS_OF} SELECT case_id, key, id, place FROM D WHERE place <= 3",
    "r6_create_entities": f"""{_R}, F0 AS (SELECT p_partkey % 4 AS case_id, CASE WHEN p_partkey % 100 = 0 THEN 'UPI 12' ELSE upper(p_name) END AS name, p_partkey AS created_at FROM part WHERE p_partkey % 10 = 0),
      F1 AS (SELECT *, coalesce(nullif({KEY_SQL.format(x="name")}, ''), '"' || lower(trim(name)) || '"') AS key FROM F0 WHERE case_id < 3), F2 AS (SELECT case_id, key, max_by(name, created_at) AS name, max(created_at) AS created_at, list(DISTINCT name) AS told FROM F1 GROUP BY 1, 2)
      SELECT case_id, key, coalesce(F2.name, E.name) AS name, CASE WHEN F2.key IS NULL THEN coalesce(array_to_string(E.aliases, '|'), '') ELSE coalesce(array_to_string(list_filter(list_sort(list_distinct(list_concat(F2.told, coalesce(E.aliases, []), CASE WHEN E.key IS NULL THEN [] ELSE [E.name] END))), lambda x: x <> F2.name), '|'), '') END AS aliases,
        F2.key IS NULL AS auto_created, F2.created_at FROM E FULL JOIN F2 USING (case_id, key)""",
    "r7_link": f"{_R}, {_WANT} SELECT * FROM LK",
    "r7_unlink": f"{_R}, {_WANT} SELECT * FROM LK WHERE id % 7 <> 0 AND (id, key) NOT IN (SELECT (id, key) FROM LK WHERE role = 'owner')",
    "r8_entities_of_rows": f"{_R}, {_WANT}, {_STATS} SELECT case_id, id, key, name, txn_count, total_dr, total_cr FROM (SELECT DISTINCT case_id, id, key FROM LK WHERE id % 10 = 0) JOIN E USING (case_id, key) JOIN TS USING (case_id, key)",
    "r9_resolution_counts": f"""{_RECURSIVE}, {_OLD}, {_MERGES}, G AS (SELECT case_id, count(*) AS groups, count(EX.key) AS old FROM E LEFT JOIN EX USING (case_id, key) GROUP BY 1), M AS (SELECT case_id, count(into_key) AS m FROM ST GROUP BY 1)
      SELECT case_id, groups - old AS entities_created, old AS entities_updated, m AS entities_merged, groups FROM G JOIN M USING (case_id)""",
    "j7_suggestions": f"""{_R}, SP AS (SELECT case_id, lower(unnest(list_append(coalesce(aliases, []), name))) AS n, key FROM E), FI AS (SELECT case_id, n, min(key) AS key FROM SP GROUP BY 1, 2)
      SELECT Q.case_id, id, key FROM Q LEFT JOIN FI ON FI.case_id = Q.case_id AND n = lower(trim(counterparty))""",
    "m5_inline_edit": f"""WITH L AS ({T.ledger_sql()}) SELECT id, e[1] AS entity, e[2] AS value, e[3] AS source, e[4] AS confidence FROM (SELECT id, unnest([ROW('channel', 'UPI', 'extracted', 1.0::DOUBLE),
      ROW('category', 'Transfer', 'auto_resolved', 0.7::DOUBLE), ROW('counterparty', counterparty, 'user_edited', 1.0::DOUBLE)]) AS e FROM L)""",
    # Both halves of the resolution: who is absorbed, and the names that the others end up with.
    "r4_resolve_entities": f"""{_RECURSIVE}, {_MERGES}, MV AS (SELECT case_id, key, into_key FROM ST WHERE into_key IS NOT NULL),
      MO AS (SELECT case_id, into_key AS key, list_sort(list(DISTINCT x)) AS more FROM (SELECT case_id, into_key, unnest(list_append(coalesce(aliases, []), name)) AS x FROM MV JOIN E USING (case_id, key)) GROUP BY 1, 2)
      SELECT case_id, key, name, coalesce(array_to_string(list_concat(coalesce(aliases, []), list_filter(coalesce(more, []), lambda x: x <> name AND NOT list_contains(coalesce(aliases, []), x))), '|'), '') AS aliases
      FROM E LEFT JOIN MO USING (case_id, key) ANTI JOIN MV USING (case_id, key)""",
}
