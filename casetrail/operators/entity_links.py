"""Manual entities, links by hand, the rows behind entities, and suggestions for counterparties.

Entities and links are those of ``entities``: an entity is ``(case_id, key)``, a link ``(case_id, id, key, role)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions import names
from casetrail.functions.text import strip
from casetrail.operators import entities as N


def manual_key(name: Column) -> Column:
    """The canonical key; a name without an informative word is its own key, in quotes."""
    own = F.concat(F.lit('"'), F.lower(strip(name)), F.lit('"'))
    return F.coalesce(F.nullif(names.canonical_key(name), F.lit("")), own)


def create_entities(entities: DataFrame, cases: DataFrame, fresh: DataFrame) -> DataFrame:
    """``entities`` with those of ``fresh`` (case_id, name, entity_type, created_at and more) as manual ones.

    A case has to exist and a name to be given. Whoever has the key already becomes this manual entity: its
    name joins the aliases, its links stay. Of several fresh ones of a key the last by ``created_at`` counts,
    of equal times the greatest; the names of all are kept.
    """
    asked = fresh.filter("name IS NOT NULL").join(cases.select("case_id").distinct(), "case_id", "left_semi")
    asked = asked.withColumn("key", manual_key(F.col("name")))
    rest = [c for c in fresh.columns if c not in ("case_id", "created_at")]
    last = asked.groupBy("case_id", "key").agg(
        F.max(F.struct("created_at", *rest)).alias("r"), F.collect_set("name").alias("_told")
    )
    nothing = F.array().cast("array<string>")
    old = entities.select("case_id", "key", F.array_append(F.coalesce("aliases", nothing), F.col("name")).alias("_old"))
    joined = last.join(old, ["case_id", "key"], "left")
    spelled = F.array_sort(F.array_compact(F.array_distinct(F.concat("_told", F.coalesce("_old", nothing)))))
    made = joined.select(
        "case_id", "key", "r.*",
        F.array_remove(spelled, F.col("r.name")).alias("aliases"),
        F.lit(False).alias("auto_created"),
    )
    kept = entities.join(last.select("case_id", "key"), ["case_id", "key"], "left_anti")
    return kept.unionByName(made, allowMissingColumns=True)


def link(linked: DataFrame, wanted: DataFrame, ledger: DataFrame, entities: DataFrame) -> DataFrame:
    """``linked`` and the links of ``wanted`` that are not among them: those of transactions and entities that exist.
    A null role is ``counterparty``. Both have the same columns; of several wanted links with one role the
    one with the least other columns stays."""
    key = ["case_id", "id", "key", "role"]
    rest = [c for c in linked.columns if c not in key]
    asked = wanted.withColumn("role", F.coalesce("role", F.lit("counterparty")))
    asked = asked.join(ledger.select("case_id", "id"), ["case_id", "id"], "left_semi")
    asked = asked.join(entities.select("case_id", "key"), ["case_id", "key"], "left_semi").join(linked.select(*key), key, "left_anti")
    once = asked.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else asked.select(*key).distinct()
    return linked.unionByName(once)


def entity_rows(linked: DataFrame, ledger: DataFrame, wanted: DataFrame | None = None, order: str = "row_index") -> DataFrame:
    """The transactions of the ``wanted`` entities (case_id, key), or of all: each once for an entity, in whatever
    roles. Sorted by entity, newest day first, rows without a day last, then by ``order`` and id. The sort
    cuts its ranges through all of these, so an entity with many rows lies in many partitions."""
    pairs = linked.select("case_id", "key", "id").distinct()
    if wanted is not None:
        pairs = pairs.join(wanted.select("case_id", "key").distinct(), ["case_id", "key"], "left_semi")
    rows = pairs.join(ledger, ["case_id", "id"])
    return rows.orderBy("case_id", "key", F.desc("txn_date"), order, "id")


def newest_rows(linked: DataFrame, ledger: DataFrame, k: int, order: str = "row_index") -> DataFrame:
    """The first ``k`` rows of each entity in the order of ``entity_rows``, with their ``place`` from 1. Each task
    keeps ``k`` rows of an entity before the shuffle."""
    place = Window.partitionBy("case_id", "key").orderBy(F.desc("txn_date"), order, "id")
    rows = linked.select("case_id", "key", "id").distinct().join(ledger, ["case_id", "id"])
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def entities_of(linked: DataFrame, stats: DataFrame, ids: DataFrame) -> DataFrame:
    """All entities of the given transactions (case_id, id), each once for a transaction, with their totals."""
    pairs = linked.join(ids.select("case_id", "id").distinct(), ["case_id", "id"], "left_semi")
    return pairs.select("case_id", "id", "key").distinct().join(stats, ["case_id", "key"])


def by_use(stats: DataFrame) -> DataFrame:
    """Entities of each case, those with most transactions first, equal ones by key."""
    return stats.orderBy("case_id", F.desc("txn_count"), "key")


def suggestions(ledger: DataFrame, entities: DataFrame) -> DataFrame:
    """``(case_id, id, key)``: for each transaction the first entity of its case whose name or an alias is its
    counterparty, in any case and without outer blanks; null where there is none. The first is by ``entity_seq`` where
    entities have one, else by key. Names are made unique first, so no counterparty meets more than one row.
    """
    order = F.struct("entity_seq", "key") if "entity_seq" in entities.columns else F.struct("key")
    spelled = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))
    each = entities.select("case_id", "key", order.alias("_order"), F.explode(spelled).alias("_n"))
    first = each.groupBy("case_id", F.lower("_n").alias("_party")).agg(F.min_by("key", "_order").alias("key"))
    asked = ledger.select("case_id", "id", F.nullif(F.lower(strip(F.col("counterparty"))), F.lit("")).alias("_party"))
    return asked.join(first, ["case_id", "_party"], "left").select("case_id", "id", "key")


def resolution_counts(ledger: DataFrame, existing: DataFrame, moves: DataFrame) -> DataFrame:
    """What resolving a ledger changes, a row for each of its cases: ``groups`` of equal keys, ``entities_created`` and ``entities_updated``
    among them, and ``entities_merged`` afterwards (see ``entities.merges``)."""
    cases = ledger.select("case_id").distinct()
    groups = N.keyed(ledger).select("case_id", "key").distinct()
    known = existing.select("case_id", "key").distinct().withColumn("_known", F.lit(True))
    found = groups.join(known, ["case_id", "key"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("groups"), F.count("_known").alias("entities_updated")
    )
    gone = moves.groupBy("case_id").agg(F.count(F.lit(1)).alias("entities_merged"))
    number = lambda c: F.coalesce(c, F.lit(0))
    return cases.join(found, "case_id", "left").join(gone, "case_id", "left").select(
        "case_id",
        (number("groups") - number("entities_updated")).alias("entities_created"),
        *[number(c).alias(c) for c in ("entities_updated", "entities_merged", "groups")],
    )
