"""Entity resolution: counterparties of all cases to entities, links and merges.

A ledger has ``case_id, id, seq, counterparty, amount, direction`` and, if a model gave one,
``llm_entity_type``. An entity is ``(case_id, key)`` with ``name, aliases, entity_type,
auto_created``; a link is ``(case_id, id, key, role)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import names
from casetrail.operators import containment
from casetrail.session import cut_lineage

MONEY = "decimal(28,2)"


def with_keys(ledger: DataFrame) -> DataFrame:
    """Add ``counterparty_key``, so that a saved ledger tells its keys once; a blank one names nobody."""
    return ledger.withColumn("counterparty_key", names.canonical_key(F.coalesce("counterparty", F.lit(""))))


def keyed(ledger: DataFrame) -> DataFrame:
    """Rows with the key of their counterparty, told before or now; rows with a blank key are left out."""
    told = ledger if "counterparty_key" in ledger.columns else with_keys(ledger)
    return told.withColumn("key", F.col("counterparty_key")).drop("counterparty_key").filter("key <> ''")


def _vote(rows: DataFrame, column: str, out: str, *more: Column) -> DataFrame:
    """The commonest value of each group, the first seen among equals, and ``more`` of its distinct values."""
    each = rows.groupBy("case_id", "key", column).agg(
        F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first")
    )
    best = F.max_by(column, F.struct("_n", -F.col("_first")))
    return each.groupBy("case_id", "key").agg(best.alias(out), *more)


def resolve(ledger: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Entities of every key of every case, merged with ``existing`` ones.

    The name is the commonest counterparty; the aliases are its other spellings, sorted; the type
    is the models' majority, else what the name tells. Existing manual entities keep their name and
    type, and all get the new aliases.
    """
    rows = keyed(ledger)
    # Spellings of one entity: distinct before they are gathered.
    found = _vote(rows, "counterparty", "name", F.array_sort(F.collect_set("counterparty")).alias("_all"))
    kind = names.classify_type(F.col("name"))
    if "llm_entity_type" in ledger.columns:
        told = _vote(rows.filter(F.col("llm_entity_type") != ""), "llm_entity_type", "_told")
        found = found.join(told, ["case_id", "key"], "left")
        kind = F.coalesce("_told", kind)
    fresh = found.select(
        "case_id",
        "key",
        "name",
        F.array_remove("_all", F.col("name")).alias("aliases"),
        kind.alias("entity_type"),
        F.lit(True).alias("auto_created"),
    )
    if existing is None:
        return fresh
    old = existing.select(
        "case_id", "key", F.struct("name", "aliases", "entity_type", "auto_created").alias("o")
    )
    new = fresh.select("case_id", "key", F.struct("name", "aliases", "entity_type", "auto_created").alias("f"))
    both = old.join(new, ["case_id", "key"], "full_outer")
    manual = F.coalesce(~F.col("o.auto_created"), F.lit(False))
    first = lambda c: F.when(manual, F.col("o." + c)).otherwise(F.coalesce("f." + c, "o." + c)).alias(c)
    return both.select(
        "case_id",
        "key",
        first("name"),
        F.coalesce("f.aliases", "o.aliases").alias("aliases"),
        first("entity_type"),
        F.coalesce("o.auto_created", "f.auto_created").alias("auto_created"),
    )


def links(ledger: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Links of transactions to the entities of their counterparties; old links stay.

    They are dealt by transaction, as the joins with the ledger need them.
    """
    fresh = keyed(ledger).select("case_id", "id", "key", F.lit("counterparty").alias("role"))
    every = fresh if existing is None else existing.unionByName(fresh)
    return every.repartition("case_id", "id").distinct()


def containments(entities: DataFrame, min_key_len: int = 5) -> DataFrame:
    """Pairs of entities of one case one of whose squeezed keys holds the other.

    Keys meet through the shorter one's run of ``min_key_len`` letters that is rarest in the case.
    """
    keys = entities.select("case_id", "key", names.squeezed_key(F.col("key")).alias("k"))
    sides = [keys.withColumnRenamed("key", side) for side in ("short", "long")]
    pairs = containment.containment_pairs(*sides, ["case_id"], "k", "k", "short", "long", min_key_len, min_key_len)
    return pairs.filter(F.col("long") != F.col("short")).select("case_id", "long", "short")


def merges(entities: DataFrame, linked: DataFrame, min_key_len: int = 5) -> DataFrame:
    """``(case_id, key, into)``: which automatic entities are absorbed by which other ones.

    Entities rank by links, then by key. One survives if no survivor of a higher rank matches it, or
    if it is manual; an absorbed one goes to the highest of its matching survivors. Each round
    decides every entity whose matches of higher rank are decided, until none is open.
    """
    counts = linked.groupBy("case_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "key")
    # Saved, as the pairs and both of their ranks come from it.
    ranked = cut_lineage(
        entities.join(counts, ["case_id", "key"], "left").select("case_id", "key", "auto_created", rank.alias("rank"))
    )
    pairs = containments(ranked, min_key_len)
    sides = pairs.select("case_id", F.col("long").alias("key"), F.col("short").alias("other")).union(
        pairs.select("case_id", "short", "long")
    )
    other = ranked.select("case_id", F.col("key").alias("other"), F.col("rank").alias("other_rank"))
    above = (
        sides.distinct()
        .join(ranked.filter("auto_created"), ["case_id", "key"])
        .join(other, ["case_id", "other"])
        .filter(F.col("other_rank") < F.col("rank"))
        .select("case_id", "key", "other", "other_rank")
    )
    above = cut_lineage(above)
    # Whoever has nobody above survives; the others are open.
    state = cut_lineage(above.select("case_id", "key").distinct().withColumn("into", F.lit(None).cast("string")).withColumn("open", F.lit(True)))
    while state.filter("open").limit(1).count():
        seen = above.join(
            state.select("case_id", F.col("key").alias("other"), F.col("into").alias("gone"), F.col("open").alias("waits")),
            ["case_id", "other"],
            "left",
        )
        survives = F.col("gone").isNull() & ~F.coalesce("waits", F.lit(False))
        news = seen.groupBy("case_id", "key").agg(
            F.min(F.when(survives, F.struct("other_rank", "other")))["other"].alias("taker"),
            F.min(F.when(survives, F.col("other_rank"))).alias("best"),
            F.min(F.when(F.coalesce("waits", F.lit(False)), F.col("other_rank"))).alias("waiting"),
        )
        # Decided if the highest survivor ranks above all that are still open, or none is open.
        settled = F.col("waiting").isNull() | (F.col("best") < F.col("waiting"))
        state = cut_lineage(
            state.join(news, ["case_id", "key"]).select(
                "case_id",
                "key",
                F.when(F.col("open") & settled, F.col("taker")).otherwise(F.col("into")).alias("into"),
                (F.col("open") & ~F.coalesce(settled, F.lit(False))).alias("open"),
            )
        )
    return state.filter("into IS NOT NULL").select("case_id", "key", "into")


def merged(entities: DataFrame, linked: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and links after ``moves``: names and aliases of the absorbed join the aliases."""
    gone = entities.join(moves, ["case_id", "key"])
    told = gone.select(
        "case_id", F.col("into").alias("key"), F.explode(F.array_append("aliases", F.col("name"))).alias("more")
    ).distinct()
    told = told.groupBy("case_id", "key").agg(F.array_sort(F.collect_set("more")).alias("more"))
    stay = entities.join(moves.select("case_id", "key"), ["case_id", "key"], "left_anti")
    joined = stay.join(told, ["case_id", "key"], "left")
    all_names = F.array_distinct(F.concat("aliases", F.coalesce("more", F.array().cast("array<string>"))))
    kept = joined.withColumn("aliases", F.array_remove(all_names, F.col("name"))).drop("more")
    rewired = linked.join(moves, ["case_id", "key"], "left").select(
        "case_id", "id", F.coalesce("into", "key").alias("key"), "role"
    )
    return kept, rewired.distinct()


def entity_stats(entities: DataFrame, linked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entities with their number of transactions and both totals."""
    of = lambda kind: F.sum(F.when(F.col("direction") == kind, F.col("amount")))
    rows = linked.select("case_id", "key", "id").distinct().join(ledger.select("id", "direction", "amount"), "id")
    sums = rows.groupBy("case_id", "key").agg(
        F.count(F.lit(1)).alias("txn_count"), of("Dr").alias("dr"), of("Cr").alias("cr")
    )
    return entities.join(sums, ["case_id", "key"], "left").select(
        *entities.columns,
        F.coalesce("txn_count", F.lit(0)).alias("txn_count"),
        F.coalesce("dr", F.lit(0)).cast(MONEY).alias("total_dr"),
        F.coalesce("cr", F.lit(0)).cast(MONEY).alias("total_cr"),
    )


def used_entities(stats: DataFrame) -> DataFrame:
    """Entities with a transaction, and manual ones."""
    return stats.filter((F.col("txn_count") > 0) | ~F.col("auto_created"))


def search_entities(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose name or an alias holds the text, in any case."""
    wanted = F.lit(text.strip().lower())
    held = F.exists("aliases", lambda a: F.contains(F.lower(a), wanted))
    return entities.filter(F.contains(F.lower("name"), wanted) | held)


def unlink(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Remove all roles of the given ``(case_id, id, key)``."""
    return linked.join(pairs.select("case_id", "id", "key").distinct(), ["case_id", "id", "key"], "left_anti")
