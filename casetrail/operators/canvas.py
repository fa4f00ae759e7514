"""The case graph as a canvas shows it: whole nodes and edges, filters, focus and the inspector.

Nodes are ``(case_id, node, type, label, size, flagged, needs_review, high_value, total_amount, flagged_txn_ids,
needs_review_txn_ids, pattern_hits)``; edges are ``(case_id, edge, source, target, kind, total_amount, txn_count,
date_min, date_max, sample_txn_ids, sample_txns)`` of the kinds ``owns``, ``flow_in`` and ``flow_out``. All cases are built at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.operators.graph import MONEY, PATTERN_FLAGS, first_links
from casetrail.session import cut_lineage

HIGH_VALUE = 1_000_000


def _id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _stats(rows: DataFrame, high_value: int) -> DataFrame:
    """Badges of each ``(case_id, node)`` over its transactions. The ids of flagged transactions are part of the
    result, so a node gathers those, and no others."""
    ours = F.array_intersect(F.coalesce("flags", F.array().cast("array<string>")), F.array(*map(F.lit, PATTERN_FLAGS)))
    flagged = F.coalesce(F.col("review_status") == "flagged", F.lit(False)) | (F.size(ours) > 0)
    review = F.coalesce(F.array_contains("flags", "NEEDS_REVIEW"), F.lit(False))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    base = rows.groupBy("case_id", "node").agg(
        F.bool_or(flagged).alias("flagged"),
        F.bool_or(review).alias("needs_review"),
        (F.sum("amount") >= high_value).alias("high_value"),
        F.sum("amount").cast(MONEY).alias("total_amount"),
        ids(flagged).alias("flagged_txn_ids"),
        ids(review).alias("needs_review_txn_ids"),
        *[F.count_if(F.array_contains(ours, name)).alias(name) for name in PATTERN_FLAGS],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in sorted(PATTERN_FLAGS)])
    hits = F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))
    return base.withColumn("pattern_hits", hits).drop(*PATTERN_FLAGS)


def nodes(ledger: DataFrame, entities: DataFrame, links: DataFrame, high_value: int = HIGH_VALUE) -> DataFrame:
    """Persons (sized by accounts, without badges), accounts (by transactions) and entities (by links).

    ``ledger`` is ``(case_id, id, person_id, holder_name, account_id, amount, flags, review_status)``, ``entities`` ``(case_id,
    key, name)``, ``links`` ``(case_id, id, key)``. An account's label is its number. Entities without a link
    have size 0 and no badge.
    """
    people = ledger.groupBy("case_id", "person_id").agg(F.min("holder_name").alias("label"), F.countDistinct("account_id").alias("size"))
    people = people.select("case_id", _id("person", "person_id").alias("node"), F.lit("person").alias("type"), "label", "size")
    accounts = ledger.groupBy("case_id", "account_id").agg(F.count(F.lit(1)).alias("size"))
    accounts = accounts.select(
        "case_id", _id("account", "account_id").alias("node"), F.lit("account").alias("type"), F.col("account_id").cast("string").alias("label"), "size"
    )
    sized = links.groupBy("case_id", "key").agg(F.count(F.lit(1)).alias("size"))
    parties = entities.select("case_id", "key", "name").join(sized, ["case_id", "key"], "left").select(
        "case_id", _id("entity", "key").alias("node"), F.lit("entity").alias("type"), F.col("name").alias("label"), F.coalesce("size", F.lit(0)).alias("size")
    )
    facts = ["case_id", "id", "amount", "flags", "review_status"]
    of_accounts = ledger.select(*facts, _id("account", "account_id").alias("node"))
    of_parties = links.select("case_id", "id", "key").join(ledger.select(*facts), ["case_id", "id"]).select(*facts, _id("entity", "key").alias("node"))
    stats = _stats(of_accounts.unionByName(of_parties), high_value)
    found = people.unionByName(accounts).unionByName(parties).join(stats, ["case_id", "node"], "left")
    bare = F.col("type") == "person"
    none = F.array().cast(stats.schema["flagged_txn_ids"].dataType)
    filled = {
        **{c: F.when(~bare, F.coalesce(c, F.lit(False))) for c in ("flagged", "needs_review", "high_value")},
        "total_amount": F.when(~bare, F.coalesce("total_amount", F.lit(0).cast(MONEY))),
        **{c: F.when(~bare, F.coalesce(c, none)) for c in ("flagged_txn_ids", "needs_review_txn_ids")},
        "pattern_hits": F.when(~bare, F.coalesce("pattern_hits", F.create_map().cast(stats.schema["pattern_hits"].dataType))),
    }
    return found.withColumns(filled)


def edges(ledger: DataFrame, links: DataFrame, samples: int = 20, ids: int = 5) -> DataFrame:
    """Ownership of accounts and flows between accounts and entities, with the newest transactions of each.

    Debits flow out to the entity, all others in. A sample has ``id, txn_date, amount, direction, raw_description``
    (140 characters); the newest come first by day and ``row_index``, unknown days last. No edge gathers more than ``samples``.
    """
    owned = ledger.groupBy("case_id", "person_id", "account_id").agg(F.count(F.lit(1)).alias("txn_count"))
    owned = owned.select(
        "case_id", F.concat_ws(":", F.lit("owns"), "person_id", "account_id").alias("edge"), _id("person", "person_id").alias("source"),
        _id("account", "account_id").alias("target"), F.lit("owns").alias("kind"), F.lit(0).cast(MONEY).alias("total_amount"), "txn_count",
    )
    rows = ledger.join(first_links(links), ["case_id", "id"])
    out = F.coalesce(F.col("direction") == "Dr", F.lit(False))
    account, party = _id("account", "account_id"), _id("entity", "key")

    def ends(goes_out: Column) -> list[Column]:
        name = F.when(goes_out, F.concat_ws(":", F.lit("out"), "account_id", "key")).otherwise(F.concat_ws(":", F.lit("in"), "key", "account_id"))
        return [
            name.alias("edge"),
            F.when(goes_out, account).otherwise(party).alias("source"),
            F.when(goes_out, party).otherwise(account).alias("target"),
            F.when(goes_out, "flow_out").otherwise("flow_in").alias("kind"),
        ]

    flows = rows.select(
        "case_id", ends(out)[0], "id", "row_index", "txn_date", "amount", "direction",
        F.substring(F.coalesce("raw_description", F.lit("")), 1, 140).alias("raw_description"),
    )
    sums = rows.groupBy("case_id", "account_id", "key", out.alias("_out")).agg(
        F.sum("amount").cast(MONEY).alias("total_amount"), F.count(F.lit(1)).alias("txn_count"), F.min("txn_date").alias("date_min"), F.max("txn_date").alias("date_max")
    )
    sums = sums.select("case_id", *ends(F.col("_out")), "total_amount", "txn_count", "date_min", "date_max")
    newest = Window.partitionBy("case_id", "edge").orderBy(F.desc_nulls_last("txn_date"), F.desc("row_index"), F.desc("id"))
    entry = F.struct("_n", "id", "txn_date", "amount", "direction", "raw_description")
    shown = (
        flows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= samples)
        .groupBy("case_id", "edge").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s.dropFields("_n")).alias("sample_txns"))
    )
    # Every edge has samples; a left join is left out by Spark where nobody asks for them.
    told = sums.join(shown, ["case_id", "edge"], "left").withColumn("sample_txn_ids", F.transform(F.slice("sample_txns", 1, ids), lambda s: s["id"]))
    return owned.unionByName(told, allowMissingColumns=True)


def filter_graph(
    found: DataFrame,
    lines: DataFrame,
    types: tuple[str, ...] = ("person", "account", "entity"),
    flagged_only: bool = False,
    least_amount: float = 0,
    first_month: str | None = None,
    last_month: str | None = None,
    hide_orphans: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and ``(case_id, hidden)`` of a filtered canvas.

    Nodes of the wanted types, flagged ones only on demand (persons are exempt); edges with both
    ends left, of an amount and with days that meet the months from first to last (ownership is exempt from both;
    unknown days meet any). ``hide_orphans`` drops nodes without an edge; ``hidden`` counts them.
    """
    kept = found.filter(F.col("type").isin(*types))
    if flagged_only:
        kept = kept.filter((F.col("type") == "person") | F.coalesce("flagged", F.lit(False)))
    ends = kept.select("case_id", "node")
    for side in ("source", "target"):
        lines = lines.join(ends.withColumnRenamed("node", side), ["case_id", side], "left_semi")
    fits = F.col("total_amount") >= least_amount
    if last_month:
        fits = fits & F.coalesce(F.col("date_min").cast("string") <= f"{last_month}-31", F.lit(True))
    if first_month:
        fits = fits & F.coalesce(F.col("date_max").cast("string") >= f"{first_month}-01", F.lit(True))
    lines = lines.filter((F.col("kind") == "owns") | fits)
    if not hide_orphans:
        return kept, lines, kept.select("case_id").distinct().withColumn("hidden", F.lit(0).cast("bigint"))
    used = lines.select("case_id", F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("_used", F.lit(True))
    marked = kept.join(used, ["case_id", "node"], "left")
    hidden = marked.groupBy("case_id").agg(F.count_if(F.col("_used").isNull()).alias("hidden"))
    return marked.filter("_used").drop("_used"), lines, hidden


def node_counts(found: DataFrame) -> DataFrame:
    """Nodes and flagged nodes of each type."""
    return found.groupBy("case_id", "type").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"))


def label_matches(found: DataFrame, text: str) -> DataFrame:
    """``(case_id, node)`` whose label holds the text, in any case; a blank text matches nothing."""
    wanted = text.strip().lower()
    return found.filter(F.contains(F.lower("label"), F.lit(wanted)) & F.lit(wanted != "")).select("case_id", "node")


def touching(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with at least one end among ``chosen`` (case_id, node)."""
    ends = chosen.select("case_id", "node").distinct()
    one = lines.join(ends.withColumnRenamed("node", "source"), ["case_id", "source"], "left_semi")
    two = lines.join(ends.withColumnRenamed("node", "source"), ["case_id", "source"], "left_anti")
    return one.unionByName(two.join(ends.withColumnRenamed("node", "target"), ["case_id", "target"], "left_semi"))


def focus(lines: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around chosen nodes: themselves, their edges and the far ends of those."""
    near = touching(lines, chosen)
    ends = near.select("case_id", F.explode(F.array("source", "target")).alias("node"))
    return chosen.select("case_id", "node").unionByName(ends).distinct(), near


def incident(lines: DataFrame) -> DataFrame:
    """Every edge from both of its ends: ``case_id, node, other, is_out, ...``; a loop is told once."""
    rest = [c for c in lines.columns if c not in ("case_id", "source", "target")]
    out = F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("is_out"))
    back = F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("is_out"))
    both = F.when(F.col("source") == F.col("target"), F.array(out)).otherwise(F.array(out, back))
    return lines.select("case_id", F.inline(both), *rest)


def ranked_incident(lines: DataFrame, k: int | None = None) -> DataFrame:
    """Edges of each node in the order of the inspector, ``place`` from 1: ownership first, then by amount, ties by
    edge; ``k`` of each node."""
    order = Window.partitionBy("case_id", "node").orderBy(F.when(F.col("kind") == "owns", 0).otherwise(1), F.desc("total_amount"), "edge")
    rows = incident(lines).withColumn("place", F.row_number().over(order))
    return rows if k is None else rows.filter(F.col("place") <= k)


def inspect(found: DataFrame, lines: DataFrame, relative: bool = True) -> DataFrame:
    """What the inspector tells about every node: its columns and ``total_in, total_out, incident_txns, patterns, partners``.

    ``patterns`` are the pattern hits as ``(name, hits)``, commonest first. ``relative`` counts what comes in
    and goes out as seen from the node; else only accounts have totals, as where a flow in ends at the
    account and a flow out begins there. ``partners`` are the numbers of other nodes by type.
    """
    each = incident(lines)
    came, went = ~F.col("is_out") & (F.col("kind") != "owns"), F.col("is_out") & (F.col("kind") != "owns")
    if not relative:
        came, went = came & (F.col("kind") == "flow_in"), went & (F.col("kind") == "flow_out")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_amount"))), F.lit(0)).cast(MONEY)
    sums = each.groupBy("case_id", "node").agg(
        total(came).alias("total_in"), total(went).alias("total_out"),
        F.coalesce(F.sum(F.when(F.col("kind") != "owns", F.col("txn_count"))), F.lit(0)).alias("incident_txns"),
    )
    kind = F.substring_index("other", ":", 1)
    others = each.select("case_id", "node", "other", kind.alias("kind")).distinct().groupBy("case_id", "node").agg(
        *[F.count_if(F.col("kind") == t).alias(t) for t in ("person", "account", "entity")]
    )
    others = others.select("case_id", "node", F.struct("person", "account", "entity").alias("partners"))
    hits = F.transform(F.map_entries("pattern_hits"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("name")))
    patterns = F.transform(F.array_sort(hits), lambda e: F.struct(e["name"].alias("name"), (-e["n"]).alias("hits")))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(t) for t in ("person", "account", "entity")])
    joined = found.join(sums, ["case_id", "node"], "left").join(others, ["case_id", "node"], "left")
    return joined.withColumns(
        {
            "total_in": F.coalesce("total_in", F.lit(0).cast(MONEY)), "total_out": F.coalesce("total_out", F.lit(0).cast(MONEY)),
            "incident_txns": F.coalesce("incident_txns", F.lit(0).cast("bigint")), "patterns": patterns, "partners": F.coalesce("partners", zero),
        }
    )


def flagged_samples(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Flagged transactions among the samples of a node's edges, newest first by ``place``: ``case_id, node, id, txn_date,
    amount, place``; each once."""
    ids = found.select("case_id", "node", F.explode("flagged_txn_ids").alias("id"))
    each = incident(lines.filter("sample_txns IS NOT NULL")).select("case_id", "node", F.inline("sample_txns"))
    rows = each.select("case_id", "node", "id", "txn_date", "amount").distinct().join(ids, ["case_id", "node", "id"], "left_semi")
    newest = Window.partitionBy("case_id", "node").orderBy(F.desc_nulls_last("txn_date"), "id")
    return rows.withColumn("place", F.row_number().over(newest))


def compare(inspected: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two nodes side by side, for ``pairs`` (case_id, one, two): totals, transactions, flags and flagged transactions of each,
    and the number of neighbours that they share, those that are one of both included."""
    facts = ["total_in", "total_out", "incident_txns", "flagged"]
    many = F.coalesce(F.size("flagged_txn_ids"), F.lit(0))
    # Both sides of a pair read what the inspector told.
    inspected = cut_lineage(inspected.select("case_id", "node", *facts, "flagged_txn_ids"))
    found = pairs.select("case_id", "one", "two").distinct()
    for side in ("one", "two"):
        told = inspected.select("case_id", F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in facts], F.when(F.col("flagged_txn_ids").isNull(), 0).otherwise(many).alias(f"{side}_flagged_txns"))
        found = found.join(told, ["case_id", side])
    near = incident(lines).select("case_id", "node", "other").distinct()
    first, second = near.withColumnRenamed("node", "one"), near.withColumnRenamed("node", "two")
    shared = pairs.select("case_id", "one", "two").distinct().join(first, ["case_id", "one"]).join(second, ["case_id", "two", "other"])
    shared = shared.groupBy("case_id", "one", "two").agg(F.count(F.lit(1)).alias("shared"))
    return found.join(shared, ["case_id", "one", "two"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def unflag(ledger: DataFrame, found: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ledger after the flagged transactions of ``chosen`` nodes (case_id, node) are set to unreviewed."""
    ids = found.join(chosen.select("case_id", "node").distinct(), ["case_id", "node"], "left_semi")
    ids = ids.select("case_id", F.explode("flagged_txn_ids").alias("id")).distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit"), "unreviewed").otherwise(F.col("review_status"))
    joined = ledger.join(ids, ["case_id", "id"], "left")
    return joined.select(*[status.alias(c) if c == "review_status" else F.col(c) for c in ledger.columns])
