"""The money-flow graph of every case: nodes, edges and what the inspector tells about a node.

A ledger has ``case_id, id, seq, account_id, person_id, txn_date, amount, direction, flags,
review_status``; links are ``(case_id, id, key, role)`` as entity resolution gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"


def _node(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


def first_links(links: DataFrame) -> DataFrame:
    """One entity for each transaction: the link that came first by ``link_seq``, where links have one,
    else the first by key."""
    order = F.struct("link_seq", "key") if "link_seq" in links.columns else F.struct("key")
    return links.groupBy("case_id", "id").agg(F.min_by("key", order).alias("key"))


def nodes(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """``(case_id, node, type, size)``: persons by accounts, accounts by transactions, entities by
    links."""
    persons = ledger.select("case_id", "person_id", "account_id").distinct()
    persons = persons.groupBy("case_id", _node("p", F.col("person_id")).alias("node")).agg(F.count(F.lit(1)).alias("size"))
    accounts = ledger.groupBy("case_id", _node("a", F.col("account_id")).alias("node")).agg(F.count(F.lit(1)).alias("size"))
    entities = links.groupBy("case_id", _node("e", F.col("key")).alias("node")).agg(F.count(F.lit(1)).alias("size"))
    named = [(persons, "person"), (accounts, "account"), (entities, "entity")]
    frames = [df.select("case_id", "node", F.lit(kind).alias("type"), "size") for df, kind in named]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def flow_edges(ledger: DataFrame, links: DataFrame, samples: int = 20) -> DataFrame:
    """Flows between accounts and entities: ``out`` for debits, else ``in``; totals, days and the
    newest transactions, of which no edge gathers more than ``samples``."""
    rows = ledger.join(first_links(links), ["case_id", "id"])
    way = F.when(F.col("direction") == "Dr", "out").otherwise("in")
    account, entity = _node("a", F.col("account_id")), _node("e", F.col("key"))
    flows = rows.select(
        "case_id",
        F.when(way == "out", account).otherwise(entity).alias("source"),
        F.when(way == "out", entity).otherwise(account).alias("target"),
        way.alias("way"),
        "id",
        "seq",
        "txn_date",
        "amount",
    )
    edge = ["case_id", "source", "target", "way"]
    sums = flows.groupBy(*edge).agg(
        F.sum("amount").cast(MONEY).alias("amount"),
        F.count(F.lit(1)).alias("count"),
        F.min("txn_date").alias("first_date"),
        F.max("txn_date").alias("last_date"),
    )
    newest = Window.partitionBy(*edge).orderBy(F.desc_nulls_last("txn_date"), F.desc("seq"))
    shown = (
        flows.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= samples)
        .groupBy(*edge)
        .agg(F.array_sort(F.collect_list(F.struct("_n", "id", "txn_date", "amount"))).alias("_s"))
        .select(*edge, F.transform("_s", lambda s: s.dropFields("_n")).alias("samples"))
    )
    return sums.join(shown, edge)


def owns_edges(ledger: DataFrame) -> DataFrame:
    pairs = ledger.select("case_id", "person_id", "account_id").distinct()
    return pairs.select("case_id", _node("p", F.col("person_id")).alias("source"), _node("a", F.col("account_id")).alias("target"))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends: ``(case_id, node, other, inward, ...)``."""
    rest = [c for c in edges.columns if c not in ("case_id", "source", "target")]
    ends = F.array(
        F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(True).alias("inward")),
        F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(False).alias("inward")),
    )
    return edges.select("case_id", F.inline(ends), *rest)


def node_totals(edges: DataFrame) -> DataFrame:
    """In and out totals and transactions of every node."""
    side = lambda inward: F.coalesce(F.sum(F.when(F.col("inward") == inward, F.col("amount"))), F.lit(0)).cast(MONEY)
    return incident(edges).groupBy("case_id", "node").agg(
        side(True).alias("total_in"), side(False).alias("total_out"), F.sum("count").alias("transactions")
    )


def partner_ranking(edges: DataFrame) -> DataFrame:
    """Per node its partners, in the ``in`` column if at least as much came as went; each column by
    amount, ties by name."""
    side = lambda inward: F.coalesce(F.sum(F.when(F.col("inward") == inward, F.col("amount"))), F.lit(0)).cast(MONEY)
    both = incident(edges).groupBy("case_id", "node", "other").agg(side(True).alias("came"), side(False).alias("went"))
    column = F.when(F.col("came") >= F.col("went"), "in").otherwise("out")
    rows = both.withColumn("column", column).withColumn("amount", F.greatest("came", "went"))
    order = Window.partitionBy("case_id", "node", "column").orderBy(F.desc("amount"), "other")
    return rows.withColumn("place", F.row_number().over(order))


def monthly_activity(ledger: DataFrame) -> DataFrame:
    dated = ledger.filter("txn_date IS NOT NULL")
    return dated.groupBy("case_id", F.date_format("txn_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("count"))


def badges(ledger: DataFrame, high_value: int = 1_000_000) -> DataFrame:
    """Per account: flagged, needs review and high value."""
    six = F.array(*map(F.lit, PATTERN_FLAGS))
    status = F.coalesce(F.col("review_status") == "flagged", F.lit(False))
    return ledger.groupBy("case_id", _node("a", F.col("account_id")).alias("node")).agg(
        F.bool_or(status | F.arrays_overlap("flags", six)).alias("flagged"),
        F.bool_or(F.array_contains("flags", "NEEDS_REVIEW")).alias("needs_review"),
        (F.sum("amount") >= high_value).alias("high_value"),
        F.sum("amount").cast(MONEY).alias("total"),
    )


# Flags of the six detectors.
PATTERN_FLAGS = (
    "STRUCTURING_SUSPECTED",
    "VELOCITY_SPIKE",
    "ROUND_AMOUNT_CLUSTER",
    "FUND_THROUGH_FLOW",
    "DORMANT_THEN_ACTIVE",
    "SAME_DAY_ROUND_TRIP",
)


def filter_edges(edges: DataFrame, least_amount=None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Flows of at least an amount whose days overlap a window."""
    if least_amount is not None:
        edges = edges.filter(F.col("amount") >= least_amount)
    if since:
        edges = edges.filter(F.col("last_date") >= F.lit(since).cast("date"))
    if until:
        edges = edges.filter(F.col("first_date") <= F.lit(until).cast("date"))
    return edges


def shared_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes that are partners of both nodes of each pair ``(case_id, one, two)``."""
    near = incident(edges).select("case_id", "node", "other").distinct()
    first = near.select("case_id", F.col("node").alias("one"), F.col("other").alias("shared"))
    second = near.select("case_id", F.col("node").alias("two"), F.col("other").alias("shared"))
    return pairs.join(first, ["case_id", "one"]).join(second, ["case_id", "two", "shared"])


def sides(transfers: DataFrame, addresses: list[str] | None = None) -> DataFrame:
    """Transfers by who sends and who receives: ``address`` in lower case, ``side`` (out or in) and the transfer's
    columns, for the given addresses or for all. A transfer to oneself is on both sides; a missing or empty
    end is nobody's. No row is shuffled."""
    ends = F.array(
        F.struct(F.lower("source").alias("address"), F.lit("out").alias("side")), F.struct(F.lower("target").alias("address"), F.lit("in").alias("side"))
    )
    rows = transfers.select(F.inline(ends), "*").filter("address <> ''")
    return rows if addresses is None else rows.filter(F.col("address").isin(*{a.lower() for a in addresses}))
