"""Walks over the transfer graph, for many seeds or pairs at once.

Edges are ``(source, target, seq, ...)``; ``seq`` is the order in which the transfers were recorded. A
walk goes on level by level: each level is one join of the last level's nodes with the neighbours,
an anti-join with what was seen, and a saved copy. Nodes are told apart by their lower-case names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.session import cut_lineage

WAYS = ("outgoing", "incoming", "all")


def _name(column: str | Column) -> Column:
    return F.lower(F.col(column) if isinstance(column, str) else column)


def neighbours(edges: DataFrame, direction: str = "all") -> DataFrame:
    """``(node, other, seq)``: each neighbour once, with the first transfer that shows it.

    ``outgoing`` follows transfers from the node, ``incoming`` those to it. Null and empty ends are
    left out; a transfer to oneself makes a node its own neighbour.
    """
    if direction not in WAYS:
        raise ValueError(f"direction is one of {', '.join(WAYS)}")
    out = F.struct(_name("source").alias("node"), _name("target").alias("other"))
    back = F.struct(_name("target").alias("node"), _name("source").alias("other"))
    sides = {"outgoing": [out], "incoming": [back], "all": [out, back]}[direction]
    rows = edges.select(F.inline(F.array(*sides)), "seq").filter("node <> '' AND other <> ''")
    return rows.groupBy("node", "other").agg(F.min("seq").alias("seq"))


def stops_at(kind: Column, name: Column, stop_types: list[str], names: Column | None = None) -> Column:
    """Whether a walk ends at an entity: by its type, in any case, or by a condition ``names`` on its
    name, which says what a general type does not. An empty or null name never stops."""
    by_type = F.lower(kind).isin([t.lower() for t in stop_types]) if stop_types else F.lit(False)
    by_name = F.lit(False) if names is None else (F.coalesce(name, F.lit("")) != "") & names
    return F.coalesce(by_type, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def _marked(nodes: DataFrame, stops: DataFrame | None) -> DataFrame:
    if stops is None:
        return nodes.withColumn("stopped", F.lit(False))
    ends = stops.select(_name("node").alias("node"), F.lit(True).alias("stopped")).distinct()
    return nodes.join(ends, "node", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))


TRACE = ["seed", "node", "hop", "place", "parent", "parent_place", "stopped"]


def trace(
    seeds: DataFrame,
    edges: DataFrame,
    hops: int,
    cap: int | None = None,
    stops: DataFrame | None = None,
    direction: str = "all",
) -> DataFrame:
    """Nodes around each of ``seeds`` (column ``seed``), level by level: ``seed, node, hop, place, parent,
    parent_place, stopped``.

    A level goes through the nodes of the last one in order, and through the transfers of each in
    order; nodes not seen before make up the next level, ``cap`` of them at most. ``place`` is the order
    in a level (null without a cap: then it decides nothing), ``parent`` the node it was first seen
    from. Nodes of ``stops`` (column ``node``) are reached but not gone beyond; a seed that is one of them
    stays alone. Null and empty seeds are dropped, repeated ones count once.
    """
    steps = cut_lineage(neighbours(edges, direction))
    start = seeds.select(_name("seed").alias("seed")).filter("seed <> ''").distinct()
    start = start.select(
        "seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(1).alias("place"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("parent_place"),
    )
    levels = [cut_lineage(_marked(start, stops).select(*TRACE))]
    for hop in range(1, hops + 1):
        seen = reduce(DataFrame.unionByName, levels)
        going = levels[-1].filter("NOT stopped").select("seed", "node", "place")
        came = F.min(F.struct(F.col("place").alias("parent_place"), "seq", F.col("node").alias("parent")))
        new = (
            going.join(steps, "node")
            .groupBy("seed", F.col("other").alias("node"))
            .agg(came.alias("came"))
            .join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        )
        if cap is None:
            new = new.withColumn("place", F.lit(None).cast("int"))
        else:
            # Only the first of a seed are kept, so each task sorts and sends no more than the cap.
            order = Window.partitionBy("seed").orderBy("came.parent_place", "came.seq", "node")
            new = new.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
        new = new.select("seed", "node", F.lit(hop).alias("hop"), "place", "came.parent", "came.parent_place")
        level = cut_lineage(_marked(new, stops).select(*TRACE))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def hop_counts(traced: DataFrame, cap: int | None = None) -> DataFrame:
    """Per seed and hop of a trace: ``found`` nodes, ``stopped`` ones among them, and ``fetched``, the
    nodes of the last level that were looked at before the cap was reached."""
    levels = traced.filter("hop > 0").groupBy("seed", "hop").agg(
        F.count(F.lit(1)).alias("found"), F.count_if("stopped").alias("stopped"), F.max("parent_place").alias("last")
    )
    full = F.col("found") >= cap if cap is not None else F.lit(False)
    levels = levels.withColumn("last", F.when(full, F.col("last")))
    going = traced.filter("NOT stopped").select("seed", (F.col("hop") + 1).alias("hop"), "place")
    looked = F.col("last").isNull() | (F.col("place") <= F.col("last"))
    return (
        going.join(levels, ["seed", "hop"])
        .groupBy("seed", "hop", "found", "stopped")
        .agg(F.count_if(looked).alias("fetched"))
    )


ENDS = ("source", "target")


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """A shortest way along transfers for each of ``pairs`` (``pair, source, target``; ``pair`` unique).

    ``pair, source, target, length, path``: ``path`` lists the steps as ``(source, target, seq)`` with the first
    transfer of each step. Without a way of ``max_hops`` or fewer steps ``length`` is null and the
    path empty; from a node to itself it is 0. Of several shortest ways one is given.

    The search starts at both ends, once for each node that is an end, however many pairs share it.
    Levels are laid on the pairs from the end that has fewer rows a start, and the end goes on whose
    next level makes fewer rows, those laid included. A start whose pairs have all met leaves the
    search. The last step is laid on the pairs and not saved. Each node of a level keeps the number of
    one step that led to it, so the way is found by going back from where the ends met.
    """
    named = cut_lineage(pairs.select("pair", *[_name(end).alias(end) for end in ENDS]))
    steps = cut_lineage(neighbours(edges, "outgoing").withColumn("step", F.monotonically_increasing_id()))
    turned = steps.select(F.col("other").alias("node"), F.col("node").alias("other"), "step")
    moves = {"source": _with_width(steps), "target": _with_width(turned)}
    other_end = {"source": "target", "target": "source"}
    unmet = named.filter("source <> target AND source <> '' AND target <> ''")
    levels, size, width = {}, {}, {}

    def add(end: str, level: DataFrame) -> None:
        """A further level of an end, with its rows and the steps that lead on from them."""
        level = cut_lineage(level)
        levels.setdefault(end, []).append(level)
        size[end], width[end] = level.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()

    for end in ENDS:
        begun = unmet.select(F.col(end).alias("start"), F.col(end).alias("node")).distinct()
        begun = begun.join(_widths(moves[end]), "node", "left").withColumn("step", F.lit(None).cast("bigint"))
        add(end, begun.select("start", "node", F.coalesce("width", F.lit(0)).alias("width"), "step"))
    starts, many = dict(size), unmet.count()

    def lighter(rows: dict[str, int]) -> str:
        return min(ENDS, key=lambda end: rows[end] / starts[end])

    def next_rows(end: str) -> float:
        """Rows to be made and laid if an end goes on."""
        after = size | {end: width[end]}
        light = lighter(after)
        return width[end] + many * after[light] / starts[light]

    def laid(end: str) -> DataFrame:
        """The last level of an end, for each unmet pair."""
        return unmet.join(levels[end][-1].withColumnRenamed("start", end), end).select("pair", *ENDS, "node", "step")

    # Pairs that met, with the depth of either end there and the steps that led to the node.
    met: list[tuple[dict[str, int], DataFrame]] = []
    for hop in range(1, max_hops + 1):
        if not min(size.values()):
            break
        depth = {end: len(levels[end]) - 1 for end in ENDS}
        last = hop == max_hops
        side = lighter(size) if last else min(ENDS, key=next_rows)
        if last:
            rows = laid(side).drop("step").join(moves[side], "node").select("pair", *ENDS, F.col("other").alias("node"), "step")
            light = side
        else:
            going = levels[side][-1].join(unmet.select(F.col(side).alias("start")).distinct(), "start", "left_semi")
            reached = going.select("start", "node").join(moves[side], "node")
            reached = reached.select("start", F.col("other").alias("node"), "width", "step", F.lit(True).alias("new"))
            known = reduce(DataFrame.unionByName, levels[side]).withColumn("new", F.lit(False))
            level = reached.unionByName(known).groupBy("start", "node").agg(
                F.max("width").alias("width"), F.min("step").alias("step"), F.bool_and("new").alias("new")
            )
            add(side, level.filter("new").drop("new"))
            light = lighter(size)
            rows = laid(light)
        # The first meeting lies on the last levels of both ends, or it had been found before.
        far = other_end[light]
        reach = levels[far][-1].select(F.col("start").alias(far), "node", F.col("step").alias(f"{far}_step"))
        both = rows.withColumnRenamed("step", f"{light}_step").join(reach, [far, "node"])
        at = F.min(F.struct("node", *[f"{end}_step" for end in ENDS])).alias("at")
        found = cut_lineage(both.groupBy("pair", *ENDS).agg(at).select("pair", *ENDS, "at.*"))
        depth[side] += 1
        met.append((depth, found))
        if not last and not found.isEmpty():
            unmet = cut_lineage(unmet.join(found.select("pair"), "pair", "left_anti"))
    told = [named.filter("source = target AND source <> ''").select("pair", F.lit(0).alias("length"))]
    told += [rows.select("pair", F.lit(sum(depth.values())).alias("length")) for depth, rows in met]
    found_steps = [step for end in ENDS for step in _walked_back(met, levels[end], steps, end)]
    none = F.array().cast(f"array<struct<step:int,source:string,target:string,seq:{steps.schema['seq'].dataType.simpleString()}>>")
    told = reduce(DataFrame.unionByName, told)
    if found_steps:
        # At most max_hops rows for each pair.
        ways = reduce(DataFrame.unionByName, found_steps).groupBy("pair").agg(F.array_sort(F.collect_list("step")).alias("path"))
        told = told.join(ways, "pair", "left")
    else:
        told = told.withColumn("path", none)
    path = F.transform(F.coalesce("path", none), lambda s: s.dropFields("step"))
    return named.join(told, "pair", "left").select("pair", "source", "target", "length", path.alias("path"))


def _widths(steps: DataFrame) -> DataFrame:
    return steps.groupBy("node").agg(F.count(F.lit(1)).alias("width"))


def _with_width(steps: DataFrame) -> DataFrame:
    """Steps with ``width``, the number of those that lead on from ``other``."""
    ahead = _widths(steps).withColumnRenamed("node", "other")
    return cut_lineage(steps.join(ahead, "other", "left").select("node", "other", "step", F.coalesce("width", F.lit(0)).alias("width")))


def _walked_back(met: list[tuple[dict[str, int], DataFrame]], levels: list[DataFrame], steps: DataFrame, end: str) -> list[DataFrame]:
    """``(pair, step)``: the steps between an end and the nodes where its pairs met, one row a pair at a time."""
    numbered = steps.select("step", F.col("node").alias("source"), F.col("other").alias("target"), "seq")
    found: list[DataFrame] = []
    carried: list[DataFrame] = []
    for depth in range(max((d[end] for d, _ in met), default=0), 0, -1):
        at = carried + [
            rows.select("pair", F.col(end).alias("start"), F.lit(sum(d.values())).alias("length"), F.col(f"{end}_step").alias("step"))
            for d, rows in met if d[end] == depth
        ]
        here = cut_lineage(reduce(DataFrame.unionByName, at).join(numbered, "step"))
        place = F.lit(depth) if end == "source" else F.col("length") - depth + 1
        found.append(here.select("pair", F.struct(place.alias("step"), *ENDS, "seq").alias("step")))
        # The step begins, seen from its end, at a node of the level before.
        before = levels[depth - 1].select("start", F.col("node").alias(end), "step")
        carried = [here.drop("step").join(before, ["start", end]).select("pair", "start", "length", "step")]
    return found


def distances(targets: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """``(node, away)``: steps from each node to the nearest of ``targets`` (column ``node``), ``most`` at most;
    ``steps`` is ``(node, other)``."""
    levels = [cut_lineage(targets.select(_name("node").alias("node")).distinct().withColumn("away", F.lit(0)))]
    back = steps.select(F.col("other").alias("at"), "node")
    for away in range(1, most + 1):
        seen = reduce(DataFrame.unionByName, levels).select("node")
        level = levels[-1].select(F.col("node").alias("at")).join(back, "at").select("node").distinct()
        level = cut_lineage(level.join(seen, "node", "left_anti").withColumn("away", F.lit(away)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def typed_paths(
    sources: DataFrame,
    edges: DataFrame,
    targets: DataFrame,
    max_hops: int = 4,
    limit: int = 10,
    direction: str = "outgoing",
) -> DataFrame:
    """Ways from each of ``sources`` (column ``source``) to nodes of a wanted type (``targets``, column
    ``node``): ``source, place, length, target, path``.

    A path never visits a node twice and ends at the first target on it. ``limit`` of each source are
    given, short ones first, of equal lengths in the order of their nodes. A path goes on only while
    a target lies within the steps that are left, and a source that has its paths leaves the search.
    """
    steps = cut_lineage(neighbours(edges, direction).select("node", "other"))
    near = cut_lineage(distances(targets, steps, max_hops - 1).withColumnRenamed("node", "other"))
    begun = sources.select(_name("source").alias("source")).filter("source <> ''").distinct()
    open_paths = cut_lineage(begun.select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    order = Window.partitionBy("source").orderBy("path")
    done: list[DataFrame] = []
    for hop in range(1, max_hops + 1):
        going = open_paths
        if done:
            full = reduce(DataFrame.unionByName, done).groupBy("source").count().filter(F.col("count") >= limit)
            going = going.join(full.select("source"), "source", "left_anti")
        longer = (
            going.join(steps, "node")
            .filter(~F.array_contains("path", F.col("other")))
            .join(near.filter(F.col("away") <= max_hops - hop), "other")
            .select("source", F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"), "away")
        )
        longer = cut_lineage(longer)
        ended = longer.filter("away = 0").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
        done.append(ended.select("source", F.lit(hop).alias("length"), F.col("node").alias("target"), "path"))
        open_paths = longer.filter("away > 0").drop("away")
    best = Window.partitionBy("source").orderBy("length", "path")
    rows = reduce(DataFrame.unionByName, done).withColumn("place", F.row_number().over(best))
    return rows.filter(F.col("place") <= limit).select("source", "place", "length", "target", "path")


def between(edges: DataFrame, pairs: DataFrame, exclude_spam: bool = True) -> DataFrame:
    """All transfers from ``source`` to ``target`` of each of ``pairs``; those marked ``is_spam`` only on demand."""
    rows = edges.withColumns({"source": _name("source"), "target": _name("target")})
    if exclude_spam and "is_spam" in edges.columns:
        rows = rows.filter(~F.coalesce("is_spam", F.lit(False)))
    wanted = pairs.select(_name("source").alias("source"), _name("target").alias("target")).distinct()
    return rows.join(wanted, ["source", "target"], "left_semi")


def enriched_edges(transfers: DataFrame, preferred: tuple[str, ...] = (), weight: str = "1.01") -> DataFrame:
    """One row for each ``source, target``: the largest transfer of the edge's main token, kept whole.

    ``source, target``, the fields of that transfer (``seq, value`` and all further columns),
    ``token_symbol, total_value, tx_count`` and ``secondary_tokens``, an array of ``(token_symbol, total_value,
    tx_count)`` in the order in which the tokens first occur. The main token has the largest total,
    where totals of ``preferred`` tokens count ``weight`` times; of equal totals the token that occurs
    first counts, of equal transfers the first. A null or empty token is ``native``, a null value 0.
    The rows of an edge are given by ``between``; no edge gathers them.
    """
    rest = [c for c in transfers.columns if c not in ("source", "target", "token_symbol", "value")]
    token = F.coalesce(F.nullif(F.col("token_symbol"), F.lit("")), F.lit("native"))
    rows = transfers.withColumns(
        {"token_symbol": token, "value": F.coalesce(F.col("value").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))}
    )
    whole = F.struct("value", *rest)
    tokens = rows.groupBy("source", "target", "token_symbol").agg(
        F.sum("value").cast("decimal(28,2)").alias("total_value"),
        F.count(F.lit(1)).alias("tx_count"),
        F.min("seq").alias("first"),
        F.max_by(whole, F.struct("value", -F.col("seq"))).alias("largest"),
    )
    weighed = F.col("total_value") * F.when(F.col("token_symbol").isin(*preferred), F.lit(weight).cast("decimal(6,4)")).otherwise(F.lit(1).cast("decimal(6,4)"))
    rank = F.struct((-weighed).alias("w"), "first", "token_symbol")
    # At most one entry for each token of an edge.
    entry = F.struct(rank.alias("rank"), "first", "token_symbol", "total_value", "tx_count", "largest")
    edges = tokens.groupBy("source", "target").agg(F.array_sort(F.collect_list(entry)).alias("all"), F.sum("tx_count").alias("tx_count"))
    main = F.element_at("all", 1)
    others = F.array_sort(F.transform(F.slice("all", 2, F.size("all")), lambda e: F.struct(e["first"].alias("first"), e["token_symbol"].alias("token_symbol"), e["total_value"].alias("total_value"), e["tx_count"].alias("tx_count"))))
    return edges.select(
        "source", "target", *[main["largest"][c].alias(c) for c in ("value", *rest)],
        main["token_symbol"].alias("token_symbol"), main["total_value"].alias("total_value"), "tx_count",
        F.transform(others, lambda e: e.dropFields("first")).alias("secondary_tokens"),
    )
