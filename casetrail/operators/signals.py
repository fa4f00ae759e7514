"""Risk signals of addresses in eight families, from optional tables.

A family is triggered, clear, or not tested (null) where the table it needs is not given. What the
services of an investigation would look up are tables here:

``known`` (address, name, category, source, risk_level, confidence), ``remembered`` (address, name,
risk_score), ``sanctions`` (address), ``counterparties`` (address, entity, risk_tier), ``patterns``
(address, pattern), ``velocity`` (as ``velocity.analyze`` gives it), ``exposure`` (address,
source_risk_score, destination_risk_score, risky_counterparties as a number), ``exposure_shares`` (address,
direction, category, pct), ``graphs`` (address, node_count, unique_counterparties), ``feeds`` (address,
source), ``ads`` (address, platform).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.operators.scores import temporal_anomaly

# Names of the families in order, and words that the rules look for.
FAMILIES = (
    "entity_attribution", "behavioral_pattern", "exposure_composition", "graph_topology",
    "temporal_anomaly", "external_intelligence", "p2p_behavioral", "osint_social",
)
RISKY_LEVELS = ("high", "critical")
RISKY_CATEGORIES = ("scam", "mixer", "ransomware", "phishing")
EXCHANGES = ("exchange", "high_risk_exchange")
EXCHANGE_WORDS = ("exchange", "binance", "coinbase")
RISKY_TIERS = ("severe", "high")
HIGH_RISK_EXPOSURE = ("mixer", "sanctioned", "scam", "darknet_market", "ransomware")
ENTITY_WORDS = ("known_entity", "known_exchange", "heuristic_exchange", "chainabuse", "sanctions", "arkham")
LEAST_TRANSFERS = 5  # fewer give no velocity


def _any(words: tuple[str, ...], text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def _listed(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs]))


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def _known(known: DataFrame) -> DataFrame:
    """One entity for each address: the surest one, ties by name and source."""
    whole = F.struct("name", "category", "source", "risk_level", "confidence")
    order = F.struct((-F.coalesce(F.col("confidence"), F.lit(0.0))).alias("c"), "name", "source")
    return known.groupBy("address").agg(F.min_by(whole, order).alias("_known"))


def _counterparties(rows: DataFrame) -> DataFrame:
    named = F.coalesce(~F.col("entity").isin("", "Unknown", "unknown"), F.lit(False))
    return rows.filter(named).groupBy("address").agg(
        F.count(F.lit(1)).alias("_named"),
        F.bool_or(_any(EXCHANGE_WORDS, F.lower("entity"))).alias("_exchange"),
        F.bool_or(F.coalesce(F.col("risk_tier").isin(*RISKY_TIERS), F.lit(False))).alias("_risky"),
    )


def _shares(rows: DataFrame, high_risk: tuple[str, ...]) -> DataFrame:
    """Signals of the shares, sources first: unknown ones above 60 %, risky categories above 5 %."""
    category = F.translate(F.lower(F.coalesce("category", F.lit(""))), " ", "_")
    side = F.regexp_replace("direction", "_exposure$", "")
    place = F.when(side == "source", 0).otherwise(1)
    share = F.coalesce(F.col("pct"), F.lit(0.0))
    unknown = F.when((F.col("category") == "Unknown") & (share > 60), F.struct(F.lit(0).alias("group"), place.alias("place"), F.concat(F.lit("high_unknown_"), side, F.lit("_pct")).alias("signal")))
    risky = F.when(category.isin(*high_risk) & (share > 5), F.struct(F.lit(1).alias("group"), place.alias("place"), F.concat(F.lit("exposure_"), category, F.lit("_"), side).alias("signal")))
    # Few distinct signals can occur, so the set of an address is small.
    each = rows.select("address", F.explode(F.array_compact(F.array(unknown, risky))).alias("s"))
    return each.groupBy("address").agg(F.transform(F.array_sort(F.collect_set("s")), lambda s: s["signal"]).alias("_shares"))


def families(
    addresses: DataFrame,
    known: DataFrame | None = None,
    remembered: DataFrame | None = None,
    sanctions: DataFrame | None = None,
    counterparties: DataFrame | None = None,
    patterns: DataFrame | None = None,
    velocity: DataFrame | None = None,
    exposure: DataFrame | None = None,
    exposure_shares: DataFrame | None = None,
    graphs: DataFrame | None = None,
    feeds: DataFrame | None = None,
    ads: DataFrame | None = None,
    high_risk: tuple[str, ...] = HIGH_RISK_EXPOSURE,
) -> DataFrame:
    """All families of all ``addresses``: ``address, family, triggered, signals, velocity_profile, velocity_risk_score``.

    Attribution needs one of ``known``, ``remembered`` and ``sanctions``; outside reports need ``known`` or
    ``feeds``, advertisements need ``ads``. Exposure is tested for addresses that ``exposure`` has. The graph's
    shape is judged by ``graphs`` or, for addresses that it lacks, by velocity; rhythm by velocity
    and patterns. Velocity counts from five transfers on. Social media are never tested. Repeated
    rows of a table count once, where its rule doesn't count rows; null addresses are dropped.
    """
    rows = addresses.select("address").filter("address IS NOT NULL").distinct()
    nothing = {
        "_known": "struct<name:string,category:string,source:string,risk_level:string,confidence:double>",
        "_memory": "double", "_sanctioned": "boolean", "_named": "bigint", "_exchange": "boolean", "_risky": "boolean",
        "_patterns": "array<string>", "_count": "bigint", "_rate": "double", "_profile": "string", "_score": "double",
        "_regular": "double", "_burst": "double", "_source": "double", "_destination": "double", "_risky_count": "bigint",
        "_exposed": "boolean", "_shares": "array<string>", "_nodes": "bigint", "_partners": "bigint", "_graph": "boolean",
        "_feeds": "array<string>", "_ads": "bigint",
    }
    parts: list[DataFrame] = []
    if known is not None:
        parts.append(_known(known.withColumn("confidence", F.col("confidence").cast("double"))))
    if remembered is not None:
        parts.append(remembered.groupBy("address").agg(F.max(F.col("risk_score").cast("double")).alias("_memory")))
    if sanctions is not None:
        parts.append(sanctions.select("address").distinct().withColumn("_sanctioned", F.lit(True)))
    if counterparties is not None:
        parts.append(_counterparties(counterparties))
    if patterns is not None:
        parts.append(patterns.groupBy("address").agg(F.array_sort(F.collect_set("pattern")).alias("_patterns")))
    if velocity is not None:
        parts.append(
            velocity.filter(F.col("transaction_count") >= LEAST_TRANSFERS).select(
                "address", F.col("transaction_count").cast("bigint").alias("_count"), F.col("fund_through_rate").alias("_rate"),
                F.col("velocity_profile").alias("_profile"), F.col("velocity_risk_score").alias("_score"),
                F.col("regularity_score").alias("_regular"), F.col("burst_score").alias("_burst"),
            )
        )
    if exposure is not None:
        parts.append(
            exposure.groupBy("address").agg(
                F.max(F.col("source_risk_score").cast("double")).alias("_source"), F.max(F.col("destination_risk_score").cast("double")).alias("_destination"),
                F.max(F.col("risky_counterparties").cast("bigint")).alias("_risky_count"), F.lit(True).alias("_exposed"),
            )
        )
        if exposure_shares is not None:
            parts.append(_shares(exposure_shares, high_risk))
    if graphs is not None:
        parts.append(
            graphs.groupBy("address").agg(
                F.max(F.col("node_count").cast("bigint")).alias("_nodes"), F.max(F.col("unique_counterparties").cast("bigint")).alias("_partners"), F.lit(True).alias("_graph")
            )
        )
    if feeds is not None:
        kinds = F.array_compact(F.array(*[F.when(F.contains("source", F.lit(w)), F.lit(s)) for w, s in (("goplus", "goplus_flags"), ("etherscan", "etherscan_label"), ("scraped", "scraped_intelligence"))]))
        parts.append(feeds.select("address", F.explode(kinds).alias("s")).groupBy("address").agg(F.array_sort(F.collect_set("s")).alias("_feeds")))
    if ads is not None:
        parts.append(ads.groupBy("address").agg(F.count(F.lit(1)).alias("_ads")))
    for part in parts:
        rows = rows.join(part, "address", "left")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items() if c not in rows.columns})

    source, category = F.coalesce("_known.source", F.lit("")), F.coalesce("_known.category", F.lit(""))
    risky = F.col("_known.risk_level").isin(*RISKY_LEVELS) | category.isin(*RISKY_CATEGORIES)
    exchange, heuristic = category.isin(*EXCHANGES), source == "heuristic"
    sure = F.coalesce("_known.confidence", F.lit(0.0)) >= 0.5
    plain = ~F.coalesce(F.col("_exchange"), F.lit(False)) & ~F.coalesce(F.col("_risky"), F.lit(False))
    attribution = _listed(
        (F.contains(source, F.lit("chainabuse")), "chainabuse_scraped"),
        (F.coalesce(risky, F.lit(False)) | (F.col("_known").isNull() & (F.col("_memory") >= 0.6)), "known_entity"),
        (exchange & ~heuristic, "known_exchange"), (exchange & heuristic & sure, "heuristic_exchange"),
        (F.col("_sanctioned"), "sanctions_hit"), (F.col("_exchange"), "counterparty_exchange"),
        (F.col("_risky"), "counterparty_high_risk"), ((F.col("_named") >= 2) & plain, "counterparty_attributed"),
    )
    moving = F.lower("_profile")
    behaviour = F.concat(
        F.transform(_texts("_patterns"), lambda p: F.concat(F.lit("pattern_"), p)),
        F.array_compact(F.array(F.when(F.col("_profile").isin("Relay", "Distributor"), F.concat(F.lit("velocity_profile_"), moving)))),
        _listed((F.col("_rate") >= 0.90, "high_fund_through_rate")),
    )
    exposed = F.concat(
        _listed(((F.col("_source") > 0.4) | (F.col("_destination") > 0.4), "high_risk_exposure")),
        F.array_compact(F.array(F.when(F.col("_risky_count") > 0, F.concat(F.lit("risky_counterparties_"), F.col("_risky_count"))))),
        _texts("_shares"),
    )
    shape = _listed((F.col("_nodes") > 50, "large_graph"), (F.col("_partners") > 30, "many_counterparties"))
    proxy = _listed((F.col("_count") > 100, "high_tx_volume"), (F.col("_rate") >= 0.9, "relay_topology"))
    rhythm = temporal_anomaly(F.col("_regular"), F.col("_burst"), F.array_contains("_patterns", "automated_cadence"))
    reports = F.concat(
        _listed(*[(F.contains(source, F.lit(w)), f"{w}_reports") for w in ("chainabuse", "reddit", "bitcointalk")]), _texts("_feeds")
    )
    trading = _listed((F.col("_ads") > 0, "active_p2p_trader"))
    none, always, never = F.array().cast("array<string>"), F.lit(True), F.lit(False)
    has_graph, has_velocity = F.coalesce("_graph", never), F.col("_count").isNotNull()
    told = [
        (attribution, F.lit(any(t is not None for t in (known, remembered, sanctions)))),
        (behaviour, always),
        (exposed, F.coalesce("_exposed", never)),
        (F.when(has_graph, shape).otherwise(proxy), has_graph | has_velocity),
        (rhythm, has_velocity | (F.size(_texts("_patterns")) > 0)),
        (reports, F.lit(known is not None or feeds is not None)),
        (trading, F.lit(ads is not None)),
        (none, never),
    ]
    each = [
        F.struct(F.lit(name).alias("family"), F.when(tested, F.size(signals) > 0).alias("triggered"), F.when(tested, signals).otherwise(none).alias("signals"))
        for name, (signals, tested) in zip(FAMILIES, told)
    ]
    return rows.select("address", F.inline(F.array(*each)), F.col("_profile").alias("velocity_profile"), F.col("_score").alias("velocity_risk_score"))


def contradictions(found: DataFrame) -> DataFrame:
    """``(address, message)``: where the scores of an address and its signals do not fit together.

    ``found`` is what ``families`` gives, or has its columns; a velocity of 0.5 and more without any signal of
    a known entity, and unknown destinations although ``destination_entity:`` signals name some (the first
    five by name are told). Addresses without velocity have none. The velocity is rounded half up.
    """
    signals = F.coalesce("signals", F.array().cast("array<string>"))
    named = F.transform(F.filter(signals, lambda s: s.startswith("destination_entity:")), lambda s: F.substring(s, 20, 10_000))
    per = found.select(
        "address",
        "velocity_risk_score",
        F.exists(signals, lambda s: _any(ENTITY_WORDS, s)).alias("entity"),
        F.exists(signals, lambda s: s.contains("high_unknown_destination_pct")).alias("unknown"),
        # Of a family only the first five can be told.
        F.slice(F.array_sort(F.array_distinct(named)), 1, 5).alias("named"),
    )
    # At most eight families with five names each.
    rows = per.groupBy("address").agg(
        F.max("velocity_risk_score").alias("score"), F.bool_or("entity").alias("entity"), F.bool_or("unknown").alias("unknown"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("named")))), 1, 5).alias("named"),
    )
    score = F.col("score").cast("decimal(6,3)").cast("decimal(6,2)").cast("string")
    first = F.when(
        (F.col("score") >= 0.5) & ~F.col("entity"),
        F.concat(F.lit("Velocity risk ("), score, F.lit(") is elevated but no known-entity match — behavioral signals outweigh attribution factors")),
    )
    second = F.when(
        F.col("score").isNotNull() & F.col("unknown") & (F.size("named") > 0),
        F.concat(
            F.lit("Exposure shows 100% unknown destinations (direct counterparties), but forward trace found identified entities at deeper hops: "),
            F.array_join("named", ", "), F.lit(" — funds ultimately reach known exchanges"),
        ),
    )
    return rows.select("address", F.explode(F.array_compact(F.array(first, second))).alias("message"))
