"""Responses of language models to statements: reading, comparing, pricing and laying over parsed rows.

Responses are text; calls to the services are outside of this library. An attempt is one response:
``extraction_id, provider, model, slot, seq, raw, parsed, parse_error, provider_error, prompt_tokens,
completion_tokens, latency_ms, created_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# US dollars for a million tokens, input and output, in the order in which they are looked up.
PRICES = (
    ("claude-sonnet-4-5", "3.00", "15.00"),
    ("claude-sonnet-4-6", "3.00", "15.00"),
    ("claude-opus-4-5", "15.00", "75.00"),
    ("claude-opus-4-7", "15.00", "75.00"),
    ("claude-haiku-4-5", "1.00", "5.00"),
    ("gemini-2.5-flash", "0.30", "2.50"),
    ("gemini-2.5-pro", "1.25", "10.00"),
    ("gemini-2.0-flash", "0.10", "0.40"),
)
# Slots whose response counts first.
PREFERENCE = ("claude", "gemini-2.5-pro", "gemini-2.5-flash", "gemini")

_FENCE = "(?s)```(?:json)?\\s*(.*?)```"
_OBJECT = "(?s)\\{.*\\}"
_BLANK = " \t\n\r\x0b\x0c"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _filled(text: Column) -> Column:
    """Stripped text, null where nothing is left."""
    return F.nullif(_strip(text), F.lit(""))


def _one_value(text: Column) -> Column:
    """The one JSON value that ``text`` is. The parser stops after a value, so what follows it has to be ruled
    out: nothing but a single value fits into both an array and an object. The array of one element holds the
    text, and then what was read, so that each is told once."""

    def only(listed: Column, whole: Column) -> Column:
        single = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
        named = F.try_parse_json(F.concat(F.lit('{"v":'), whole, F.lit("}")))
        return F.when(single & named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))

    both = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).alias("v")))
    return F.get(F.transform(both, lambda b: only(b["v"], b["t"])), F.lit(0))


def parsed_json(raw: Column) -> Column:
    """The JSON of a response as VARIANT: what a code fence holds, else the whole text, else what lies
    between the first and the last brace. Null where none of them is JSON."""
    fenced = raw.rlike(_FENCE)
    candidate = _strip(F.when(fenced, F.regexp_extract(raw, _FENCE, 1)).otherwise(raw))
    braced = F.nullif(F.regexp_extract(raw, _OBJECT, 0), F.lit(""))
    return F.coalesce(_one_value(candidate), _one_value(braced))


def parse_problem(raw: Column, parsed: Column) -> Column:
    """Why a response was not read; null where it was."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty response")
        .when(parsed.isNotNull(), None)
        .when(raw.rlike(_OBJECT), "invalid JSON")
        .otherwise("no JSON object found in response")
    )


def read_responses(attempts: DataFrame) -> DataFrame:
    """Add ``parsed`` (VARIANT) and ``parse_error`` to attempts with ``raw``; attempts of a failed call have
    neither."""
    called = F.when(F.col("provider_error").isNull(), F.col("raw"))
    # Rows of one element keep later filters above: pushed below, they would make and read every response anew.
    rest = [c for c in attempts.columns if c not in ("raw", "parsed", "parse_error")]
    texts = attempts.select(*rest, F.inline(F.array(F.struct("raw"))))
    read = texts.select(*rest, "raw", F.inline(F.array(F.struct(parsed_json(called).alias("parsed")))))
    kept = [c for c in attempts.columns if c not in ("parsed", "parse_error")]
    return read.select(*kept, "parsed").withColumn(
        "parse_error", F.when(F.col("provider_error").isNull(), parse_problem(F.col("raw"), F.col("parsed")))
    )


def _at(path: str, kind: str = "string", of: str = "parsed") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def _entries(path: str = "transactions") -> Column:
    return F.coalesce(_at(path, "array<variant>"), F.array().cast("array<variant>"))


TRANSACTION = (
    ("date", "string"), ("amount", MONEY), ("direction", "string"), ("description", "string"), ("counterparty", "string"),
    ("channel", "string"), ("category", "string"), ("entity_type", "string"), ("is_self_transfer", "boolean"), ("notable_reason", "string"),
)


def response_rows(read: DataFrame, *keep: str) -> DataFrame:
    """The transactions of read responses, one row each: ``keep``, ``pos`` from 1, and their fields as typed
    columns; a field of another type is null."""
    each = read.select(*keep, F.posexplode(_entries()).alias("_p", "entry"))
    return each.select(
        *keep, (F.col("_p") + 1).alias("pos"), *[_at(name, kind, "entry").alias(name) for name, kind in TRANSACTION]
    )


def normalised(read: DataFrame, *keep: str) -> DataFrame:
    """The envelope of each read response: bank, account, period, balance, summary of its transactions and
    analysis. Missing parts are null, or empty lists; the bank's key is ``unknown``, its label ``Unknown``, the
    currency ``INR`` unless told. Sums count debits and credits by their direction, in any case."""
    way = lambda t: F.lower(F.coalesce(F.try_variant_get(t, "$.direction", "string"), F.lit("")))
    amount = lambda t: F.coalesce(F.try_variant_get(t, "$.amount", MONEY), F.lit(0).cast(MONEY))
    total = lambda side: F.aggregate(
        F.filter("_entries", lambda t: way(t) == side), F.lit(0).cast("decimal(28,2)"), lambda s, t: (s + amount(t)).cast("decimal(28,2)")
    )
    or_else = lambda path, default: F.coalesce(F.nullif(_at(path), F.lit("")), F.lit(default))
    names = F.coalesce(_at("account.joint_holders", "array<string>"), F.array().cast("array<string>"))
    rows = read.filter("parsed IS NOT NULL").withColumn("_entries", _entries()).select(
        *keep,
        or_else("bank.key", "unknown").alias("bank_key"),
        or_else("bank.label", "Unknown").alias("bank_label"),
        _at("bank.account_type").alias("account_type"),
        *[_at(f"account.{f}").alias(f) for f in ("number_masked", "holder_name", "customer_id", "pan_hint", "phone_hint", "email_hint", "branch")],
        names.alias("joint_holders"),
        _at("period.start").alias("period_start"),
        _at("period.end").alias("period_end"),
        _at("balance.opening", MONEY).alias("opening"),
        _at("balance.closing", MONEY).alias("closing"),
        or_else("balance.currency", "INR").alias("currency"),
        F.size("_entries").alias("transaction_count"),
        total("debit").alias("total_debit"),
        total("credit").alias("total_credit"),
        _at("narrative_summary").alias("narrative_summary"),
        _at("risk_level").alias("risk_level"),
        F.size(_entries("anomalies")).alias("anomaly_count"),
        _at("statement_integrity", "variant").alias("statement_integrity"),
        _at("confidence").alias("confidence"),
    )
    return rows.withColumn("net_change", (F.col("total_credit") - F.col("total_debit")).cast("decimal(28,2)"))


def cost_usd(model: Column, prompt: Column, completion: Column, prices: tuple = PRICES) -> Column:
    """Price of one call, to six digits: by the model's own name, else by the first listed name that it begins
    with, in any case. Null for unknown models and where both counts are missing. Sums are exact
    decimals, rounded half up."""
    per = [(name, F.lit(i).cast("decimal(10,4)"), F.lit(o).cast("decimal(10,4)")) for name, i, o in prices]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,0)")
    value = lambda i, o: (count(prompt) * i + count(completion) * o) / F.lit(1_000_000)
    found = F.coalesce(
        *[F.when(model == name, value(i, o)) for name, i, o in per],
        *[F.when(F.startswith(F.lower(model), F.lit(name.lower())), value(i, o)) for name, i, o in per],
    )
    known = (F.coalesce(model, F.lit("")) != "") & (prompt.isNotNull() | completion.isNotNull())
    return F.when(known, F.round(found, 6).cast("decimal(18,6)"))


def _failed() -> Column:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return some("provider_error") | some("parse_error")


def priced(attempts: DataFrame, prices: tuple = PRICES) -> DataFrame:
    return attempts.withColumn("cost_usd", cost_usd(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), prices))


def cost_summary(attempts: DataFrame, since: str | None = None, until: str | None = None, prices: tuple = PRICES) -> DataFrame:
    """Calls, tokens, latency and cost of all attempts (``level`` total), by provider and by model, in one pass;
    attempts at or after ``since`` and before ``until``. Attempts without a name are ``unknown``; a call without a
    price costs nothing."""
    rows = priced(attempts, prices)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("created_at") < until)
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = rows.select(
        name("provider").alias("provider"), name("model").alias("model"), _failed().alias("failed"), "prompt_tokens", "completion_tokens", "latency_ms", "cost_usd"
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.groupingSets([["provider"], ["model"], []], "provider", "model").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("errors"),
        total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), total("latency_ms").alias("total_latency_ms"),
        total("cost_usd").cast("decimal(28,6)").alias("cost_usd"),
    )
    level = F.when(F.col("_g") == 1, "provider").when(F.col("_g") == 2, "model").otherwise("total")
    return sums.select(
        level.alias("level"), F.coalesce("provider", "model").alias("key"), "calls", "successes", "errors", "prompt_tokens", "completion_tokens",
        "total_latency_ms", "cost_usd", F.round(F.col("total_latency_ms") / F.col("calls"), 1).alias("avg_latency_ms"),
        F.round(F.col("cost_usd") / F.col("calls"), 6).cast("decimal(18,6)").alias("avg_cost_usd"),
    )


def attempts_of(attempts: DataFrame, prices: tuple = PRICES) -> DataFrame:
    """All attempts with their cost and place among those of an extraction, oldest first, and its total cost.
    An extraction has as many attempts as there are providers."""
    mine = Window.partitionBy("extraction_id")
    rows = priced(attempts, prices)
    return rows.withColumns(
        {
            "place": F.row_number().over(mine.orderBy("created_at", "seq")),
            "total_cost_usd": F.coalesce(F.sum("cost_usd").over(mine), F.lit(0)).cast("decimal(18,6)"),
        }
    )


HEAVY = ("prompt_text", "raw", "parsed")


def attempt_list(
    attempts: DataFrame, provider: str | None = None, bank: str | None = None, has_error: bool | None = None
) -> DataFrame:
    """Attempts without their heavy columns, by provider, bank key and whether a call or its reading failed."""
    rows = attempts
    if provider:
        rows = rows.filter(F.col("provider") == provider)
    if bank:
        rows = rows.filter(F.col("bank_key") == bank)
    if has_error is not None:
        wrong = F.col("provider_error").isNotNull() | F.col("parse_error").isNotNull()
        rows = rows.filter(wrong if has_error else ~wrong)
    return rows.drop(*HEAVY)


def slot_matches(slot: Column, wanted: list[str]) -> Column:
    """Whether a slot (``provider`` or ``provider:model``), or its part after the colon, begins with a wanted name."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    low = F.lower(slot)
    tail = F.when(F.contains(low, F.lit(":")), F.regexp_extract(low, "^[^:]*:(.*)$", 1))
    hit = F.lit(False)
    for n in names:
        hit = hit | F.startswith(low, F.lit(n)) | F.coalesce(F.startswith(tail, F.lit(n)), F.lit(False))
    return hit


def primary_slots(responses: DataFrame, preference: tuple[str, ...] = PREFERENCE, *keep: str) -> DataFrame:
    """``(extraction_id, slot)``: the response that counts, of those with ``slot`` and ``seq``: the first preference
    that a slot fits (equal, beginning with it, or equal after the colon), of several slots the first. ``keep``
    names columns of that response to go along, so that it need not be looked up and read again."""
    slot = F.col("slot")
    dashed = F.translate(slot, ":", "-")
    after = F.regexp_extract(slot, "^[^:]*:(.*)$", 1)
    rank = F.coalesce(
        *[
            F.when(F.startswith(slot, F.lit(p)) | F.startswith(dashed, F.lit(p.replace(":", "-"))) | (after == p), F.lit(k))
            for k, p in enumerate(preference)
        ]
    )
    fitting = responses.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = fitting.groupBy("extraction_id").agg(F.min_by(F.struct("slot", *keep), F.struct("_rank", "seq")).alias("_best"))
    return best.select("extraction_id", "_best.*")


TEXTS = ("channel", "category", "entity_type", "notable_reason")


def overlay(parsed_rows: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Rows of the parser with what a model said about them.

    ``parsed_rows`` is ``(extraction_id, row_index, date, amount, direction, counterparty, ...)``, ``model_rows`` what
    ``response_rows`` gives for one response of each extraction. With equally many rows they fit by
    place; else a row takes the model's first row of the same date, amount (two digits) and direction
    (in any case). A model's counterparty counts unless blank or unknown, its other texts unless blank,
    its ``is_self_transfer`` unless missing. ``overlaid`` and ``count_match`` tell what was done; rows that
    nothing fits, and extractions without a model's rows, stay as they are. The rows of an extraction pass
    through one task, as sorted streams that spill.
    """
    key = [
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("_date"),
        F.round(F.coalesce(F.col("amount").cast("decimal(28,8)"), F.lit(0)), 2).cast(MONEY).alias("_amount"),
        F.lower(F.coalesce("direction", F.lit(""))).alias("_way"),
    ]
    said = [c for c in ("counterparty", *TEXTS, "is_self_transfer") if c in model_rows.columns]
    ours = parsed_rows.select("extraction_id", F.col("row_index").cast("int").alias("_place"), *key, F.struct(*parsed_rows.columns).alias("_row"))
    theirs = model_rows.filter("extraction_id IS NOT NULL").select("extraction_id", F.col("pos").cast("int").alias("_place"), *key, F.struct(*said).alias("_said"))
    # Both kinds of rows in one stream: each is made once, and neither is sent whole anywhere.
    every = ours.unionByName(theirs, allowMissingColumns=True)
    mine = Window.partitionBy("extraction_id")
    counted = every.withColumns({"_d": F.count("_row").over(mine), "_m": F.count("_said").over(mine)})
    placed = F.col("_d") == F.col("_m")
    keyed = counted.withColumns(
        {"_at": F.when(placed, F.col("_place")), **{c: F.when(~placed, F.col(c)) for c in ("_date", "_amount", "_way")}}
    )
    # The model's rows of a place or key come first.
    same = Window.partitionBy("extraction_id", "_at", "_date", "_amount", "_way").orderBy(F.isnotnull("_row"), "_place")
    first = F.first("_said").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fitted = keyed.withColumn("_said", first).filter("_row IS NOT NULL")
    both = fitted.select("_row.*", "_said", F.when(F.col("_m") > 0, placed).alias("count_match"))
    party = F.when(~F.lower("_said.counterparty").isin("unknown", "(unknown)"), _filled(F.col("_said.counterparty")))
    new = {"counterparty": F.coalesce(party, "counterparty")} if "counterparty" in said else {}
    old = lambda c: F.col(c) if c in parsed_rows.columns else F.lit(None)
    new |= {c: F.coalesce(_filled(F.col(f"_said.{c}")), old(c)) for c in TEXTS if c in said}
    if "is_self_transfer" in said:
        new["is_self_transfer"] = F.coalesce(F.col("_said.is_self_transfer"), old("is_self_transfer"))
    kept = [new.pop(c).alias(c) if c in new else F.col(c) for c in parsed_rows.columns]
    return both.select(*kept, *[v.alias(c) for c, v in new.items()], F.col("_said").isNotNull().alias("overlaid"), "count_match")


HEADER = ("customer_id", "pan_hint", "phone_hint", "email_hint", "branch")


def overlay_headers(parsed_headers: DataFrame, model_headers: DataFrame) -> DataFrame:
    """Headers of the parser (``extraction_id, holder_name, opening, closing`` and more) with a model's where the
    parser has none; texts are taken if not blank."""
    said = model_headers.select("extraction_id", *[F.col(c).alias("_" + c) for c in ("holder_name", *HEADER, "opening", "closing")])
    both = parsed_headers.join(said, "extraction_id", "left")
    old = lambda c: F.col(c) if c in parsed_headers.columns else F.lit(None)
    new = {"holder_name": F.coalesce(F.nullif(old("holder_name"), F.lit("")), _filled(F.col("_holder_name")))}
    new |= {c: F.coalesce(F.nullif(old(c), F.lit("")), F.nullif(F.col("_" + c), F.lit(""))) for c in HEADER}
    new |= {c: F.coalesce(old(c), F.col("_" + c)) for c in ("opening", "closing")}
    kept = [new.pop(c).alias(c) if c in new else F.col(c) for c in parsed_headers.columns]
    return both.select(*kept, *[v.alias(c) for c, v in new.items()])


def final_choice(extractions: DataFrame, primary: DataFrame) -> DataFrame:
    """Which rows an extraction (``extraction_id, parsed_rows``) ends with: the parser's if it found any, overlaid by
    the primary response; else that response's; else none of the parser. ``choice`` and ``source``."""
    both = extractions.join(primary, "extraction_id", "left")
    found, slot = F.coalesce("parsed_rows", F.lit(0)) > 0, F.col("slot")
    return both.select(
        "extraction_id",
        F.when(found | slot.isNull(), "deterministic").otherwise("model").alias("choice"),
        F.when(slot.isNull(), "deterministic").when(found, F.concat(F.lit("deterministic+"), slot)).otherwise(F.concat(F.lit("llm-"), slot)).alias("source"),
    )


def agreement(read: DataFrame) -> DataFrame:
    """How the providers of each extraction agree: ``extraction_id, field, values, distinct_count, unanimous``.

    ``values`` lists what was reported, first seen first, and the ``provider:model`` that did; a field is unanimous if
    there is one value from more than one provider. Failed attempts and missing values don't
    count; amounts compare to two digits, lists by their length, self-transfers by their number.
    """
    lists = F.size(_at("anomalies", "array<variant>"))
    rows = F.coalesce("_listed", F.array().cast("array<variant>"))
    marked = F.size(F.filter(rows, lambda t: F.coalesce(F.try_variant_get(t, "$.is_self_transfer", "boolean"), F.lit(False))))
    fields = {
        "txn_count": F.size("_listed"),
        "bank_key": _at("bank.key"),
        "holder_name": _at("account.holder_name"),
        "confidence": _at("confidence"),
        "account_type": _at("bank.account_type"),
        "opening_balance": _at("balance.opening", MONEY),
        "closing_balance": _at("balance.closing", MONEY),
        "period_start": _at("period.start"),
        "period_end": _at("period.end"),
        "risk_level": _at("risk_level"),
        "anomaly_count": F.when(lists >= 0, lists),
        "self_transfer_rows": F.when(F.size(rows) > 0, marked),
    }
    fields["txn_count"] = F.when(fields["txn_count"] >= 0, fields["txn_count"])
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])
    who = F.struct("created_at", "seq", F.concat_ws(":", "provider", "model").alias("reporter"))
    heard = read.filter(~_failed() & F.col("parsed").isNotNull()).withColumn("_listed", _at("transactions", "array<variant>"))
    said = heard.select("extraction_id", who.alias("who"), F.inline(pairs)).filter("value IS NOT NULL")
    # As many entries as an extraction has attempts.
    values = said.groupBy("extraction_id", "field", "value").agg(F.array_sort(F.collect_list("who")).alias("who"))
    entry = F.struct(F.element_at("who", 1).alias("first"), "value", F.transform("who", lambda w: w["reporter"]).alias("reporters"))
    found = values.groupBy("extraction_id", "field").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    return found.select(
        "extraction_id", "field", F.transform("v", lambda e: e.dropFields("first")).alias("values"), F.size("v").alias("distinct_count"),
        ((F.size("v") == 1) & (F.size(F.col("v")[0]["reporters"]) > 1)).alias("unanimous"),
    )


# Rules that tell of no match, and how many characters of a description are sent along.
_NO_RULE = ("unmatched", "no_decoder")
CONTEXT_CHARS = 200


def context_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Parsed rows as a model gets them: ``keep`` and ``entry``, a JSON object of ``date, amount, direction`` (else ``type``) and the
    first characters of ``description``; nulls are shown. ``decoded`` (a map of texts) is added where its
    ``matched_rule`` tells of a match, without that rule and without empty values."""
    shown = {"ignoreNullFields": "false"}
    base = [
        F.col("date"), F.col("amount"),
        F.coalesce(F.nullif("direction", F.lit("")), "type").alias("direction"),
        F.coalesce(F.substring("description", 1, CONTEXT_CHARS), F.lit("")).alias("description"),
    ]
    rule = F.col("decoded")["matched_rule"]
    told = F.map_filter("decoded", lambda k, v: (v != "") & (k != "matched_rule"))
    matched = F.coalesce(~rule.isin(*_NO_RULE), F.lit(False))
    entry = F.when(matched, F.to_json(F.struct(*base, told.alias("decoded")), shown)).otherwise(F.to_json(F.struct(*base), shown))
    return rows.select(*keep, entry.alias("entry"))


def contexts(rows: DataFrame, key: str = "statement_id", order: str = "seq") -> DataFrame:
    """``(key, row_count, context)``: the entries of each statement in order as one JSON array. One statement's rows
    go into one prompt, so they are few."""
    told = context_rows(rows, key, order).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "entry"))).alias("e"))
    return told.select(key, F.size("e").alias("row_count"), F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("]")).alias("context"))
