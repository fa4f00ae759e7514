"""Channel, category and counterparty of a narration, and the flags derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.functions.dates import iso_date
from casetrail.functions.logic import first_match
from casetrail.functions.text import (
    blank_to_null, contains_any, count_chars, extract, null_if_empty, strip,
)

# Channel tokens, category keywords and narration noise words.
CHANNEL_TOKENS = (
    "UPI", "NEFT", "IMPS", "RTGS", "POS", "ATM", "ECS", "NACH", "CHEQUE", "CHQ", "CASH",
)
CATEGORY_KEYWORDS = (
    ("Salary", ("SALARY", "SAL CREDIT", "SAL-")),
    ("Rewards", ("CASHBACK", "REWARD", "REFERRAL")),
    ("Finance", ("CRED", "CREDIT CARD", "LOAN", "EMI", "INTEREST")),
    ("Shopping", ("AMAZON", "FLIPKART", "SWIGGY", "ZOMATO", "MYNTRA", "MEESHO")),
    ("Food", ("RESTAURANT", "HOTEL", "ZEPTO", "BLINKIT", "CAFE")),
    ("Rent", ("RENT", "LANDLORD")),
    ("Transfer", ("UPI", "NEFT", "IMPS", "RTGS", "IFT")),
    ("Cash", ("ATM", "CASH")),
    ("Charges", ("FEE", "CHG", "CHARGE", "GST")),
)
NOISE_WORDS = (
    "DR", "CR", "TO", "FROM", "P2A", "P2M", "P2P", "PAY", "PAYMENT", "TRF", "TRANSFER",
    "INB", "REV", "IMPS", "NEFT", "RTGS", "UPI", "POS", "ATM",
)
LEADING_CHANNEL = r"(?i)^(UPI|NEFT|IMPS|RTGS|POS|ATM)[-/\s]*"
LEADING_CHANNEL_WIDE = r"(?i)^(UPI|NEFT|IMPS|RTGS|POS|ATM|ECS|NACH|CHQ|CHEQUE)[\s\-/:]*"
THREE_LETTERS = r"\p{L}[^\p{L}]*+\p{L}[^\p{L}]*+\p{L}"
UNKNOWN_PARTY = "(unknown)"


def infer_channel(description: Column) -> Column:
    found = extract(description, rf"(?i)\b({'|'.join(CHANNEL_TOKENS)})\b")
    return F.coalesce(F.upper(found), F.lit("OTHER"))


def infer_category(description: Column) -> Column:
    upper = F.upper(description)
    return first_match(
        ((contains_any(upper, words), F.lit(label)) for label, words in CATEGORY_KEYWORDS),
        F.lit("Other"),
    )


def _head(description: Column) -> Column:
    """What stands before the first dash, slash or at sign, without channel and numbers; null if nothing does."""
    text = F.regexp_replace(description, LEADING_CHANNEL, "")
    text = F.regexp_replace(text, r"[-/]\d{6,}.*$", "")
    text = F.regexp_replace(text, r"-\d{4}-\d{10,}", "")
    head = strip(F.regexp_extract(strip(text), r"^[^-/@]*", 0))
    return null_if_empty(F.substring(head, 1, 50))


def infer_counterparty(description: Column) -> Column:
    return F.coalesce(_head(description), F.lit(UNKNOWN_PARTY))


def counterparty_from_description(description: Column) -> Column:
    """First narration segment that reads like a name, else ``infer_counterparty``."""
    text = F.regexp_replace(strip(description), LEADING_CHANNEL_WIDE, "")
    noise = rf"(?i)^(?:{'|'.join(NOISE_WORDS)})$"

    def reads_like_name(part: Column) -> Column:
        # Three letters at least and no more digits than letters; these are counted only if there are any.
        few = ~part.rlike(r"\p{Nd}") | (count_chars(part, r"\p{Nd}") <= count_chars(part, r"\p{L}"))
        return part.rlike(THREE_LETTERS) & few & ~strip(part).rlike(noise)

    def trimmed(given: Column) -> Column:
        part = strip(given)
        rest = null_if_empty(strip(F.regexp_replace(part, r"[-\s]+\d{6,}.*$", "")))
        return F.substring(F.coalesce(rest, part), 1, 80)

    parts = F.split(text, r"[/|]")
    # An array of at most one element holds the first name, so that it is looked for once.
    first = F.slice(F.filter(parts, reads_like_name), 1, 1)
    chosen = F.get(F.transform(first, trimmed), F.lit(0))
    # A head that says unknown is none; an array of one element, so that the head is cut out once.
    head = F.get(F.array_remove(F.array(_head(description)), UNKNOWN_PARTY), F.lit(0))
    return F.coalesce(chosen, head, null_if_empty(F.substring(description, 1, 60)), F.lit(UNKNOWN_PARTY))


def to_dr_cr(value: Column) -> Column:
    return (
        F.when(value.isin("Dr", "Cr"), value).when(value == "debit", F.lit("Dr")).otherwise("Cr")
    )


def to_debit_credit(value: Column) -> Column:
    return F.when(value == "Dr", F.lit("debit")).otherwise("credit")


def shape_transaction(date: Column, description: Column, amount: Column, kind: Column, balance: Column):
    """Columns of the wire row; the enrichment columns start out empty."""
    text = F.lit(None).cast("string")
    return [
        iso_date(date).alias("date"),
        amount.alias("amount"),
        to_debit_credit(kind).alias("direction"),
        description.alias("description"),
        counterparty_from_description(description).alias("counterparty"),
        infer_channel(description).alias("channel"),
        infer_category(description).alias("category"),
        balance.alias("balance_after"),
        text.alias("entity_type"),
        F.lit(None).cast("boolean").alias("is_self_transfer"),
        text.alias("notable_reason"),
        text.alias("card_last4"),
        text.alias("ref_number"),
        text.alias("counterparty_bank"),
    ]


def signed(amount: Column, direction: Column) -> Column:
    return F.when(direction == "Cr", amount).otherwise(-amount)


def needs_review(counterparty: Column) -> Column:
    return F.startswith(counterparty, F.lit("(unknown")) | (F.length(counterparty) < 3)


def confidence(counterparty: Column, channel: Column) -> Column:
    return (
        F.when(needs_review(counterparty), F.lit("low"))
        .when(channel == "OTHER", F.lit("medium"))
        .otherwise("high")
    )


def intake_flags(counterparty: Column, is_self_transfer: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(needs_review(counterparty), F.lit("NEEDS_REVIEW")),
            F.when(is_self_transfer, F.lit("SELF_TRANSFER")),
        )
    )


def prefer(given: Column, inferred: Column) -> Column:
    """A given value unless it is missing or blank; the given text is kept unchanged."""
    return F.when(F.length(strip(given)) > 0, given).otherwise(inferred)


def entities_map(
    channel: Column, counterparty: Column, category: Column, party_given: Column, level: Column
) -> Column:
    """Map of channel, counterparty and category with source and confidence."""

    def entry(value: Column, source: Column, score: Column) -> Column:
        return F.struct(
            value.alias("value"), source.alias("source"), score.cast("double").alias("confidence")
        )

    party_score = (
        F.when(party_given, F.lit(0.95))
        .when(level == "high", F.lit(0.9))
        .when(level == "medium", F.lit(0.5))
        .otherwise(F.lit(0.25))
    )
    return F.create_map(
        F.lit("channel"),
        entry(channel, F.lit("extracted"), F.when(channel != "OTHER", F.lit(1.0)).otherwise(F.lit(0.4))),
        F.lit("counterparty"),
        entry(counterparty, F.when(party_given, F.lit("llm_overlay")).otherwise("extracted"), party_score),
        F.lit("category"),
        entry(category, F.lit("auto_resolved"), F.lit(0.7)),
    )


def sparse_text(value: Column) -> Column:
    """Optional text column: trimmed, null when blank."""
    return blank_to_null(value)
