"""Matching keys and keyword classes for counterparty names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.functions.logic import first_match
from casetrail.functions.text import contains_any

# Words without signal in counterparty names, and types without information.
STOP_WORDS = (
    "upi", "neft", "imps", "rtgs", "pos", "atm", "ecs", "nach", "cheque", "chq", "cash", "by",
    "to", "the", "ltd", "pvt", "services", "service", "india", "pay", "payment", "inr", "rs",
)
UNINFORMATIVE_TYPES = ("labeled", "other", "unknown", "")

# Keyword vocabulary of entity types, in matching order.
ENTITY_TYPE_KEYWORDS: Mapping[str, tuple[str, ...]] = {
    "merchant": (
        "amazon", "flipkart", "myntra", "meesho", "ajio", "nykaa", "swiggy", "zomato", "zepto",
        "blinkit", "dunzo", "bigbasket", "grofers", "jiomart", "bookmyshow", "paytm", "phonepe",
        "googlepay", "cred", "uber", "ola", "rapido", "redbus", "makemytrip", "goibibo", "oyo",
        "netflix", "hotstar", "jiocinema", "sonyliv", "prime", "reliance", "airtel", "jio", "bsnl",
        "vi ", "vodafone", "tata", "croma", "reliance digital",
    ),
    "bank": (
        "hdfc bank", "icici bank", "sbi", "state bank", "axis bank", "kotak", "idfc",
        "bank of baroda", "pnb", "punjab national", "yes bank", "indusind", "rbl",
        "bank of india", "canara bank",
    ),
    "government": (
        "income tax", "gst", "cgst", "sgst", "igst", "government", "govt of india",
        "reserve bank", "employee provident fund", "epfo", "esic", "passport", "rto",
        "municipal", "nagar nigam",
    ),
    "salary": ("salary", "sal credit", "sal-", "payroll"),
    "finance": (
        "cred", "bajaj finance", "bajaj finserv", "mahindra finance", "home loan", "car loan",
        "personal loan", "emi", "credit card", "cc payment", "stock", "zerodha", "groww",
        "upstox", "angel one", "mutual fund", "sip",
    ),
    "utility": (
        "electricity", "mseb", "bses", "tneb", "kseb", "water bill", "gas bill",
        "mahanagar gas", "indraprastha gas", "lpg", "hp gas", "bharat gas",
    ),
}


def canonical_key(name: Column) -> Column:
    """The three longest informative words, sorted; empty when none is left."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(
        words,
        lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w),
    )
    ranked = F.array_sort(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    longest = F.transform(F.slice(ranked, 1, 3), lambda s: s["w"])
    return F.coalesce(F.array_join(F.array_sort(longest), " "), F.lit(""))


def squeezed_key(key: Column) -> Column:
    """A canonical key without spaces, as compared by the substring merge."""
    return F.regexp_replace(F.coalesce(key, F.lit("")), " ", "")


def name_matches(name: Column, keywords: Iterable[str]) -> Column:
    return F.coalesce(contains_any(F.lower(name), keywords), F.lit(False))


def category_from_name(name: Column, vocabulary: Mapping[str, Iterable[str]]) -> Column:
    """First category with a keyword inside the name, else null."""
    return first_match(
        ((name_matches(name, words), F.lit(category)) for category, words in vocabulary.items()),
        F.lit(None).cast("string"),
    )


def resolve_type(
    entity_type: Column, name: Column, vocabulary: Mapping[str, Iterable[str]]
) -> Column:
    """Keep an informative type, else infer one from the name, else keep what was given."""
    informative = ~F.lower(entity_type).isin(*UNINFORMATIVE_TYPES)
    given = F.nullif(entity_type, F.lit(""))
    return F.when(informative, entity_type).otherwise(
        F.coalesce(category_from_name(name, vocabulary), given)
    )


def classify_type(name: Column) -> Column:
    return F.coalesce(category_from_name(name, ENTITY_TYPE_KEYWORDS), F.lit("counterparty"))


def person_key(name: Column) -> Column:
    """Lower-case words separated by single spaces, for person matching."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))
