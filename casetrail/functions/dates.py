"""Dates and amounts as they are printed on statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.functions.text import strip

# Accepted layouts, in the order in which they are tried.
PRINTED_LAYOUTS = ("d/M/yyyy", "d/M/yy", "d-M-yyyy", "d-M-yy", "d MMM yy", "d MMM yyyy")
HEADER_LAYOUTS = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")


def _parse(raw: Column, layout: str) -> Column:
    # A layout that cannot fit is not tried: a failed parse costs an exception.
    separator = "/" if "/" in layout else "-" if "-" in layout else " "
    fits = F.contains(raw, F.lit(separator))
    if "yyyy" in layout:
        return F.when(fits & raw.rlike("[0-9]{4}$"), F.try_to_date(raw, layout))
    day = F.try_to_date(raw, layout)
    # Two-digit years 69-99 belong to the twentieth century.
    early = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return F.when(fits & ~raw.rlike("[0-9]{3}$"), early)


def parse_first(raw: Column, layouts: Sequence[str]) -> Column:
    return F.coalesce(*[_parse(raw, layout) for layout in layouts])


def clean_amount(raw: Column) -> Column:
    """``1,234.50`` as DECIMAL(18,2)."""
    return strip(F.replace(raw, F.lit(","), F.lit(""))).try_cast("decimal(18,2)")


def normalize_date(raw: Column) -> Column:
    """Any printed layout as DD/MM/YYYY; other text stays as it is."""
    text = F.regexp_replace(strip(raw), r"\s+", " ")
    return F.coalesce(F.date_format(parse_first(text, PRINTED_LAYOUTS), "dd/MM/yyyy"), text)


def header_iso_date(raw: Column) -> Column:
    """Header date as ISO text; other text stays as it is."""
    return F.coalesce(F.date_format(parse_first(raw, HEADER_LAYOUTS), "yyyy-MM-dd"), raw)


def iso_date(raw: Column) -> Column:
    """DD/MM/YYYY as ISO text; other text stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(raw, "d/M/yyyy"), "yyyy-MM-dd"), raw)


def parse_moment(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e12) or ISO text as a UTC timestamp."""
    text = value.cast("string")
    is_number = text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    number = F.when(is_number, strip(text).try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    in_range = F.abs(seconds) < 1e11
    from_number = F.when(in_range, F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")))
    is_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d.*)?$")
    zoned = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    has_time = text.rlike(r"[ T]\d")
    iso = F.when(
        is_iso, F.when(has_time, zoned).otherwise(text).try_cast("timestamp")
    )
    return F.coalesce(from_number, iso)
