"""Labels and weights shown next to amounts, edges and accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetrail.functions.logic import first_match

# Short bank names by keyword, in matching order.
SHORT_BANKS = (
    ("hdfc", "HDFC"), ("kotak", "Kotak"), ("icici", "ICICI"),
    ("idfc", "IDFC"), ("sbi", "SBI"), ("axis", "Axis"),
)


def rupees(amount: Column) -> Column:
    """Compact rupee text with Cr, L and k suffixes."""

    def text(divisor: int, digits: int, suffix: str) -> Column:
        scaled = F.round(amount.cast("decimal(38,10)") / F.lit(divisor), digits)
        return F.concat(F.lit("₹"), scaled.cast(f"decimal(38,{digits})").cast("string"), F.lit(suffix))

    return (
        F.when(amount >= 10_000_000, text(10_000_000, 1, "Cr"))
        .when(amount >= 100_000, text(100_000, 1, "L"))
        .when(amount >= 1_000, text(1_000, 0, "k"))
        .otherwise(text(1, 0, ""))
    )


def edge_weight(kind: Column, total: Column) -> Column:
    flow = F.least(
        F.lit(6.0), 1 + F.log10(F.greatest(F.lit(1.0), F.coalesce(total.cast("double"), F.lit(0.0))) / 1000)
    )
    return F.when(kind.isin("flow_in", "flow_out"), flow).otherwise(F.lit(1.0))


def short_bank_label(bank: Column, account_type: Column) -> Column:
    lower = F.lower(bank)
    short = first_match(
        ((F.contains(lower, F.lit(keyword)), F.lit(label)) for keyword, label in SHORT_BANKS),
        F.get(F.split(bank, " "), F.lit(0)),
    )
    return F.concat(short, F.lit(" "), account_type)


def node_sublabel(node_type: Column, size: Column, pan: Column) -> Column:
    def counted(word: str) -> Column:
        return F.concat(
            size.cast("string"), F.lit(f" {word}"), F.when(size == 1, F.lit("")).otherwise("s")
        )

    pan_text = F.when(F.length(pan) > 0, F.concat(F.lit("PAN "), pan))
    return F.when(
        node_type == "person", F.concat_ws(" · ", counted("account"), pan_text)
    ).otherwise(counted("txn"))
