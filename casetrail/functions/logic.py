"""Ordered rule lists as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(cases: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """Value of the first case whose condition holds."""
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return otherwise if chain is None else chain.otherwise(otherwise)
