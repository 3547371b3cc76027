"""Membership, factor and text helpers with the missing-value rules of the analysis scripts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c, values: Iterable) -> Column:
    """Membership that is false (never NULL) for a missing value; an empty set holds nothing."""
    values = list(values)
    if not values:
        return F.lit(False)
    return F.coalesce(as_col(c).isin(values), F.lit(False))


def not_in(c, values: Iterable) -> Column:
    """Anti-membership; a missing value is kept."""
    return ~is_in(c, values)


def paste(*cols, sep: str = "_") -> Column:
    """Join texts; a missing part is written as ``NA`` instead of vanishing."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def factor(c, levels: Iterable) -> Column:
    """Keep listed values, turn every other one into NULL."""
    c = as_col(c)
    return F.when(is_in(c, levels), c)


def level_ordinal(c, levels: Iterable) -> Column:
    """1-based place of a value in an explicit level list, NULL when it is not listed."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.nullif(place, F.lit(0)).cast("int")
