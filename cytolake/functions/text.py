"""Name parsing: sample from cell name, feature-set patterns, composite keys."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .nulls import as_col


def before_first(c, separator: str) -> Column:
    """Text up to the first ``separator``; the whole text where there is none."""
    return F.regexp_replace(as_col(c), f"(?s){re.escape(separator)}.*", "")


def name_matches(c, patterns: str | Sequence[str], first_only: bool = False) -> Column:
    """Unanchored, case-sensitive match of any pattern.

    ``first_only`` looks at the first pattern alone, as a single-pattern matcher given a list does.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    if first_only:
        patterns = patterns[:1]
    c = as_col(c)
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def split_key(c, names: Sequence[str], sep: str = "_") -> list[Column]:
    """Columns of a composite key; parts that are not there are NULL."""
    parts = F.split(as_col(c), re.escape(sep))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def mangle_name(c) -> Column:
    """Column-name checking of text readers: every other character than letter, digit, ``.``, ``_``
    becomes ``.``; a leading digit gets an ``X``."""
    cleaned = F.regexp_replace(as_col(c), r"[^A-Za-z0-9._]", ".")
    return F.when(cleaned.rlike(r"^([0-9_]|\.[0-9])"), F.concat(F.lit("X"), cleaned)).otherwise(cleaned)
