"""Column predicates and small scalar rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import _col

__all__ = ["blank_to_null", "nonblank", "group3", "period_overlap", "first_reason",
           "any_null", "same_different_unknown", "validate_identifier", "distinct_from",
           "title_status", "array_minus"]


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def nonblank(c) -> Column:
    """True when the text holds a character that is not white space."""
    return _col(c).rlike(r"\S")


def distinct_from(a, b) -> Column:
    return ~_col(a).eqNullSafe(_col(b))


def group3(category, home, home_label="Home", missing_label="Missing", other_label="Other") -> Column:
    c = _col(category)
    return (F.when(c.isNull(), F.lit(missing_label))
             .when(c == F.lit(home), F.lit(home_label))
             .otherwise(F.lit(other_label)))


def period_overlap(start, end, lo, hi) -> Column:
    """Spell [start, end] (NULL end = open) touches [lo, hi]; both sides push to the scan."""
    return (_col(start) <= hi) & (_col(end).isNull() | (_col(end) >= lo))


def first_reason(rules) -> Column:
    """First matching ``(condition, label)``; NULL when none matches."""
    picks = [F.when(cond, F.lit(label)) for cond, label in rules]
    return F.coalesce(*picks)


def any_null(cols) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).isNull() for c in cols])


def same_different_unknown(a, b) -> Column:
    return F.coalesce(F.when(_col(a) == _col(b), "same").when(_col(a) != _col(b), "different"),
                      F.lit("unknown"))


def title_status(raw_key_present, raw_key_conflicting, same_person, title) -> Column:
    """Why a joined title may or may not be used."""
    return (F.when(raw_key_conflicting, "conflicting_raw_key")
             .when(~raw_key_present, "no_raw_row")
             .when(~same_person, "raw_user_mismatch")
             .when(blank_to_null(title).isNull(), "blank_title")
             .otherwise("ok"))


def array_minus(values, one) -> Column:
    """Sorted array without NULLs and without ``one`` (which may be NULL)."""
    return F.array_sort(F.array_except(F.coalesce(values, F.array().cast("array<string>")),
                                       F.array(_col(one))))


def validate_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain column or table name: {name!r}")
    return name
