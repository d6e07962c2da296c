"""Month and quarter indices.

A month index is ``year*12 + month-1`` and a quarter index ``year*4 + quarter-1``,
so ``quarter = month // 3``.  Column helpers run inside whole-stage codegen; the
``*_of`` helpers are their driver-side twins for configuration values.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["month_index", "quarter_index", "quarter_of_month", "quarter_label", "quarter_year",
           "quarter_end", "quarter_of", "month_of", "label_of"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(date) -> Column:
    d = _col(date)
    return F.year(d) * 12 + F.month(d) - 1


def quarter_of_month(midx) -> Column:
    """Quarter index of a (non-negative) month index, as INT."""
    return F.floor(_col(midx) / 3).cast("int")


def quarter_index(date) -> Column:
    d = _col(date)
    return F.year(d) * 4 + F.quarter(d) - 1


def quarter_year(qidx) -> Column:
    return F.floor(_col(qidx) / 4).cast("int")


def quarter_label(qidx) -> Column:
    q = _col(qidx)
    return F.concat(quarter_year(q).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"))


def quarter_end(qidx) -> Column:
    q = _col(qidx)
    return F.last_day(F.make_date(quarter_year(q), (q % 4) * 3 + 3, F.lit(1)))


def quarter_of(label: str) -> int:
    """'2019Q4' -> 8079."""
    parts = re.fullmatch(r"(\d{4})Q([1-4])", str(label))
    if parts is None:
        raise ValueError(f"not a quarter label: {label!r}")
    return 4 * int(parts[1]) + int(parts[2]) - 1


def month_of(day) -> int:
    if isinstance(day, str):
        day = dt.date.fromisoformat(day)
    return 12 * day.year + day.month - 1


def label_of(qidx: int) -> str:
    return f"{qidx // 4}Q{qidx % 4 + 1}"
