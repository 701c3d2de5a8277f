"""Leaderboard column functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from mathtide.functions.text import col_of

# Text pandas.to_numeric accepts: optional sign, digits with an optional
# fraction, optional exponent, surrounding spaces.  Guarding with a pattern
# keeps Spark's wider cast ('1d', '1_0') from accepting more.
NUMERIC_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def coerce_numeric(c) -> Column:
    """Text -> double, unparseable -> null (NaN in the reference)."""
    t = col_of(c).cast("string")
    return F.when(t.rlike(NUMERIC_TEXT), F.trim(t).try_cast("double"))


def has_value(c) -> Column:
    """Known-value flag."""
    return col_of(c).isNotNull()


def size_normalised(size) -> Column:
    """I16: log10(size) * 200 when the size is known, else 100."""
    s = col_of(size)
    return F.when(s.isNotNull(), F.log10(s) * 200).otherwise(F.lit(100.0))


def published_date(c) -> Column:
    """I17: 'yy-Mon' -> first day of that month (null when it does not parse).

    Two-digit years map to 2000-2099 (Python maps 69-99 to the 1900s).
    """
    return F.to_date(F.try_to_timestamp(F.concat(col_of(c), F.lit("-01")), F.lit("yy-MMM-dd")))


def point_label(name, size) -> Column:
    """I18: 'Name (intB)' with the size truncated, or 'Name'."""
    s = col_of(size)
    return F.when(s.isNotNull(), F.concat(col_of(name), F.lit(" ("), s.cast("long").cast("string"),
                                          F.lit("B)"))).otherwise(col_of(name))


def in_box(date, score, low: float, high: float,
           start: dt.date = dt.date(2024, 1, 1), end: dt.date = dt.date(2025, 3, 1)) -> Column:
    """Date within [start, end] and score within [low, high]."""
    d, s = col_of(date), col_of(score)
    return F.coalesce(d.between(F.lit(start), F.lit(end)) & s.between(F.lit(low), F.lit(high)),
                      F.lit(False))
