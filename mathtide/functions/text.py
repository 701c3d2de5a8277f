"""General string helpers shared by the record shapers and answer rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes by default
# (str.isspace() is true for exactly these code points).  Spark's trim only
# removes spaces, so btrim is given this set explicitly.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def self_overlaps(delimiter: str) -> bool:
    """True when two occurrences of ``delimiter`` can overlap (e.g. '####')."""
    return any(delimiter[i:] == delimiter[:len(delimiter) - i] for i in range(1, len(delimiter)))


def piece(c, delimiter: str, index: int) -> Column:
    """Python ``text.split(delimiter)[index]``; null where the piece is absent.

    ``index`` is 0-based, negative counts from the end.  The delimiter is a
    literal string, not a pattern.  The first piece, and the last one for a
    delimiter that cannot overlap itself, are cut with ``substring_index``
    (no array is built); other pieces come from a split.
    """
    t = col_of(c)
    if index == 0:
        return F.substring_index(t, delimiter, 1)
    if index == -1 and not self_overlaps(delimiter):
        return F.substring_index(t, delimiter, -1)
    parts = F.split(t, F.lit(_quote(delimiter)))
    if index >= 0:
        return F.get(parts, index)
    return F.try_element_at(parts, F.lit(index))


def _quote(literal: str) -> str:
    """Java-regex quoting of a literal delimiter for ``split``."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_regex(literal: str) -> str:
    return _quote(literal)


def excerpt(c, limit: int = 500, head: int = 250, tail: int = 250) -> Column:
    """Long text shown as its first ``head`` and last ``tail`` characters."""
    t = col_of(c)
    return F.when(F.length(t) > limit,
                  F.concat(F.substring(t, 1, head), F.lit("...\n..."),
                           F.substring(t, -tail, tail))).otherwise(t)
