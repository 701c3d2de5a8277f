"""Row filters (C1-C3, C5, C6).  All but C3 are plain predicates Catalyst can push
towards the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathtide.functions.text import col_of


def not_from_sources(source, prefixes: Sequence[str]) -> Column:
    """C1 predicate: source starts with none of ``prefixes``; null source -> rejected."""
    s = col_of(source)
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | s.startswith(p)
    return s.isNotNull() & ~hit


def exclude_sources(df: DataFrame, prefixes: Sequence[str], source: str = "source") -> DataFrame:
    """Drop rows whose source starts with any prefix (e.g. 'data/PoT/')."""
    return df.where(not_from_sources(source, prefixes))


def has_required(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where every named field is present."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def drop_unparseable(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Drop rows whose formatter gave null, and report how many.

    Returns (kept rows, one-row counts ``seen`` / ``dropped``).  The counts are
    their own partial aggregate rather than an ``observe`` metric, which would
    count twice wherever the plan is evaluated more than once (a range
    partitioner samples its input in a separate pass).

    A row number keeps the filter above the formatter's projections: pushed below
    them, it would hold every piece of the text anew for each of its uses.
    """
    counts = df.agg(F.count(F.lit(1)).alias("seen"),
                    F.sum(F.when(F.col(col).isNull(), 1).otherwise(0)).cast("long").alias("dropped"))
    kept = df.withColumn("__row", F.monotonically_increasing_id()).where(F.col(col).isNotNull() & (F.col("__row") >= 0))
    return kept.drop("__row"), counts


def every_k_steps(df: DataFrame, step: str = "step", k: int = 10, positive: bool = False) -> DataFrame:
    """Step % k = 0 (and step > 0 for saves)."""
    cond = (F.col(step) % k) == 0
    if positive:
        cond = cond & (F.col(step) > 0)
    return df.where(cond)
