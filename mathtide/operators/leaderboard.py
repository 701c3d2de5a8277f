"""Leaderboard operators (C4, C5, E5, E6, F4, D2) and the K6 composite."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathtide.functions import leaderboard as L
from mathtide.operators.ranking import global_rank

# The ten colours of the categorical 'tab10' palette, in order;
# families beyond ten reuse them cyclically.
TAB10 = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd",
         "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"]

SIZE = "Size (in Billion)"


def prepare(raw: DataFrame, metric: str = "MATH Performance", key: str = "row_key") -> DataFrame:
    """Typed columns next to the raw CSV strings."""
    size = L.coerce_numeric(F.col(f"`{SIZE}`"))
    return raw.select(
        key, "Name", "Family",
        L.published_date("Published").alias("Date"),
        size.alias("size"),
        L.has_value(size).alias("has_size"),
        L.size_normalised(size).alias("size_normalised"),
        L.coerce_numeric(F.col(f"`{metric}`")).alias("score"),
        L.point_label(F.col("Name"), size).alias("label"))


def zoom(df: DataFrame, start: dt.date = dt.date(2024, 1, 1), min_score: float = 40) -> DataFrame:
    """C4: date >= start and score >= min (nulls fail both)."""
    return df.where((F.col("Date") >= F.lit(start)) & (F.col("score") >= F.lit(min_score)))


def axis_bounds(zoomed: DataFrame, min_score: float = 40, days: int = 15, pad: float = 2) -> DataFrame:
    """E5: date range padded by ``days``; score from threshold - pad to max + pad."""
    return zoomed.agg(F.date_sub(F.min("Date"), days).alias("min_date"),
                      F.date_add(F.max("Date"), days).alias("max_date"),
                      F.lit(float(min_score - pad)).alias("min_score"),
                      (F.max("score") + F.lit(float(pad))).alias("max_score"),
                      F.count(F.lit(1)).alias("n_points"))


def family_palette(df: DataFrame, key: str = "row_key") -> DataFrame:
    """E6 + F4: families in first-appearance order (date, then key), index and colour.

    The family table has one row per family; its order index comes from the
    slice-ranking helper, not from a window over one partition.
    """
    first = df.groupBy("Family").agg(F.min(F.struct("Date", key)).alias("__first"))
    first = first.select("Family", F.col("__first.Date").alias("first_date"),
                         F.col(f"__first.{key}").alias("first_key"))
    ranked = global_rank(first, ["first_date", "first_key"], "family_idx")
    colours = F.array(*[F.lit(c) for c in TAB10])
    return ranked.withColumn("colour", F.element_at(colours, (F.col("family_idx") % len(TAB10) + 1).cast("int")))


def with_colours(df: DataFrame, palette: DataFrame) -> DataFrame:
    """Family -> index/colour lookup (equi-join; the planner broadcasts a small table)."""
    return df.join(palette.select("Family", "family_idx", "colour"), on="Family", how="left")


def leaderboard(raw: DataFrame, metric: str = "MATH Performance", start: dt.date = dt.date(2024, 1, 1),
                min_score: float = 40, box_high: float = 80, key: str = "row_key") -> DataFrame:
    """K6: typed rows, zoom filter, highlight flag, family colours, sorted by date.

    Colours are assigned over *all* rows so a family keeps its colour in the
    zoomed view.  An empty zoom gives an empty frame (Q12).
    """
    typed = prepare(raw, metric, key)
    palette = family_palette(typed, key)
    zoomed = zoom(typed, start, min_score).withColumn(
        "in_box", L.in_box(F.col("Date"), F.col("score"), min_score, box_high))
    return with_colours(zoomed, palette).orderBy("Date", key)


def split_by_size(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known size and rows without."""
    return typed.where(F.col("has_size")), typed.where(~F.col("has_size"))
