"""Leaderboard functions and composite on the FIXTURES rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from mathtide.operators import leaderboard as LB

COLS = ["row_key", "Name", "Family", "Published", "Size (in Billion)", "GSM8K Performance", "MATH Performance"]
ROWS = [
    (1, "m1", "F1", "24-Jan", "7", "79", "40"),        # known size, thresholds, date exactly 2024-01-01
    (2, "m2", "F2", "23-Dec", "", "75", "70"),          # empty size, before the start date
    (3, "m3", "F1", "24-Mar", "unknown", "70", "39.9"),  # unknown size, just under 40
    (4, "m4", "F3", "25-Feb", "0.5", "40", ""),         # size below 1, null score
    (5, "m5", "F2", "24-Jun", "13.9", "90", "80"),      # truncated label, box top
]


def _raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"`{c}` {'long' if c == 'row_key' else 'string'}" for c in COLS))


def test_typed_columns(spark):
    typed = {r.row_key: r for r in LB.prepare(_raw(spark)).collect()}
    assert typed[1].size == 7.0 and typed[1].has_size and typed[1].Date == dt.date(2024, 1, 1)
    assert typed[2].size is None and not typed[2].has_size and typed[2].size_normalised == 100.0
    assert typed[3].size is None and typed[3].label == "m3"
    assert math.isclose(typed[4].size_normalised, math.log10(0.5) * 200) and typed[4].size_normalised < 0
    assert typed[4].score is None
    assert typed[5].label == "m5 (13B)"


def test_zoom_palette_and_axis(spark):
    out = LB.leaderboard(_raw(spark), "MATH Performance", min_score=40, box_high=80)
    rows = {r.row_key: r for r in out.collect()}
    assert sorted(rows) == [1, 5]                    # >= 40 on or after 2024-01-01; nulls fail
    assert rows[1].in_box and rows[5].in_box         # 40 and 80 are inside the box
    palette = {r.Family: (r.family_idx, r.colour) for r in LB.family_palette(LB.prepare(_raw(spark))).collect()}
    assert palette == {"F2": (0, "#1f77b4"), "F1": (1, "#ff7f0e"), "F3": (2, "#2ca02c")}
    axis = LB.axis_bounds(LB.zoom(LB.prepare(_raw(spark)))).first()
    assert (axis.min_date, axis.max_date) == (dt.date(2023, 12, 17), dt.date(2024, 6, 16))
    assert (axis.min_score, axis.max_score, axis.n_points) == (38.0, 82.0, 2)


def test_gsm8k_thresholds_and_empty(spark):
    typed = LB.prepare(_raw(spark), "GSM8K Performance")
    for low, n in [(40, 4), (70, 3), (75, 2), (79, 2), (101, 0)]:
        assert LB.zoom(typed, min_score=low).count() == n
    assert LB.leaderboard(_raw(spark), "GSM8K Performance", min_score=101).isEmpty()
    with_size, without = LB.split_by_size(typed)
    assert (with_size.count(), without.count()) == (3, 2)
    assert typed.where(F.col("Date") >= F.lit("2022-01-01").cast("date")).count() == 5
